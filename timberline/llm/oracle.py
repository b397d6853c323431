"""DuckDB equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"

#: Quality rules: words and 5-word windows by position, lines by distinct text.
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(cov.n, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
        strlen(regexp_replace(text, '[^A-Za-z]', '', 'g')) + length(regexp_replace(text, '[\x00-\x{{BF}}]', '', 'g')) AS n_letters,
        strlen(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_letters < 5 * word_chars THEN 64 ELSE 0 END
        + CASE WHEN 100 * n_stutter > 30 * n_words THEN 128 ELSE 0 END
        + CASE WHEN n_words >= 10 AND 10 * n_upper > 7 * n_letters THEN 256 ELSE 0 END AS fail_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

#: Windows of benchmark items against windows of documents, as joined words.
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM items),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, dp.i, dp.n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM dp) dp JOIN items USING (n, s)),
places AS (SELECT DISTINCT doc_id, i, n FROM hits),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM places) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Weighted fair queueing with whole-number finish times; ties are taken together.
MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS size,
             md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 150 / 100.0 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, rank, weight, source_size, least(2 * source_size, weight * coalesce(min(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER (), 1e18)) AS target FROM l),
q AS (SELECT d.*, t.rank, t.weight, t.source_size, t.target, sum(size) OVER (PARTITION BY t.rank ORDER BY k, doc_id, size) AS run
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, (run + e * source_size) * (10 // weight) AS finish FROM q, range(2) AS x(e)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, k, doc_id, size) AS used FROM c)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(sum(CASE WHEN used * 100 <= 150 * (SELECT sum(size) FROM d) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target
"""

#: 13-word windows as joined words; the first document of each keeps it.
SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM pos),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, range(13) AS r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Fill-in-the-middle: cuts by code points of the text, the parts joined again from the output's form.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
             sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1, n - b) AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""

#: Collocations: all n-grams of the pieces, scored over all cuts in 128-bit numbers.
COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
runs AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:], w[4:], w[5:])) AS x FROM w),
at1 AS (SELECT lang, x[1] AS p1, x[1] || ' ' || x[2] AS p2, x[1] || ' ' || x[2] || ' ' || x[3] AS p3,
          x[1] || ' ' || x[2] || ' ' || x[3] || ' ' || x[4] AS p4, x[1] || ' ' || x[2] || ' ' || x[3] || ' ' || x[4] || ' ' || x[5] AS p5 FROM runs),
grams AS (SELECT lang, 1 AS k, p1 AS phrase FROM at1 UNION ALL SELECT lang, 2, p2 FROM at1 UNION ALL SELECT lang, 3, p3 FROM at1
          UNION ALL SELECT lang, 4, p4 FROM at1 UNION ALL SELECT lang, 5, p5 FROM at1),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f, [lang, phrase] AS key FROM grams WHERE phrase IS NOT NULL GROUP BY lang, phrase, k),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k >= 2 AND f >= 100),
inner_parts AS (SELECT lang, a AS longer, array_to_string(list_slice(p, s, s + m - 1), ' ') AS phrase
  FROM c, range(1, 5) AS y(s), range(2, 5) AS z(m) WHERE m < k AND s + m - 1 <= k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 100 * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
parts AS MATERIALIZED (SELECT *, [lang, array_to_string(list_slice(p, 1, cut), ' ')] AS head, [lang, array_to_string(list_slice(p, cut + 1, k), ' ')] AS tail FROM cuts),
scored AS (SELECT parts.lang, parts.phrase, a, fl.f AS l, fr.f AS r, n, cut,
             CAST(1000 * a::HUGEINT * n::HUGEINT // (fl.f::HUGEINT * fr.f::HUGEINT) AS BIGINT) AS score
           FROM parts JOIN f fl ON fl.key = head JOIN f fr ON fr.key = tail
           JOIN n ON n.lang = parts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING,
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op6_source_mixing": MIXING,
    "op10_quality_rules": QUALITY,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op13_collocations": COLLOCATIONS,
}
