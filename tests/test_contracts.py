"""Commands within the contract's bounds: out of range is an error, never clamped."""

import datetime as dt

import pytest

from timberline import fixtures as fx
from timberline.operators import alerts, report, vectors
from timberline.params import ChatParams, IndexParams, IngestParams, ReportParams
from timberline.sources.registry import LogSource, ingest_journal

SF = "/root/testdata/sf0.001"
DAY = 86400


@pytest.mark.parametrize("make", [lambda: ReportParams(since=366 * DAY), lambda: ReportParams(fmt="pdf"), lambda: ChatParams(since=31 * DAY),
                                  lambda: ChatParams(context_size=51), lambda: ChatParams(context_size=0), lambda: IngestParams(since=0),
                                  lambda: IngestParams(since=31 * DAY), lambda: IngestParams(limit=100_001), lambda: IngestParams(limit=True)])
def test_out_of_range(make):
    with pytest.raises(ValueError):
        make()


def test_report_formats(spark):
    logs, metrics = fx.logs(spark, SF), fx.metrics(spark, SF)
    found = alerts.store_alerts(alerts.threshold_alerts(metrics))
    made = {f: report.generate(logs, metrics, found, fx.AS_OF, ReportParams(since=30 * DAY, fmt=f)).first()[-1] for f in ("text", "html", "json")}
    assert made["html"].lstrip().startswith("<") and made["json"].startswith("{") and "<" not in made["text"][:20]


def test_chat_context_holds_the_size_asked_for(spark):
    logs = fx.logs(spark, SF)
    vec, _ = vectors.index_logs(logs, fx.index_ledger(spark, SF).limit(0), fx.AS_OF, IndexParams(since=30 * DAY))
    row = vectors.chat_context(vec, logs, "error by user 1", fx.AS_OF, ChatParams(since=30 * DAY, context_size=3)).first()
    assert row.n_logs == 3 and row.context.count("\n") == 3


def test_ingest_journal(spark, tmp_path):
    base = int(dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc).timestamp())
    (tmp_path / "j.log").write_text("".join(f'{{"__REALTIME_TIMESTAMP": "{(base + i) * 10**6}", "__CURSOR": "c{i}", "_SYSTEMD_UNIT": "{u}", "MESSAGE": "m{i}"}}\n'
                                            for i, u in enumerate(["a", "b", "systemd-x", "a"])))
    source = LogSource("j", "journald", config={"paths": [str(tmp_path / "j.log")], "by_position": True})
    run = lambda **kw: ingest_journal(spark, source, str(tmp_path / "t"), str(tmp_path / "s"), "2024-01-10 12:30:00", IngestParams(**kw))
    assert run(exclude_units=("systemd-*",), limit=2) == (3, 2)
    assert run(exclude_units=("systemd-*",), limit=2) == (1, 1)
