"""Training-data operators for large corpora (dedup, filtering, scoring, mixing, token output).

Nothing else in the library imports this subpackage. Every operator takes and returns
DataFrames; Python runs only inside tasks, on Arrow batches that Spark partitions.
"""
