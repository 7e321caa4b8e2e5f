"""fundflow: campaign-finance analytics on Spark DataFrames.

Layout
------
functions/  column-expression helpers (name rules, ratios, money formats, labels)
sources/    landed paged JSON, source predicates, date window, test-data binding
operators/  validation + quarantine, de-duplication, accumulation, merge, hierarchy
plans/      derived tables (summaries), list / lookup queries, refresh, batch jobs
streaming/  incremental micro-batch ingest (Structured Streaming, foreachBatch)
oracle/     independent SQL for the correctness check (DuckDB dialect)
"""

__all__ = ["session"]
