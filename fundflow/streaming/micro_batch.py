"""Incremental ingest: landed page files -> page-1 rule -> validate -> de-duplicate -> merge, per micro-batch.

Page 1 of a fetch decides whether its other pages count, and it may land after them. A stateful
stream operator joins pages with what page 1 says (``page_one_join``): pages wait in the state store
until page 1 of their fetch has come and tells of more pages, so the same pages count in every
landing order, and they are the ones that count in a batch reading (``sources.paged_json``).

What counts goes through the same transform, parent check and merge as the batch job inside
``foreachBatch``. The stored table keeps the arrival number ``_seq`` of (fetch, page, pos) of each
row as a version column and a row is replaced only by a newer one, so

* a batch replayed after a failure (same epoch, same files) changes nothing; its rejects replace
  those of the first try in the quarantine log,
* batches that arrive out of order still converge to "last arrival wins", and
* a later fetch replaces an earlier one wherever its pages put a record.

When the landing folder is drained the derived rows of the cycles that changed are rebuilt.

``trigger(availableNow=True)`` drains what has landed and stops, which is how a
scheduled incremental run uses it; the same code runs continuously with a
processing-time trigger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fundflow.operators.quality import SEQ
from fundflow.plans.jobs import SPENDING_ENTITIES, EntityResult, ingest_entity, refresh_changed
from fundflow.plans.refresh import TableStore
from fundflow.session import discard, new_location
from fundflow.sources.paged_json import PAGINATION, envelope_schema, records_of

#: State groups that the pages of one fetch are dealt to. Fixed for the life of a checkpoint.
BUCKETS = 32
#: Pages that leave the state in one piece.
RELEASED = 256
#: Micro-batches that a known backlog is drained in at most: each merge writes the stored table anew.
MOST_BATCHES = 8
SHUFFLE = "spark.sql.shuffle.partitions"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class StreamResult:
    batches: int = 0
    inserted: int = 0
    updated: int = 0
    errors: int = 0
    refreshed: bool = False


def _page_one() -> StatefulProcessor:
    class PageOne(StatefulProcessor):  # a local class: workers get it by value
        """Of one share of a fetch's pages: what page 1 says, and the pages that don't count (yet)."""

        def init(self, handle) -> None:
            self.facts = handle.getValueState("facts", "p1_rows int, p1_pages int")
            self.waiting = handle.getListState("waiting", "value string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            known = self.facts.get() if self.facts.exists() else (-1, -1)
            first = known
            for frame in rows:
                told = frame[frame["fact"]]
                if len(told):  # a page 1 that lands again may tell more, never less
                    known = (max(known[0], int(told["p1_rows"].max())), max(known[1], int(told["p1_pages"].max())))
                pages = frame.loc[~frame["fact"], "value"].tolist()
                if pages and known[0] > 0 and known[1] > 1:
                    yield pd.DataFrame({"value": pd.Series(pages, dtype=object)})
                elif pages:
                    self.waiting.appendList([(v,) for v in pages])
            if known != first:
                self.facts.update(known)
            if known[0] > 0 and known[1] > 1 and self.waiting.exists():
                piece = []
                for (value,) in self.waiting.get():
                    piece.append(value)
                    if len(piece) == RELEASED:
                        yield pd.DataFrame({"value": pd.Series(piece, dtype=object)})
                        piece = []
                if piece:
                    yield pd.DataFrame({"value": pd.Series(piece, dtype=object)})
                self.waiting.clear()

        def close(self) -> None:
            pass

    return PageOne()


def page_one_join(lines: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of a stream of landed lines those that count, once it is known that they do.

    Page 1 always counts. The other pages of a fetch are dealt to ``buckets`` groups by their number, so
    that a large fetch is no hot group, and what page 1 says goes to all of them. Lines that name
    no endpoint are left out, as they are in a batch reading.
    """
    header = T.StructType([T.StructField("endpoint", T.StringType()), T.StructField("fetch", T.LongType()),
                           T.StructField("results", T.ArrayType(T.StringType())), T.StructField("pagination", PAGINATION)])
    h, page = F.from_json("value", header), F.col("h.pagination.page")
    seen = lines.select("value", h.alias("h")).where("h.endpoint is not null").select(
        "value", "h.endpoint", F.coalesce("h.fetch", F.lit(0)).alias("fetch"), F.coalesce(page == 1, F.lit(False)).alias("fact"),
        F.when(page == 1, F.size(F.coalesce("h.results", F.array()))).otherwise(-1).alias("p1_rows"),
        F.coalesce(F.when(page == 1, F.col("h.pagination.pages")), F.lit(-1)).alias("p1_pages"),
        F.pmod(F.coalesce(page, F.lit(0)), F.lit(buckets)).alias("bucket"))
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    told = seen.withColumn("bucket", F.explode(F.when(F.col("fact"), everywhere).otherwise(F.array("bucket"))))
    told = told.withColumn("value", F.when(~F.col("fact"), F.col("value")).otherwise(""))
    others = told.groupBy("endpoint", "fetch", "bucket").transformWithStateInPandas(_page_one(), "value string", "Append", "None")
    return seen.where("fact").select("value").unionByName(others)


def merge_batch(store: TableStore, entity: str, envelopes: DataFrame, record: T.StructType, run_ts: str,
                run: str | None = None) -> EntityResult:
    """One micro-batch of envelopes that count: transform, parent check, versioned merge."""
    return ingest_entity(store, entity, records_of(envelopes, record), run_ts, version=SEQ, run=run)


def batch_files(waiting: int, least: int, most_batches: int = MOST_BATCHES) -> int:
    """Files of a micro-batch when ``waiting`` files have landed: ``least``, or more so that a backlog of any size is
    drained in a bounded number of micro-batches (and writes the stored table as often)."""
    return max(least, -(-waiting // most_batches))


def state_partitions(spark: SparkSession, buckets: int = BUCKETS) -> int:
    """Partitions of the stream's state, each a store and a Python worker in every micro-batch: no more than a fetch
    has groups or the cluster has cores. Spark keeps the number with the checkpoint."""
    return max(1, min(int(spark.conf.get(SHUFFLE)), buckets, spark.sparkContext.defaultParallelism))


def run_incremental(spark: SparkSession, store: TableStore, landing: str, record: T.StructType,
                    entity: str, run_ts: str, files_per_batch: int = 1,
                    checkpoint: str | None = None, strict: bool = False, buckets: int = BUCKETS) -> StreamResult:
    """Drain the landing folder in micro-batches, then refresh the derived tables if they may have changed."""
    out = StreamResult()
    checkpoint = checkpoint or new_location(spark, f"stream_ckpt_{entity}")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def handle(batch: DataFrame, epoch: int) -> None:
        # what the state released is written once: running the stateful plan again for each job would change its state again
        path = f"{store.root}/released/{name}/{epoch}"
        batch.write.mode("overwrite").parquet(path)
        lines = spark.read.schema("value string").parquet(path)
        envelopes = lines.select(F.from_json("value", envelope_schema(record, strict)).alias("e")).select("e.*")
        r = merge_batch(store, entity, envelopes, record, run_ts, run=f"{name}-{epoch}")
        discard(spark, path)
        out.batches += 1
        out.errors += r.errors
        out.inserted += (r.stats or {}).get("inserted", 0)
        out.updated += (r.stats or {}).get("updated", 0)

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)
    before = {k: spark.conf.get(k) for k in (STATE_STORE, SHUFFLE)}
    spark.conf.set(STATE_STORE, ROCKSDB)  # the store that keeps lists; the query holds on to both settings
    spark.conf.set(SHUFFLE, state_partitions(spark, buckets))
    try:
        q = (page_one_join(lines, buckets).writeStream.foreachBatch(handle)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    q.awaitTermination()
    if entity in SPENDING_ENTITIES and out.inserted + out.updated:
        refresh_changed(store)
        out.refreshed = True
    return out
