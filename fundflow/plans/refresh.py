"""Versioned tables and the derived-table refresh chain.

A table is a catalog entry (``<db>.<name>``) that points at parquet under the cluster's
shared folder. Nothing that is published is ever changed in place; a write goes to a
fresh folder and becomes visible when the catalog entry is altered, so readers see the
state before or after it, and a write that fails half-way leaves nothing behind but an
unreferenced folder.

* A table without a cycle is written whole and published with ``ALTER TABLE ... SET LOCATION``.
* A table with a cycle is partitioned by it in the catalog, and each partition has its own
  location. A write covers some cycles: it reads and rewrites those only, and each is
  published with ``ALTER TABLE ... PARTITION ... SET LOCATION`` (new ones together). Cycles
  don't depend on each other, so a run that dies between two of them is simply run again.
* Logs (quarantine, pages held back) have one folder for each writer and run, so writers never share
  a folder and a run that is repeated replaces its own rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.plans import marts
from fundflow.session import discard, shared_dir

DB = "fundflow"
#: Folders that the write before the last one replaced, and cycles whose derived rows are to be rebuilt.
OLD, STALE = "fundflow.old", "fundflow.stale"
#: Election cycles that one write may touch; each is a folder.
MOST_CYCLES = 1000


class UniqueKeyError(RuntimeError):
    pass


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys present more than once (must be empty for a keyed table)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def key_report(df: DataFrame, key: list[str], table: str) -> DataFrame:
    """One row: table, rows, distinct keys, keys seen more than once."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).cast("bigint").alias("duplicate_keys"),
    ).select(F.lit(table).alias("table_name"), "rows", "distinct_keys", "duplicate_keys")


class TableStore:
    """Catalog tables backed by parquet folders that are never changed once published."""

    def __init__(self, spark: SparkSession, root: str | None = None, db: str = DB):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/tables").rstrip("/")
        self.db = db
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")

    def qualified(self, name: str) -> str:
        return f"{self.db}.{name}"

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.db}.{name}")

    def _property(self, name: str, key: str) -> list[str]:
        """A comma-separated table property."""
        if not self.exists(name):
            return []
        held = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.qualified(name)}").collect()}
        return [x for x in held.get(key, "").split(",") if x]

    def _set_property(self, name: str, key: str, values: Iterable) -> None:
        self.spark.sql(f"ALTER TABLE {self.qualified(name)} SET TBLPROPERTIES ('{key}'='{','.join(map(str, values))}')")

    def location(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        rows = (self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.qualified(name)}")
                .filter(F.col("col_name") == "Location").select("data_type").take(1))
        return rows[0][0] if rows else None

    def cycles(self, name: str) -> list[int]:
        """Cycles that are published of a table partitioned by them."""
        shown = self.spark.sql(f"SHOW PARTITIONS {self.qualified(name)}").collect() if self.exists(name) else []
        return sorted(int(r[0].split("=")[1]) for r in shown)

    def cycle_location(self, name: str, cycle: int) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.qualified(name)} PARTITION (cycle={cycle})")
        return [r["data_type"] for r in rows.collect() if r["col_name"] == "Location"][0]

    def read(self, name: str, cycles: Iterable[int] | None = None) -> DataFrame:
        """The published rows, of the given cycles only if any are given (other partitions are not scanned)."""
        rows = self.spark.table(self.qualified(name))
        return rows if cycles is None else rows.where(F.col("cycle").isin(list(cycles)))

    def write_version(self, name: str, df: DataFrame, key: list[str] | None = None) -> str:
        """Write the whole table anew, assert key uniqueness on what was written, publish it."""
        path = f"{self.root}/{name}/v_{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        self._assert_unique(name, path, key)
        self.publish_version(name, path)
        return path

    def publish_version(self, name: str, path: str) -> None:
        """Make a written folder the table, and delete the version before the one it replaces."""
        before = self.location(name)
        self.publish(name, path)
        self._retire(name, [before] if before else [])

    def publish(self, name: str, path: str) -> None:
        q = self.qualified(name)
        if self.exists(name):
            self.spark.sql(f"ALTER TABLE {q} SET LOCATION '{path}'")
            self.spark.sql(f"REFRESH TABLE {q}")
        else:
            self.spark.sql(f"CREATE TABLE {q} USING parquet LOCATION '{path}'")

    def stage_cycles(self, name: str, df: DataFrame) -> str:
        """Write rows to a fresh folder, a sub-folder a cycle; files are sized by Spark, hot cycles get several."""
        path = f"{self.root}/{name}/v_{uuid.uuid4().hex}"
        df.hint("rebalance", "cycle").write.mode("errorifexists").partitionBy("cycle").parquet(path)
        return path

    def write_cycles(self, name: str, df: DataFrame, cycles: Iterable[int], key: list[str] | None = None) -> str:
        """Write the rows of ``cycles`` anew, assert key uniqueness on what was written, publish those cycles."""
        path = self.stage_cycles(name, df)
        self._assert_unique(name, path, key)
        self.publish_cycles(name, path, cycles, df)
        return path

    def publish_cycles(self, name: str, path: str, cycles: Iterable[int], shape: DataFrame, stale: bool = False) -> None:
        """Make the sub-folders of ``cycles`` under ``path`` the partitions; a cycle without rows loses its partition.

        With ``stale`` the cycles are marked for the next refresh before they are visible, so that none is forgotten.
        """
        q, wanted = self.qualified(name), sorted(set(cycles))
        written = {int(r["cycle"]) for r in self.spark.read.parquet(path).select("cycle").distinct().collect()}
        if not self.exists(name):
            columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields if f.name != "cycle"]
            self.spark.sql(f"CREATE TABLE {q} ({', '.join(columns)}, cycle int) USING parquet PARTITIONED BY (cycle) "
                           f"LOCATION '{self.root}/{name}/none'")
        if stale:
            self.mark_stale(name, wanted)
        there = {c: self.cycle_location(name, c) for c in set(self.cycles(name)) & set(wanted)}
        at = {c: f"{path}/cycle={c}" for c in wanted if c in written}
        new = [f"PARTITION (cycle={c}) LOCATION '{p}'" for c, p in at.items() if c not in there]
        if new:
            self.spark.sql(f"ALTER TABLE {q} ADD {' '.join(new)}")
        for c in there:
            self.spark.sql(f"ALTER TABLE {q} PARTITION (cycle={c}) SET LOCATION '{at[c]}'" if c in at else f"ALTER TABLE {q} DROP PARTITION (cycle={c})")
        self.spark.sql(f"REFRESH TABLE {q}")
        self._retire(name, there.values())

    def _assert_unique(self, name: str, path: str, key: list[str] | None) -> None:
        if key and duplicate_keys(self.spark.read.parquet(path), key).take(1):
            raise UniqueKeyError(f"{name}: duplicate keys {key} in {path}; version not published")

    def _retire(self, name: str, replaced: Iterable[str]) -> None:
        """Delete what was replaced by the write before this one; readers may still be on ``replaced``."""
        for path in self._property(name, OLD):
            discard(self.spark, path)
        self._set_property(name, OLD, replaced)

    def stale_cycles(self, name: str) -> set[int]:
        """Cycles that changed since the derived tables were last built from this table."""
        return {int(c) for c in self._property(name, STALE)}

    def mark_stale(self, name: str, cycles: Iterable[int]) -> None:
        self._set_property(name, STALE, sorted(self.stale_cycles(name) | set(cycles)))

    def clear_stale(self, name: str, cycles: Iterable[int]) -> None:
        if self.exists(name):
            self._set_property(name, STALE, sorted(self.stale_cycles(name) - set(cycles)))

    def write_log(self, name: str, writer: str, run: str, df: DataFrame) -> DataFrame:
        """Rows of one writer's run, in a folder of their own; the same run written again replaces them."""
        path = f"{self.root}/{name}/writer={writer}/run={run}"
        df.drop("run").write.mode("overwrite").parquet(path)
        return self.read_log(name, writer, df.schema).where(F.col("run") == run)

    def read_log(self, name: str, writer: str, schema) -> DataFrame:
        """All rows that a writer has logged, with the run that wrote them."""
        path = f"{self.root}/{name}/writer={writer}"
        partitioned = T.StructType([*[f for f in schema.fields if f.name != "run"], T.StructField("run", T.StringType())])
        return self.spark.read.schema(partitioned).parquet(path)

    def empty_like(self, df: DataFrame) -> DataFrame:
        return df.where(F.lit(False))  # known to be empty when the plan is made, so a join with it is none


SUMMARY_TABLE = "mv_candidate_spending_summary"
ELECTION_TABLE = "mv_election_spending_summary"


def refresh_spending(store: TableStore, inside: DataFrame, outside: DataFrame, cycles: Iterable[int] | None = None) -> None:
    """Rebuild the candidate summary, then the election summary from the *written* one.

    Order matters: the election table is computed from the published candidate
    summary (read back from storage, so its lineage is cut and a lost executor
    recomputes from files, not from the raw feeds). With ``cycles`` only those are read,
    rebuilt and written, once both tables exist: a cycle's rows depend on that cycle's totals alone.
    """
    both = [inside, outside]
    if cycles is None or not (store.exists(SUMMARY_TABLE) and store.exists(ELECTION_TABLE)):
        found = both[0].select("cycle").union(both[1].select("cycle")).distinct().collect()
        cycles = sorted({r.cycle for r in found} | set(store.cycles(SUMMARY_TABLE)))
        kept = None
    else:
        cycles = sorted(set(cycles))
        both = [t.where(F.col("cycle").isin(cycles)) for t in both]
        kept = store.read(ELECTION_TABLE).where(~F.col("cycle").isin(cycles))
    check_cycles(cycles)
    store.write_cycles(SUMMARY_TABLE, marts.candidate_spending_summary(*both), cycles, key=marts.KEY)
    election = marts.election_spending_summary(store.read(SUMMARY_TABLE, cycles))
    if kept is not None:
        election = kept.select(*election.columns).unionByName(election)
    store.write_version(ELECTION_TABLE, election, key=["cycle"])


def check_cycles(cycles: Iterable[int]) -> None:
    n = len(set(cycles))
    if n > MOST_CYCLES:
        raise ValueError(f"{n} cycles in one write; at most {MOST_CYCLES} are expected")
