"""Ingest jobs: one entity end to end, an ordered batch of entities, and the refresh gate.

The loop over entities runs on the driver (a handful of specs); every step inside
is a distributed Spark job. The clean rows are staged as parquet in the shared folder
once, so the parent check, the merge and the statistics read materialised rows (no
second pass over the feed, no lineage back to the raw pages if an executor is lost).
Rows that break a rule or name an unknown parent are kept in the ``quarantine`` log, in a folder
of their own for each entity and run: entities run at the same time, and a run may be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fundflow.operators import merge as M
from fundflow.operators.ingest import TRANSFORMS
from fundflow.operators.quality import ERRORS, SEQ, observed
from fundflow.operators.specs import AUDIT_COLUMNS, ENTITIES, ENTITY_LEVELS, ENTITY_ORDER
from fundflow.plans.refresh import ELECTION_TABLE, TableStore, check_cycles, refresh_spending
from fundflow.session import discard, new_location

SPENDING_ENTITIES = ("inside_totals_by_candidate", "schedule_e_totals_by_candidate")
QUARANTINE = "quarantine"
UNKNOWN_PARENT = "unknown_parent"


@dataclass
class EntityResult:
    entity: str
    stats: dict | None = None             # inserted / updated / unchanged / errors; None: nothing survived
    error: str | None = None
    quarantine: DataFrame | None = None   # this run's rows of the quarantine log
    errors: int = 0

    def failed_ids(self) -> DataFrame:
        """Ids of the quarantined rows, once each."""
        return self.quarantine.select("failed_id").distinct()


@dataclass
class BatchResult:
    results: dict[str, EntityResult] = field(default_factory=dict)
    refreshed: bool = False


def order_entities(entities: list[str] | None) -> list[str]:
    """Requested entities in dependency order; unknown names fail before anything runs."""
    if entities is None:
        return list(ENTITY_ORDER)
    unknown = [e for e in entities if e not in ENTITIES]
    if unknown:
        raise ValueError(f"unknown entities: {unknown}; known: {ENTITY_ORDER}")
    return [e for e in ENTITY_ORDER if e in set(entities)]


def _rejects(entity: str, run: str, run_ts: str, rows: DataFrame, errors) -> DataFrame:
    """Rows in the shape of the quarantine log: which entity and run, the id, the rules, the row as JSON."""
    id_column = ENTITIES[entity].key[0]
    values = [c for c in rows.columns if c not in (SEQ, ERRORS)]
    return rows.select(F.lit(entity).alias("entity"), F.lit(run).alias("run"), F.lit(run_ts).cast("timestamp").alias("run_ts"),
                       F.col(id_column).cast("string").alias("failed_id"), errors.cast("array<string>").alias("errors"),
                       F.to_json(F.struct(*values)).alias("row"))


def ingest_entity(store: TableStore, entity: str, raw: DataFrame, run_ts: str, version: str | None = None,
                  run: str | None = None) -> EntityResult:
    """Transform, check parents, merge into the stored table; rejects go to the quarantine log.

    1. the clean rows are staged once (the transform runs once), flagged when the parent
       they name isn't stored; rule failures and unknown parents are observed metrics;
    2. the stored rows are merged with them and written to a fresh folder (action counts
       observed); of a table with a cycle only the incoming rows' cycles are read and written;
    3. the folder is published; only then is anything visible.

    Without a surviving row nothing is written and ``stats`` is None. With ``version`` a
    row only applies when it is newer than the stored one. ``run`` names the run in the quarantine
    log: the same run again replaces its rejects.
    """
    spark, spec, run = store.spark, ENTITIES[entity], run or uuid.uuid4().hex
    key = list(spec.key)
    t = TRANSFORMS[entity](raw)
    rows, known = t.writes.select(*spec.columns, SEQ), F.lit(True)
    if spec.parent:
        parents = (store.read(spec.parent).select(F.col(ENTITIES[spec.parent].key[0]).alias("__parent")) if store.exists(spec.parent)
                   else spark.createDataFrame([], "__parent string"))
        rows, known = rows.join(parents, F.col(key[0]) == F.col("__parent"), "left"), F.col("__parent").isNotNull()
    seen, staged_path = Observation(f"incoming_{uuid.uuid4().hex[:12]}"), new_location(spark, f"staging/{entity}_in")
    (rows.select(*spec.columns, SEQ, known.alias("__known"))
     .observe(seen, F.count_if("__known").alias("known"), F.count_if(~F.col("__known")).alias("orphans"))
     .write.mode("errorifexists").parquet(staged_path))
    staged = spark.read.parquet(staged_path)
    orphans, invalid = observed(seen, "orphans"), t.invalid_count()
    out = EntityResult(entity, errors=invalid + orphans)
    bad = []
    if invalid:  # only then is the feed read again
        bad.append(_rejects(entity, run, run_ts, t.quarantine, F.col(ERRORS)))
    if orphans:
        lost = staged.filter(~F.col("__known")).drop("__known")
        bad.append(_rejects(entity, run, run_ts, lost, F.array(F.lit(UNKNOWN_PARENT))))
    if bad:
        out.quarantine = store.write_log(QUARANTINE, entity, run, reduce(DataFrame.unionByName, bad))
    if observed(seen, "known"):
        out.stats = _merge_into(store, entity, staged.filter("__known").drop("__known"), run_ts, version, t.repeats) | {"errors": out.errors}
    discard(spark, staged_path)
    return out


def _merge_into(store: TableStore, entity: str, incoming: DataFrame, run_ts: str, version: str | None, repeats: bool) -> dict:
    """Merge staged rows with the stored ones and publish what changed. Returns the counts.

    A batch that repeats a key counts every write that changes its value (``write_counts``). Without
    ``repeats`` the transform has left one row a key, which is not looked for again.
    """
    spec, key, by_cycle = ENTITIES[entity], list(ENTITIES[entity].key), "cycle" in ENTITIES[entity].key
    extra, cycles = [version] if version else [], None
    if by_cycle:
        cycles = [r.cycle for r in incoming.select("cycle").distinct().collect()]
        check_cycles(cycles)
    if store.exists(entity):
        stored = store.read(entity, cycles)
    else:
        stored = store.empty_like(incoming.select(
            *spec.columns, *[F.col(v) for v in extra], *[F.lit(None).cast("timestamp").alias(c) for c in AUDIT_COLUMNS]))
    writes = M.write_counts(stored, incoming, spec, version).first() if repeats else None
    result = M.merge(stored, incoming, spec, run_ts, version=version, repeats=repeats)
    counted = Observation(f"merge_{uuid.uuid4().hex[:12]}")
    counts = [F.count_if(F.col(M.ACTION) == a).alias(name) for a, name in M.ACTION_COUNTS if a != "keep"]
    changed = F.collect_set(F.when(F.col(M.WRITE), F.col("cycle"))) if by_cycle else F.count_if(M.WRITE)
    table = result.frame.observe(counted, *counts, changed.alias("changed")).select(*result.columns)
    if by_cycle:
        path = store.stage_cycles(entity, table)
    else:
        path = f"{store.root}/{entity}/v_{uuid.uuid4().hex}"
        table.write.mode("errorifexists").parquet(path)
    got = dict(counted.get)
    changed = got.pop("changed")
    if not changed:
        discard(store.spark, path)
    elif by_cycle:
        store.publish_cycles(entity, path, changed, table, stale=True)
        for cycle in set(cycles) - set(changed):
            discard(store.spark, f"{path}/cycle={cycle}")
    else:
        store.publish_version(entity, path)
    got = {name: int(v) for name, v in got.items()}
    return got | ({"inserted": writes.inserted, "updated": writes.updated} if writes else {})


def spending_inputs(store: TableStore) -> tuple[DataFrame, DataFrame]:
    """The two spending tables, or empty frames of their shape if never loaded."""
    out = []
    for name in SPENDING_ENTITIES:
        spec = ENTITIES[name]
        if store.exists(name):
            out.append(store.read(name).select(*spec.columns))
        else:
            schema = ", ".join(f"{c} {t}" for c, t in zip(spec.columns, SPENDING_TYPES[name]))
            out.append(store.spark.createDataFrame([], schema))
    return out[0], out[1]


SPENDING_TYPES = {
    "inside_totals_by_candidate": ("string", "int", "decimal(15,2)", "decimal(15,2)"),
    "schedule_e_totals_by_candidate": ("string", "int", "string", "decimal(14,2)"),
}


def ingest_batch(store: TableStore, feeds: dict[str, DataFrame], run_ts: str,
                 entities: list[str] | None = None, parallel: bool = True) -> BatchResult:
    """Run entities in dependency order; a failing entity is recorded, the rest go on.

    Entities of the same dependency level run concurrently (``parallel``).

    Afterwards the spending tables are refreshed only if a spending entity ran,
    produced rows and raised no error (row-level errors do not block a refresh).
    """
    out = BatchResult()
    wanted = order_entities(entities)

    def run_one(e: str) -> EntityResult:
        if e not in feeds:
            return EntityResult(e, None, f"no feed for {e}")
        try:
            return ingest_entity(store, e, feeds[e], run_ts)
        except Exception as exc:  # noqa: BLE001 - isolate one entity's failure
            return EntityResult(e, None, f"{type(exc).__name__}: {exc}")

    # levels in dependency order; the entities of a level are independent, so their
    # Spark jobs are submitted together and share the cluster
    for level in ENTITY_LEVELS:
        todo = [e for e in wanted if e in level]
        if len(todo) <= 1 or not parallel:
            done = [run_one(e) for e in todo]
        else:
            with ThreadPoolExecutor(max_workers=len(todo)) as pool:
                done = list(pool.map(run_one, todo))
        for r in done:
            out.results[r.entity] = r
    if should_refresh(out):
        refresh_changed(store)
        out.refreshed = True
    return out


def refresh_changed(store: TableStore) -> None:
    """Rebuild the derived rows of the cycles that changed since they were last built."""
    stale = set().union(*(store.stale_cycles(name) for name in SPENDING_ENTITIES))
    if stale or not store.exists(ELECTION_TABLE):
        refresh_spending(store, *spending_inputs(store), cycles=stale)
        for name in SPENDING_ENTITIES:
            store.clear_stale(name, stale)


def should_refresh(batch: BatchResult) -> bool:
    return any(r.entity in SPENDING_ENTITIES and r.stats is not None and r.error is None
               for r in batch.results.values())


def ingest(store: TableStore, feeds: dict[str, DataFrame], run_ts: str, start: str | None = None,
           end: str | None = None, entities: list[str] | None = None) -> BatchResult:
    """Single entry point: resolve the date window, restrict dated feeds, run the batch.

    Missing ``start`` / ``end`` default to local yesterday / today of ``run_ts``
    (America/New_York). Feeds that carry ``first_file_date`` (candidates,
    committees) keep rows filed inside the window; the totals feeds are not dated.
    """
    from fundflow.functions.dates import date_window
    spark = store.spark
    lo, hi = date_window(F.lit(start).cast("string"), F.lit(end).cast("string"),
                         F.lit(run_ts).cast("timestamp_ntz"))
    bounds = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    dated = {}
    for name, df in feeds.items():
        if "first_file_date" in df.columns:
            d = F.col("first_file_date").try_cast("date")
            df = df.filter(d.between(F.lit(bounds.lo), F.lit(bounds.hi)))
        dated[name] = df
    return ingest_batch(store, dated, run_ts, entities)
