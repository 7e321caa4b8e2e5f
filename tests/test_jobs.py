import json
import os
import tempfile
import uuid
from decimal import Decimal as D

import pytest
from pyspark.sql import types as T

from fundflow.plans import jobs
from fundflow.plans.refresh import ELECTION_TABLE, SUMMARY_TABLE, TableStore, refresh_spending
from fundflow.sources.paged_json import page_coverage, page_envelopes, read_envelopes, read_pages

REC = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def _write_pages(pages):
    d = tempfile.mkdtemp(prefix="pages-")
    with open(os.path.join(d, "part-0.json"), "w") as f:
        for env in pages:
            f.write(json.dumps(env) + "\n")
    return d


def env(page, pages, results):
    return {"endpoint": "e", "results": results, "pagination": {"page": page, "pages": pages}}


def test_pages_concatenate_and_audit(spark):
    d = _write_pages([env(1, 3, [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]), env(3, 3, [{"id": 5, "v": "c"}])])
    recs = read_pages(spark, d, REC)
    assert sorted((r.id, r.page, r.pos) for r in recs.collect()) == [(1, 1, 0), (2, 1, 1), (5, 3, 0)]
    assert [(r.endpoint, r.page) for r in page_coverage(spark, d, REC).collect()] == [("e", 2)]


def test_empty_first_page_hides_the_rest(spark):
    d = _write_pages([env(1, 2, []), env(2, 2, [{"id": 9, "v": "x"}])])
    assert read_pages(spark, d, REC).count() == 0
    d2 = _write_pages([env(1, 1, [{"id": 1, "v": "x"}]), env(2, 1, [{"id": 2, "v": "y"}])])
    assert [r.id for r in read_pages(spark, d2, REC).collect()] == [1]
    d3 = _write_pages([{"endpoint": "e", "pagination": {"page": 1, "pages": 1}}])
    assert read_pages(spark, d3, REC).count() == 0


def test_entity_order_and_unknown():
    assert jobs.order_entities(["schedule_e_totals_by_candidate", "candidates"]) == \
        ["candidates", "schedule_e_totals_by_candidate"]
    with pytest.raises(ValueError):
        jobs.order_entities(["candidates", "nope"])


def _store(spark):
    tag = uuid.uuid4().hex[:8]
    return TableStore(spark, root=tempfile.mkdtemp(prefix="store-"), db=f"t_{tag}")


INSIDE = "candidate_id string, cycle int, receipts decimal(15,2), disbursements decimal(15,2), _seq long"
OUTSIDE = "candidate_id string, cycle int, support_oppose_indicator string, total decimal(14,2), _seq long"


CANDIDATE = "candidate_id string, name string, party string, _seq long"


def _candidates(spark, *rows):
    return spark.createDataFrame([(c, n, p, i) for i, (c, n, p) in enumerate(rows)], CANDIDATE)


def test_pages_are_cut_by_rank(spark):
    df = spark.createDataFrame([(10 * i, f"v{i}") for i in range(25)] + [(70, "v7")], REC)  # sparse keys, one twice
    env_ = page_envelopes(df, "e", page_size=10, order_col="id").collect()
    assert sorted((r.pagination.page, len(r.results), r.pagination.pages, r.pagination["count"]) for r in env_) == [
        (1, 10, 3, 26), (2, 10, 3, 26), (3, 6, 3, 26)]
    first = next(r for r in env_ if r.pagination.page == 1)
    assert [x.id for x in first.results] == [0, 10, 20, 30, 40, 50, 60, 70, 70, 80]


def test_coverage_lists_every_gap(spark):
    d = _write_pages([env(2, 6, []), env(5, 6, [])])
    assert sorted(r.page for r in page_coverage(spark, d, REC).collect()) == [1, 3, 4, 6]


def test_batch_refresh_gate_and_isolation(spark):
    store = _store(spark)
    feeds = {"inside_totals_by_candidate": spark.createDataFrame([("C1", 2024, D(100), D(80), 1)], INSIDE),
             "schedule_e_totals_by_candidate": spark.createDataFrame([("C1", 2024, "S", D(20), 1)], OUTSIDE),
             "candidates": _candidates(spark, ("C1", "DOE, JO", None))}
    broken = feeds | {"committees": spark.createDataFrame([(1,)], "committee_id int")}  # no _seq: this entity fails
    out = jobs.ingest_batch(store, broken, "2024-06-01 00:00:00")
    assert out.results["committees"].error and not out.results["candidates"].error
    assert out.results["inside_totals_by_candidate"].stats["inserted"] == 1
    assert out.refreshed
    e = store.read(ELECTION_TABLE).first()
    assert (e.cycle, e.candidate_count, e.global_influence_ratio) == (2024, 1, D("0.25"))
    # second run with the same data: nothing changes, nothing is written
    place = store.cycle_location("inside_totals_by_candidate", 2024)
    out2 = jobs.ingest_batch(store, feeds, "2024-07-01 00:00:00", ["inside_totals_by_candidate"])
    s = out2.results["inside_totals_by_candidate"].stats
    assert (s["inserted"], s["updated"], s["unchanged"]) == (0, 0, 1)
    assert store.cycle_location("inside_totals_by_candidate", 2024) == place
    assert store.read("inside_totals_by_candidate").first().updated_at.month == 6
    assert store.read(SUMMARY_TABLE).count() == 1


def test_no_refresh_when_nothing_survives(spark):
    store = _store(spark)
    feeds = {"inside_totals_by_candidate": spark.createDataFrame([("", 2024, D(1), D(1), 1)], INSIDE)}
    out = jobs.ingest_batch(store, feeds, "2024-06-01 00:00:00", ["inside_totals_by_candidate"])
    assert out.results["inside_totals_by_candidate"].stats is None
    assert not out.refreshed


def test_an_empty_feed_changes_nothing(spark):
    store = _store(spark)
    feeds = {"inside_totals_by_candidate": spark.createDataFrame([], INSIDE), "candidates": spark.createDataFrame([], CANDIDATE),
             "schedule_e_totals_by_candidate": spark.createDataFrame([], OUTSIDE)}
    out = jobs.ingest_batch(store, feeds, "2024-06-01 00:00:00", list(feeds))
    assert [(r.error, r.stats, r.errors) for r in out.results.values()] == [(None, None, 0)] * 3 and not out.refreshed


def test_unknown_candidates_are_quarantined(spark):
    store = _store(spark)
    feeds = {"candidates": _candidates(spark, ("C1", "DOE, JO", None), ("C9", "  ", None)),
             "inside_totals_by_candidate": spark.createDataFrame([("C1", 2024, D(1), D(1), 1), ("CX", 2024, D(2), D(2), 2)], INSIDE),
             "schedule_e_totals_by_candidate": spark.createDataFrame([("CX", 2024, "S", D(20), 1)], OUTSIDE)}
    out = jobs.ingest_batch(store, feeds, "2024-06-01 00:00:00")
    inside, outside, cands = (out.results[e] for e in ("inside_totals_by_candidate", "schedule_e_totals_by_candidate", "candidates"))
    assert (inside.stats["inserted"], inside.stats["errors"], inside.errors) == (1, 1, 1)
    assert [r.candidate_id for r in store.read("inside_totals_by_candidate").collect()] == ["C1"]
    assert outside.stats is None and outside.errors == 1 and not store.exists("schedule_e_totals_by_candidate")
    assert [(r.failed_id, r.errors) for r in outside.quarantine.collect()] == [("CX", ["unknown_parent"])]
    assert [r.failed_id for r in cands.failed_ids().collect()] == ["C9"]
    assert json.loads(inside.quarantine.first().row)["receipts"] == 2
    # the log outlives the run
    assert spark.read.parquet(f"{store.root}/{jobs.QUARANTINE}").count() == 3
    schema = inside.quarantine.schema
    assert [(r.failed_id, r.run) for r in store.read_log(jobs.QUARANTINE, "candidates", schema).collect()] == [
        ("C9", cands.quarantine.first().run)]


def test_writers_of_a_log_do_not_meet(spark):
    """Thirty rounds of two writers at once: nothing raises and every row is there."""
    from concurrent.futures import ThreadPoolExecutor
    store = _store(spark)
    df = spark.range(4000).repartition(4)
    with ThreadPoolExecutor(2) as pool:
        for r in range(30):
            list(pool.map(lambda w: store.write_log("q", w, str(r), df.selectExpr(f"id + {r} as id")), ("a", "b")))
    for w in ("a", "b"):
        log = store.read_log("q", w, df.schema)
        assert log.count() == 30 * 4000 and log.select("run").distinct().count() == 30
    again = store.write_log("q", "a", "7", df)  # the same run again replaces its rows
    assert again.count() == 4000 and store.read_log("q", "a", df.schema).count() == 30 * 4000


REC_C = T.StructType([T.StructField("candidate_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("party", T.StringType())])


def _land(folder, name, fetch, page, rows, pages=2):
    with open(os.path.join(folder, name), "w") as f:
        f.write(json.dumps(env(page, pages, [dict(zip(["candidate_id", "name", "party"], r)) for r in rows]) | {"fetch": fetch}) + "\n")


def test_stream_is_replay_safe_and_a_later_fetch_wins(spark):
    from fundflow.streaming.micro_batch import merge_batch, run_incremental
    d, store, ck = tempfile.mkdtemp(prefix="land-"), _store(spark), tempfile.mkdtemp(prefix="ck-")
    _land(d, "p0.json", 1, 1, [("C1", "SMITH, JOHN", "DEM")])
    _land(d, "p1.json", 1, 2, [("C1", "SMITH, JOHN", "REP"), ("C2", "DOE, JO", None), ("", "NOBODY", None)])
    r = run_incremental(spark, store, d, REC_C, "candidates", "2024-06-01 00:00:00", checkpoint=ck)
    assert (r.batches, r.errors, r.refreshed) == (2, 1, False)
    got = {x.candidate_id: (x.name, x.party) for x in store.read("candidates").collect()}
    assert got == {"C1": ("John Smith", "REP"), "C2": ("Jo Doe", None)}
    assert spark.read.parquet(f"{store.root}/{jobs.QUARANTINE}").count() == 1
    # replaying page 1 (older) into the same table changes nothing
    merge_batch(store, "candidates", read_envelopes(spark, os.path.join(d, "p0.json"), REC_C), REC_C, "2024-06-02 00:00:00")
    # a batch tried twice leaves its rejects once
    for _ in range(2):
        merge_batch(store, "candidates", read_envelopes(spark, os.path.join(d, "p1.json"), REC_C), REC_C, "2024-06-02 00:00:00", run="s-1")
    assert spark.read.parquet(f"{store.root}/{jobs.QUARANTINE}").count() == 2
    assert {x.candidate_id: (x.party, x.updated_at.day) for x in store.read("candidates").collect()}["C1"] == ("REP", 1)
    # the next fetch has the record on a lower page, and it still replaces the old one
    _land(d, "q0.json", 2, 1, [("C1", "SMITH, JOHN", "GRN")])
    run_incremental(spark, store, d, REC_C, "candidates", "2024-06-03 00:00:00", checkpoint=ck)
    assert {x.candidate_id: x.party for x in store.read("candidates").collect()} == {"C1": "GRN", "C2": None}


ROW = lambda c, p: {"candidate_id": c, "name": "DOE, JO", "party": p}


def _fetches():
    """Three fetches in pages: a normal one, one whose page 1 is empty, one that lacks page 1."""
    pages = [env(p, 4, [ROW(f"C{p}", f"a{p}"), ROW("C0", f"a{p}")]) | {"fetch": 1} for p in (1, 2, 3, 4)]
    pages += [env(p, 3, [ROW("C0", "hidden"), ROW(f"H{p}", "x")] if p > 1 else []) | {"fetch": 2} for p in (1, 2, 3)]
    return pages + [env(p, 3, [ROW(f"M{p}", "x")]) | {"fetch": 3} for p in (2, 3)]


@pytest.mark.parametrize("order", ["page 1 first", "page 1 last", "mixed"])
def test_every_landing_order_gives_what_a_batch_reading_gives(spark, order):
    from fundflow.streaming.micro_batch import run_incremental
    import random
    pages = _fetches()
    late = lambda e: (e["pagination"]["page"] == 1, e["fetch"])  # noqa: E731  the empty page 1 is the last to land
    pages.sort(key=late, reverse=order == "page 1 first")
    if order == "mixed":
        random.Random(5).shuffle(pages)
    whole = _write_pages(pages)
    batch = jobs.TRANSFORMS["candidates"](read_pages(spark, whole, REC_C)).rows
    want = sorted((r.candidate_id, r.party) for r in batch.collect())
    assert want == [("C0", "a4"), ("C1", "a1"), ("C2", "a2"), ("C3", "a3"), ("C4", "a4")]
    d, store, ck = tempfile.mkdtemp(prefix="land-"), _store(spark), tempfile.mkdtemp(prefix="ck-")
    for i in range(0, len(pages), 3):  # three runs of one batch each, with the state kept between them
        with open(os.path.join(d, f"{i}.json"), "w") as f:
            f.writelines(json.dumps(e) + "\n" for e in pages[i:i + 3])
        run_incremental(spark, store, d, REC_C, "candidates", "2024-06-01 00:00:00", checkpoint=ck, buckets=3)
    assert sorted((r.candidate_id, r.party) for r in store.read("candidates").collect()) == want


def test_a_second_page_one_may_tell_more(spark):
    from fundflow.streaming.micro_batch import run_incremental
    d, store, ck = tempfile.mkdtemp(prefix="land-"), _store(spark), tempfile.mkdtemp(prefix="ck-")
    steps = [[env(1, 2, [])], [env(2, 2, [ROW("C2", "b")])], [env(1, 2, [ROW("C1", "a")])], [{"pagination": {"page": 2}}]]
    for i, pages in enumerate(steps):
        with open(os.path.join(d, f"{i}.json"), "w") as f:
            f.writelines(json.dumps(e) + "\n" for e in pages)
        run_incremental(spark, store, d, REC_C, "candidates", "2024-06-01 00:00:00", checkpoint=ck, buckets=2)
        assert store.exists("candidates") == (i > 1)
    assert {r.candidate_id for r in store.read("candidates").collect()} == {"C1", "C2"}
    assert {r.candidate_id for r in read_pages(spark, d, REC_C).collect()} == {"C1", "C2"}


def test_coverage_by_blocks(spark):
    import random
    rng = random.Random(3)
    delivered = sorted(rng.sample(range(1, 60), 25)) + [70]  # one beyond the reported count
    d = _write_pages([env(p, 57, []) for p in delivered] + [env(1, 0, []) | {"endpoint": "none"}])
    want = sorted(set(range(1, 58)) - set(delivered))
    for block in (1, 4, 16, 4096):
        got = page_coverage(spark, d, REC, block)
        assert sorted(r.page for r in got.collect()) == want
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_arrival_numbers_keep_the_order(spark):
    from pyspark.sql import functions as F
    from fundflow.sources.paged_json import arrival_number
    rows = [(f, p, i) for f in (0, 1, 1_700_000_000, 10 ** 17) for p in (0, 1, 2 ** 31 - 1) for i in (0, 7, 2 ** 31 - 1)]
    df = spark.createDataFrame(rows[::-1], "f long, p int, i int").withColumn("n", arrival_number(F.col("f"), F.col("p"), F.col("i")))
    assert [(r.f, r.p, r.i) for r in df.orderBy("n").collect()] == rows


def test_null_lists_are_told_from_absent_ones(spark):
    rec = T.StructType([T.StructField("committee_id", T.StringType()), T.StructField("cycles", T.ArrayType(T.StringType())),
                        T.StructField("candidate_ids", T.ArrayType(T.StringType())), T.StructField("n", T.LongType())])
    d = _write_pages([env(1, 1, [{"committee_id": "A"}, {"committee_id": "B", "cycles": None, "candidate_ids": None, "n": 5},
                                 {"committee_id": "C", "cycles": [2020, "2022", 1.5], "n": "x"}, None])])
    got = {r.committee_id: r for r in read_pages(spark, d, rec, strict=True).collect()}
    assert {k: (r.cycles, r.candidate_ids, r.n, r._nulls, r.pos) for k, r in got.items()} == {
        "A": (None, None, None, [], 0), "B": (None, None, 5, ["cycles", "candidate_ids"], 1), "C": (["2020", "2022", "1.5"], None, None, [], 2)}


def test_stream_applies_the_first_page_rule_and_refreshes(spark):
    from fundflow.streaming.micro_batch import run_incremental
    rec = T.StructType([T.StructField("candidate_id", T.StringType()), T.StructField("cycle", T.IntegerType()),
                        T.StructField("receipts", T.StringType()), T.StructField("disbursements", T.StringType())])
    store, d = _store(spark), tempfile.mkdtemp(prefix="land-")
    jobs.ingest_entity(store, "candidates", _candidates(spark, ("C1", "DOE, JO", None), ("C2", "ROE, AL", None)), "2024-06-01 00:00:00")
    row = lambda c: {"candidate_id": c, "cycle": 2024, "receipts": "10", "disbursements": "5"}
    for name, e in (("a.json", env(1, 1, [row("C1")])), ("b.json", env(2, 1, [row("C2")]))):
        with open(os.path.join(d, name), "w") as f:
            f.write(json.dumps(e) + "\n")
    os.utime(os.path.join(d, "a.json"), (1, 1))  # page 1 lands first
    r = run_incremental(spark, store, d, rec, "inside_totals_by_candidate", "2024-06-01 00:00:00")
    assert r.refreshed and store.read(SUMMARY_TABLE).first().candidate_id == "C1"
    assert [x.candidate_id for x in store.read("inside_totals_by_candidate").collect()] == ["C1"]


def test_single_entry_applies_date_window(spark):
    store = _store(spark)
    cands = spark.createDataFrame(
        [("C1", "DOE, JANE", "2024-05-31", 1), ("C2", "ROE, RICK", "2024-06-01", 2), ("C3", "POE, ED", "2024-01-01", 3)],
        "candidate_id string, name string, first_file_date string, _seq long")
    # run at 2024-06-01 12:00 UTC: default window = New York yesterday .. today
    out = jobs.ingest(store, {"candidates": cands}, "2024-06-01 12:00:00", entities=["candidates"])
    assert out.results["candidates"].stats["inserted"] == 2
    assert sorted(r.candidate_id for r in store.read("candidates").collect()) == ["C1", "C2"]
    out2 = jobs.ingest(store, {"candidates": cands}, "2024-06-01 12:00:00", start="2024-01-01",
                       entities=["candidates"])
    assert out2.results["candidates"].stats["inserted"] == 1


def _totals(spark, rows):
    return spark.createDataFrame([(c, y, D(r), D(1), i) for i, (c, y, r) in enumerate(rows)], INSIDE)


def _loaded(spark):
    """Totals of five cycles, one of them with most rows."""
    store = _store(spark)
    ids = [f"C{i}" for i in range(300)]
    jobs.ingest_entity(store, "candidates", _candidates(spark, *[(c, "DOE, JO", None) for c in ids]), "2024-06-01 00:00:00")
    rows = [(c, 2024, i) for i, c in enumerate(ids)] + [(c, y, 5) for y in (2016, 2018, 2020, 2022) for c in ids[:20]]
    jobs.ingest_batch(store, {"inside_totals_by_candidate": _totals(spark, rows)}, "2024-06-01 00:00:00", ["inside_totals_by_candidate"])
    return store, rows


def test_a_merge_of_one_cycle_reads_and_writes_that_cycle_only(spark):
    store, _ = _loaded(spark)
    entity = "inside_totals_by_candidate"
    plan = store.read(entity, [2020])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cycle" in plan and "(cycle#" in plan and "= 2020" in plan
    assert all("cycle=2020" in f for f in store.read(entity, [2020]).inputFiles())
    before = {(n, c): store.cycle_location(n, c) for n in (entity, SUMMARY_TABLE) for c in store.cycles(n)}
    r = jobs.ingest_batch(store, {entity: _totals(spark, [("C1", 2020, 77), ("C299", 2020, 1), ("C2", 2018, 5)])}, "2024-07-01 00:00:00", [entity])
    stats = r.results[entity].stats
    assert (stats["inserted"], stats["updated"], stats["unchanged"]) == (1, 1, 1) and r.refreshed
    moved = {k for k, p in before.items() if store.cycle_location(*k) != p}
    assert moved == {(entity, 2020), (SUMMARY_TABLE, 2020)}  # 2018 was read, but nothing in it changed
    assert not store.stale_cycles(entity)


def test_changed_cycles_equal_a_full_rebuild(spark):
    store, rows = _loaded(spark)
    entity = "inside_totals_by_candidate"
    jobs.ingest_batch(store, {entity: _totals(spark, [("C1", 2020, 77), ("C9", 2030, 1)])}, "2024-07-01 00:00:00", [entity])
    jobs.ingest_batch(store, {"schedule_e_totals_by_candidate": spark.createDataFrame(
        [("C1", 2020, "S", D(20), 1), ("C5", 2010, "O", D(3), 2)], OUTSIDE)}, "2024-08-01 00:00:00", ["schedule_e_totals_by_candidate"])
    step = {n: sorted(map(str, store.read(n).collect())) for n in (SUMMARY_TABLE, ELECTION_TABLE)}
    assert store.cycles(SUMMARY_TABLE) == [2010, 2016, 2018, 2020, 2022, 2024, 2030]
    refresh_spending(store, *jobs.spending_inputs(store))
    assert {n: sorted(map(str, store.read(n).collect())) for n in step} == step


def test_cycles_are_not_forgotten_when_a_refresh_fails(spark, monkeypatch):
    store, _ = _loaded(spark)
    entity = "inside_totals_by_candidate"
    with monkeypatch.context() as m:
        m.setattr(jobs, "refresh_spending", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.ingest_batch(store, {entity: _totals(spark, [("C1", 2020, 77)])}, "2024-07-01 00:00:00", [entity])
    assert store.stale_cycles(entity) == {2020}
    jobs.ingest_batch(store, {entity: _totals(spark, [("C1", 2022, 78)])}, "2024-07-02 00:00:00", [entity])
    got = {r.cycle: int(r.inside_receipts) for r in store.read(SUMMARY_TABLE).where("candidate_id = 'C1'").collect()}
    assert (got[2020], got[2022]) == (77, 78)


def test_the_job_counts_every_write_of_a_repeated_key(spark):
    from fundflow.operators.merge import write_counts
    from fundflow.operators.specs import OUTSIDE_TOTALS
    store = _store(spark)
    jobs.ingest_entity(store, "candidates", _candidates(spark, *[(f"C{i}", "DOE, JO", None) for i in range(9)]), "2024-06-01 00:00:00")
    feed = [("C1", 2024, "s", D(1), 1), ("C1", 2024, "S", D(2), 2), ("C2", 2024, "o", D(3), 3), ("C2", 2024, "O", D(3), 4), ("C3", 2024, "S", D(3), 5)]
    first = jobs.ingest_entity(store, "schedule_e_totals_by_candidate", spark.createDataFrame(feed, OUTSIDE), "2024-06-01 00:00:00")
    assert (first.stats["inserted"], first.stats["updated"]) == (3, 1)
    stored = store.read("schedule_e_totals_by_candidate")
    again = spark.createDataFrame([("C1", 2024, "s", D(2), 1), ("C1", 2024, "S", D(5), 2), ("C4", 2024, "O", D(1), 3)], OUTSIDE)
    want = write_counts(stored, again, OUTSIDE_TOTALS).first()  # raw keys differ in case: one write each
    upper = spark.createDataFrame([("C1", 2024, "S", D(2), 1), ("C1", 2024, "S", D(5), 2), ("C4", 2024, "O", D(1), 3)], OUTSIDE)
    want = write_counts(stored, upper, OUTSIDE_TOTALS).first()
    second = jobs.ingest_entity(store, "schedule_e_totals_by_candidate", again, "2024-07-01 00:00:00")
    assert (second.stats["inserted"], second.stats["updated"]) == (want.inserted, want.updated) == (1, 1)
    assert {r.candidate_id: int(r.total) for r in store.read("schedule_e_totals_by_candidate").collect()} == {"C1": 5, "C2": 3, "C3": 3, "C4": 1}


def test_a_failed_merge_loses_nothing(spark, monkeypatch):
    store = _store(spark)
    jobs.ingest_entity(store, "candidates", _candidates(spark, ("C1", "DOE, JO", "A"), ("C2", "ROE, AL", "A")), "2024-06-01 00:00:00")
    before = sorted(store.read("candidates").collect())
    update = _candidates(spark, ("C1", "DOE, JO", "B"))
    with monkeypatch.context() as m:
        m.setattr(TableStore, "publish_version", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.ingest_entity(store, "candidates", update, "2024-07-01 00:00:00")
    assert sorted(store.read("candidates").collect()) == before
    jobs.ingest_entity(TableStore(spark, store.root, store.db), "candidates", update, "2024-07-01 00:00:00")
    assert {r.candidate_id: r.party for r in store.read("candidates").collect()} == {"C1": "B", "C2": "A"}


def test_old_derived_versions_are_retired(spark):
    from fundflow.session import local_path
    store = _store(spark)
    df = spark.createDataFrame([(2024, 1)], "cycle int, n int")
    # another store on the same catalog sees and retires the same versions
    paths = [TableStore(spark, store.root, store.db).write_version("t", df, key=["cycle"]) for _ in range(4)]
    alive = [os.path.isdir(local_path(p)) for p in paths]
    assert alive == [False, False, True, True]
    assert store.read("t").count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N
    from fundflow.session import shared_dir
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=N(master="yarn", applicationId="a"), conf=N(get=lambda k, d=None: d)))


def test_a_filter_on_a_missing_column_is_an_error(spark):
    from fundflow.sources.predicates import source_filter
    with pytest.raises(ValueError):
        source_filter(spark.range(1), offices=("P",))
    one = spark.createDataFrame([(2000, "P"), (2002, "P"), (2000, "X")], "cycle int, office string")
    assert source_filter(one, cycle=2000, cycle_column="cycle").count() == 1  # a scalar cycle
    assert source_filter(one, offices=None, office="X").count() == 1


def test_a_backlog_takes_few_micro_batches_and_state_partitions(spark):
    from fundflow.streaming.micro_batch import BUCKETS, MOST_BATCHES, SHUFFLE, batch_files, run_incremental, state_partitions
    assert [batch_files(n, 16) for n in (0, 1, 94, 128, 563, 1024)] == [16, 16, 16, 16, 71, 128]
    assert all(-(-n // batch_files(n, 1)) <= MOST_BATCHES for n in range(1, 3000))
    before = spark.conf.get(SHUFFLE)
    d, store, ck = tempfile.mkdtemp(prefix="land-"), _store(spark), tempfile.mkdtemp(prefix="ck-")
    for p in range(1, 10):
        _land(d, f"p{p}.json", 1, p, [("C0", "DOE, JO", f"P{p}"), (f"C{p}", "DOE, JO", "DEM")], pages=9)
    spark.conf.set(SHUFFLE, 60)
    try:
        assert state_partitions(spark) == min(60, BUCKETS, spark.sparkContext.defaultParallelism)
        r = run_incremental(spark, store, d, REC_C, "candidates", "2024-06-01 00:00:00", batch_files(9, 1), checkpoint=ck)
        assert spark.conf.get(SHUFFLE) == "60"
    finally:
        spark.conf.set(SHUFFLE, before)
    assert 1 < r.batches <= MOST_BATCHES
    assert len([x for x in os.listdir(f"{ck}/state/0") if x.isdigit()]) <= spark.sparkContext.defaultParallelism
    assert {x.candidate_id: x.party for x in store.read("candidates").collect()} == {"C0": "P9"} | {f"C{p}": "DEM" for p in range(1, 10)}


def test_landed_files_are_bounded(spark, monkeypatch):
    from fundflow.plans import registered_jobs as R
    monkeypatch.setattr(R, "PAGES_PER_FILE", 1)
    monkeypatch.setattr(R, "MOST_FILES", 3)
    raw = spark.range(900).selectExpr("id as _seq", *[f"'x' as {f.name}" for f in R.CANDIDATE_RECORD.fields if f.name != "order_key"])
    assert R._candidate_pages(raw, 1)[1] == 3
    assert R._candidate_pages(raw.limit(150), 1)[1] == 2


def test_the_feed_is_read_again_only_when_a_rule_failed(spark, monkeypatch):
    read = []
    rejects = jobs._rejects
    monkeypatch.setattr(jobs, "_rejects", lambda entity, run, ts, rows, errors: read.append(entity) or rejects(entity, run, ts, rows, errors))
    store = _store(spark)
    outside = spark.createDataFrame([("C1", 2024, "S", D(1), 1), ("CX", 2024, "s", D(2), 2), ("CX", 2024, "S", D(3), 3)], OUTSIDE)
    bad = spark.createDataFrame([("C1", 2022, "X", D(9), 1), ("CY", 2022, "S", D(9), 2)], OUTSIDE)
    jobs.ingest_batch(store, {"candidates": _candidates(spark, ("C1", "DOE, JO", None))}, "2024-06-01 00:00:00", ["candidates"])
    assert read == []
    r = jobs.ingest_entity(store, "schedule_e_totals_by_candidate", outside, "2024-06-01 00:00:00")
    assert len(read) == 1  # the staged rows of unknown parents, not the feed
    assert sorted((x.failed_id, x.errors[0]) for x in r.quarantine.collect()) == [("CX", jobs.UNKNOWN_PARENT)] * 2
    r = jobs.ingest_entity(store, "schedule_e_totals_by_candidate", bad, "2024-06-01 00:00:00")
    assert len(read) == 3
    assert sorted((x.failed_id, x.errors[0]) for x in r.quarantine.collect()) == [("C1", "indicator_domain"), ("CY", jobs.UNKNOWN_PARENT)]
