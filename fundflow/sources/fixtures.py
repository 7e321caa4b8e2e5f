"""Binding of the driver's test tables to campaign-finance feeds.

Every feed is derived from the given tables by Spark, so its size grows with the
scale factor. Raw feeds carry ``_seq``, the arrival order a paged source would
give (here derived from the source's own key), because last-wins / first-wins
rules need an order that Spark rows do not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.functions.dates import cycle_of
from fundflow.operators.specs import COMMITTEE_TYPE_CODES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the binding.
SEGMENT_OFFICE = {"HOUSEHOLD": "H", "BUILDING": "S", "AUTOMOBILE": "P"}
PARTY_BY_MOD4 = {0: "DEM", 1: "REP", 2: "DFL"}
CHALLENGE_BY_MOD3 = {0: "I", 1: "C"}
# Suffix appended to a synthesised person name, by part size modulo 5.
NAME_SUFFIXES = [", JR.", " III", " PhD", " V", ""]

MERGE_STORED_BEFORE = "2000-01-01"
MERGE_INCOMING_FROM = "1998-01-01"
STORED_CREATED_AT = "2020-01-01 00:00:00"
RUN_TS = "2024-06-01 12:00:00"
PAGE_SIZE = 100
STREAM_PAGE_SIZE = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(c: Column, mapping: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out.cast("string")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate registry rows (one per customer) with cycles and filing dates from orders."""
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    per_cust = (orders.groupBy("o_custkey")
                .agg(F.min("o_orderdate").cast("date").alias("first_file_date"),
                     F.max("o_orderdate").cast("date").alias("last_file_date"),
                     F.sort_array(F.collect_set(cycle_of("o_orderdate"))).alias("cycles")))
    k = F.col("c_custkey")
    return (cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
            .select(k.cast("string").alias("candidate_id"),
                    F.col("c_name").alias("name"),
                    _case(F.col("c_mktsegment"), SEGMENT_OFFICE).alias("office"),
                    F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("state"),
                    (k % 20).cast("string").alias("district"),
                    _case(k % 4, PARTY_BY_MOD4).alias("party"),
                    _case(k % 3, CHALLENGE_BY_MOD3, "O").alias("incumbent_challenge"),
                    F.coalesce(F.col("cycles"), F.array().cast("array<int>")).alias("cycles"),
                    "first_file_date", "last_file_date",
                    F.concat(F.col("c_mktsegment"), F.lit(" PARTY")).alias("party_full"),
                    F.when(k % 3 == 0, "Incumbent").when(k % 3 == 1, "Challenger").otherwise("Open seat").alias("incumbent_challenge_full"),
                    F.substring("c_mktsegment", 1, 1).alias("candidate_status"),
                    F.year("last_file_date").alias("active_through"),
                    F.transform(F.coalesce(F.col("cycles"), F.array().cast("array<int>")), lambda c: c + 2).alias("election_years"),
                    (F.col("c_acctbal") < 0).alias("federal_funds_flag"),
                    (F.col("c_acctbal") > 5000).alias("has_raised_funds")))


def committees_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw committee records (one per supplier) before cleaning.

    Domain faults come from the data: suppliers with a negative balance send an
    unknown type code ('z9') and a 3-letter state (first letters of the nation).
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    code = F.element_at(F.array(*[F.lit(c) for c in COMMITTEE_TYPE_CODES]), (k % len(COMMITTEE_TYPE_CODES)).cast("int") + 1)
    negative = F.col("s_acctbal") < 0
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 8, "0")).alias("committee_id"),
        F.upper("s_name").alias("name"),
        F.when(negative, F.lit("z9")).otherwise(F.lower(code)).alias("committee_type"),
        F.when(k % 3 == 0, "NONE").when(k % 3 == 1, " none ").otherwise(F.col("s_name"))
         .alias("affiliated_committee_name"),
        F.upper(F.substring("n_name", 1, F.when(negative, 3).otherwise(2))).alias("state"),
        k.alias("_seq"),
    )


def inside_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw candidate totals, one row per order (several rows per candidate and cycle)."""
    o = table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    return o.select(
        F.col("o_custkey").cast("string").alias("candidate_id"),
        cycle_of("o_orderdate").alias("cycle"),
        amount.alias("receipts"),
        F.when(F.col("o_orderstatus") == "F", amount)
         .when(F.col("o_orderstatus") == "O", F.lit(0).cast("decimal(15,2)"))
         .alias("disbursements"),
        F.col("o_orderkey").alias("_seq"),
    )


#: Order of the line items, with the decimal digits that each column's values take.
OUTSIDE_ORDER = {"l_orderkey": 12, "l_linenumber": 1, "l_partkey": 9, "l_suppkey": 8, "l_extendedprice": 8}


def arrival_number() -> Column:
    """The order columns side by side in one decimal(38,0): fixed width, same order (prices in cents)."""
    total, below = F.lit(0).cast("decimal(38,0)"), sum(OUTSIDE_ORDER.values())
    for c, digits in OUTSIDE_ORDER.items():
        below -= digits
        whole = (F.col(c).cast("decimal(15,2)") * 100 if c == "l_extendedprice" else F.col(c)).cast("decimal(38,0)")
        total = total + whole * F.lit(str(10 ** below)).cast("decimal(38,0)")
    return total.cast("decimal(38,0)")


def outside_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw independent-expenditure totals, one row per line item.

    The five order columns together are unique and give the arrival number. Support comes
    in either case, so a clean key can have two raw keys.
    """
    li = table(spark, sf_dir, "lineitem").select(*OUTSIDE_ORDER, "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").cast("string").alias("candidate_id"),
                    cycle_of("l_shipdate").alias("cycle"),
                    F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") % 3 == 0, "S").otherwise("s"))
                     .when(F.col("l_returnflag") == "R", "O")
                     .alias("support_oppose_indicator"),
                    F.col("l_extendedprice").cast("decimal(14,2)").alias("total"),
                    arrival_number().alias("_seq")))


def candidates_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw candidate records as a feed delivers them: one snapshot per order.

    A candidate appears many times; later snapshots (higher order key) carry the
    newer party and filing date, ids arrive with stray blanks, the office code in
    lower case, and cancelled records ('P' status with '5-LOW' priority) have a blank
    name and must be rejected.
    """
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_custkey")
    blank_name = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return j.select(
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
         .otherwise(k.cast("string")).alias("candidate_id"),
        F.when(blank_name, F.lit("   ")).otherwise(F.col("c_name")).alias("name"),
        F.lower(_case(F.col("c_mktsegment"), SEGMENT_OFFICE)).alias("office"),
        F.col("c_nationkey").cast("string").alias("state"),
        (k % 20).cast("string").alias("district"),
        F.substring(F.col("o_orderpriority"), 3, 10).alias("party"),
        F.col("o_orderdate").cast("date").cast("string").alias("last_file_date"),
        F.col("o_orderkey").alias("_seq"),
    )


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'LAST, FIRST SUFFIX' person names synthesised from part names."""
    p = table(spark, sf_dir, "part")
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    sfx = _case(F.col("p_size") % 5, dict(enumerate(NAME_SUFFIXES)))
    return p.select(F.col("p_partkey").alias("name_id"),
                    F.concat(F.upper(w2), F.lit(", "), F.upper(w1), sfx).alias("raw_name"))


def _sum_by_key(o: DataFrame) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    return (o.groupBy(F.col("o_custkey").cast("string").alias("candidate_id"),
                      cycle_of("o_orderdate").alias("cycle"))
            .agg(F.sum(amount).cast("decimal(15,2)").alias("receipts"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", amount)).cast("decimal(15,2)")
                  .alias("disbursements")))


def merge_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored inside totals: orders before 2000, with audit timestamps of an earlier run."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(MERGE_STORED_BEFORE))
    ts = F.lit(STORED_CREATED_AT).cast("timestamp")
    return _sum_by_key(o).withColumn("created_at", ts).withColumn("updated_at", ts)


def merge_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming inside totals: orders from 1998 on (overlaps the stored years)."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(MERGE_INCOMING_FROM))
    return _sum_by_key(o).withColumn("_seq", F.lit(0).cast("bigint"))


def merge_incoming_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming inside totals with in-batch duplicates: one version per order.

    For each (candidate, cycle) the feed repeats the key once per order from 1998
    on; amounts are the order total rounded down to 100 000, so consecutive
    versions often repeat the previous value (a write that changes nothing).
    Versions arrive in order-key order, so the last one wins.
    """
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(MERGE_INCOMING_FROM))
    amount = (F.floor(F.col("o_totalprice") / 100000) * 100000).cast("decimal(15,2)")
    return o.select(F.col("o_custkey").cast("string").alias("candidate_id"),
                    cycle_of("o_orderdate").alias("cycle"),
                    amount.alias("receipts"),
                    F.when(F.col("o_orderstatus") == "F", amount).alias("disbursements"),
                    F.col("o_orderkey").alias("_seq"))
