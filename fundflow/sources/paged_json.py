"""Paged JSON envelopes: ``{"fetch": f, "results": [...], "pagination": {"page": p, "pages": N, ...}}``.

A fetch lands one envelope per page (one JSON document per line). Reading is a
plain JSON scan with an explicit schema, then ``posexplode`` of ``results``;
(fetch, page, pos) becomes ``_seq``, one fixed-width number, so order-dependent rules (first/last
wins) have the arrival order, across fetches too. A strict reading lands the records as VARIANT
values, which keep a list that is null apart from one that is absent: it names the null ones in
``_nulls``. Coverage is audited against ``pagination.pages`` in blocks of page numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundflow.operators.ordered import rank_within_group
from fundflow.operators.quality import NULLS, SEQ

PAGINATION = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("per_page", T.IntegerType()),
    T.StructField("count", T.LongType()),
])


#: Digits of the page and of the place in a record's arrival number; the fetch stands before them.
PAGE_DIGITS, POS_DIGITS = 10, 10
#: Page numbers that one group of the coverage audit covers.
PAGE_BLOCK = 4096


def arrival_number(fetch: Column, page: Column, pos: Column) -> Column:
    """Order of a record as a decimal(38,0): the number of its fetch (growing, e.g. its start time), its page, its place."""
    wide = [c.cast("decimal(38,0)") for c in (fetch, page, pos)]
    scale = [F.lit(str(10 ** d)).cast("decimal(38,0)") for d in (PAGE_DIGITS + POS_DIGITS, POS_DIGITS)]
    return (wide[0] * scale[0] + wide[1] * scale[1] + wide[2]).cast("decimal(38,0)")


def envelope_schema(record: T.StructType, strict: bool = False) -> T.StructType:
    return T.StructType([
        T.StructField("endpoint", T.StringType()),
        T.StructField("fetch", T.LongType()),
        T.StructField("results", T.ArrayType(T.VariantType() if strict else record)),
        T.StructField("pagination", PAGINATION),
    ])


def page_envelopes(records: DataFrame, endpoint: str, page_size: int = 100, order_col: str | None = None,
                   fetch: int = 0) -> DataFrame:
    """``records`` as envelopes of ``page_size`` rows by their rank on ``order_col``, pages numbered from 1."""
    columns = records.columns
    order_col = order_col or columns[0]
    order = [F.col(order_col).asc()] + [F.col(c).asc() for c in columns if c != order_col]
    ranked = rank_within_group(records.withColumn("__all", F.lit(1)), ["__all"], order, name="__rank")
    place = F.col("__rank").cast("long") - 1
    pages = (ranked.withColumn("page", F.floor(place / page_size).cast("int") + 1)
             .groupBy("page")
             .agg(F.array_sort(F.collect_list(F.struct("__rank", F.struct(*columns).alias("rec")))).alias("rows")))  # one page
    rows = records.agg(F.count(F.lit(1)).alias("count"))
    n_pages = rows.select(F.greatest(F.ceil(F.col("count") / page_size), F.lit(1)).cast("int")).scalar()
    n_rows = rows.select(F.col("count").cast("long")).scalar()
    return pages.select(F.lit(endpoint).alias("endpoint"), F.lit(fetch).cast("long").alias("fetch"),
                        F.transform("rows", lambda r: r["rec"]).alias("results"),
                        F.struct(F.col("page"), n_pages.alias("pages"), F.lit(page_size).alias("per_page"),
                                 n_rows.alias("count")).alias("pagination"))


def land(envelopes: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Write envelopes as JSON lines; ``files`` spreads the pages over that many files, in page order."""
    if files:
        envelopes = envelopes.repartitionByRange(files, F.col("pagination.page"))
    envelopes.write.mode(mode).json(path)


def read_envelopes(spark: SparkSession, path: str, record: T.StructType, strict: bool = False) -> DataFrame:
    """Landed envelopes."""
    return spark.read.schema(envelope_schema(record, strict)).json(path)


def page_facts(envelopes: DataFrame) -> DataFrame:
    """What page 1 of each endpoint and fetch says: its rows (``p1_rows``) and the pages reported (``p1_pages``)."""
    size = F.size(F.coalesce("results", F.array()))
    return (envelopes.where("pagination.page = 1").groupBy("endpoint", F.coalesce("fetch", F.lit(0)).alias("fetch"))
            .agg(F.max(size).alias("p1_rows"), F.max("pagination.pages").alias("p1_pages")))


def records_of(envelopes: DataFrame, record: T.StructType) -> DataFrame:
    """Records with ``endpoint``, ``fetch``, ``page``, ``pos``, ``pages`` and ``_seq``; no results is an empty page.

    Of VARIANT records each field is read as its type, and ``_nulls`` names the lists that are null.
    """
    rows = envelopes.select(
        "endpoint", F.coalesce("fetch", F.lit(0)).cast("long").alias("fetch"), F.col("pagination.page").alias("page"),
        F.col("pagination.pages").alias("pages"), F.posexplode(F.coalesce("results", F.array())).alias("pos", "rec"))
    place = ["endpoint", "fetch", "page", "pos", "pages"]
    seq = arrival_number(F.col("fetch"), F.coalesce("page", F.lit(0)), F.col("pos")).alias(SEQ)
    if not isinstance(rows.schema["rec"].dataType, T.VariantType):
        return rows.where("rec is not null").select(*place, *[F.col("rec")[f.name].alias(f.name) for f in record.fields], seq)
    lists = [f.name for f in record.fields if isinstance(f.dataType, T.ArrayType)]
    null = [F.when(F.is_variant_null(F.try_variant_get("rec", f"$.{c}", "variant")), F.lit(c)) for c in lists]
    return rows.where("rec is not null and not is_variant_null(rec)").select(
        *place, *[F.try_variant_get("rec", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in record.fields],
        F.array_compact(F.array(*null)).cast("array<string>").alias(NULLS), seq)


def counts(page: Column, rows: Column, pages: Column) -> Column:
    """Whether a page counts: page 1 does, the others if page 1 has ``rows`` and tells of more than one of ``pages``."""
    return F.coalesce(page == 1, F.lit(False)) | F.coalesce((rows > 0) & (pages > 1), F.lit(False))


def first_page_rule(records: DataFrame, facts: DataFrame) -> DataFrame:
    """When page 1 is empty or missing, or the source reports one page or fewer, only page 1 counts.

    ``facts`` has one row for each endpoint and fetch. They are few, but nothing here
    relies on it: the join is left to Spark, which broadcasts them when it measures them small.
    """
    j = records.join(facts, ["endpoint", "fetch"], "left")
    return j.where(counts(F.col("page"), F.col("p1_rows"), F.col("p1_pages"))).drop("p1_rows", "p1_pages")


def read_pages(spark: SparkSession, path: str, record: T.StructType, strict: bool = False) -> DataFrame:
    """Records of all landed pages that count (``first_page_rule``)."""
    envelopes = read_envelopes(spark, path, record, strict)
    return first_page_rule(records_of(envelopes, record), page_facts(envelopes))


def page_coverage(spark: SparkSession, path: str, record: T.StructType, block: int = PAGE_BLOCK) -> DataFrame:
    """Pages expected (1..pages) but not delivered, per endpoint.

    Islands of page numbers are looked at in blocks: what a block should hold (the part of
    1..pages within its bounds) less the pages it did get. Every block up to the reported count is
    there, with or without pages, so a gap that crosses a block's edge is found in parts that meet.
    No group is larger than a block, whatever an endpoint holds.
    """
    env = read_envelopes(spark, path, record).select("endpoint", F.col("pagination.page").cast("long").alias("page"),
                                                     F.col("pagination.pages").cast("long").alias("pages"))
    of = F.floor(F.col("page") / block).alias("block")
    got = env.where("page >= 1").groupBy("endpoint", of).agg(F.collect_set("page").alias("got"))  # a block's pages at most
    reported = env.groupBy("endpoint").agg(F.max("pages").alias("pages")).where("pages >= 1")
    wanted = reported.select("endpoint", "pages", F.explode(F.sequence(F.lit(0), F.floor(F.col("pages") / block))).alias("block"))
    low, high = F.greatest(F.col("block") * block, F.lit(1)), F.least(F.col("block") * block + (block - 1), F.col("pages"))
    held = wanted.where(low <= high).join(got, ["endpoint", "block"], "left")
    missing = F.array_except(F.sequence(low, high), F.coalesce("got", F.array().cast("array<bigint>")))
    return held.select("endpoint", F.explode(missing.cast("array<int>")).alias("page"))
