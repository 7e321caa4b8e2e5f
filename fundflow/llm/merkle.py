"""Merkle dataset manifest (operator 11): lag and lead windows, one pass for each level.

Rows are leaves. The leaf is the digest of a row's fields (``leaf_of``). Within a group the leaves
ascend by an order; while more than one node remains, every ``ARITY`` consecutive ones (the last
run may be shorter, even one) become the digest of their digests. What remains is the group's
subroot; the subroots, in the order of the groups, are the leaves of the last tree, whose rest is
the root. H is the lowercase hexadecimal sha256; inner nodes hash their children's hex digits.

A node of level j lives on the row of its first leaf. In a window of the rows in their order, the
nodes of a level are ARITY**j rows apart, so lag and lead columns at fixed offsets, masked by the
node's slot and the length of its run, hold its siblings, and the row of slot 0 hashes the parent.
Runs never cross a boundary of ARITY**LEVELS rows, so a window covers one such block (512 rows) and
no group is gathered, however many rows it has; the blocks' nodes are the rows of the next round.
On the way back every block hands the siblings above it to its rows, so a row ends up with its path:
left and right siblings of each level from leaf to root.

Places in a group come from a range partitioning: rows are stored with their slice, numbered within
it, and moved up by the rows of the earlier slices. All of it moves narrow rows (ids and digests);
the fields are read once and never shuffled.

Cases: null fields are written ``-``; a null group is a group and comes first; rows with a null id come
first in their group; rows that tie in the order are put in the order of their digests, so equal rows
are interchangeable; a lone leaf is its group's subroot, a lone subroot the root; an empty table has
no rows and no root; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import staged

#: Children of a node, and the levels that one window covers.
ARITY, LEVELS = 8, 3
BLOCK = ARITY ** LEVELS


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row: each field ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    def said(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[said(c.cast("string")) for c in fields]))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) among the rows of their ``g``, and ``n``, how many those are; no group is gathered."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = staged(rows, f"{name}-rows").withColumn("tie", F.monotonically_increasing_id())  # splits a crowd of equal rows
    dealt = staged(held.repartitionByRange(partitions, "g", *order, "tie").withColumn("slice", F.spark_partition_id()), f"{name}-slices")
    group, slices = Window.partitionBy("g"), dealt.groupBy("g", "slice").agg(F.count(F.lit(1)).alias("size"))
    earlier = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = slices.select("g", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(group).alias("n"))
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("g", "slice").orderBy(*order, "tie")))
    return staged(local.join(counts, ["g", "slice"]).withColumn("place", F.col("before") + F.col("local") - 1)
                  .select(*rows.columns, "place", "n"), f"{name}-places")


def nodes_at(n: Column, level: int) -> Column:
    """Nodes of a level above ``n`` rows."""
    return F.ceil(n / F.lit(ARITY ** level)).cast("long")


def block_levels(rows: DataFrame) -> DataFrame:
    """Rows (g, place, n, node) with their path within their block and, at its first row, the block's node (else null)."""
    spec = Window.partitionBy("g", "block").orderBy("place")
    out = rows.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    for level in range(LEVELS):
        step, count = ARITY ** level, nodes_at(F.col("n"), level)
        at = F.floor(F.col("place") / step)
        slot = at % ARITY
        run = F.least(F.lit(ARITY), count - (at - slot))
        own = (F.col("place") % step == 0) & (count > 1)
        sides = {f"b{i}": F.lag("node", i * step).over(spec) for i in range(1, ARITY)}
        sides |= {f"a{i}": F.lead("node", i * step).over(spec) for i in range(1, ARITY)}
        left = F.concat(*[F.when(slot >= i, F.col(f"b{i}")).otherwise("") for i in range(ARITY - 1, 0, -1)])
        right = F.concat(*[F.when(slot + i < run, F.col(f"a{i}")).otherwise("") for i in range(1, ARITY)])
        seen = out.withColumns(sides).withColumns({f"left{level}": F.when(own, left), f"right{level}": F.when(own, right)})
        parent = F.when(count <= 1, F.col("node")).when(slot == 0, digest(F.concat("node", f"right{level}")))
        out = seen.withColumn("node", F.when(F.col("place") % (step * ARITY) == 0, parent)).drop(*sides)
    # a node's siblings stand on its first row: the last ones seen are those of a row's own ancestors
    for level in range(1, LEVELS):
        out = out.withColumns({f"{side}{level}": F.last(f"{side}{level}", True).over(spec) for side in ("left", "right")})
    steps = [F.when(nodes_at(F.col("n"), level) > 1, F.struct(F.col(f"left{level}").alias("left"), F.col(f"right{level}").alias("right")))
             for level in range(LEVELS)]
    path = F.filter(F.array(*steps), lambda e: e.isNotNull())
    return out.select(*rows.columns, "block", path.alias("path"))  # node: the block's, on its first row


def climb(rows: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rows of every round, from ``rows`` (g, place, n, node) up, and the node left of each group (g, node)."""
    most, rounds = rows.agg(F.max("n")).first()[0] or 0, [rows]
    while True:
        tops = block_levels(rounds[-1]).where(F.col("place") % BLOCK == 0)
        if most <= BLOCK:
            return rounds, staged(tops.select("g", "node"), f"{name}-tops")
        most = -(-most // BLOCK)
        rounds.append(staged(tops.select("g", F.col("block").alias("place"), nodes_at(F.col("n"), LEVELS).alias("n"), "node"),
                             f"{name}-round{len(rounds)}"))


def descend(rounds: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The first round's rows with their whole path and the other columns of ``above`` (g, path, ...)."""
    kept = [c for c in above.columns if c not in ("g", "path")]
    above, keys = above.withColumnRenamed("path", "upper"), ["g"]
    for i, rows in reversed(list(enumerate(rounds))):
        found = block_levels(rows).join(above, keys).withColumn("path", F.concat("path", "upper")).drop("upper", "block")
        if i == 0:
            return found
        above, keys = staged(found.select("g", F.col("place").alias("block"), F.col("path").alias("upper"), *kept), f"{name}-path{i}"), ["g", "block"]
    raise ValueError("no rounds")


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """``rows`` with subroot, root and path (left and right siblings of every level, from the leaf up)."""
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # no nulls; those of a null group come first
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), named.alias("g"),
                         *[F.col(f"`{c}`").alias(f"order{i}") for i, c in enumerate(order)], F.col(leaf).alias("node"))
    leaves = numbered(packed, [*[f"order{i}" for i in range(len(order))], "node"], "merkle").select("row", "g", "place", "n", "node")
    rounds, tops = climb(leaves, "merkle")
    groups = numbered(tops.select(F.struct("g").alias("row"), F.lit("").alias("g"), F.col("g").alias("order0"), "node"), ["order0"], "merkle-groups")
    group_rounds, root = climb(groups.select("row", "g", "place", "n", "node"), "merkle-groups")
    root = root.select("g", F.col("node").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = descend(group_rounds, root, "merkle-groups").select("row.g", "path", "root")
    above = staged(above.join(tops.withColumnRenamed("node", "subroot"), "g"), "merkle-subroots")
    return descend(rounds, above, "merkle").select("row.*", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, e: digest(F.concat(e["left"], node, e["right"])))
