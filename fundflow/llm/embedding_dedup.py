"""Embedding near-duplicates by spherical k-means cells (operator 5).

Centroids are fitted by spherical k-means on a bounded sample of unit vectors (SAMPLE_ROWS
by hash). Every vector then goes to each cell in which it can have a partner: for a pair
with cosine >= t the two unit vectors are at most e = sqrt(2 - 2t) apart, so both lie within
e / 2 of their midpoint, and the cell of the midpoint has both within reach::

    x . c  >=  x . c'  -  |c - c'| e / 2      for every other centroid c'

A pair that meets in several cells counts in one, the common cell with the largest
x . c + y . c (both numbers travel with the vectors, so all tasks agree). No pair is missed
and none counted twice, whatever the centroids are; they only decide the amount of work.

Within a (label, cell) vectors are cut into blocks of about BLOCK rows by a hash and
compared block against block by matrix products, one task for each pair of blocks, so a
label or cell that holds a third of all rows is spread over many tasks. A task returns
counts per vector and a spanning set of links, never the pairs. Equal vectors of a label
are collapsed first and count by their number.

Cases: vectors that are null, empty or zero, or hold a null or non-finite component, and
rows with a null label, link with nothing and are kept; vectors of different lengths never
link; repeated rows of one vec_id are copies of it like any others; a row with a null
vec_id links with nothing and has no component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, staged
from fundflow.llm.components import components, contracted

SIMILARITY = 0.98
#: Vectors that the centroids are fitted to, rows a cell should have, most centroids, and rounds.
SAMPLE_ROWS, CELL_ROWS, MOST_CELLS, ROUNDS = 16_384, 4096, 2048, 12
BLOCK = 1024
#: Added to the reach of a cell for rounding.
SLACK = 1e-9


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v) -> bool:
    if v is None or len(v) == 0 or any(c is None for c in v):
        return False
    a = np.array(v, np.float64)
    return bool(np.isfinite(a).all() and a.any())


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit rows: assign by cosine, average, normalise; an empty cell keeps its centroid."""
    random = np.random.default_rng(11)
    c = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        cell = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def centroids(rows: DataFrame) -> np.ndarray:
    """Centroids for the most common vector length, from a bounded sample chosen by hash."""
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0))
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    k = min(MOST_CELLS, SAMPLE_ROWS // 8, -(-n // CELL_ROWS))
    share = min(1.0, SAMPLE_ROWS / n)
    sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vector", "label"), F.lit(2 ** 32)) <= int(share * 2 ** 32)))
    # about SAMPLE_ROWS vectors reach the driver
    got = [r.vector for r in sample.select("vector", F.xxhash64("vector", "label").alias("h")).sort("h").collect()]
    return spherical_kmeans(unit_rows(got), min(k, len(got))) if got else np.zeros((0, dim))


def distinct_vectors(table: DataFrame) -> DataFrame:
    """label, vector, dim, rep (the smallest vec_id) and copies of each distinct usable vector."""
    @F.arrow_udf("boolean")
    def fine(vectors: pa.Array) -> pa.Array:
        return pa.array([usable(v) for v in vectors.to_pylist()], pa.bool_())

    return (table.where(fine("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
            .withColumn("dim", F.size("vector"))
            .groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))


def in_cells(rows: DataFrame, c: np.ndarray, reach: float) -> DataFrame:
    """A row for each cell that a vector reaches: label, dim, cell, rep, copies, vector, cells, nearness."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) if len(c) else c
    held = rows.sparkSession.sparkContext.broadcast((c, apart))  # MOST_CELLS centroids and their distances

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, gap = held.value
        for batch in batches:
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            lists, near = [[0]] * len(dim), [[0.0]] * len(dim)
            at = np.flatnonzero(dim == centre.shape[1]) if len(centre) else np.zeros(0, np.int64)
            if len(at):
                dots = unit_rows(batch.column("vector").take(pa.array(at)).to_pylist()) @ centre.T
                own = dots.argmax(axis=1)
                mask = dots >= dots[np.arange(len(at)), own][:, None] - gap[own] * reach - SLACK
                for i, row, m in zip(at, dots, mask):
                    lists[i] = np.flatnonzero(m)
                    near[i] = row[m]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.float64()))],
                                             [*batch.schema.names, "cells", "nearness"])

    columns = "label string, dim int, vector array<double>, rep long, copies long"
    return (rows.select("label", "dim", F.col("vector").cast("array<double>").alias("vector"), "rep", "copies")
            .mapInArrow(place, columns + ", cells array<int>, nearness array<double>")
            .withColumn("cell", F.explode("cells")))


def home_cells(cells: list[np.ndarray], near: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a group of rows, sorted, and a matrix of each row's nearness to them (-inf: not reached)."""
    known = np.unique(np.concatenate(cells))
    out = np.full((len(cells), len(known)), -np.inf)
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    out[row, np.searchsorted(known, np.concatenate(cells))] = np.concatenate(near)
    return known, out


def compared(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: the rows' links counted by copies, and spanning links (a, b)."""
    x = unit_rows(group.column("vector").to_pylist())
    rep, copies, block = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
    cell, low, high = (group.column(c)[0].as_py() for c in ("cell", "i", "j"))
    cells = [np.array(v) for v in group.column("cells").to_pylist()]
    near = [np.array(v) for v in group.column("nearness").to_pylist()]
    several = np.array([len(v) > 1 for v in cells])
    known, reached = home_cells(cells, near)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    linked, a, b = np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        i, j = np.nonzero(x[rows] @ x[right].T >= similarity)
        i, j = rows[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        unsure = several[i] & several[j]
        keep = ~unsure
        for some in np.array_split(np.flatnonzero(unsure), 1 + int(unsure.sum()) * len(known) // (1 << 22)):
            keep[some] = known[(reached[i[some]] + reached[j[some]]).argmax(axis=1)] == cell
        i, j = i[keep], j[keep]
        linked += np.bincount(i, copies[j], len(x)).astype(np.int64) + np.bincount(j, copies[i], len(x)).astype(np.int64)
        if len(i):
            a, b = contracted(np.concatenate([a, i]), np.concatenate([b, j]))
    return rep, linked, a, b


def groups(table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding, label)."""
    bounded_batches(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"),
                        F.col("label").cast("string").alias("label"))
    nodes = staged(distinct_vectors(rows), "distinct-vectors")
    placed = in_cells(nodes, centroids(nodes), float(np.sqrt(max(0.0, 2 - 2 * similarity)) / 2))
    key = ["label", "dim", "cell"]
    large = staged(placed.groupBy(*key).count().select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
                   .where("blocks > 1"), "large-cells")
    blocks = F.coalesce("blocks", F.lit(1))
    work = (placed.join(large, key, "left")
            .select(*key, F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"),
                    F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"), "rep", "copies", "vector", "cells", "nearness")
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other"))

    def compare(group: pa.Table) -> pa.Table:
        """Rows (node, null, links) and spanning links (node, other, 0)."""
        rep, linked, a, b = compared(group, similarity)
        some = np.flatnonzero(linked)
        return pa.table({
            "node": pa.array(np.concatenate([rep[some], rep[a]]), pa.int64()),
            "other": pa.array(np.concatenate([rep[some], rep[b]]), pa.int64(), mask=np.arange(len(some) + len(a)) < len(some)),
            "links": pa.array(np.concatenate([linked[some], np.zeros(len(a), np.int64)]), pa.int64())})

    found = staged(work.groupBy(*key, "i", "j").applyInArrow(compare, "node long, other long, links long"), "vector-links")
    counted = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = staged(nodes.join(counted, nodes.rep == counted.node, "left").drop("node")
                .join(joined, F.col("rep") == F.col("node"), "left")
                .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                        F.coalesce("component", "rep").alias("component")), "vector-components")
    given = F.col("vec_id").isNotNull()
    return (rows.join(of, ["label", "vector"], "left")
            .select("vec_id", F.when(given, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    F.when(given, F.coalesce("component", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
