import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fundflow.llm import merkle as M
from fundflow.llm import queries as Q


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and of each node the siblings on its way there: (left, right) level by level."""
    paths, above = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, above):
            run = at - at % 8
            path.append((nodes[run:at], nodes[at + 1:run + 8]))
        above = [at // 8 for at in above]
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def lower(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([n[2] for n in sorted(groups[g], key=lambda n: n[:3])]) for g in langs}
    root, upper = tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda n: n[:3]), trees[g][1]):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], lower(r[4]))) if hit else own
            for left, right in path:
                node = H(*left, node, *right)
            out.append((r[0], own, trees[g][0], root, H(*[x for s in path for side in s for x in side]), node, node == root))
    return sorted(out, key=str)


def written(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.selectExpr("*", "'a' as leaf", "1 as root", "2 as path", "3 as g").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")


def run(spark, tmp_path):
    return sorted((tuple(r) for r in Q.op11_merkle(spark, str(tmp_path)).collect()), key=str)


def some_rows():
    rng = random.Random(5)
    rows = []
    for lang, n in (("en", 1100), ("de", 513), ("fr", 64), ("é", 65), ("", 9), ("es", 1), (None, 7), ("zz", 8), ("-", 2), ("=", 3)):
        rows += [(i, rng.choice(["s1", None]), lang, rng.choice([None, 5]), rng.choice([None, "", "Ab É", "abc", "XYZ"])) for i in rng.sample(range(10 ** 6), n)]
    rows += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (-4, "s", "en", 1, "LONG É " * 50000)] + [(77, "s", "en", 1, "Twice")] * 40
    return rows


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("merkle")
    rows = some_rows()
    written(spark, path, rows)
    return rows, run(spark, path), path


def test_against_a_plain_version(both):
    rows, got, _ = both
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_sql_agrees(both):
    rows, got, path = both
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    answer = con.execute(Q.ORACLE["op11_merkle"])
    assert [c[0] for c in answer.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(answer.fetchall(), key=str) == got


def test_a_changed_row_is_found(spark, tmp_path):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = df.select("doc_id", "lang", M.leaf_of([F.col(c) for c in Q.LEAF]).alias("leaf"))
    found = M.manifest(leaves, "lang", ["doc_id"]).withColumn("wrong", F.when(F.col("doc_id") == 600, F.sha2(F.lit(b""), 256)).otherwise(F.col("leaf")))
    bad = found.where(M.folded(F.col("wrong"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [600]


def test_one_row_and_none(spark, tmp_path):
    written(spark, tmp_path / "one", [(3, None, None, None, None)])
    own = leaf((3, None, None, None, None))
    assert run(spark, tmp_path / "one") == [(3, own, own, own, H(""), own, True)]
    written(spark, tmp_path / "none", [])
    assert run(spark, tmp_path / "none") == []


def test_windows_cover_blocks_only(spark, tmp_path):
    written(spark, tmp_path, [(i, "s", "en", 1, "t") for i in range(20)])
    plan = Q.op11_merkle(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "block" in plan
