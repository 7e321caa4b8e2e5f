import random
import zlib

import numpy as np

from fundflow.llm import quality_gam as Q


def made(n):
    rng, rows = random.Random(8), []
    for i in range(n):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.random()
            words = [w + "###" for w in words] if kind < 0.3 else [w.upper() + "!!" for w in words] if kind < 0.6 else words[:2] * 40
        rows.append((i, " ".join(words), "en", int(good)))
    return rows


def test_held_out_accuracy_and_folds(spark, documents):
    rows = made(600)
    docs = documents([r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], r[3], 0, 9.0) for r in rows] + [(0, None, 0, 9.0), (None, 1, 0, 9.0), (9999, 1, 0, 9.0), (3, rows[3][3], 0, 9.0)],
                                   "doc_id long, quality int, toxic int, x double")
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert len(got) == 600
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in out}
    assert np.mean([got[r[0]].predicted == r[3] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(spark, documents):
    rows = made(200)
    docs = documents([r[:3] for r in rows])
    schema = "doc_id long, quality int"
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], schema)
    turned = spark.createDataFrame([(r[0], 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[3]) for r in rows], schema)
    assert sorted(Q.quality(docs, labels).collect()) == sorted(Q.quality(docs, turned).collect())


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert (7, 2) in model.pairs
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_edge_cases(spark, documents):
    rows = [(1, None, "en"), (2, "", None), (3, "x " * 50000, "en"), (None, "a b", "en"), (4, "a b", "en"), (4, "a b", "en")]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(documents(rows), none).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    rows += [(i, "plain words", "en") for i in range(5, 12)]
    one = spark.createDataFrame([(i, 1) for i in range(1, 12)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in Q.quality(documents(rows), one).collect())
    assert Q.quality(documents([]), one).collect() == []
    assert all(np.isfinite(Q.features(t)).all() for t in (None, "", " \n", "é", " ", "1", "#" * 1000))
