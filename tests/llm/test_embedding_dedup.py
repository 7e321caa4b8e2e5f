import numpy as np
import pytest

from fundflow.llm import embedding_dedup as E


def plain(rows, limit=0.98):
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and E.usable(v)]
    unit = [(i, v / np.linalg.norm(v), l) for i, v, l in good]
    links = {i: set() for i, *_ in rows}
    count = {i: 0 for i, *_ in rows}
    for a, (i, v, l) in enumerate(unit):
        for j, w, m in unit[a + 1:]:
            if l == m and len(v) == len(w) and v @ w >= limit:
                count[i] += 1
                count[j] += 1
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (count[i], min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("cell, block", [(4096, 1024), (20, 16)])
def test_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(E, "CELL_ROWS", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    random = np.random.default_rng(3)
    rows, i = [], 0
    for g in range(40):
        centre, label = random.normal(size=8), int(random.integers(0, 3))
        for _ in range(int(random.integers(1, 14))):
            rows.append((i, [float(np.float32(x)) for x in centre + random.normal(size=8) * 0.12], label))
            i += 1
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(50)]  # exact copies
    rows += [(1100, None, 1), (1101, [], 1), (1102, [0.0] * 8, 1), (1103, [float("nan")] + [1.0] * 7, 1), (1104, [None] + [1.0] * 7, 1),
             (1105, rows[5][1], None), (1106, rows[5][1][:7], rows[5][2]), (1107, [float("inf")] * 8, 1), (1108, [1e30] * 8, 2), (1109, [2e30] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as dim", "2 as cell", "3 as component_id")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.groups(df).collect()}
    assert got == plain(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.groups(df).collect()), key=str) == [(2, 0, 2, True), (None, 0, None, True)]
    assert E.groups(df.limit(0)).collect() == []
