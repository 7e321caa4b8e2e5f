import random
import re

import numpy as np
import pytest
import xxhash

from fundflow.llm import simhash as S
from fundflow.llm.components import components


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(values, limit):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= limit
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprint_against_a_plain_version(spark):
    random.seed(2)
    for _ in range(1500):
        text = "".join(random.choices("abÀZİé \t\n\x0b\x1c\x85 ", k=random.randint(0, 50)))
        assert S.fingerprint(text, 3) == plain_fingerprint(text), repr(text)
    shingle = "one two three"
    from pyspark.sql import functions as F
    assert spark.range(1).select(F.xxhash64(F.lit(shingle))).first()[0] % 2 ** 64 == xxhash.xxh64_intdigest(shingle.encode(), 42)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 7])
def test_links_find_every_group(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "BLOCK", 16)  # hot anchors are split
    random.seed(bits)
    values = []
    for centre in [random.getrandbits(64) for _ in range(30)] + [0]:
        for _ in range(random.randint(1, 12)):
            x = centre
            for _ in range(random.randint(0, bits + 1)):
                x ^= 1 << random.randrange(64)
            values.append(x)
    values = list(dict.fromkeys(values + [values[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(values)], "rep long, fp long")
    found = {r.node: r.component for r in components(S.links(df, bits)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == plain_labels(np.array(values, np.uint64), bits).tolist()


def rows_of(n):
    random.seed(9)
    base = [" ".join(random.choices("abcdefgh", k=40)) for _ in range(n)]
    rows = [(i, t, "en") for i, t in enumerate(base)] + [(100 + i, base[i % 3].upper(), "en") for i in range(30)]
    return rows + [(200, None, "en"), (201, "", None), (202, " \n", "en"), (203, "Two words", "en"), (204, "two\tWORDS", "en"),
                   (205, "x " * 40000, "en"), (None, base[0], "en"), (100, base[0].upper(), "en")]


def test_groups_against_a_plain_version(documents):
    rows = rows_of(12)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.groups(documents(rows)).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    known = [(d, p) for (d, *_), p in zip(rows, prints) if d is not None]
    label = plain_labels(np.array([p for _, p in known], np.uint64), 3)
    least = {}
    for (d, _), l in zip(known, label):
        least[l] = min(least.get(l, d), d)
    expected = [(d, f"{p:016x}", least[l]) for (d, p), l in zip(known, label)] + [(None, f"{prints[-2]:016x}", None)]
    assert got == sorted(expected, key=str)


def test_keep_one_of_each_group(documents):
    docs = documents(rows_of(12))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r.doc_id: r.component_id for r in S.groups(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({c for c in groups.values() if c is not None}) and ids.count(None) == 1
    assert S.keep_one(documents([])).collect() == [] and S.groups(documents([])).collect() == []


def test_keep_one_where_ids_repeat(documents):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    docs = documents([(1, a, "en"), (2, a, "en"), (2, b, "en"), (2, b, "en"), (3, c, "en"), (3, d, "en"), (None, a, "en"), (None, a, "en")])
    got = sorted(((r.doc_id, r.text) for r in S.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (None, a), (None, a)], key=str)
