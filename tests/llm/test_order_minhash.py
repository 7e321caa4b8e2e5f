import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fundflow.llm import order_minhash as O
from fundflow.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = 2 ** 64


def xx(*values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True) if abs(v) < 2 ** 31 else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - ALL if h >= ALL // 2 else h


def xx_pair(kmer, number):
    h = xxhash.xxh64_intdigest((kmer % ALL).to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(number.to_bytes(4, "little"), h)


def murmur(longs):
    def rot(x, r):
        return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = 42
    for v in longs:
        h1 = h
        for k in (v & 0xFFFFFFFF, (v >> 32) & 0xFFFFFFFF):
            k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h1 = (rot(h1 ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h1 ^= 8
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h1 = (h1 ^ (h1 >> shift)) * factor & 0xFFFFFFFF
        h = h1 ^ (h1 >> 16)
    return h


def plain(text, k=2, size=2, count=16):
    """Every slot by sorting all pairs anew."""
    w = WORD.findall(text or "")
    if not w:
        return "00000000" * count
    kmers = [xx(*w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    n, low, seen, keys = len(kmers), (1 << len(kmers).bit_length()) - 1, Counter(), []
    for i, x in enumerate(kmers):
        keys.append((xx_pair(x, seen[x]) & ~low | (i + 1), i))
        seen[x] += 1
    out = []
    for s in range(count):
        start = s * (ALL // count) - ALL // 2
        least = sorted(((key - start) % ALL, i) for key, i in keys)[:size]
        out.append(murmur([kmers[i] % ALL for i in sorted(i for _, i in least)]))
    return "".join(f"{x:08x}" for x in out)


TEXTS = ["", None, " \n\t", "one", "one two", "one two three", "a a a a a a a a", "a b a b a b a b a b a", "é x 日本 語\x0bz",
         " ".join(random.Random(3).choice("abcdefgh") for _ in range(700)), " ".join(f"w{i}" for i in range(300))]


@pytest.mark.parametrize("k, size, count", [(2, 2, 16), (1, 3, 8), (5, 1, 32), (3, 4, 64)])
def test_against_a_plain_version(documents, k, size, count):
    rows = documents([(i, t, "en") for i, t in enumerate(TEXTS)]).select(
        "doc_id", O.written(O.slots(F.col("text"), k, size, count)).alias("f")).collect()
    assert {r.doc_id: r.f for r in rows} == {i: plain(t, k, size, count) for i, t in enumerate(TEXTS)}


def test_order_and_edits_count(documents):
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(2000)]

    def edited(share):
        return [f"x{rng.randrange(4000)}" if rng.random() < share else w for w in base]

    cut = base[1000:] + base[:1000]  # the same words and nearly the same pairs of words, in another order
    texts = [base, edited(0.02), edited(0.1), edited(0.3), edited(0.9), cut, sorted(base)]
    rows = documents([(i, " ".join(t), "en") for i, t in enumerate(texts)]).select("doc_id", O.slots(F.col("text"), count=512).alias("f")).collect()
    f = {r.doc_id: r.f for r in rows}
    near = [sum(a == b for a, b in zip(f[0], f[i])) / 512 for i in range(len(texts))]
    assert near[0] == 1 and near[1] > 0.8 > near[2] > 0.4 > near[3] > near[4] and near[4] < 0.05
    assert 0.3 < near[5] < 0.7  # two of k-mers from different halves change places
    assert near[6] < 0.02


def following(rows):
    """The next text of each row, in descending order of doc_id, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    return [(r[0], r[1], order[(i + 1) % len(order)][1]) for i, r in enumerate(order)]


@pytest.mark.parametrize("slice_bytes", [1, 60, 1 << 20])
def test_next_document(documents, slice_bytes):
    rng = random.Random(4)
    ids = rng.sample(range(-5000, 5000), 200)
    rows = [(i, f"text {i} é" * rng.randint(0, 4), "en") for i in ids]
    rows += [(9000, "twice", "en")] * 2 + [(None, "nobody", "en")] + [(77777, "crowd", "en")] * 900
    got = O.with_next(documents(rows), {"next": "text", "next_id": "doc_id"}, slice_bytes).collect()
    assert sorted(((r.doc_id, r.text, r.next) for r in got), key=str) == sorted(following([r[:2] for r in rows]), key=str)
    assert {r.next_id for r in got if r.doc_id is None} == {77777} and all(r.key == "x" for r in got)


def test_one_id_with_many_texts(documents):
    rows = [(5, f"text {i}", "en") for i in range(60)] + [(4, "a", "en"), (6, None, "en")]
    got = {(r.doc_id, r.text): r.next for r in O.with_next(documents(rows), {"next": "text"}, 20).collect()}
    assert len(got) == 62 and got[(6, None)].startswith("text") and got[(4, "a")] is None
    assert sorted(v for k, v in got.items() if k[0] == 5) == sorted([f"text {i}" for i in range(60) if f"text {i}" != got[(6, None)]] + ["a"])


def test_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(0, 80)))) for i in range(40)]
    rows += [(50, None), (51, "equal text é"), (52, "equal text é"), (53, " ".join(f"long{i % 977}" for i in range(30000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op13_order_minhash(spark, str(tmp_path)).collect()}
    import hashlib

    def near(a, b):
        return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)

    assert len(got) == len(rows)
    for i, text, after in following([(i, t or "") for i, t in rows]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        f, e = plain(text, count=O.SLOTS), plain(edited, count=O.SLOTS)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e)
        assert (r.near_edited, r.near_next) == (near(f, e), near(f, plain(after, count=O.SLOTS)))
    assert got[52].near_next == 1


def test_native_and_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = Q.op13_order_minhash(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("regexp_extract_all") == 2  # the text's and the edited text's, once each


def test_empty_table(documents):
    assert O.with_next(documents([]), {"next": "text"}).collect() == []
