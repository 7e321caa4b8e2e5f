import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fundflow.llm import periodic_runs as P
from fundflow.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, least=24, times=3):
    """Every period at every place."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and all(any(w[x] != w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted((s, n, q) for s, n, q in out)


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_text(rng):
    letters = "ab" if rng.random() < 0.4 else "abcdefgh"
    w = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        w += part * rng.randint(1, 12) + part[:rng.randint(0, len(part))]
        w += [rng.choice(letters) for _ in range(rng.randint(0, 12))]
    return w


@pytest.mark.parametrize("least, times", [(24, 3), (1, 2), (6, 2), (10, 4)])
def test_against_a_plain_version(least, times):
    rng = random.Random(least)
    texts = [some_text(rng) for _ in range(250)] + [["a"] * 90, [], ["a"] * 23, ["a"] * 24, list("ab" * 12), list("abcdefghi" * 3), list("abcdefghi" * 3)[:-1]]
    got = list(P.judged([" ".join(t).encode() for t in texts], least, times))
    for t, (n, runs, kept) in zip(texts, got):
        want = plain(t, least, times)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert n == len(t) and kept.decode() == collapsed(t, want)


def test_sets_in_many_buckets(monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 3)
    rng = random.Random(2)
    places, held = P.Places(500), [500]
    for x in rng.sample([i for i in range(1000) if i != 500], 400):
        before, after = max([h for h in held if h < x], default=-1), min([h for h in held if h > x], default=-1)
        assert places.add(x) == (before, after)
        held.append(x)
    assert sum(places.buckets, []) == sorted(held) and places.size == len(held)


def test_common_prefix_of_sorted_suffixes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2, 300)
    owner = np.repeat([0, 1, 2], 100)
    p, q, lcp = P.neighbours(words, owner, 4)
    assert len(p)
    for a, b, n in zip(p, q, lcp):
        ends = [100 * (x // 100 + 1) for x in (a, b)]
        k = 0
        while a + k < ends[0] and b + k < ends[1] and a // 100 == b // 100 and words[a + k] == words[b + k]:
            k += 1
        assert k == n >= 4


def test_long_periodic_texts():
    w = [f"w{i}" for i in range(20011)]
    text = w * 3 + ["x"] * 50000
    n, runs, kept = next(P.judged([" ".join(text).encode()], 24, 3))
    assert [(r["start"], r["length"], r["period"]) for r in runs] == [(0, 3 * 20011, 20011), (3 * 20011, 50000, 1)]
    assert kept.decode() == " ".join(w + ["x"])


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(some_text(rng) if i % 2 else [f"é{rng.randrange(9000)}" for _ in range(rng.randint(0, 150))]))
            for i in range(300)]
    rows += [(None, "a " * 40), (900, None), (901, ""), (902, " \n"), (903, "a b c\x1cd " * 30), (903, "a b c\x1cd " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in Q.op12_periodic_runs(spark, str(tmp_path)).collect()]
    want = [expected(*r) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_other_columns_and_empty_table(documents):
    rows = P.collapse(documents([(1, "a " * 30, "en"), (2, None, "en")]).selectExpr("*", "1 as kept", "2 as runs")).collect()
    assert [(r.doc_id, r.kept, r.n_words) for r in sorted(rows)] == [(1, "a", 30), (2, "", 0)]
    assert P.collapse(documents([])).collect() == []
