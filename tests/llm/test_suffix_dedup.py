import random
import re

import pytest

from fundflow.llm import suffix_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, k):
    first, split = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - k + 1):
            if i is not None:
                first[tuple(w[a:a + k])] = min(first.get(tuple(w[a:a + k]), i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if i is not None and first[tuple(w[a:a + k])] < i:
                gone[a:a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(docs, k):
    return sorted(((r.doc_id, r.n_words, sum(s["end"] - s["start"] for s in r.removed), r.kept)
                   for r in S.remove_repeats(docs, k).collect()), key=str)


@pytest.mark.parametrize("block, group", [(8 << 20, 1 << 21), (600, 8)])
def test_against_a_plain_version(documents, monkeypatch, block, group):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "GROUP_SUFFIXES", group)
    random.seed(5)
    passages = [[random.choice("abcdef") + random.choice("gh") for _ in range(random.randint(3, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = sum((random.choice(passages) + [random.choice("xyz")] for _ in range(random.randint(0, 6))), [])
        rows.append((random.randint(0, 50), "".join(w + random.choice([" ", "\n", "\t ", "\x0b"]) for w in words), "en"))
    rows += [(None, " ".join(passages[0] * 3), "en"), (3, None, "en"), (4, "", "en"), (8, " \n ", None),
             (60, "one two", "en"), (61, "a\u00a0b c\x1cd é " * 20, "en"), (62, "a\u00a0b c\x1cd é " * 20, "en"),
             (-1, " ".join(passages[1] * 4), "en"), (-1, " ".join(passages[1] * 4), "en")]
    assert run(documents(rows), 5) == plain([r[:2] for r in rows], 5)


def test_very_long_text_is_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000)).encode()
    whole = S.hash_words([text])
    monkeypatch.setattr(S, "PIECE", 101)
    cut = S.hash_words([b"", text, b"x", b"\xc3\xa9" * 200])
    assert (cut[0][:5000] == whole[0]).all() and list(cut[1][4999:]) == [1, 2, 3]


def test_packed_digests_round_trip():
    import numpy as np

    x = np.unique(np.random.default_rng(1).integers(0, 2 ** 64, 1000, dtype=np.uint64))
    assert (S.unpacked(S.packed(x)) == x).all() and len(S.unpacked(S.packed(x[:0]))) == 0


def test_empty_table(documents):
    assert S.remove_repeats(documents([])).collect() == []
