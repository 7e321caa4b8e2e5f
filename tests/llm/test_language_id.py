import random
import zlib

import numpy as np
import pytest

from fundflow.llm import language_id as L

SYLLABLES = {"en": "the ing and th er wh sh ou".split(), "de": "sch ung ein ch ü ß tz pf".split(), "fr": "eau ou è é que ai ê oi".split(), "es": "ción ñ que rr ll ar os í".split()}


def made(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def test_held_out_accuracy(documents):
    rows = made(500)
    got = {r.doc_id: r for r in L.languages(documents(rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_languages_are_not_learned(documents):
    rows = made(300)
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    assert sorted(L.languages(documents(rows)).collect()) == sorted(L.languages(documents(turned)).collect())


def test_undetermined_and_edge_cases(documents):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !? …", "de"), (1003, "the and ing " * 200000, "en"), (None, "ein schung", "de"),
           (1004, "eau que", None), (1005, "the and", "en"), (1005, "the and", "en")]
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in L.languages(documents(made(300) + odd)).collect()]
    of = {g[0]: g for g in got}
    assert len(got) == 308 and all(of[i][1:3] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert of[1003][1] == "en" and of[None][1] == "de" and of[None][3] is False and of[1004][1] == "fr"
    assert L.languages(documents([])).collect() == []
    assert all(r.lang_pred == "und" for r in L.languages(documents([(1, "no labels", None), (3, "none", None)])).collect())


def test_long_text_counts_like_one_piece(monkeypatch):
    text = "Ein Übergang, 1234 und   mehr. " * 50
    whole = L.counts(text)
    monkeypatch.setattr(L, "PIECE", 37)
    cut = L.counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_penalty_makes_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(2)
    examples = []
    for _ in range(300):
        label = int(rng.integers(0, 2))
        examples.append((np.array([label, 2 + int(rng.integers(0, 200))]), np.array([0.9, 0.1]), label))
    w, b = L.ftrl(examples, 2)
    assert (w[:2] != 0).all() and (w[300:] == 0).all() and (w[2:202] == 0).mean() > 0.3
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(logits)])
    assert abs(L.temperature(5 * logits, labels) - 5) < 0.5


def test_filter_keeps_columns_and_clean_documents(documents):
    rows = made(300)
    docs = documents(rows + [(900, "1234", "en"), (901, None, "en")])
    kept = L.keep_identified(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {900, 901} and len(ids) >= 295


@pytest.mark.parametrize("n", [1, 2, 4, 40])
def test_rejection_does_not_depend_on_the_number_of_languages(documents, n):
    rng = np.random.default_rng(n)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    names = [f"l{k:02}" for k in range(n)]
    syllables = {k: ["".join(rng.choice(alphabet, 3)) for _ in range(25)] for k in names}
    rows = []
    for i in range(max(240, 40 * n)):
        lang = names[i % n]
        words = ["".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(rng.integers(1 if i % 10 == 0 else 5, 40))]
        rows.append((i, " ".join(words), lang))
    foreign = [(100_000 + i, "\u03b1\u03b2\u03b3\u03b4 \u03b5\u03b6\u03b7" * 5, None) for i in range(5)]  # letters never seen
    kept = {r.doc_id for r in L.keep_identified(documents(rows + foreign + [(200_000, "12 34", "l00")])).collect()}
    assert len(kept & {r[0] for r in rows}) >= 0.99 * len(rows) and 200_000 not in kept
    assert not kept & {r[0] for r in foreign}
