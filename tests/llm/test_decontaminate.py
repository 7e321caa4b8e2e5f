import random

import numpy as np

from fundflow.llm import decontaminate as D


def plain_distance(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        p, what = rng.randrange(len(words)), rng.random()
        if what < 0.6:
            words[p] = f"zz{rng.randrange(50)}"
        elif what < 0.8:
            words.insert(p, f"yy{rng.randrange(50)}")
        elif len(words) > 1:
            del words[p]
    return words


def corpus(seed, fraction):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(6, 60))]) for i in range(150)]
    docs = []
    for i, words in items:
        around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(2)]
        docs.append((i, around[0] + edited(words, int(fraction * D.edits(len(words))), rng) + around[1]))
    return items, docs


def test_best_stretch_against_plain_distance():
    rng = random.Random(4)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))
        distance, start, end = D.best_stretch(np.array(item), np.array(text))
        assert distance == plain_distance(item, text)
        assert plain_distance(item, text[start:end]) == distance and 0 <= start <= end <= len(text)


def test_recall_and_no_false_matches():
    for fraction, least in ((0.0, 1.0), (0.5, 0.99), (1.0, 0.95)):
        items, docs = corpus(7, fraction)
        index, hit = D.Benchmark(items), 0
        found = list(index.matches([" ".join(w) for _, w in docs]))
        for (truth, words), matches in zip(docs, found):
            hit += truth in {m[0] for m in matches}
            for item, start, end, distance, similarity in matches:
                assert distance <= D.edits(len(items[item][1])) and similarity >= D.SIMILARITY - 1e-9
                stretch = " ".join(words)[start:end].split()
                assert plain_distance(items[item][1], stretch) == distance
        assert hit >= least * len(docs), (fraction, hit)


def test_clean_documents_stay():
    items, _ = corpus(7, 0)
    rng = random.Random(11)
    words = sorted({w for _, item in items for w in item})
    found = D.Benchmark(items).matches([" ".join(rng.choice(words) for _ in range(400)) for _ in range(40)])
    assert not any(found)


def test_table(spark, documents):
    passage = "The quick brown fox jumps over the lazy dog while nine small birds look on from a tree"
    items = spark.createDataFrame([(1, passage, 1), (1, passage, 1), (2, None, 1), (3, "", 1), (None, passage, 1), (4, "tiny", 1), (5, "Ünï cödé words in here", 1)],
                                  "item_id long, text string, distance int")
    rows = [(1, f"before {passage.upper()}, after", "en"), (2, "nothing here at all", "en"), (3, None, "en"), (4, "", None),
            (5, "x y z " * 30000 + passage.replace("brown", "red"), "en"), (6, passage, "en"), (6, passage, "en"), (7, "a tiny one", "en"),
            (None, passage, "en"), (8, "İİİ said: ÜNÏ CÖDÉ words in here!", "de")]
    docs = documents(rows)
    got = D.contaminated(docs, items).collect()
    assert sorted({(r.doc_id, r.item_id, r.distance) for r in got}, key=str) == sorted(
        [(1, 1, 0), (5, 1, 1), (6, 1, 0), (7, 4, 0), (None, 1, 0), (8, 5, 0)], key=str)
    assert sum(r.doc_id == 6 for r in got) == 4  # both rows, for both copies of the item
    first = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][first.start:first.end] == passage.upper() and first.similarity == 1.0
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.contaminated(docs, items.limit(0)).collect() == [] and D.contaminated(documents([]), items).collect() == []
    assert D.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_benchmark_goes_out_in_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WORDS", 20)
    items, docs = corpus(3, 0)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items[:12]], "item_id long, text string")
    assert len(D.match_columns(spark, table)) > 5
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents([(i, " ".join(w), "en") for i, w in docs[:12]]), table).collect()}
    assert {(i, i) for i in range(12)} <= got


def edited_apart(words, k, rng):
    """k edits at places of their own."""
    out, places = [], set(rng.sample(range(len(words)), k))
    for p, word in enumerate(words):
        what = rng.random() if p in places else 1
        if what < 0.6:
            out.append(f"zz{rng.randrange(50)}")
        elif what < 0.8:
            out += [f"yy{rng.randrange(50)}", word]
        elif what == 1:
            out.append(word)
    return out


def test_recall_of_long_items():
    for n in (100, 250, 500):
        rng = random.Random(n)
        vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
        items = [(i, [rng.choice(vocabulary) for _ in range(n)]) for i in range(40)]
        index = D.Benchmark(items)
        for fraction, least in ((0.0, 1.0), (0.5, 0.99), (1.0, 0.95)):
            around = [rng.choice(vocabulary) for _ in range(20)]
            docs = [around + edited_apart(words, int(fraction * D.edits(n)), rng) + around for _, words in items]
            hit = sum(any(m[0] == i for m in matches) for i, matches in enumerate(index.matches([" ".join(w) for w in docs])))
            assert hit >= least * len(items), (n, fraction, hit)


def test_a_part_may_hold_its_share_of_the_edits():
    for n in range(1, 3000):
        cuts = D.cuts(n)
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == n
        assert all(b - a <= D.PART and D.edits(n) // len(cuts) <= D.edits(b - a) for a, b in cuts)


def test_edited_copies_around_a_verbatim_one():
    item = [f"w{i}" for i in range(20)]
    copies = [[*item[:5], "x", *item[6:15], "y", *item[16:]], [*item[:10], "z", *item[11:]], item, [*item[:3], "x", *item[4:]]]
    for order in ([0, 2], [2, 0], [0, 1, 2, 3], [1, 2, 0, 3], [3, 1, 2], [0, 2, 1, 2, 3]):
        text = " ".join(w for c in order for w in copies[c])
        matches = next(D.Benchmark([(7, item)]).matches([text]))
        assert [text[m[1]:m[2]].split() for m in matches] == [copies[c] for c in order]
        assert [m[3] for m in matches] == [(2, 1, 0, 1)[c] for c in order]


def test_items_that_are_too_short_can_be_left_out(spark, documents):
    items = spark.createDataFrame([(1, "common"), (2, "five words make an item"), (3, "")], "item_id long, text string")
    docs = documents([(1, "a common word", "en"), (2, "here five words make an item of it", "en"), (3, "nothing", "en")])
    assert {r.doc_id for r in D.drop_contaminated(docs, items).collect()} == {3}
    assert {r.doc_id for r in D.drop_contaminated(docs, items, least_words=5).collect()} == {1, 3}
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items, least_words=5).collect()] == [(2, 2)]


def test_an_index_is_made_once_a_worker(monkeypatch):
    class Held:
        value = [(1, ["one", "two", "three"])]
    monkeypatch.setattr(D, "_indexes", {})
    made = [D.index_of(k, Held) for k in ("a", "a", "b", "c", "c")]
    assert made[0] is made[1] and made[3] is made[4] and len(D._indexes) == D.INDEXES
