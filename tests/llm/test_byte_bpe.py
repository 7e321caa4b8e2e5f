import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from fundflow.llm import byte_bpe as B

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return B.ByteCodec.of(open(FILE, "rb").read(), PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    ranks = B.read_ranks(open(FILE, "rb").read())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_table_is_a_bijection():
    table = B.byte_table()
    assert len(table) == len(set(table.values())) == 256 and all(c.isprintable() and not c.isspace() for c in table.values())


def test_ids_equal_the_rank_merger(codec, reference):
    random.seed(1)
    tokens = [t.decode() for t in codec.token.values() if t.isascii()]
    texts = ["".join(random.choices(tokens, k=random.randint(1, 5))) for _ in range(5000)]
    texts += ["".join(random.choices("aeé.0- ha\n日😀", k=random.randint(0, 20))) for _ in range(5000)]
    texts += [c * n + d * m for c in "a. =0é" for d in " .e" for n in range(1, 25) for m in (0, 1, 2, 3)]
    texts += ["x" * 5000, "ab" * 3000, " " * 4000, "<|endoftext|>"]
    for text in texts:
        ids = codec.encode(text)
        assert list(B.ids_of(ids)) == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_offsets_and_split_characters(codec):
    text = "naïve 日本😀 text"
    ids = codec.encode(text)
    offsets = codec.offsets(ids)
    assert offsets[0][0] == 0 and offsets[-1][1] == len(text.encode())
    assert all(codec.token[i] == text.encode()[a:b] for i, (a, b) in zip(B.ids_of(ids), offsets))
    decoder = B.TextDecoder(codec)
    parts = [decoder.feed(struct.pack("<I", i)) for i in B.ids_of(ids)] + [decoder.feed(b"", last=True)]
    assert "".join(parts) == text and "\ufffd" not in "".join(parts)


def test_round_trip_of_a_table(documents, reference):
    rows = [(1, "Hello  world\n", "en"), (2, None, None), (3, "", "en"), (4, "long text é " * 20000, "fr"), (4, "x", "en"),
            (4, "x", "en"), (None, "no id", "en")]
    got = sorted((tuple(r) for r in B.round_trip(documents(rows), FILE, PATTERN).collect()), key=str)
    expected = []
    for doc_id, text, _ in rows:
        ids = reference.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    assert B.round_trip(documents([]), FILE, PATTERN).collect() == []


def test_encode_and_decode_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(1, "naïve 日本", "en"), (2, None, "en")])
    e = B.encode_column(spark, FILE, PATTERN, offsets=True)
    d = B.decode_column(spark, FILE, PATTERN)
    rows = docs.select("doc_id", e(F.col("text")).alias("e")).select("doc_id", "e.*").withColumn("back", d("ids")).orderBy("doc_id").collect()
    assert [r.back for r in rows] == ["naïve 日本", ""] and rows[0].ends[-1] == len("naïve 日本".encode())
