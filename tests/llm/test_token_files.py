import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fundflow.llm import token_files as T
from fundflow.llm.word_bpe import WordEncoder, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    words = T.pack(ids, bits)
    assert words.nbytes == -(-1000 * bits // 64) * 8
    assert (T.unpack(words, bits, 1000) == ids).all()
    assert len(T.pack(ids[:0], bits)) == 0


def test_width_is_the_fewest_bits():
    assert [T.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access_within_a_shard(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", 64)
    arrays = [np.arange(n, dtype=np.uint32) for n in (0, 1, 63, 64, 65, 500)]
    shard = T.Shard(T.build_shard([5, None, 7, 7, 9, 10], arrays, 9))
    every = np.concatenate(arrays)
    for a, b in [(0, 0), (0, 1), (10, 64), (63, 65), (64, 128), (100, 693), (692, 693)]:
        assert (shard.read_range(a, b) == every[a:b]).all()
    assert [list(shard.document(i)) for i in range(6)] == [list(a) for a in arrays]
    assert list(shard.null) == [False, True, False, False, False, False]
    with pytest.raises(ValueError):
        T.build_shard([1], [np.array([512], np.uint32)], 9)


def test_encoder_equals_the_library():
    encoder, plain = WordEncoder.of(vocabulary(PATH)[0]), Tokenizer.from_file(PATH)
    random.seed(3)
    alphabet = list("abAZ éÉß12  \n.,'st!&#😀日ñÿŸſ") + ["\u0301", "\u0130", "\u01c5", "\x1c", "\x85", "\t", "<|endoftext|>", "'ll"]
    for _ in range(2000):
        text = "".join(random.choices(alphabet, k=random.randint(0, 25)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batches_of_any_vocabulary_equal_the_library(name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    encoder, plain = WordEncoder.of(vocabulary(path)[0]), Tokenizer.from_file(path)
    random.seed(4)
    texts = ["Hello world", None, "", " ", "\n\n", "one\ntwo  three", "Ünïcode\t\u0301x"] + [
        "".join(random.choices("abAZ éÉ12  \n.,'st!日\t", k=random.randint(0, 60))) for _ in range(500)]
    ids, ends = encoder.encode_all(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [len(x) for x in encoder.encode_all(pa.array([], pa.string()))] == [0, 0]


def test_files_against_a_plain_version(spark, documents, monkeypatch):
    rows = [(7, "seven words are in this short text", "en"), (3, None, "en"), (5, "", None), (4, "word " * 3000, "en"),
            (9, "same", "en"), (9, "same", "en"), (-2, "Ärger über Öl", "de"), (None, "no id", "en")]
    plain = Tokenizer.from_file(PATH)
    got = [tuple(r) for r in T.token_files(documents(rows), PATH, 2).orderBy("start").collect()]
    expected, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_read_ids_and_empty_table(spark, documents):
    from fundflow.session import new_location

    docs = documents([(1, "a b c", "en"), (2, "d", "en")])
    path = T.write(docs, new_location(spark, "t"), PATH, 2)
    plain = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.ids for r in T.read(spark, path, with_ids=True).collect()}
    assert got == {1: plain.encode("a b c", add_special_tokens=False).ids + [2], 2: plain.encode("d", add_special_tokens=False).ids + [2]}
    assert T.token_files(documents([]), PATH, 2).collect() == []
