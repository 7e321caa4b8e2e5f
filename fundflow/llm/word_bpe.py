"""Fast encoding with the tokenizers library.

A vocabulary whose normalizer and pre-tokenizer are those of ``BY_WORD`` drops white space and lets no
pre-token cross it, so the ids of a text are those of its space-separated chunks in turn. No pre-token goes on from
a letter to a mark either, so chunks are cut there too (but not before an apostrophe, which opens
contractions, or "<" and "|", which special tokens hold). Invented or natural, words repeat: the pieces of a whole
batch are cut by numpy and numbered by Arrow, each distinct one is encoded once, and the ids are gathered by
number. A worker remembers the pieces it has met (a bounded memory, cleared when full) and asks the
library only for new ones. Texts of any other vocabulary go to the library as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers, and the longest of them in characters.
MEMORY, LONGEST = 1_000_000, 40
#: Letters whose lower case and NFC form are made character by character.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

_code = np.arange(256)
SPACE = (_code == 0x20) | (_code == 0x0A)
LETTER = ((_code | 0x20) >= 0x61) & ((_code | 0x20) <= 0x7A) & (_code < 0x80)
MARK = (_code > 0x20) & (_code < 0x7F) & ~LETTER & ~((_code >= 0x30) & (_code <= 0x39)) & ~np.isin(_code, [0x27, 0x3C, 0x7C])
LOWER = np.where(LETTER, _code | 0x20, _code).astype(np.uint8)

# The steps before the model of a vocabulary that can be encoded chunk by chunk.
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)

_encoders: dict[str, "WordEncoder"] = {}


def vocabulary(path: str) -> tuple[bytes, int]:
    """The bytes of a vocabulary file and the number of its ids."""
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        data = f.read()
    ids = Tokenizer.from_buffer(data).get_vocab(with_added_tokens=True).values()
    return data, max(ids) + 1


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """encode(text), encode_all(texts): ids without special tokens, of any vocabulary file of the library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        steps = json.loads(data)
        self.by_word = (steps["normalizer"], steps["pre_tokenizer"]) == BY_WORD
        self.tokenizer = Tokenizer.from_buffer(data)
        self.model, self.known = self.tokenizer.model, {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letter = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, (*range(97, 123), *range(0xDF, 0x100)))}

    @classmethod
    def of(cls, data: bytes) -> "WordEncoder":
        key = hashlib.sha256(data).hexdigest()
        if key not in _encoders:
            _encoders[key] = cls(data)
        return _encoders[key]

    def whole(self, piece: str) -> bytes:
        return packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """The ids of a PLAIN word: one pre-token, spelt as the library spells its bytes."""
        word = word.lower()
        spelt = word if word.isascii() else "".join(map(self.letter.__getitem__, word))
        return packed([t.id for t in self.model.tokenize(spelt)])

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of some distinct pieces."""
        known, out = self.known, list(map(self.known.get, pieces))
        new = [i for i, ids in enumerate(out) if ids is None]
        for i in new:
            piece = pieces[i]
            out[i] = self.word(piece) if PLAIN.fullmatch(piece) else self.whole(piece)
        if len(known) + len(new) > MEMORY:
            known.clear()
        known.update((pieces[i], out[i]) for i in new if len(pieces[i]) <= LONGEST)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian u32 bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text end; a null text is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        bodies = [t.encode() for t in texts.to_pylist()]
        data = b"\n".join(bodies)
        code = np.frombuffer(data, np.uint8)
        if b"<" not in data:  # a special token's text keeps its case
            code = LOWER[code]
        filled = ~SPACE[code]
        start = filled.copy()
        start[1:] &= SPACE[code[:-1]] | (LETTER[code[:-1]] & MARK[code[1:]])
        starts, text_ends = np.flatnonzero(start), np.cumsum([len(b) + 1 for b in bodies])
        body = np.concatenate([code[filled], np.zeros(1, np.uint8)])
        place = np.cumsum(filled) - 1
        offsets = np.append(place[starts], filled.sum()).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body))
        coded = cut.dictionary_encode()
        each = self.pieces(coded.dictionary.to_pylist())
        sizes = np.array([len(b) // 4 for b in each], np.int64)
        known, first = np.frombuffer(b"".join(each), "<u4"), np.cumsum(sizes) - sizes
        number = coded.indices.to_numpy()
        n = sizes[number]
        ends = np.cumsum(n)
        ids = known[np.repeat(first[number] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, text_ends)]
