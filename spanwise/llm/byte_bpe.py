"""Byte-level BPE by a SentencePiece model that is serialised from a rank file.

A rank file gives each token's bytes and rank. Each byte becomes one printable
character, each token the string of its bytes' characters, and a SentencePiece model of
type BPE is written from these strings: its scores are the negative ranks, so that the
merge of the highest score is that of the lowest rank, leftmost first; its normaliser is
the identity; ids are ranks, and the unknown piece, which no byte string meets, comes last.
Text is split into pre-tokens by the vocabulary's pattern and each pre-token is encoded by
itself. Pre-tokens that are a token as a whole are that token, also where merges alone do
not lead to it: those are found once, when the model is made. Decoding maps each id back
to its bytes.

Both are Arrow functions of a column: rows are independent, Spark deals them out, and
nothing is shuffled. A worker holds the model, a bounded memory of pre-tokens and one
Arrow batch, whose bytes Spark bounds; only a single text is held whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .packing import OTHER_CHARACTERS, PLAIN_PIECES

#: Pre-tokens that a worker remembers before it forgets all, and the longest of them in characters.
REMEMBERED = 150_000
LONGEST_REMEMBERED = 64
#: Characters that are split at a time.
CHUNK_CHARS = 500_000

# Field numbers and enumerations of SentencePiece's model format.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _VOCABULARY, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 4, 40, 41, 42, 43
_BPE = 2
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, a space, the rank on each line) in the order of their ranks, which must be 0, 1, ..."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


#: A printable character for each byte: U+0100 and those after it, none of which any normaliser or splitter treats specially.
_CHARACTERS = "".join(chr(0x100 + b) for b in range(256))


def mapped(raw: bytes) -> str:
    """``raw`` with each byte as one character."""
    return raw.decode("latin-1").translate(_TO_CHARACTER)


_TO_CHARACTER = dict(enumerate(_CHARACTERS))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + np.array(value, "<f4").tobytes()


def serialised(tokens: list[bytes]) -> bytes:
    """A SentencePiece model whose piece i is token i with the score -i, and whose last piece is the unknown one."""
    if len(tokens) >= 1 << 24:
        raise ValueError("a score of 32 bits tells apart 2^24 ranks")
    pieces = [_bytes(_PIECES, _bytes(_PIECE, mapped(t).encode()) + _float(_SCORE, -float(i)) + _number(_TYPE, _NORMAL)) for i, t in enumerate(tokens)]
    pieces.append(_bytes(_PIECES, _bytes(_PIECE, b"<unk>") + _float(_SCORE, 0.0) + _number(_TYPE, _UNKNOWN)))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCABULARY, len(pieces)) + _number(_UNK_ID, len(tokens)) + b"".join(_number(f, -1) for f in (_BOS_ID, _EOS_ID, _PAD_ID))
    normaliser = _bytes(_NAME, b"identity") + b"".join(_number(f, 0) for f in (_DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES))
    return b"".join(pieces) + _bytes(_TRAINER, trainer) + _bytes(_NORMALISER, normaliser)


# Fixed value: the pattern that ``packing`` has in a faster form for texts of plain characters.
_COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encoder of one vocabulary, with the ids (as bytes) of the pre-tokens it remembers."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        if len({t for t in tokens if len(t) == 1}) < 256:
            raise ValueError("every byte must be a token")
        self.any_text = regex.compile(pattern).findall
        self.plain = pattern == _COMMON
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(tokens))
        led = self.model.encode([mapped(t) for t in tokens], num_threads=1)
        self.known: dict[str, bytes] = {}
        #: Tokens that merges do not lead to, by their mapped strings.
        self.whole = {mapped(t): [i] for i, (t, ids) in enumerate(zip(tokens, led)) if ids != [i]}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return PLAIN_PIECES(text) if self.plain and not OTHER_CHARACTERS(text) else self.any_text(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as 32-bit numbers; null as empty. What is not remembered is encoded in one call, as calls are dear."""
        parts = [self.split(t) if t else [] for t in texts]
        known, new = self.known, set()
        for words in parts:
            new |= set(words).difference(known)
        strings = [mapped(w.encode()) for w in new]
        for w, s, ids in zip(new, strings, self.model.encode(strings, num_threads=1) if new else ()):
            known[w] = array("i", self.whole.get(s) or ids).tobytes()
        out = [b"".join(map(known.__getitem__, words)) for words in parts]
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        if len(known) > REMEMBERED:
            known.clear()
        return out


def _chunks(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, some CHUNK_CHARS at a time, a longer one by itself."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    yield held


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each process, rank file and pattern."""
    return Codec(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> np.ndarray:
    """The bytes of each id."""
    return np.array(read_ranks(path), object)


def encode(text: str, ranks: str, pattern: str) -> Column:
    """The ids (array<int>) of the whole text in column ``text``, without special tokens.

    ``ranks`` is the path of a rank file on every machine and ``pattern`` the expression that
    finds its pre-tokens. Null and empty texts have no ids; a very long text is encoded
    whole; a pre-token of any length takes time n log n. Equal rows have equal ids.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(ranks, pattern)
        for b in batches:
            rows = [ids for texts in _chunks(b) for ids in own.encode(texts)]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    # Not deterministic in name only: the optimiser must not run it once for each use.
    return run.asNondeterministic()(F.col(text).cast("string"))


def decode(ids: str, ranks: str) -> Column:
    """The bytes that the ids in column ``ids`` stand for; null as empty. An id outside the vocabulary is an error."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocabulary(ranks)
        for b in batches:
            out = []
            for row in b:
                at = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32)
                if len(at) and not 0 <= at.min() <= at.max() < len(known):
                    raise ValueError("an id outside the vocabulary")
                out.append(b"".join(known[at].tolist()))
            yield pa.array(out, pa.binary())

    return run.asNondeterministic()(F.col(ids))
