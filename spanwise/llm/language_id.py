"""Language identification with a blended-spectrum string kernel.

A text's features are the 1-, 2- and 3-grams present in it (letters lower-cased, runs of
other characters one blank), each hashed to a bit. The kernel of two texts is the number
of bits they share, divided by the geometric mean of their own counts. Landmarks L from
the labelled sample give the Nystroem map ``phi(x) = K(x, L) K(L, L)^(-1/2)``; one-versus-
rest kernel ridge regression on ``phi`` is solved in closed form on the driver. As ``phi``
is linear in the bits but for the text's own norm, landmarks, root and ridge weights fold
into one (bits x languages) matrix, and a batch of texts is scored by one product of its
presence matrix with it. That matrix is the only broadcast; its size depends on the number
of bits and languages alone.

The training sample is bounded: ``PER_LANGUAGE`` rows of each language, those whose ids
hash lowest. As hashes are uniform, a first cut by each language's row count leaves few
rows to rank. Their features, not their texts, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import as_batches, fresh

#: log2 of the number of bits of the 1-, 2- and 3-grams.
GRAM_BITS = (10, 13, 15)
#: Labelled rows of a language that are learned from, and how many of them are landmarks.
PER_LANGUAGE = 256
LANDMARKS = 48
RIDGE = 1e-2
#: Labels beyond this many are refused, and landmarks of all languages together: with the sample they bound the driver's memory.
MAX_LANGUAGES = 200
MAX_LANDMARKS = 1536
UNDETERMINED = "und"

_STARTS = np.cumsum([0, *(1 << b for b in GRAM_BITS)])
N_BITS = int(_STARTS[-1])
_MIX = np.uint32(2654435761)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters one 0; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return c[:0]
    c = np.where(is_letter, c, np.uint32(0))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = c[keep]
    return np.concatenate(([np.uint32(0)], c, [np.uint32(0)])) if c[-1] else np.concatenate(([np.uint32(0)], c))


def _grams(c: np.ndarray) -> list[np.ndarray]:
    """The bit of each n-gram of each length."""
    out, h = [], c * _MIX
    for n, bits in enumerate(GRAM_BITS):
        if n:
            h = (h[:-1] * np.uint32(31) + c[n:]) * _MIX
        out.append((h >> np.uint32(32 - bits)).astype(np.int32) + np.int32(_STARTS[n]))
    return out


def presence(text: str) -> np.ndarray | None:
    """The text's feature bits, or None if it has no letter."""
    c = _codes(text or "")
    if not len(c):
        return None
    row = np.zeros(N_BITS, np.bool_)
    for g in _grams(c):
        row[g] = True
    return row


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # N_BITS x languages

    def score_batch(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score from 0 to 1) of each text, by one matrix product for each 32 texts."""
        for at in range(0, len(texts), 32):
            part = texts[at : at + 32]
            block = np.zeros((len(part), N_BITS), np.float32)
            for i, t in enumerate(part):
                c = _codes(t or "")
                if len(c):
                    for g in _grams(c):
                        block[i, g] = 1
            own = block.sum(axis=1)
            scores = block @ self.weights / np.sqrt(np.maximum(own, 1))[:, None]
            best = scores.argmax(axis=1) if self.languages else np.zeros(len(part), int)
            for i, k in enumerate(best):
                yield (self.languages[k], float(min(1.0, max(0.0, scores[i, k])))) if own[i] and self.languages else (UNDETERMINED, 0.0)


def _bits(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=N_BITS).astype(np.float32)


def fit(samples: dict[str, np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """``samples``: of each language, a row of packed presence bits for each text; they are unpacked a few at a time."""
    languages = sorted(k for k, v in samples.items() if len(v))
    if not languages:
        return LanguageModel([], np.zeros((N_BITS, 0), np.float32))
    landmarks = max(1, min(landmarks, MAX_LANDMARKS // len(languages)))
    x = np.concatenate([samples[k] for k in languages])
    y = np.concatenate([np.full(len(samples[k]), i) for i, k in enumerate(languages)])
    at = np.cumsum([0, *(len(samples[k]) for k in languages)])
    marks = np.concatenate([np.arange(a, min(b, a + landmarks)) for a, b in zip(at, at[1:])])
    land = _bits(x[marks])
    land /= np.sqrt(land.sum(axis=1))[:, None]
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    live = values > 1e-6 * values[-1]
    root = vectors[:, live] / np.sqrt(values[live])
    weight = (1.0 / np.bincount(y))[y]  # each language counts alike
    gram, goal = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(languages)))
    for i in range(0, len(x), 256):
        bits = np.concatenate([_bits(x[j : min(j + 32, i + 256)]) @ land.T / np.sqrt(np.bitwise_count(x[j : min(j + 32, i + 256)]).sum(axis=1, dtype=np.int64))[:, None] for j in range(i, min(i + 256, len(x)), 32)])
        phi = bits.astype(np.float64) @ root
        own = phi * weight[i : i + 256, None]
        gram += own.T @ phi
        goal += own.T @ np.eye(len(languages))[y[i : i + 256]]
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), goal)
    return LanguageModel(languages, np.ascontiguousarray(land.T @ (root @ solved), dtype=np.float32))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bits", pa.binary())])

    def rows():
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = presence(text)
                if row is not None:
                    yield lang, np.packbits(row).tobytes()

    return as_batches(schema, rows(), 256)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and ``lang`` is not null: ``per_language`` of each language.

    The sample is the rows whose keys hash lowest, then by the texts' hashes. One aggregate
    counts the keys of each language; hashes below a share of the range that leaves over
    twice as many as wanted are ranked, a few hundred rows of each language, from (key,
    language) alone; only the texts of those are read. Rows of one key that differ are rows
    of their own, equal ones count once; texts without a letter teach nothing; very long
    ones are read whole. Raises ValueError at more than MAX_LANGUAGES labels.
    """
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    keyed = rows.select("k", "lang", F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit(""))).alias("h"))
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return fit({})
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, (2.5 * per_language + 64) / max(1, n))))))
    low = F.col("h") / F.lit(2.0**64) + F.lit(0.5) <= share[F.col("lang")]
    order = Window.partitionBy("lang").orderBy("h", "k")
    chosen = keyed.where(low).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(F.col("k").alias("k2"), F.col("lang").alias("l2"), "h")
    picked = rows.join(F.broadcast(chosen), F.col("k").eqNullSafe(F.col("k2")) & (F.col("lang") == F.col("l2")))
    # Repeated keys may bring more rows: of each language the first stay, by the same order and then by text.
    picked = picked.withColumn("t", F.xxhash64("text")).groupBy("lang", "h", "k", "t").agg(F.min("text").alias("text"))
    picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "k", "t"))).where(F.col("n") <= per_language).select("lang", "text")
    packed: dict[str, list[bytes]] = {}
    for r in picked.mapInArrow(_features, "lang string, bits binary").toLocalIterator():
        packed.setdefault(r["lang"], []).append(bytes(r["bits"]))
    samples = {k: np.frombuffer(b"".join(sorted(v)), np.uint8).reshape(len(v), -1) for k, v in packed.items()}
    rng = np.random.default_rng(7)
    return fit({k: v[rng.permutation(len(v))] for k, v in sorted(samples.items())})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; every row stays, in one pass and without a shuffle.

    ``und`` with score 0 if the text is null, empty or without a letter, or nothing was learned.
    Ties go to the language first by name; very long texts are scored whole; repeated rows
    get the same; an empty table stays empty. Columns named like the results are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.weights))
    keep = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    (t,) = fresh(docs, "lid_text")
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for b in batches:
            names, scores = [], []
            for at in range(0, b.num_rows, 32):
                for n, s in own.score_batch(b.column(len(keep)).slice(at, 32).to_pylist()):
                    names.append(n)
                    scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, pred, score])

    schema = src.select(*(F.col(f"`{c}`") for c in keep)).schema.add(pred, "string").add(score, "double")
    return src.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter, by the CRC-32 of the key's text. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
