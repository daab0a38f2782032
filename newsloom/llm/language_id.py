"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, documented sample per language with Spark; the matrix of log-probabilities
(languages x N_BUCKETS, whatever the corpus) is broadcast, and batches of texts are scored sparsely in numpy: each
n-gram gathers its column and a segmented sum adds them up by text. Long texts go through in windows of WINDOW
characters, so what a text takes beside its own characters is bounded.

Defined cases: a text that is null or has no letter is `und` with score 0.0; without any usable training row every
text is `und`; rows with null lang or text don't train, and equal rows train once; ties between languages go to the
one first by name; repeated ids each get their own row; an empty table gives an empty result; other columns aren't
read, or with carry stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, bounded_batches, byte_slices, of_worker, release_memory, row_hash

UNDETERMINED = "und"
N_BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Most training documents of one language; distinct ones, with the smallest hashes. A documented bound.
TRAIN_DOCS_PER_LANG = 4_000
BATCH_BYTES = 1 << 20
WINDOW = 1 << 18
ALPHA = 0.1

_GAP = " " * max(ORDERS)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _make_letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for all that aren't letters."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts one after the other, blanks for the rest, and where each text starts."""
    joined = "".join(_GAP + t for t in texts)  # so no gram sees another text
    points = of_worker(("language_id",), _make_letters)[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter((len(t) + len(_GAP) for t in texts), np.int64, len(texts))
    return points, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _windows(points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """By windows of the points: hashed n-grams of each order, the texts in the window, and where they start in it."""
    ends = np.append(starts[1:], len(points))
    for low in range(0, len(points), WINDOW):
        high = min(low + WINDOW, len(points))
        size = high - low
        ahead = np.full(size + max(ORDERS), 32, np.uint32)
        seen = points[low : high + max(ORDERS)]
        ahead[: len(seen)] = seen
        hashed, rolled = [], np.zeros(size, np.uint32)
        filling = (ahead[:size] == 32) & (ahead[1 : 1 + size] == 32)
        for order in range(1, max(ORDERS) + 1):
            rolled = (rolled ^ ahead[order - 1 : order - 1 + size]) * _MIX[order - 1]
            rolled ^= rolled >> np.uint32(15)
            if order in ORDERS:
                bucket = (rolled ^ np.uint32(order * 0x27D4EB2F)) * np.uint32(0x165667B1) >> np.uint32(17)
                # a gram must start in a word or just before one, or it is only filling
                bucket[filling] = N_BUCKETS
                hashed.append(bucket)
        inside = np.flatnonzero((starts < high) & (ends > low))
        yield hashed, inside, np.maximum(starts[inside] - low, 0)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # (N_BUCKETS + 1) x languages; the last row, for filling, is 0
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        points, starts = _points(texts)
        letters = np.add.reduceat(points != 32, starts, dtype=np.int64)
        total = np.tile(self.log_prior, (len(texts), 1))
        for hashed, inside, at in _windows(points, starts):
            for order in hashed:
                for k in range(len(self.langs)):
                    total[inside, k] += np.add.reduceat(self.log_prob[k][order], at, dtype=np.float64) / len(ORDERS)
        total -= total.max(axis=1, keepdims=True)
        share = np.exp(total)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        known = letters > 0
        names = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
        return names, np.where(known, share[np.arange(len(texts)), best], 0.0)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS_PER_LANG) -> Model:
    """Fit on about per_lang documents of each language. What reaches the driver is languages x N_BUCKETS counts at most."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    hashed = rows.withColumn("h", row_hash(["id", "text"]))
    seen = {r["lang"]: r for r in hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}  # a row per language
    langs = sorted(seen)
    if not langs:
        return Model((), np.zeros((0, N_BUCKETS + 1)), np.zeros(0))
    sizes = {lang: seen[lang]["n"] for lang in langs}
    keep = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(max(int(1.25 * (1 << 30) * min(1.0, per_lang / sizes[lang])), seen[lang]["least"] + 1)))])
    once = hashed.where(F.col("h") < keep[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_lang)  # 1.25 x per_lang rows of a language, about

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in byte_slices(batch, 0, BATCH_BYTES):
                names = np.array(part.column(1).to_pylist(), object)
                texts = part.column(0).to_pylist()
                for lang in dict.fromkeys(names):
                    held = sums.setdefault(lang, np.zeros(N_BUCKETS + 1, np.int64))
                    for hashed, _, _ in _windows(*_points([t for t, x in zip(texts, names, strict=True) if x == lang])):
                        for order in hashed:
                            held += np.bincount(order, minlength=N_BUCKETS + 1)
        for lang, held in sums.items():
            at = np.flatnonzero(held[:N_BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bucket", "n"])

    counted = arrow_map(sample.select("text", "lang"), count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((len(langs), N_BUCKETS + 1))
    place = {lang: k for k, lang in enumerate(langs)}
    which = np.array([place[x] for x in counted.column("lang").to_pylist()], int)
    held[which, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    log_prob = np.log((held[:, :N_BUCKETS] + ALPHA) / (held[:, :N_BUCKETS].sum(axis=1, keepdims=True) + ALPHA * N_BUCKETS))
    log_prob = np.concatenate([log_prob, np.zeros((len(langs), 1))], axis=1).astype(np.float32)
    counts = np.array([sizes[x] for x in langs], float)
    return Model(tuple(langs), log_prob, np.log(counts / counts.sum()))


def verdicts(docs: DataFrame, model: Model, *, text_col: str = "text"):
    """A column of docs: struct of lang_pred and score. Only texts go to Python; rows stay in the JVM."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def verdict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            langs, shares = [], []
            for part in byte_slices(pa.RecordBatch.from_arrays([batch], names=["text"]), 0, BATCH_BYTES):
                names, share = shared.value.predict(part.column(0).to_pylist())
                langs += names
                shares.append(share)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(shares) if shares else [], pa.float64())], names=["lang_pred", "score"])
        release_memory()

    return verdict(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: id_col, lang_pred and score (the posterior of that language, 0 to 1); with carry also the row itself, as a struct."""
    whole = [F.struct("*").alias("row")] if carry else []
    return docs.select(F.col(id_col), verdicts(docs, model, text_col=text_col).alias("verdict"), *whole).select(F.col(id_col), "verdict.*", *[F.col("row") for _ in whole])
