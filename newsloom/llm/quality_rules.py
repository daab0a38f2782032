"""Quality rules: rule statistics of every text, then an isolation forest over them.

Statistics come from one pass over whole texts in Arrow batches. The forest is fitted on a bounded, documented
sample of statistics rows (TREES x TREE_ROWS at most), so it is the same size for any corpus; every document is
scored by its mean path length over the random splits. The verdict's threshold is calibrated on all labelled rows,
good and bad: the scores are counted in SCORE_BINS bins by label, and of the thresholds that keep KEEP_GOOD of the
rows labelled good the one is taken that keeps the fewest labelled bad, the highest of these if they tie.

The forest sees by how much a rule's limit is passed, not the raw statistics. These differ with language and length:
raw shares of marks or upper-case letters would set apart short texts and rare languages, which no rule objects to.

Defined cases: a null text has no words and fails the base rules (under 20 words); ids may repeat or be null (each row
is judged by itself; null ids have no label); equal statistics have equal scores, and a score at the threshold fails;
without rows labelled good the threshold is DEFAULT_THRESHOLD; an empty table gives an empty result; other columns
aren't read, or with carry stay as they are. One text's words are held at once, some 100 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, bounded_sample, byte_slices, materialise, of_worker, release_memory

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
TREES = 100
TREE_ROWS = 256
KEEP_GOOD = 0.999
SCORE_BINS = 2000
DEFAULT_THRESHOLD = 0.65
BATCH_BYTES = 1 << 20

#: What the usual rules for web text allow: symbols, marks, repeated, adjacent equal words a word; upper-case letters a
#: letter; digits a character; repeated lines a line; mean characters a word.
LIMITS = {"symbols": 0.1, "upper": 0.3, "marks": 0.5, "digits": 0.2, "repeats": MAX_REPEAT_PERCENT / 100, "adjacent": 0.05, "dup_lines": 0.3}
WORD_LENGTHS = (3, 10)

#: The characters of the symbol rule.
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")
FEATURES = ("symbols", "upper", "marks", "digits", "repeats", "adjacent", "dup_lines", "word_length")

_OTHER, _BLANK, _SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK = range(7)
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW_WORDS)], np.uint64)


def _make_classes() -> np.ndarray:
    """Code point -> kind of character."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            kinds[c] = _UPPER if x.isupper() else _LETTER
        elif x.isdigit():
            kinds[c] = _DIGIT
        elif 32 < c < 127:
            kinds[c] = _SYMBOL if x in SYMBOLS else _MARK
    kinds[[32, *range(9, 14)]] = _BLANK
    return kinds


def repeat_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of `size` words found twice or more among words."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(size):
        windows += ids[k : k + n] * _ODD[k]
    windows ^= windows >> np.uint64(29)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines."""
    lines = text.split("\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0, len(lines)
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(_WORD.search(line))
        seen.add(line)
    return n, len(lines)


def count_batch(texts: list[str]) -> np.ndarray:
    """COUNTS of each text (texts x counts)."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    if not texts:
        return out
    joined = "\n".join(texts) + "\n"
    kinds = of_worker(("quality_rules",), _make_classes)[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = {k: np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (_BLANK, _SYMBOL, _UPPER, _LETTER, _DIGIT, _MARK)}
    out[:, 1] = sizes - of[_BLANK]
    out[:, 2] = of[_SYMBOL]
    out[:, 7], out[:, 8] = of[_UPPER], of[_UPPER] + of[_LETTER]
    out[:, 9], out[:, 10] = of[_DIGIT], of[_MARK]
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        out[i, 0] = len(words)
        out[i, 3], out[i, 6] = dup_lines(text)
        out[i, 4] = repeat_words(words)
        out[i, 5] = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return out


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: id_col and COUNTS; with carry also the row itself, as a struct. Only texts go to Python."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [count_batch(part.column(0).to_pylist()) for part in byte_slices(pa.RecordBatch.from_arrays([batch], names=["text"]), 0, BATCH_BYTES)]
            all_ = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.StructArray.from_arrays([pa.array(all_[:, k]) for k in range(len(COUNTS))], names=list(COUNTS))
        release_memory()

    whole = [F.struct("*").alias("row")] if carry else []
    counted = docs.select(F.col(id_col), counts(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("counts"), *whole)
    return counted.select(F.col(id_col), "counts.*", *[F.col("row") for _ in whole])


def _features() -> list:
    """By how much each statistic lies beyond its rule's limit (LIMITS): 0 for what no rule objects to, whatever a text's length."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_lines") + 3.0
    over = lambda x, rule: F.greatest(x - LIMITS[rule], F.lit(0.0))
    mean = F.col("word_chars") / words
    return [
        F.sqrt(over(F.col("n_symbols") / words, "symbols")).alias("symbols"),
        over(F.col("n_upper") / (F.col("n_letters") + 20.0), "upper").alias("upper"),
        F.sqrt(over(F.col("n_marks") / (words + 10.0), "marks")).alias("marks"),
        over(F.col("n_digits") / (F.col("word_chars") + 50.0), "digits").alias("digits"),
        over(F.col("n_repeat_words") / words, "repeats").alias("repeats"),
        over(F.col("n_adjacent") / words, "adjacent").alias("adjacent"),
        over(F.col("n_dup_lines") / lines, "dup_lines").alias("dup_lines"),
        (F.greatest(F.lit(float(WORD_LENGTHS[0])) - mean, F.lit(0.0)) + F.greatest(mean - WORD_LENGTHS[1], F.lit(0.0))).alias("word_length"),
    ]


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        path = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return np.where(n > 2, path, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: column (-1: a leaf), split, first child (the second follows it), and path length at leaves."""

    column: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    rows: int

    @classmethod
    def grow(cls, sample: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 1) -> Forest:
        rng, nodes, roots = np.random.default_rng(seed), [], []
        rows = min(tree_rows, len(sample))
        most = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        for _ in range(trees if rows else 0):
            roots.append(len(nodes))
            nodes.append(None)
            todo = [(len(nodes) - 1, sample[rng.choice(len(sample), rows, replace=False)], 0)]
            while todo:
                at, own, depth = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                varied = np.flatnonzero(high > low)
                if depth >= most or len(own) < 2 or not len(varied):
                    nodes[at] = (-1, 0.0, -1, depth + float(_expected_path(len(own))))
                    continue
                column = int(rng.choice(varied))
                split = float(rng.uniform(low[column], high[column]))
                left = own[:, column] < split
                nodes[at] = (column, split, len(nodes), 0.0)
                nodes += [None, None]
                todo += [(len(nodes) - 2, own[left], depth + 1), (len(nodes) - 1, own[~left], depth + 1)] if left.any() and not left.all() else [(len(nodes) - 2, own[:1], depth + 1), (len(nodes) - 1, own, depth + 1)]
        columns = [np.array(x) for x in zip(*nodes, strict=True)] if nodes else [np.zeros(0)] * 4
        return cls(columns[0].astype(np.int32), columns[1].astype(float), columns[2].astype(np.int32), columns[3].astype(float), np.array(roots, np.int32), rows)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that few splits set apart."""
        if not len(self.roots) or self.rows < 2:
            return np.full(len(rows), 0.5)
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while (inner := self.column[at] >= 0).any():
                own = every[inner]
                node = at[own]
                at[own] = self.child[node] + (rows[own, self.column[node]] >= self.split[node])
            total += self.path[at]
        return np.exp2(-total / len(self.roots) / float(_expected_path(self.rows)))


def fit_forest(features: DataFrame, *, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    """From at most trees x tree_rows rows of distinct statistics and features."""
    columns = [*COUNTS, *FEATURES]
    sample = bounded_sample(features, columns, trees * tree_rows).select(*FEATURES).toPandas().to_numpy(float)
    return Forest.grow(sample[np.lexsort(sample.T[::-1])], trees, tree_rows)


def anomaly_scores(features: DataFrame, forest: Forest) -> DataFrame:
    """features with the column anomaly."""
    shared = features.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns):
        import pandas as pd

        return pd.Series(shared.value.score(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    return features.withColumn("anomaly", score(*[F.col(c) for c in FEATURES]))


@dataclass(frozen=True)
class Calibration:
    """A threshold with the shares of the labelled good and bad rows (of those that pass the base rules) that it keeps."""

    threshold: float
    good_kept: float = 1.0
    bad_kept: float = 1.0


def calibrate(scored: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", keep_good: float = KEEP_GOOD) -> Calibration:
    """The threshold (an edge of SCORE_BINS bins) that keeps keep_good of the rows labelled 1 and the fewest labelled 0."""
    own = labels.select(F.col(id_col), F.col(label_col).alias("label")).where("label in (0, 1)").distinct()
    judged = scored.where("not base_failed").select(F.col(id_col), F.floor(F.col("anomaly") * SCORE_BINS).alias("bin")).join(own, id_col)
    counts = judged.groupBy("bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()  # SCORE_BINS rows at most
    good, bad = np.zeros(SCORE_BINS + 2), np.zeros(SCORE_BINS + 2)
    for r in counts:
        good[r["bin"] + 1], bad[r["bin"] + 1] = r["good"], r["bad"]
    if not good.sum():
        return Calibration(DEFAULT_THRESHOLD)
    good_kept, bad_kept = np.cumsum(good) / good.sum(), np.cumsum(bad) / max(bad.sum(), 1.0)
    able = np.flatnonzero(good_kept >= keep_good)
    best = able[np.lexsort((-able, bad_kept[able]))[0]]
    return Calibration(float(best / SCORE_BINS), float(good_kept[best]), float(bad_kept[best]))


def assess(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_good: float = KEEP_GOOD, carry: bool = False) -> DataFrame:
    """One row per row of docs: id_col, COUNTS, base_failed, anomaly, threshold, good_kept, bad_kept (of labelled rows) and kept; with carry also the row itself, as a struct."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialise(statistics(docs, id_col=id_col, text_col=text_col, carry=carry).withColumn("base_failed", failed), "rule-statistics")
    features = counted.select("*", *_features())
    scored = anomaly_scores(features, fit_forest(features)).drop(*FEATURES)
    found = calibrate(scored, labels, id_col=id_col, keep_good=keep_good)
    told = scored.withColumns({"threshold": F.lit(found.threshold), "good_kept": F.lit(found.good_kept), "bad_kept": F.lit(found.bad_kept)})
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < found.threshold))
