"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by best-two-fit.

Lengths are whole numbers up to the capacity, so what has to be packed is known from how many pieces there are of each
length: at most `capacity` counts, whatever the corpus. The plan is made on those counts. A bin is filled greedily,
largest piece that fits first; then its smallest piece is replaced by the two unpacked pieces that fill the widened
gap best, if they fill it more tightly, until no such pair is left. The bin's pattern is used as often as the counts
allow, so the plan has about as many patterns as there are lengths, not as there are bins.

Spark then ranks the pieces of each length (in salted groups of RANKED_SHARE of all pieces, so a length that a third of
all pieces has is ranked by many tasks) and each rank looks up its bin and offset in the broadcast plan, which
has as many rows as there are lengths in patterns. The groups' first ranks are joined by a shuffle of their own, to rows
that lie as they are ranked.

Defined cases: a null text is an empty document, one piece of the end token; documents longer than the capacity, and
only these, are cut into pieces of the capacity and a rest; null or repeated ids are pieces of their own rows; pieces of
one length may change places; an empty table gives an empty result; other columns of documents aren't read, those of a
piece table stay, whatever their names, but for sequence_id and offset. A text's ids are held at once by its task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import Memo, arrow_map, byte_slices, materialise, of_worker, release_memory

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that one task ranks, about: this share of all, RANKED_ROWS at most and LEAST_RANKED at least.
RANKED_SHARE, RANKED_ROWS, LEAST_RANKED = 1 / 1024, 1 << 16, 64
BATCH_BYTES = 1 << 20
#: Bytes of each memo's generation.
MEMO_BYTES = 48 << 20
#: Bytes of texts after which a task gives freed memory back, as it does at its end.
RELEASE_BYTES = 16 << 20

_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_ODD = re.compile(r"[^ \nA-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]")


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins what blanks or line ends part.

    Words are encoded once while a memo holds them. A text of nothing but plain letters, digits, blanks and marks is
    parted as the tokenizer parts it, into lower-case words, single digits and runs of marks; in any other text, what
    stands between blanks or line ends goes to the tokenizer as it is.
    """

    def __init__(self, path: str, most: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        trial = "Ab,b; x2y/é"
        self.parts_plain = b"".join(self._plain(_PARTS.findall(trial.lower()))) == self._whole(trial)
        self.chunks, self.plain = Memo(self._whole, most), Memo(self._whole, most)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of runs of plain letters or marks: each run is one word to the tokenizer, so its last id ends a word."""
        out = []
        groups = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        for k, encoded in enumerate(self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            edges = [0, *(np.flatnonzero(self.ends_word[ids]) + 1).tolist()]
            if len(edges) - 1 != len(words[256 * k : 256 * k + 256]):  # a tokenizer without ends of words
                return [self._whole(w) for w in words]
            packed = ids.tobytes()
            out += [packed[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.parts_plain and "<|" not in t and not _ODD.search(t) for t in texts]
        split = [_PARTS.findall(t.lower()) if p else t.replace("\n", " ").split(" ") for t, p in zip(texts, plain, strict=True)]
        missing = set().union(*(words for words, p in zip(split, plain, strict=True) if p)).difference(self.plain)
        new = list(missing.difference(self.plain.older))
        for word, ids in zip(new, self._plain(new), strict=True):
            self.plain[word] = ids
            self.plain.held += Memo.ENTRY + len(word) + len(ids)
        self.chunks[""] = b""
        memos = (self.chunks.__getitem__, self.plain.__getitem__)
        out = [b"".join(map(memos[p], words)) for words, p in zip(split, plain, strict=True)]
        self.chunks.trim()
        self.plain.trim()
        return out


def pieces(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row per piece: id_col, piece, start, length and ids (little-endian unsigned 32-bit, in bytes)."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end, width = end_id.to_bytes(4, "little"), 4 * capacity
    names = [id_col, "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = of_worker(("packing", path, memo_bytes), lambda: WordTokenizer(path, memo_bytes))
        freed = 0
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                at, number, start, length, ids = [], [], [], [], []
                for row, packed in enumerate(own.encode(part.column(1).to_pylist())):
                    packed += end
                    for k, low in enumerate(range(0, len(packed), width)):
                        cut = packed[low : low + width]
                        at.append(row)
                        number.append(k)
                        start.append(low // 4)
                        length.append(len(cut) // 4)
                        ids.append(cut)
                columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            freed += batch.nbytes
            if freed >= RELEASE_BYTES:
                freed = 0
                release_memory()

    kind = source.schema[id_col].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary")


@dataclass(frozen=True)
class Plan:
    """For every length, from which rank on a pattern takes its pieces: sorted by length, then rank."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray  # the pattern's first sequence
    each: np.ndarray  # how many of the length a sequence takes
    offset: np.ndarray  # where the first of them stands
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the piece with that rank among those of its length."""
        at = np.searchsorted(self.length * (1 << 44) + self.rank, length * (1 << 44) + rank, side="right") - 1
        beyond = rank - self.rank[at]
        return self.sequence[at] + beyond // self.each[at], self.offset[at] + beyond % self.each[at] * length


def _best_pair(lengths: np.ndarray, left: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """The two lengths of the largest sum up to room, if it is larger than over; lengths: ascending, with pieces left."""
    low = lengths[: np.searchsorted(lengths, room)]
    if not len(low):
        return None
    partner = np.searchsorted(low, room - low, side="right") - 1
    sums = np.where(partner >= 0, low + low[np.maximum(partner, 0)], 0)
    for k in np.argsort(-sums, kind="stable")[:8]:
        a, b = int(low[k]), int(low[partner[k]])
        if sums[k] <= over:
            return None
        if a != b or left[a] > 1:
            return a, b
    return None


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Patterns of bins for that many pieces of each length."""
    left = {k: n for k, n in counts.items() if n > 0}
    taken: Counter[int] = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    have = sum(1 << k for k in left)  # bit k: there are pieces of length k
    sequences = 0
    while left:
        bin_, room = Counter(), capacity

        def fill(bin_=bin_) -> None:
            nonlocal room, have
            while room and (fitting := have & ((1 << (room + 1)) - 1)):
                k = fitting.bit_length() - 1
                n = min(left[k], room // k)
                add(k, n, bin_)

        def add(k: int, n: int, bin_=bin_) -> None:
            nonlocal room, have
            bin_[k] += n
            left[k] -= n
            room -= k * n
            if left[k] == 0:
                have &= ~(1 << k)
            else:
                have |= 1 << k
            if bin_[k] == 0:
                del bin_[k]

        fill()
        while room and have:
            small = min(bin_)
            lengths = np.array([k for k in range(1, min(room + small, capacity) + 1) if have >> k & 1], np.int64)
            pair = _best_pair(lengths, left, room + small, small)
            if pair is None:
                break
            add(small, -1)
            for k in pair:
                add(k, 1)
            fill()
        # the same pattern again, as often as pieces allow
        times = 1 + min(left[k] // n for k, n in bin_.items())
        offset = 0
        for k, n in sorted(bin_.items(), reverse=True):
            rows.append((k, taken[k], sequences, n, offset))
            taken[k] += n * times
            offset += k * n
            left[k] -= n * (times - 1)
            if left[k] == 0:
                have &= ~(1 << k)
        left = {k: n for k, n in left.items() if n} if len(left) > 2 * bin(have).count("1") or not have else left
        sequences += times
        if not have:
            break
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences)


def pack(cut: DataFrame, *, capacity: int = CAPACITY, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """cut (rows with a length from 1 to capacity) with sequence_id and offset added."""
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy(length_col).count().collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(make_plan(counts, capacity))
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    order = F.struct(*order_by)
    own = cut.select(F.struct(*kept).alias("row"), F.col(length_col).cast("long").alias("length"), order.alias("key"), F.monotonically_increasing_id().alias("number"))
    # ids may all be equal, so a row's number decides too: a task that is repeated ranks its rows as before
    ranked_rows = int(min(RANKED_ROWS, max(LEAST_RANKED, RANKED_SHARE * sum(counts.values()))))
    groups = {k: n for k, n in counts.items() if n > ranked_rows}  # capacity entries at most
    many = F.create_map(*[F.lit(x) for k, n in groups.items() for x in (int(k), -(-n // ranked_rows))])[F.col("length")] if groups else F.lit(None)
    salted = own.withColumn("salt", F.pmod(F.xxhash64("key", "number"), F.coalesce(many.cast("long"), F.lit(1).cast("long"))))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "number")))
    placed = ranked.join(starts, ["length", "salt"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):
        import pandas as pd

        sequence, offset = shared.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return placed.select("row", place(F.col("length"), F.col("before") + F.col("rank") - 1).alias("place")).select("row.*", "place.sequence_id", "place.offset")


def packed_pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Pieces of docs with their places. Without keep_ids only the ids' crc32 travels with the pieces, as ids_crc32."""
    cut = pieces(docs, tokenizer, capacity=capacity, memo_bytes=memo_bytes).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialise(cut if keep_ids else cut.drop("ids"), "pieces"), capacity=capacity)
