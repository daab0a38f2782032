"""Collocations: frequent phrases of a few words, scored by their loosest cut, without those that a longer one explains.

Shards are chunks of a task's texts of one language. Two passes read the texts, each in whole:

1. Each shard counts its words and short phrases (FILTER_WORDS). They are summed over all shards, as text, so the counts
   are exact; at most FILTER_WORDS rows for each word are made, whatever is frequent. The frequent ones are candidates,
   and the hashes of their phrases set PROBES bits each in a filter of FILTER_BITS (a fixed size, whatever the table).
   Phrases that share bits, or a filter that fills up, let more through and lose nothing.
2. Each shard cuts its pieces wherever a short phrase is certainly too rare, since no frequent one holds a rare one,
   and builds the generalised suffix automaton of what is left. Its states are the classes of substrings with the same end
   positions; the tree of suffix links is the tree of the reversed prefixes, so sorting those (up to `most_words` deep)
   gives states, lengths, links and end-position counts at once. Only the states in which prefixes end are told, with
   how many end there: one row for each word at most, not one for each substring. These are summed over all shards, as
   text, and only then handed on to their suffixes, down to those one word longer than what the first pass has counted;
   all that share such a suffix meet in one partition.

Defined cases: a null text counts as empty, a null language as UNDETERMINED (with rows that say so); rows that repeat
count each; words and phrases are compared as UTF-8 bytes; ties go by score, count and phrase, which no two rows of a
language share; an empty table gives an empty result; other columns and ids aren't read. A text longer than a shard is
a shard by itself. Ranks are taken in salted groups first, so that no language is ranked in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, byte_slices, materialise

UNDETERMINED = "und"
LEAST, MOST_WORDS, TOP = 100, 5, 2000
PERCENT = 100  # a phrase goes if a longer one has this share of its occurrences
#: Bytes of a shard; when a task holds twice as many, of all languages, it ends the largest shard.
SHARD_BYTES = 8 << 20
#: Bits of the filter, and the longest phrases that it knows.
FILTER_BITS, FILTER_WORDS = 1 << 26, 2
PROBES = 3
SALTS = 64
OUT_ROWS = 1 << 16

_BLANK, _BREAK = 0x20, 0x0A
_FOLD = bytes(_BREAK if c in b".,;:!?\x0a\x0b\x0c\x0d" else _BLANK if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))


def joined_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of phrases and the words that follow them."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


@dataclass(frozen=True)
class Shard:
    """Words of texts in order: ids into vocabulary, and whether each one begins a piece."""

    lang: str
    ids: np.ndarray
    begins: np.ndarray
    vocabulary: pa.Array

    def word_hashes(self) -> np.ndarray:
        return word_hashes(self.lang, self.vocabulary.to_pylist())

    def phrases(self, ends: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that end at these positions, space-joined."""
        parts = [self.vocabulary.take(pa.array(self.ids[ends - back])) for back in range(words - 1, -1, -1)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", self.vocabulary.type))

    def phrase_counts(self, known: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 2 to known words: the phrases, each by a position where it ends, and their counts."""
        ends, own = np.arange(len(self.ids)), self.ids
        for k in range(2, known + 1):
            longer = (ends[1:] == ends[:-1] + 1) & ~self.begins[ends[1:]]
            own, ends = own[:-1][longer] * len(self.vocabulary) + self.ids[ends[1:][longer]], ends[1:][longer]
            _, firsts, own, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            yield k, ends[firsts], counts

    def phrase_hashes(self, words: np.ndarray, known: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2 to known words: the positions where such a phrase ends, and its hash."""
        ends, hashes = np.arange(len(self.ids)), words[self.ids]
        for _ in range(2, known + 1):
            longer = (ends[1:] == ends[:-1] + 1) & ~self.begins[ends[1:]]
            hashes = joined_hashes(hashes[:-1][longer], words[self.ids[ends[1:][longer]]])
            ends = ends[1:][longer]
            yield ends, hashes


def shard(lang: str, texts: list[bytes]) -> Shard:
    """Lower-cases A-Z and splits, for all the texts at once."""
    body = np.frombuffer(b"\n".join(texts).translate(_FOLD), np.uint8)
    inside = (body != _BREAK) & (body != _BLANK)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    del first
    if not len(starts):
        return Shard(lang, np.zeros(0, np.int64), np.zeros(0, bool), pa.array([], pa.binary()))
    pieces = np.searchsorted(np.flatnonzero(body == _BREAK), starts).astype(np.int32)
    kept = body[inside]
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    encoded = words.dictionary_encode()
    return Shard(lang, encoded.indices.to_numpy().astype(np.int64), np.concatenate([[True], pieces[1:] != pieces[:-1]]), encoded.dictionary)


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD_BYTES) -> Iterator[Shard]:
    """(lang, text) rows as shards of about size bytes, or of what is largest where all languages together hold twice as many."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def end(lang: str) -> Shard:
        sizes.pop(lang)
        return shard(lang, held.pop(lang))

    for batch in batches:
        for part in byte_slices(batch, 1, 1 << 20):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                body = bytes(text.as_buffer())
                held.setdefault(lang, []).append(body)
                sizes[lang] = sizes.get(lang, 0) + len(body) + 1
                if sizes[lang] >= size:
                    yield end(lang)
        while sum(sizes.values()) >= 2 * size:
            yield end(max(sizes, key=sizes.get))
    for lang in list(held):
        yield end(lang)


@dataclass(frozen=True)
class Automaton:
    """States of a generalised suffix automaton of words, of substrings up to a depth: of each state the length of its
    longest substring, where one occurrence of it ends, how many there are, and the state of its suffix link (-1: none)."""

    length: np.ndarray
    end: np.ndarray
    count: np.ndarray
    link: np.ndarray

    def substrings(self, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, end positions, counts) of all substrings: a state has those longer than its link's, as long as its own at most."""
        below = np.where(self.link >= 0, self.length[self.link], 0)
        for k in range(shortest, int(self.length.max(initial=0)) + 1):
            own = (below < k) & (self.length >= k)
            yield k, self.end[own], self.count[own]

    def prefixes(self) -> np.ndarray:
        """Of each state: how many prefixes (up to the depth) end in it, which are its end positions without its children's."""
        inner = self.link >= 0
        return self.count - np.bincount(self.link[inner], self.count[inner], len(self.count)).astype(np.int64)


def automaton(ids: np.ndarray, reach: np.ndarray, depth: int) -> Automaton:
    """Of runs of word ids (reach: how many words the longest phrase that ends at a position has), by sorting the reversed
    prefixes up to depth words.

    Prefixes that share their last d words form a class of substrings of d words with the same end positions; a class is
    the longest of its state if no class of d + 1 words has as many."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if not n:
        return Automaton(none, none, none, none)
    back = np.full((depth, n), -1, np.int32)
    for d in range(min(depth, n)):
        back[d, d:] = np.where(reach[d:] > d, ids[: n - d], -1)
    order = np.lexsort(back[::-1])
    back, changed = back[:, order], np.zeros(n, bool)
    changed[0] = True
    levels = []  # of each depth: classes' first places in the order, their sizes, and the class of each place
    for d in range(depth):
        changed[1:] |= back[d, 1:] != back[d, :-1]
        firsts = np.flatnonzero(changed)
        levels.append((firsts, np.diff(firsts, append=n), np.cumsum(changed) - 1, back[d, firsts] >= 0))
    length, end, count, link = [], [], [], []
    state = np.full(n, -1)  # of each place: the state of the class one word shorter
    made = 0
    for d, (firsts, sizes, own_class, real) in enumerate(levels):
        longest = real.copy()
        if d + 1 < depth:
            deeper, deeper_sizes, _, deeper_real = levels[d + 1]
            only = deeper_real & (deeper_sizes == sizes[own_class[deeper]])
            longest[own_class[deeper[only]]] = False
        new = np.full(len(firsts), -1)
        new[longest] = made + np.arange(longest.sum())
        made += int(longest.sum())
        length.append(np.full(int(longest.sum()), d + 1))
        end.append(order[firsts[longest]])
        count.append(sizes[longest])
        link.append(state[firsts[longest]])
        # a class that isn't the longest of its state leaves the link of the state to come as it is
        state = np.where(longest[own_class], new[own_class], state)
    return Automaton(*(np.concatenate(x).astype(np.int64) for x in (length, end, count, link)))


def _counted(source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """lang, words, phrase, n as run tells them; as bytes until here, since Arrow checks strings and a text may hold any bytes."""
    return arrow_map(source, run, "lang string, words int, phrase binary, n bigint").withColumn("phrase", F.col("phrase").cast("string"))


def _count_rows(lang: str, words: int, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(n), OUT_ROWS):
        some = phrases.slice(low, OUT_ROWS).cast(pa.binary())
        rows = len(some)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array(np.full(rows, words, np.int32)), some, pa.array(n[low : low + rows].astype(np.int64))], names=["lang", "words", "phrase", "n"])


def short_counts(source: DataFrame, least: int, known: int = FILTER_WORDS, size: int = SHARD_BYTES) -> DataFrame:
    """lang, words, phrase, n of all words and phrases of known words at most with `least` occurrences; a language's number of words as words 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in shards(batches, size):
            yield from _count_rows(own.lang, 0, pa.array([b""], pa.binary()), np.array([len(own.ids)]))
            yield from _count_rows(own.lang, 1, own.vocabulary, np.bincount(own.ids, minlength=len(own.vocabulary)))
            for k, ends, n in own.phrase_counts(known):
                for low in range(0, len(n), OUT_ROWS):
                    part = slice(low, low + OUT_ROWS)
                    yield from _count_rows(own.lang, k, own.phrases(ends[part], k), n[part])

    return _counted(source, run).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(at, bits) of the phrases of (lang, phrase) rows, in a filter of so many words of 64 bits."""
    for batch in batches:
        by_lang: dict[tuple[str, int], list[list[bytes]]] = {}
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            parts = phrase.split(b" ")
            by_lang.setdefault((lang, len(parts)), []).append(parts)
        for (lang, _), phrases in by_lang.items():
            first, *rest = (word_hashes(lang, words) for words in zip(*phrases, strict=True))
            for words in rest:
                first = joined_hashes(first, words)
            at = np.concatenate(list(probes(first, size)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.int64(1) << (at & 63))], names=["at", "bits"])


def probes(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """PROBES bits of each hash, in a filter of so many words of 64 bits."""
    for _ in range(PROBES):
        yield (hashes % np.uint64(size * 64)).astype(np.int64)
        hashes = _mix(hashes + np.uint64(0x9E3779B97F4A7C15))


def frequent_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of (lang, phrase) rows: words of 64 bits, bits of them in all."""
    words = arrow_map(phrases, lambda batches: _bits(batches, bits // 64), "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def passes(frequent: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in probes(hashes, len(frequent)):
        out &= (frequent[at >> 6] >> (at & 63)) & 1 == 1
    return out


def _long_phrases(own: Shard, frequent: np.ndarray, most_words: int, known: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(words, phrases, counts) of a shard: the longest phrases that may end at its positions, of more than known words."""
    joined = np.zeros((known + 1, len(own.ids)), bool)  # by words: whether a phrase of so many may end here
    for k, (ends, hashes) in enumerate(own.phrase_hashes(own.word_hashes(), known), 2):
        joined[k, ends] = passes(frequent, hashes)
        if k > 2:  # a hash may pass by chance: a phrase needs both of its parts
            joined[k, 1:] &= joined[k - 1, 1:] & joined[k - 1, :-1]
    stays = joined[2].copy()
    stays[:-1] |= joined[2, 1:]
    at = np.flatnonzero(stays)
    states = automaton(own.ids[at], reaches(joined[:, at]), most_words)
    ending = states.prefixes()
    for k in range(known + 1, most_words + 1):
        told = (states.length == k) & (ending > 0)
        yield k, own.phrases(at[states.end[told]], k), ending[told]


def reaches(joined: np.ndarray) -> np.ndarray:
    """How many words the longest phrase has that may end at each position: one more than at the position before, unless
    a phrase of k words (joined[k], from 2 on) can't end here, which leaves k - 1."""
    places = np.arange(joined.shape[1])
    least = np.full(len(places), len(joined))
    for k in range(len(joined) - 1, 1, -1):
        least[~joined[k]] = k - 1
    held = least < len(joined)  # else: as before, and one more
    held[:1] = True
    last = np.maximum.accumulate(np.where(held, places, 0))
    return places - last + np.minimum(least, len(joined) - 1)[last]


def long_counts(source: DataFrame, frequent: np.ndarray, least: int, most_words: int = MOST_WORDS, known: int = FILTER_WORDS, size: int = SHARD_BYTES) -> DataFrame:
    """lang, words, phrase, n of all phrases of more than known words with `least` occurrences."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in shards(batches, size):
            for k, phrases, n in _long_phrases(own, shared.value, most_words, known):
                yield from _count_rows(own.lang, k, phrases, n)

    last = lambda k: F.substring_index("phrase", " ", -k)
    ending = _counted(source, run).withColumn("least_suffix", last(known + 1)).repartition("lang", "least_suffix")
    ending = ending.groupBy("lang", "least_suffix", "words", "phrase").agg(F.sum("n").alias("n"))
    # a phrase is frequent only if its suffix is; most of them go here
    kept = ending.withColumn("of_suffix", F.sum("n").over(Window.partitionBy("lang", "least_suffix"))).where(F.col("of_suffix") >= least)
    kept = materialise(kept.select("lang", "words", "phrase", "n"), "ending")
    levels = [kept.where(F.col("words") >= k).groupBy("lang", F.lit(k).alias("words"), last(k).alias("phrase")).agg(F.sum("n").alias("n")).where(F.col("n") >= least) for k in range(known + 1, most_words + 1)]
    return reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, percent: int = PERCENT, filter_bits: int = FILTER_BITS, filter_words: int = FILTER_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and phrase."""
    if percent != 100:
        raise ValueError("subsumption goes by equal counts: percent has to be 100")
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    known = materialise(short_counts(source, least, min(filter_words, most_words), shard_bytes), "short")
    if most_words > filter_words:
        frequent = frequent_filter(known.where(F.col("words") >= 2).select("lang", "phrase"), filter_bits)
        known = known.unionByName(materialise(long_counts(source, frequent, least, most_words, filter_words, shard_bytes), "long"))
    candidates = known.where("words >= 2").select("lang", F.split("phrase", " ").alias("parts"), "phrase", F.col("n").alias("a"))
    piece = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    size = F.size("parts")

    shorter = candidates.where(size > 2).select("lang", F.explode(F.array(piece(F.lit(1), size - 1), piece(F.lit(2), size - 1))).alias("phrase"), F.col("a").alias("longer"))
    explained = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(explained, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")

    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "parts").select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, size - F.col("k")).alias("rest"))
    part = known.where("words >= 1").select("lang", "phrase", "n")
    of = lambda name, count: part.toDF("lang", name, count)
    totals = known.where("words = 0").select("lang", "n")  # a row a language
    each = cuts.join(of("head", "l"), ["lang", "head"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    each = each.withColumn("score", F.expr(f"(CAST(1000 AS DECIMAL(38,0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    scored = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    first = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    some = first(scored.select("*", salt), "lang", "salt").drop("rank", "salt")
    return first(some, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
