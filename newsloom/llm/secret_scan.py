"""Secret scans: base patterns, and formats inferred from the credentials that they label.

A bounded, documented sample of documents gives labelled credentials and ordinary tokens. Credentials are clustered by
a literal start that many share, or else by alphabet and length. For each cluster a prefix tree is built, in which
siblings that are too thin to be told apart are one state, and states whose symbols are statistically compatible all the way down (Hoeffding's bound) are merged, whatever their depths, into
a probabilistic automaton: a literal start stays a chain, a random rest becomes a loop. Lengths are a distribution of
their own beside it, so the merge test doesn't see them. Two bigram models of ordinary tokens, with digits and without,
are the other side: a candidate's score is the gain in log-likelihood per character of its best format over them. Every
candidate of every whole text is scored, however long, and one over the threshold becomes a span of kind `format`; base
spans always stay. Formats are learned from one half of the credentials; the threshold comes from the scores of all
labelled credentials of the other half and of all other candidates of all documents, counted in bins.

A candidate is a whole run of [A-Za-z0-9+/_=.-] between other characters that aren't letters, without `.`, `-`, `/` or
`=` at its start and `.` or `-` at its end, of CANDIDATE_LEAST characters or more: fewer say too little.

Defined cases: a null text has no spans; ids may repeat or be null, and equal rows are learned from once; without
MIN_FORMAT labelled credentials of one cluster no format spans are added; spans count code points, end exclusive; of
spans with one start base kinds come first, in their order; a candidate that overlaps a base span isn't added again;
other columns aren't read, and mask() leaves them as they are; an empty table gives an empty result. A text is read as
one string by one task, in time that grows with its length: runs and base spans are merged as sorted lists.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, bounded_batches, bounded_sample, byte_slices, materialise, release_memory

BASE_KINDS = ("assign", "access", "hex")
METHOD_KIND = "format"

#: The base patterns, each with the least length of what it has to hold.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: A run of credential characters that no letter of another alphabet adjoins.
CANDIDATE_LEAST = 8
RUN = re.compile(r"(?<![\w+/=.-])[A-Za-z0-9+/_=.-]{%d,}+(?!\w)" % CANDIDATE_LEAST)

#: Bounds of the fit: documents of the sample, credentials of a base kind, ordinary tokens with and without digits, and
#: the first characters of a word that its format is learned from (its length counts whole).
TRAIN_DOCS = 40_000
TRAIN_PER_KIND = 2_000
TRAIN_ORDINARY = 8_000
LEARNED_CHARS = 512
#: A format needs this many distinct credentials; a state with fewer visits than MIN_EVIDENCE is pooled with its like.
MIN_FORMAT = 8
MIN_EVIDENCE = 24
ALPHA = 0.05
#: The share of lengths that no credential of a format has had.
OTHER_LENGTHS = 0.02
#: Words up to so many characters are scored side by side, in tables of at most so many cells; longer ones one by one.
SIDE_BY_SIDE, CELLS = 2048, 1 << 20
#: What a false span costs against a missed credential, in shares of either; bins of scores; and the least gain.
FALSE_COST = 10.0
BIN_WIDTH, BINS = 0.02, 1000
LEAST_GAIN = 0.0
BATCH_BYTES = 1 << 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
_CODE = np.full(128, 0, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_SHAPES = [("hex", re.compile(r"[0-9a-f]+")), ("HEX", re.compile(r"[0-9A-F]+")), ("lower", re.compile(r"[a-z0-9]+")), ("upper", re.compile(r"[A-Z0-9]+")), ("mixed", re.compile(r"[A-Za-z0-9]+"))]
_LITERAL = re.compile(r"[A-Za-z][A-Za-z0-9]*[_-](?:[A-Za-z]+[_-])?")


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE_KINDS.index(x[2])))


@dataclass
class Automaton:
    """A probabilistic automaton: counts of symbols and ends by state, and moves; state 0 starts. lengths: of its words."""

    symbols: list[Counter] = field(default_factory=lambda: [Counter()])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, int]] = field(default_factory=lambda: [{}])
    lengths: Counter = field(default_factory=Counter)

    def _state(self) -> int:
        self.symbols.append(Counter())
        self.ends.append(0)
        self.moves.append({})
        return len(self.ends) - 1

    @classmethod
    def prefix_tree(cls, words: list[str], lengths: list[int] | None = None, least: int = 1) -> Automaton:
        """The prefix tree of words, in which children of a state that fewer than `least` words visit are one state: too
        few to be told apart. lengths: the words' own, where a word is only a beginning."""
        tree, todo = cls(), [(0, words, 0)]
        tree.lengths.update(lengths or map(len, words))
        while todo:
            at, own, depth = todo.pop()
            nexts: dict[str, list[str]] = defaultdict(list)
            for w in own:
                if len(w) > depth:
                    nexts[w[depth]].append(w)
                else:
                    tree.ends[at] += 1
            thin: list[str] = []
            pooled = -1
            for c, of in sorted(nexts.items()):
                tree.symbols[at][c] = len(of)
                if len(of) >= least:
                    tree.moves[at][c] = tree._state()
                    todo.append((tree.moves[at][c], of, depth + 1))
                else:
                    pooled = tree._state() if pooled < 0 else pooled
                    tree.moves[at][c] = pooled
                    thin += of
            if thin:
                todo.append((pooled, thin, depth + 1))
        return tree

    def total(self, state: int) -> int:
        return self.ends[state] + self.symbols[state].total()

    def difference(self, a: int, b: int, alpha: float, of) -> float:
        """By how much the next symbols of states a and b, and of all that follow, differ at most, as a share of
        Hoeffding's bound; over 1 they aren't compatible."""
        todo, seen, width, most = [(a, b)], set(), math.sqrt(0.5 * math.log(2 / alpha)), 0.0
        while todo:
            a, b = map(of, todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self.symbols[a].total(), self.symbols[b].total()
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.symbols[a].keys() | self.symbols[b].keys():
                most = max(most, abs(self.symbols[a][c] / n - self.symbols[b][c] / m) / bound)
                if c in self.moves[a] and c in self.moves[b]:
                    todo.append((self.moves[a][c], self.moves[b][c]))
            if most > 1:
                break
        return most

    def fit(self, state: int, other: int) -> float:
        """The log-likelihood of the other state's next symbols under this one's."""
        seen = self.symbols[state].total() + 1.0
        return sum(n * math.log((self.symbols[state][c] + 0.01) / seen) for c, n in self.symbols[other].items())

    @classmethod
    def infer(cls, words: list[str], alpha: float = ALPHA, lengths: list[int] | None = None, least: int = MIN_EVIDENCE) -> Automaton:
        """Merge the compatible states of the prefix tree of words, the most visited first, each into the one that tells its symbols best."""
        auto = cls.prefix_tree(words, lengths, least)
        parent = list(range(len(auto.ends)))

        def of(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def merge(a: int, b: int) -> None:
            # moves that both have lead to states that merge in turn, so it stays deterministic
            todo = [(a, b)]
            while todo:
                a, b = map(of, todo.pop())
                if a == b:
                    continue
                a, b = min(a, b), max(a, b)
                parent[b] = a
                auto.ends[a] += auto.ends[b]
                auto.symbols[a] += auto.symbols[b]
                for c, child in auto.moves[b].items():
                    if c in auto.moves[a]:
                        todo.append((auto.moves[a][c], child))
                    else:
                        auto.moves[a][c] = child

        kept = [0]
        while True:
            known = {of(k) for k in kept}
            kept = sorted(known)
            fringe = {of(t) for k in kept for t in auto.moves[k].values()} - known
            if not fringe:
                break
            state = min(fringe, key=lambda x: (-auto.total(x), x))
            alike = [k for k in kept if auto.difference(k, state, alpha, of) <= 1]
            if alike:
                merge(max(alike, key=lambda k: (auto.fit(k, state), -k)), state)
            else:
                kept.append(state)
        place = {k: i for i, k in enumerate(kept)}
        return cls([auto.symbols[k] for k in kept], [auto.ends[k] for k in kept], [{c: place[of(t)] for c, t in auto.moves[k].items()} for k in kept], auto.lengths)

    def log_length(self, sizes: np.ndarray) -> np.ndarray:
        """Log-probabilities of lengths: mostly those seen, and a little of all others."""
        seen = max(1, self.lengths.total())
        share = np.fromiter((self.lengths[int(n)] / seen for n in sizes), float, len(sizes))
        return np.log((1 - OTHER_LENGTHS) * share + OTHER_LENGTHS / (1.0 + sizes) ** 1.5)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of symbols by state, and moves, for whole batches.

        A state backs off to the format's characters as a whole, the more so the more different ones it has seen, and
        these a little to all others; a symbol without a move goes where most of the state's do.
        """
        n, size = len(self.ends), len(ALPHABET)
        counts = np.zeros((n, size))
        moves = np.zeros((n, size), np.int64)
        for k in range(n):
            for c, x in self.symbols[k].items():
                counts[k, _CODE[ord(c)]] = x
            to = Counter()
            for c, t in self.moves[k].items():
                to[t] += self.symbols[k][c]
            moves[k] = max(to, key=lambda t: (to[t], -t)) if to else k
            for c, t in self.moves[k].items():
                moves[k, _CODE[ord(c)]] = t
        whole = counts.sum(axis=0)
        common = 0.998 * (whole + 0.5 * (whole > 0)) / max((whole + 0.5 * (whole > 0)).sum(), 1e-9) + 0.002 / size
        seen = counts.sum(axis=1)
        kinds = 1.0 + (counts > 0).sum(axis=1)
        return np.log((counts + kinds[:, None] * common) / (seen + kinds)[:, None]), moves

    def log_likelihood(self, word: str) -> float:
        return float(_likelihood([self], [self.tables()], *_codes([word]))[0])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of codes, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = _CODE[np.frombuffer("".join(words).encode("ascii"), np.uint8)]
    out = np.zeros((len(words), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def _likelihood(automata: list[Automaton], tables: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The log-likelihood of each word under its best format."""
    best = np.full(len(sizes), -np.inf)
    for own, (log_symbol, moves) in zip(automata, tables, strict=True):
        if len(sizes) == 1:  # a long word by itself: plain steps
            log_of, to = log_symbol.ravel().tolist(), (moves * log_symbol.shape[1]).ravel().tolist()
            total, at = 0.0, 0
            for low in range(0, codes.shape[1], 1 << 16):
                for c in codes[0, low : low + (1 << 16)].tolist():
                    total += log_of[at + c]
                    at = to[at + c]
            total = np.array([total])
        else:
            state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for at in range(codes.shape[1]):
                live = np.flatnonzero(sizes > at)
                c = codes[live, at]
                total[live] += log_symbol[state[live], c]
                state[live] = moves[state[live], c]
        best = np.maximum(best, total + own.log_length(sizes))
    return best


def _bigrams(words: list[str]) -> np.ndarray:
    """Log-probabilities of a symbol after another; the last row and column stand for a token's borders."""
    size = len(ALPHABET)
    counts = np.full((size + 1, size + 1), 0.05)
    for w in words:
        own = _CODE[np.frombuffer(w.encode("ascii"), np.uint8)]
        np.add.at(counts, (np.append(size, own), np.append(own, size)), 1)
    single = counts.sum(axis=0) / counts.sum()
    counts += 2 * single[None, :]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@dataclass
class Formats:
    names: list[str]
    automata: list[Automaton]
    ordinary: list[np.ndarray]
    threshold: float = math.inf
    recall: float = 0.0  # of labelled credentials of all documents that weren't learned from
    others: float = 0.0  # share of all other candidates over the threshold

    def __post_init__(self):
        self.tables = [a.tables() for a in self.automata]

    def scores(self, words: list[str]) -> np.ndarray:
        """The gain per character of the best format over ordinary tokens, of each word; equal words are worked out once."""
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        once = list(place)
        out = np.zeros(len(once))
        # words of like length together, so that one long word doesn't stretch all
        order = sorted(range(len(once)), key=lambda i: len(once[i]))
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and len(once[order[high]]) <= SIDE_BY_SIDE and (high + 1 - low) * len(once[order[high]]) <= CELLS:
                high += 1
            part = order[low:high]
            codes, sizes = _codes([once[i] for i in part])
            out[part] = (_likelihood(self.automata, self.tables, codes, sizes) - self._plain(codes, sizes)) / (sizes + 1)
            low = high
        return out[at]

    def _plain(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The log-likelihood of each word as an ordinary token."""
        size, sums = len(ALPHABET), np.zeros((len(self.ordinary), len(sizes)))
        for low in range(0, codes.shape[1] + 1, max(1, CELLS // len(sizes))):
            high = min(low + max(1, CELLS // len(sizes)), codes.shape[1] + 1)
            before = np.full((len(sizes), high - low), size)
            before[:, (low == 0) :] = codes[:, max(0, low - 1) : high - 1]
            after = np.full((len(sizes), high - low), size)
            after[:, : min(high, codes.shape[1]) - low] = codes[:, low : min(high, codes.shape[1])]
            places = np.arange(low, high)[None, :]
            after[places == sizes[:, None]] = size
            for k, table in enumerate(self.ordinary):
                sums[k] += np.where(places <= sizes[:, None], table[before, after], 0.0).sum(axis=1)
        return np.logaddexp.reduce(sums - math.log(len(self.ordinary)), axis=0)


def cluster(words: list[str]) -> dict[str, list[str]]:
    """Distinct credentials by format name: a literal start that MIN_FORMAT share, or else alphabet and length."""
    left, found = sorted(set(words)), {}
    for start_of in (lambda w: m[0] if (m := _LITERAL.match(w)) and len(m[0]) <= 16 else "", lambda w: w[:4]):
        groups = defaultdict(list)
        for w in left:
            if len(start := start_of(w)) >= 3 and len(w) >= 2 * len(start):
                groups[start].append(w)
        # of random starts none is so frequent
        taken = {s: own for s, own in groups.items() if len(own) >= max(MIN_FORMAT, len(left) // 200)}
        found |= {f"{s}...": own for s, own in taken.items()}
        left = sorted(set(left).difference(*taken.values()))
    shape = lambda w: next((name for name, p in _SHAPES if p.fullmatch(w)), "any")
    for name_of in (lambda w: f"{shape(w)}, {len(w)}", lambda w: f"{shape(w)}, up to {1 << len(w).bit_length()}", shape):
        groups = defaultdict(list)
        for w in left:
            groups[name_of(w)].append(w)
        taken = {s: own for s, own in groups.items() if len(own) >= MIN_FORMAT}
        found |= taken
        left = sorted(set(left).difference(*taken.values()))
    return found


def literal_starts(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(name.removesuffix("...") for name in names if name.endswith("..."))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of the candidates of text that no base span (in order of start) overlaps."""
    out, at, last = [], 0, -1
    for m in RUN.finditer(text):
        run = m[0].rstrip(".-")
        start = m.end() - len(m[0].lstrip(".-/="))
        end = m.start() + len(run)
        while at < len(base) and base[at][0] < end:
            last = max(last, base[at][1])
            at += 1
        if end - start >= CANDIDATE_LEAST and last <= start:
            out.append((start, end, text[start:end]))
    return out


def learned_from(word: str) -> bool:
    """Half of all credentials teach the formats; the others, unseen, calibrate the threshold."""
    return zlib.crc32(word.encode()) & 1 == 0


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, per_kind: int = TRAIN_PER_KIND) -> Formats | None:
    """Formats of the credentials that base patterns label in train_docs documents at most; None without any.

    The threshold is calibrated on all documents: it weighs the labelled credentials that it misses against the share
    of other candidates over it.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0, BATCH_BYTES):
                found: Counter = Counter()
                for text in part.column(0).to_pylist():
                    own = base_spans(text)
                    found.update((k, w[:LEARNED_CHARS], len(w)) for _, _, k, w in own)
                    found.update(("digits" if any(map(str.isdigit, w)) else "letters", w[:LEARNED_CHARS], len(w)) for _, _, w in candidates(text, own))
                kinds, words, sizes = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(sizes, pa.int32())], names=["kind", "word", "size"])

    sample = bounded_sample(source, ["id", "text"], train_docs)
    told = materialise(arrow_map(sample.select("text"), label, "kind string, word string, size int").distinct(), "credential-words")
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for kind, most in (*((k, per_kind) for k in BASE_KINDS), ("digits", TRAIN_ORDINARY), ("letters", TRAIN_ORDINARY)):
        rows = told.where(F.col("kind") == kind).groupBy("word").agg(F.max("size").alias("size")).orderBy(F.xxhash64("word", F.lit(5)), "word").limit(most).collect()
        held[kind] = [r["word"] for r in rows]
        sizes |= {r["word"]: r["size"] for r in rows}
    words = [w for k in BASE_KINDS for w in held[k]]
    known = cluster([w for w in words if learned_from(w)]) or cluster(words)
    if not known:
        return None
    starts = literal_starts(known)
    plain = ([w for w in held[kind] if not w.startswith(starts)] for kind in ("digits", "letters"))  # unlabelled credentials aren't ordinary
    ordinary = [_bigrams(own) for own in plain if own] or [_bigrams([])]
    formats = Formats(list(known), [Automaton.infer(own, lengths=[sizes[w] for w in own]) for own in known.values()], ordinary)
    return calibrate(source, formats)


def calibrate(source: DataFrame, formats: Formats) -> Formats:
    """formats with the threshold at which missed credentials and FALSE_COST x false spans, as shares, cost least."""
    shared = source.sparkSession.sparkContext.broadcast(formats)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, np.zeros((2, BINS), np.int64)
        starts = literal_starts(own.names)  # candidates that begin so are no evidence against a format
        for batch in batches:
            for part in byte_slices(batch, 0, BATCH_BYTES):
                known, other = [], []
                for text in part.column(0).to_pylist():
                    base = base_spans(text)
                    known += [w for _, _, _, w in base if len(w) >= CANDIDATE_LEAST and not learned_from(w)]
                    other += [w for _, _, w in candidates(text, base) if not w.startswith(starts)]
                for row, words in enumerate((other, known)):
                    held[row] += np.bincount(_bin(own.scores(words)), minlength=BINS)
        which, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(which == 1), pa.array(at.astype(np.int32)), pa.array(held[which, at])], names=["known", "bin", "n"])

    held = np.zeros((2, BINS))
    for r in arrow_map(source.select("text"), count, "known boolean, bin int, n bigint").groupBy("known", "bin").agg(F.sum("n").alias("n")).collect():  # 2 x BINS rows at most
        held[int(r["known"]), r["bin"]] = r["n"]
    over = np.cumsum(held[:, ::-1], axis=1)[:, ::-1]  # rows at or above each bin's lower edge
    share = over / np.maximum(held.sum(axis=1, keepdims=True), 1.0)
    cost = (1 - share[1]) + FALSE_COST * share[0]
    least = _bin(np.array([LEAST_GAIN]))[0] + 1
    best = least + np.flatnonzero(cost[least:] <= cost[least:].min() + 1e-12)
    run = best[: 1 + np.argmax(np.append(np.diff(best) != 1, True))]  # the first gap between the two sides
    at = int(run[len(run) // 2])
    formats.threshold, formats.recall, formats.others = (at - BINS // 2) * BIN_WIDTH, float(share[1, at]), float(share[0, at])
    return formats


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.maximum(scores, -1e6) / BIN_WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64)


def spans_of_all(texts: list[str], formats: Formats | None) -> list[list[tuple[int, int, str, str]]]:
    """All spans of each text by start, then kind, base kinds first."""
    found = [base_spans(t) for t in texts]
    if formats:
        runs = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, found[i])]
        for (i, start, end, run), score in zip(runs, formats.scores([r[3] for r in runs]), strict=True):
            if score >= formats.threshold:
                found[i].append((start, end, METHOD_KIND, run))
    order = (*BASE_KINDS, METHOD_KIND)
    return [sorted(own, key=lambda x: (x[0], order.index(x[2]))) for own in found]


def spans_of(text: str, formats: Formats | None) -> list[tuple[int, int, str, str]]:
    return spans_of_all([text], formats)[0]


SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def scan(docs: DataFrame, formats: Formats | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and spans, each with start, end, kind and the credential."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                spans = [[dict(start=s, end=e, kind=k, value=v) for s, e, k, v in own] for own in spans_of_all(part.column(1).to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return arrow_map(source, run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, spans {SPANS}")


def masked_batches(batches: Iterator[pa.Array], formats: Formats | None, mark: str) -> Iterator[pa.Array]:
    """The texts of each batch with their spans replaced by mark, BATCH_BYTES of them at a time; null texts stay null."""
    for batch in batches:
        out = []
        for part in byte_slices(pa.RecordBatch.from_arrays([batch], names=["text"]), 0, BATCH_BYTES):
            whole = part.column(0).to_pylist()
            for text, spans in zip(whole, spans_of_all([t or "" for t in whole], formats), strict=True):
                parts, at = [], 0
                for start, end, _, _ in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if spans else text)
        yield pa.array(out, pa.string())
    release_memory()


def mask(docs: DataFrame, formats: Formats | None, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by mark; all columns stay, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from masked_batches(batches, shared.value, mark)

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
