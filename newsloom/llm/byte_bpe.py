"""Byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

The merges (ranks) define which pairs of tokens may stand side by side: the encoding of any prefix of a piece ends in
one token that is known by then, and two neighbours are right just when their joined bytes encode to those two. So a
transducer can read bytes one by one. Its states stand for all places at which a token that goes on could have
started at once (the longest end that starts a token; the others are its own ends), and states and transitions are
made when first met and kept. At each byte it notes the one token that may end there after the token before it.
Tokens come out once all places that can still matter lead back to them: after a lookahead of a few times the longest
token's bytes at most.

Pieces are the matches of a pre-tokeniser pattern; equal pieces are encoded once per worker and memo period. The new
pieces of a block of texts are read in sorted order, so what neighbours begin with in common is read once. Decoding
streams: token bytes go through an incremental UTF-8 automaton that holds back an unfinished character between blocks.

Defined cases: a null text counts as empty and has no tokens; ids that aren't in the vocabulary raise; bytes that
aren't UTF-8 decode to U+FFFD; repeated or null doc_ids each get their own row; other columns aren't read.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Memo, arrow_map, byte_slices, of_worker

BATCH_BYTES = 1 << 20
_DECODE_ROWS = 256
#: Pairs of tokens, and bytes of each of the memo's generations, kept by one Python worker before it starts afresh.
MOST_PAIRS = 250_000
MEMO_BYTES = 64 << 20
#: Longer pieces are read alone: sorted ones lie side by side in one array, each as wide as the longest.
SHARED_CHARS = 32
#: Of texts of more characters than BATCH_BYTES, so many pieces are encoded at a time.
BLOCK_PIECES = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 bytes and rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeTransducer:
    """Bytes of one piece -> ranks, by states made on demand.

    A state is the longest end of what was read that starts some token; its outputs are the tokens that end here,
    longest first. There are at most as many states as the vocabulary has prefixes.
    """

    def __init__(self, ranks: dict[bytes, int], most_pairs: int = MOST_PAIRS):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.stems = {token[:k] for token in ranks for k in range(1, len(token))}
        self.most_pairs = most_pairs
        self._split: dict[int, tuple[int, int] | None] = {}
        self._fits: list[dict[int, bool]] = [{} for _ in range(max(ranks.values(), default=-1) + 1)]
        self._n_fits = 0
        self._codes = {rank: struct.pack("<I", rank) for rank in self.bytes_of}
        self._ids: dict[bytes, int] = {b"": 0}
        self._ends: list[bytes] = [b""]
        self._outputs: list[tuple[tuple[int, int], ...]] = [()]
        self._moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """Parts by applying merges of ranks under `below`, lowest first; only used on the bytes of single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, or if no merges make it (it then can't occur)."""
        if token not in self._split:
            parts = self._merge(self.bytes_of[token], token)
            self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def possible(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two possible tokens gives just these two.

        Undoes merges on either side of the border, the latest first: at each moment the two tokens at the border must
        not merge before one of them is merged into the next larger token on its own side.
        """
        known = self._fits[left].get(right)
        if known is None:
            if self._n_fits > self.most_pairs:
                for pairs in self._fits:
                    pairs.clear()
                self._n_fits = 0
            self._n_fits += 1
            known = self._fits[left][right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        bytes_of, never = self.bytes_of, 1 << 60
        left_made, right_made = never, never  # ranks of the merges that swallow left and right on their own sides
        while True:
            across = self.ranks.get(bytes_of[left] + bytes_of[right], never)
            # equal ranks merge leftmost first, so a tie goes to the left side's own merge, and to this one before the right's
            if across < left_made and across <= right_made and across != never:
                return False
            single_left, single_right = len(bytes_of[left]) == 1, len(bytes_of[right]) == 1
            if single_left and single_right:
                return True
            if single_right or (not single_left and left > right):
                left_made, left = left, self._halves(left)[1]
            else:
                right_made, right = right, self._halves(right)[0]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The state after byte with its outputs; determinises a new one if need be."""
        end = self._ends[state] + bytes([byte])
        while end not in self.stems and end not in self.ranks:
            end = end[1:]
            if not end:
                raise ValueError(f"byte {byte} has no token")
        target = self._ids.get(end)
        if target is None:
            target = self._ids[end] = len(self._ends)
            self._ends.append(end)
            tokens = ((self.ranks.get(end[k:]), len(end) - k) for k in range(len(end)))
            self._outputs.append(tuple((t, n) for t, n in tokens if t is not None and self.possible(t)))
        move = self._moves[state << 8 | byte] = (target, self._outputs[target])
        return move

    def stream(self, data: bytes) -> Iterator[int]:
        """Ranks of a piece, each as soon as no later byte can change it."""
        moves, sizes = self._moves, self.bytes_of
        state = base = done = 0
        lasts: list[int] = []  # the last token of the encoding up to each place, from `base` on
        for at, byte in enumerate(data):
            state, outputs = moves.get(state << 8 | byte) or self._move(state, byte)
            for token, size in outputs:
                if size > at or self.fits(lasts[at - size - base], token):
                    break
            lasts.append(token)
            if at - base >= 4 * self.longest:
                # walk all places from which a token may still go on back until they meet: what lies before is settled
                end = self._ends[state]
                places = {at + 1, *(at + 1 - len(end) + k for k in range(len(end)) if end[k:] in self.stems)}
                while len(places) > 1:
                    far = max(places)
                    places.remove(far)
                    places.add(far - len(sizes[lasts[far - base - 1]]) if far > base else base)
                settled = places.pop()
                if settled > done:
                    yield from self._back(lasts, settled - base, done - base)
                    done = settled
                    del lasts[: settled - 1 - base]  # the last settled token stays, for what may follow it
                    base = settled - 1
        yield from self._back(lasts, len(lasts), done - base)

    def _back(self, lasts: list[int], end: int, start: int) -> list[int]:
        """The tokens from place start to place end, found from the last one back."""
        out = []
        while end > start:
            out.append(lasts[end - 1])
            end -= len(self.bytes_of[lasts[end - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ranks of a piece; one that is a token itself stays whole, as the library has it."""
        return [rank for (rank,) in struct.iter_unpack("<I", self.packed(data))]

    def packed(self, data: bytes) -> bytes:
        """encode() as little-endian unsigned 32-bit numbers."""
        if len(data) < 4 * self.longest or data in self.ranks:
            return next(self.encode_sorted([data]))
        ids = list(self.stream(data))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The ranks of each piece as packed() has them; any order is right, a sorted one is fast.

        What a piece begins with in common with the one before it isn't read again, so all places of a piece are kept
        until it ends; much longer pieces than the longest token are for stream().
        """
        move, fits, codes, whole = self._moves.get, self._fits, self._codes, self.ranks.get
        states: list[int] = []
        lasts: list[int] = []
        made: list[bytes] = []  # the ranks of the encoding up to each place
        for piece, common in zip(pieces, shared_starts(pieces), strict=True):
            token = whole(piece)
            if token is not None:
                yield codes[token]
            common = min(common, len(states))
            del states[common:], lasts[common:], made[common:]
            if token is not None:
                continue
            state = states[-1] if common else 0
            for at in range(common, len(piece)):
                byte = piece[at]
                state, outputs = move(state << 8 | byte) or self._move(state, byte)
                for token, size in outputs:
                    if size > at:
                        made.append(codes[token])
                        break
                    left = lasts[at - size]
                    ok = fits[left].get(token)
                    if ok or ok is None and self.fits(left, token):
                        made.append(made[at - size] + codes[token])
                        break
                states.append(state)
                lasts.append(token)
            yield made[-1] if made else b""


def shared_starts(pieces: list[bytes]) -> list[int]:
    """For each piece, how many bytes it begins with in common with the one before it."""
    if len(pieces) < 2:
        return [0] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    table = np.array(pieces, f"S{max(int(sizes.max()), 1)}").view(np.uint8).reshape(len(pieces), -1)
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
    return [0, *np.minimum(first, np.minimum(sizes[1:], sizes[:-1])).tolist()]  # blanks that fill rows up don't count


#: Letters and numbers that newer tables of `regex` know and the library's (Unicode 16) don't; for it they are other characters.
_NEWER = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10eee 11b0a-11b0a 11db0-11df1 1246f-1247f 12550-12686 16ea0-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-191d2 "
    "1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1dfff 1e6c0-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-3fc3f"
).split()
_NEWER_CLASS = "".join(rf"\U{int(a, 16):08x}-\U{int(b, 16):08x}" for a, b in (x.split("-") for x in _NEWER))


def _members(name: str) -> str:
    """The characters up to U+FFFF of a class of `regex`, as ranges for a class of `re`, which is faster but knows no properties."""
    known = regex.compile(rf"(?V1)[{name}--[{_NEWER_CLASS}]]+")
    spans = [x[0] for span in (range(0xD800), range(0xE000, 0x10000)) for x in known.finditer("".join(map(chr, span)))]
    return "".join(rf"\u{ord(x[0]):04x}-\u{ord(x[-1]):04x}" for x in spans)


class PieceFinder:
    """All matches of a pattern of `regex` in a text. The shipped pattern is written anew with the library's classes: for
    `re`, or for `regex` where a text has characters beyond U+FFFF."""

    def __init__(self, pattern: str):
        self.general, self.fast = regex.compile(pattern), None
        if pattern == public_tokenizers.PATTERN:
            ends, newer = "'(?:s|t|re|ve|m|ll|d)", f"[{_NEWER_CLASS}]"
            self.general = regex.compile(rf"(?V1) ?[\p{{L}}--{newer}]+|{ends}| ?[\p{{N}}--{newer}]+| ?[[^\s\p{{L}}\p{{N}}]||{newer}]+|\s+(?!\S)|\s+")
            space, letter, digit = map(_members, (r"\s", r"\p{L}", r"\p{N}"))
            self.fast = re.compile(rf" ?[{letter}]+|{ends}| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
            self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def _of(self, text: str):
        return self.fast if self.fast and (text.isascii() or not self.beyond(text)) else self.general

    def __call__(self, text: str) -> list[str]:
        return self._of(text).findall(text)

    def blocks(self, text: str, most: int = BLOCK_PIECES) -> Iterator[tuple[str, ...]]:
        """The same in blocks, for texts whose pieces would take much memory."""
        return itertools.batched((m[0] for m in self._of(text).finditer(text)), most)


class TextEncoder:
    """Texts -> little-endian unsigned 32-bit ids, with a memo for pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = MEMO_BYTES):
        self.transducer = MergeTransducer(ranks)
        self.find = PieceFinder(pattern)
        self.memo = Memo(lambda piece: self.transducer.packed(piece.encode()), most)

    def _learn(self, pieces: Iterable[str]) -> None:
        """Put those of the pieces that the memo lacks into it, but for long ones, which are encoded where they stand."""
        memo, older = self.memo, self.memo.older
        new = sorted(p for p in pieces if p not in memo and p not in older and len(p) <= SHARED_CHARS)
        for piece, ids in zip(new, self.transducer.encode_sorted([p.encode() for p in new]), strict=True):
            memo.put(piece, ids)

    def _joined(self, found: Sequence[Sequence[str]]) -> list[bytes]:
        self._learn(set().union(*found))
        out = [b"".join(map(self.memo.__getitem__, pieces)) for pieces in found]
        self.memo.trim()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        short = iter(self._joined([self.find(t) for t in texts if len(t) <= BATCH_BYTES]))
        return [next(short) if len(t) <= BATCH_BYTES else b"".join(self._joined([x])[0] for x in self.find.blocks(t)) for t in texts]


#: For each first byte of a UTF-8 character, how many bytes it has (by upper nibble; 8 to B continue one).
_UTF8_LENGTH = {**dict.fromkeys(range(8), 1), 0xC: 2, 0xD: 2, 0xE: 3, 0xF: 4}


class Utf8Stream:
    """Blocks of bytes -> text; the bytes of a character that isn't finished wait for the next block."""

    def __init__(self):
        self.waiting = b""

    def feed(self, block: bytes, last: bool = False) -> str:
        data = self.waiting + block
        cut = len(data)
        if not last:
            for back in range(1, min(4, len(data)) + 1):
                need = _UTF8_LENGTH.get(data[-back] >> 4)
                if need is not None:
                    cut -= back if need > back else 0
                    break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class TokenDecoder:
    """Ids -> text, in blocks of block_tokens."""

    def __init__(self, ranks: dict[bytes, int], block_tokens: int = 4096):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.block_tokens = block_tokens

    def decode(self, ids: np.ndarray) -> str:
        stream, out = Utf8Stream(), []
        for start in range(0, len(ids), self.block_tokens):
            block = ids[start : start + self.block_tokens].tolist()
            out.append(stream.feed(b"".join(map(self.bytes_of.__getitem__, block))))
        out.append(stream.feed(b"", last=True))
        return "".join(out)


def _default(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and ids (array of int)."""
    path = _default(ranks_path)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(("byte_bpe", path, pattern), lambda: TextEncoder(read_ranks(path), pattern))
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                packed = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int64).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_col, "ids"])

    kind = source.schema[id_col].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of ids_col added as out_col, in place of a column of that name; null ids give a null text."""
    path = _default(ranks_path)
    if out_col == ids_col:
        raise ValueError("out_col must differ from ids_col")
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = of_worker(("byte_bpe", path), lambda: TokenDecoder(read_ranks(path)))
        for batch in batches:
            for start in range(0, batch.num_rows, _DECODE_ROWS):
                part = batch.slice(start, _DECODE_ROWS)
                texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return arrow_map(encoded, run, f"{schema}, `{out_col}` string")
