"""Exact duplicates: radix tries over whole byte strings, whose terminal nodes know each text's owner.

Every task first puts equal texts of its own together, so a text leaves a task once, with the number of its rows and
their largest id. Texts are then dealt by length and content hash, into as many partitions as their bytes ask for, and
each partition inserts the full byte strings into a compressed radix trie (Patricia trie): an edge holds a run of bytes,
and a terminal node the owner (the largest id, as the contract has it), the number of rows and the digest. So two texts
are one only if all their bytes are equal, whatever their hashes. A trie that holds more than TRIE_BYTES spills its
heaviest subtree: that subtree's texts, and all that later fall into it, are written to the shared folder as rows of the
next round, which deals them anew; the last text of a trie is never spilled, so every round ends some.

Rows then get their owner by digest (SHA-256; a partition in which two texts share one raises), where digests of very
many rows are broadcast (fewer than 1 / HOT_SHARE of them), so copies of one text never meet in one task.

Defined cases: a null text counts as empty, and empty texts are one group; rows with a null id count in group_size and
go unless no row of their group has an id (keep_id null), when all stay; rows that share an id and a text stay or go
together; ties don't arise, as an owner is named by its id; an empty table gives an empty result; other columns aren't
read. One text is held whole by a task that inserts it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, join_counted, materialise

#: Bytes of text dealt to a partition on average, and held by one trie at most (but for its last text).
PARTITION_BYTES = 24 << 20
TRIE_BYTES = 96 << 20
#: Digests that a task remembers while it puts its own equal texts together.
SEEN_TEXTS = 1 << 17
OUT_BYTES = 4 << 20

_TEXTS = "length bigint, digest binary, text binary, n bigint, owner bigint"
_FOUND = f"open boolean, {_TEXTS}"


def largest(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Node:
    """The bytes on the way to a node, its children by their first byte, and what ends here. held: bytes of all below."""

    __slots__ = ("children", "digest", "edge", "held", "n", "owner", "spilled")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.held = edge, {}, len(edge)
        self.digest, self.n, self.owner, self.spilled = None, 0, None, False


def _common(edge: bytes, text: bytes, at: int) -> int:
    """How many first bytes of edge text has from `at` on, by halving: comparisons are of whole slices."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if edge[low:middle] == text[at + low : at + middle] else (low, middle - 1)
    return low


class Trie:
    """A compressed radix trie of byte strings with owners."""

    def __init__(self) -> None:
        self.root, self.terminals = Node(b""), 0

    def insert(self, text: bytes, digest: bytes, n: int, owner: int | None) -> bool:
        """Adds n rows of text; False if its subtree has been spilled."""
        node, at, path = self.root, 0, [self.root]
        while at < len(text) and not node.spilled:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                for above in path:
                    above.held += len(child.edge)
            elif not text.startswith(child.edge, at):
                k = _common(child.edge, text, at)
                upper = Node(child.edge[:k])
                upper.held = child.held
                child.edge, child.held = child.edge[k:], child.held - k
                upper.children[child.edge[0]] = child
                node.children[text[at]] = child = upper
            node = child
            path.append(node)
            at += len(node.edge)
        if node.spilled:
            return False
        if node.digest is None:
            self.terminals += 1
        node.digest, node.n, node.owner = digest, node.n + n, largest(node.owner, owner)
        return True

    def spill(self) -> Iterator[tuple[bytes, Node]]:
        """Takes the heaviest subtree of at most about half the bytes out, and gives its (text, terminal) pairs."""
        node, prefix, most = self.root, b"", self.root.held // 2
        path = [node]
        while node.children and (node is self.root or node.held > most):
            node = max((c for c in node.children.values()), key=lambda c: c.held)
            path.append(node)
            prefix += node.edge
        gone = node.held - len(node.edge)
        for above in path:
            above.held -= gone
        taken = list(_terminals(node, prefix))
        self.terminals -= len(taken)
        yield from taken
        node.children, node.digest, node.spilled = {}, None, True

    def __iter__(self) -> Iterator[tuple[bytes, Node]]:
        return _terminals(self.root, b"")


def _terminals(top: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
    open_nodes = [(top, prefix)]
    while open_nodes:
        node, text = open_nodes.pop()
        if node.digest is not None:
            yield text, node
        open_nodes += [(c, text + c.edge) for c in node.children.values()]


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about OUT_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[text_at] or b"")
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("n", pa.int64()), ("owner", pa.int64())])


def _once_a_task(batches: Iterator[pa.RecordBatch], seen_texts: int) -> Iterator[pa.RecordBatch]:
    """(id, text) rows -> a text where a task first sees it, and at its end the further rows of that text."""

    def rows() -> Iterator[tuple]:
        more: dict[bytes, list] = {}

        def further() -> Iterator[tuple]:
            for digest, (length, n, owner) in more.items():
                if n:
                    yield length, digest, None, n, owner
            more.clear()

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = text.as_buffer() if text.is_valid else b""
                digest = hashlib.sha256(body).digest()
                known = more.get(digest)
                if known is not None:
                    known[1:] = known[1] + 1, largest(known[2], own)
                    continue
                if len(more) >= seen_texts:
                    yield from further()
                more[digest] = [len(body), 0, None]
                yield len(body), digest, bytes(body), 1, own
        yield from further()

    return _batches(rows(), _ARROW, 2)


def _owners_of_partition(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie, more, digests = Trie(), {}, set()
        for batch in batches:
            for length, digest, text, n, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    known = more.get(digest, (length, 0, None))
                    more[digest] = (length, known[1] + n, largest(known[2], owner))
                elif not trie.insert(text, digest, n, owner):
                    yield True, length, digest, text, n, owner
                while trie.root.held > most and trie.terminals > 1:
                    for whole, node in trie.spill():
                        yield True, len(whole), node.digest, whole, node.n, node.owner
        for whole, node in trie:
            if node.digest in digests:
                raise ValueError("two texts share one digest")
            digests.add(node.digest)
            _, n, owner = more.pop(node.digest, (0, 0, None))
            yield False, len(whole), node.digest, None, node.n + n, largest(node.owner, owner)
        for digest, (length, n, owner) in more.items():
            yield True, length, digest, None, n, owner

    return _batches(rows(), pa.schema([("open", pa.bool_()), *_ARROW]), 3)


def owners(texts: DataFrame, size: int, *, partition_bytes: int = PARTITION_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(length, digest, text, n, owner) rows, in which a text comes at least once -> digest, n, owner of every text.

    size: bytes of all the texts. Rounds: one, and one more for as long as tries have spilled."""
    done, deal = None, 0
    while True:
        partitions = max(1, -(-size // partition_bytes))
        dealt = texts.repartition(partitions, "length", F.substring("digest", 1, 8), F.lit(deal))
        found = materialise(arrow_map(dealt, lambda batches: _owners_of_partition(batches, trie_bytes), _FOUND), "tries")
        ended = found.where("not open").select("digest", "n", "owner")
        done = ended if done is None else done.unionByName(ended)
        size = found.where("open").agg(F.sum("length")).first()[0]
        if size is None:
            return done
        texts, deal = found.where("open").drop("open"), deal + 1


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES, trie_bytes: int = TRIE_BYTES, seen_texts: int = SEEN_TEXTS) -> DataFrame:
    """One row per row of docs: id_col (long), keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = materialise(source.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("length")), "digests")
    total, size = rows.agg(F.count("*"), F.sum("length")).first()
    found = owners(arrow_map(source, lambda batches: _once_a_task(batches, seen_texts), _TEXTS), size or 0, partition_bytes=partition_bytes, trie_bytes=trie_bytes)
    sized = found.withColumn("group_size", F.col("n"))
    named = join_counted(rows.select("id", "digest"), sized, "digest", total)
    kept = F.col("owner").isNull() | F.coalesce(F.col("id") == F.col("owner"), F.lit(False))
    return named.select(F.col("id").alias(id_col), F.col("owner").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
