"""Near-duplicate documents: HyperMinHash registers, banded, estimated, then verified on whole shingle sets.

A document's set is its distinct 5-word shingles. Documents with equal sets are one node from the start, so exact
copies cost one row. A node's sketch has REGISTERS buckets; each keeps the least hash of its shingles compressed to
the number of leading zeros and MANTISSA_BITS bits that follow. Bands of registers, as many and as wide as the least
similarity asks for (band_plan), are the keys under which nodes meet. Two nodes that meet are compared by a Jaccard estimate that is corrected for accidental equal registers,
and then exactly on their sets.

Nodes of one key aren't paired with one another. First each is compared with the least of them, which near copies share
over most of their keys, so a large group has few links beyond one for each node. Where a key's nodes are then still in
different components, they are compared with one of them that is drawn anew for every key. Only keys whose nodes are
even then in different components are looked through whole, in cells of CELL_NODES nodes by what lies outside the key's largest component, and a cell gives a spanning set
of its links. So no link that would join two components is lost but for pairs that share no key (MOST_MISSED at the
least similarity), and what is emitted grows with the nodes of a group.

Joins on sets and on nodes know how many rows each key has, and give the rows of hot keys their value by a broadcast
of fewer than 1 / HOT_SHARE rows; wordless rows take no part in them. Other joins leave skew to Spark's skew join.

Defined cases: a null or wordless text has no shingles, and is linked with nothing; a text of fewer words than a
shingle has is one shingle; rows with a null id take no part (component_id null, kept true); rows that share an id
are linked, as they are one document to the result; ties don't arise, as a component is named by its least id; an
empty table gives an empty result; other columns aren't read. One text's words are held at once, some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, bounded_batches, byte_slices, join_counted, materialise

SHINGLE_WORDS = 5
PERCENT = 85
REGISTERS = 128
MANTISSA_BITS = 10
#: The chance, at most, that a pair of the least similarity shares no band.
MOST_MISSED = 1e-6
#: Standard errors that an estimate may lie under the least similarity before its pair is let go unverified.
MARGIN = 5.0
CELL_NODES = 256
CELL_BYTES = 8 << 20
BATCH_BYTES = 1 << 20

_BUCKET_BITS = REGISTERS.bit_length() - 1
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(SHINGLE_WORDS)], np.uint64)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)
_PROBES = np.random.default_rng(11).integers(0, REGISTERS, (REGISTERS, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of text (A-Z lower-cased); one for a shorter text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    hashes = np.zeros(n, np.uint64)
    for k in range(size):
        hashes += ids[k : k + n] * _ODD[k]
    hashes = np.sort(_mix(hashes))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set: leading zeros and mantissa of each bucket's least hash.

    A bucket without a hash takes the register of the first filled bucket on its own fixed walk.
    """
    at = np.searchsorted(hashes, _EDGES)
    ends = np.append(at[1:], len(hashes))
    filled = at < ends
    rest = (hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(_BUCKET_BITS)) | np.uint64(1)
    fraction, exponent = np.frexp(rest.astype(np.float64))
    registers = ((65 - exponent) << MANTISSA_BITS) + ((2 * fraction - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    if not filled.all():
        walk = filled[_PROBES]
        first = walk.argmax(axis=1)
        donor = np.where(walk.any(axis=1), _PROBES[np.arange(REGISTERS), first], filled.argmax())
        registers = np.where(filled, registers, registers[donor])
    return registers.astype(np.uint16)


def band_plan(percent: int) -> tuple[int, int]:
    """(bands, rows): the widest bands of the registers that miss a pair of the least similarity with MOST_MISSED at most."""
    for rows in range(12, 0, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) <= MOST_MISSED:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def band_keys(registers: np.ndarray, plan: tuple[int, int]) -> np.ndarray:
    """A 64-bit key for each band."""
    own = registers[: plan[0] * plan[1]].reshape(plan).astype(np.uint64)
    mixed = np.random.default_rng(12).integers(1, 1 << 62, plan).astype(np.uint64) | np.uint64(1)
    return _mix((_mix(own + np.uint64(1)) * mixed).sum(axis=1)).view(np.int64)


def accidental(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """The chance that a register of two disjoint sets of a and b hashes is equal: both least hashes in one mantissa cell."""
    return 0.72 / (1 << MANTISSA_BITS) * a * b / (a + b) ** 2


def estimate(equal: np.ndarray | float, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """Jaccard similarity from the share of equal registers, corrected for accidental ones."""
    c = accidental(a, b)
    return (equal - c) / (1 - c)


def plausible(equal: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and this share of equal registers may be similar enough; small sets get more leeway."""
    least, large = percent / 100, np.maximum(a, b)
    leeway = MARGIN * np.sqrt(least * (1 - least) / np.minimum(REGISTERS, large))
    return (100 * np.minimum(a, b) >= percent * large) & (estimate(equal, a, b) >= least - leeway)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' similarity is percent or more, exactly."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, set_id (null for an empty set) and bands."""
    plan = band_plan(percent)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [id_col, "n_shingles", "set_id", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [band_keys(sketch(s), plan) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    kind = source.schema[id_col].dataType.simpleString()
    return arrow_map(source, run, f"`{id_col}` {kind}, n_shingles bigint, set_id binary, bands array<bigint>")


def whole_sets(rows: DataFrame) -> DataFrame:
    """(node, text) rows -> node, registers and hashes, both as bytes; empty sets are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, BATCH_BYTES):
                found = [(n, s) for n, t in zip(part.column(0), part.column(1).to_pylist(), strict=True) if len(s := shingles(t or ""))]
                columns = [pa.array([n.as_py() for n, _ in found], part.schema.field(0).type), pa.array([sketch(s).tobytes() for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "registers", "hashes"])

    return arrow_map(rows.select("node", "text"), run, f"node {rows.schema['node'].dataType.simpleString()}, registers binary, hashes binary")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges -> node, component: the least node that each node can reach. Nodes without an edge have no row.

    Labels spread along edges and then jump to the label of their label, until nothing changes; each round is
    written out, so lineage stays short, and only a count comes to the driver.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialise(both.distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), name)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        spread = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = materialise(spread.join(jump, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component")), name)
        changed = new.where("old <> component").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def similar(registers_a: pa.Array, hashes_a: pa.Array, registers_b: pa.Array, hashes_b: pa.Array) -> pa.Array:
        out = []
        for ra, ha, rb, hb in zip(registers_a, hashes_a, registers_b, hashes_b, strict=True):
            a, b = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
            equal = (np.frombuffer(ra.as_buffer(), np.uint16) == np.frombuffer(rb.as_buffer(), np.uint16)).mean()
            out.append(bool(plausible(equal, len(a), len(b), percent)) and linked(a, b, percent))
        return pa.array(out, pa.bool_())

    return similar


def cell_links(left: pa.Table, right: pa.Table, band: int, percent: int) -> list[tuple[int, int]]:
    """Links between components of left's and right's nodes for which this is the first band that they share: a spanning set of them."""
    parent: dict = {}
    plan = band_plan(percent)

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def unpack(t: pa.Table):
        registers = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        return t.column("node").to_pylist(), t.column("component").to_pylist(), registers, [np.frombuffer(h, np.uint64) for h in t.column("hashes").to_pylist()]

    nodes_a, groups_a, registers_a, sets_a = unpack(left)
    nodes_b, groups_b, registers_b, sets_b = unpack(right)
    sizes_b = np.array([len(s) for s in sets_b], float)
    found = []
    for i, own in enumerate(sets_a):
        same = registers_b == registers_a[i]
        for j in np.flatnonzero(plausible(same.mean(axis=1), len(own), sizes_b, percent)):
            a, b = root(groups_a[i]), root(groups_b[j])
            if a == b or same[j, : plan[0] * plan[1]].reshape(plan).all(axis=1).argmax() != band:
                continue
            if linked(own, sets_b[j], percent):
                found.append((nodes_a[i], nodes_b[j]))
                parent[max(a, b)] = min(a, b)
    return found


def _links_left(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components that meet under one key. met: band, key, node, component."""
    sized = met.join(sets.select("node", F.length("hashes").alias("bytes")), "node")
    per = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    mixed = per.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("bytes").alias("widest")).where("groups > 1").drop("groups")
    own = met.join(mixed, "key").join(sets, "node")
    per_cell = F.greatest(F.lit(1), F.least(F.lit(CELL_NODES), F.floor(F.lit(CELL_BYTES) / F.col("widest"))))
    outer = F.ceil((F.col("n") - F.col("most")) / per_cell).cast("int")
    every = F.ceil(F.col("n") / per_cell).cast("int")
    place = lambda blocks, seed: F.pmod(F.xxhash64("node", F.lit(seed)), blocks).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    kept = ["key", "band", "node", "component", "registers", "hashes"]
    left = own.where("component <> main").select(*kept, place(outer, 1).alias("i"), all_of(every).alias("j"))
    right = own.select(*kept, place(every, 2).alias("j"), all_of(outer).alias("i"))
    right = right.toDF(*right.columns)  # a cogroup needs columns of its own on either side
    kind = met.schema["node"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = cell_links(a, b, a.column("band")[0].as_py(), percent) if a.num_rows and b.num_rows else []
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    cell = ["key", "i", "j"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col (long), n_shingles, component_id and kept (the component's smallest id)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(sketches(source, percent), "sketches")
    live = rows.where("doc_id is not null and set_id is not null")
    classes = materialise(live.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    # the bands of a class are those of any of its rows; the one with the class's smallest id stands for it
    members = join_counted(live, classes, "set_id", total).select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands"))
    members = materialise(members, "members")
    banded = members.where("bands is not null").select("node", F.posexplode("bands").alias("band", "key")).distinct()
    meeting = materialise(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "meeting")
    meetings = meeting.agg(F.sum("n")).first()[0] or 0
    met = materialise(join_counted(banded, meeting, "key", meetings), "met")

    needed = met.select("node").distinct()
    sets = materialise(whole_sets(source.withColumnRenamed("doc_id", "node").join(needed, "node", "left_semi")), "sets")
    of = lambda side: sets.select(F.col("node").alias(side), F.col("registers").alias(f"registers_{side}"), F.col("hashes").alias(f"hashes_{side}"))

    def verified(rows: DataFrame, other: str) -> DataFrame:
        """(a, b) of the rows whose node and other are similar enough."""
        pairs = rows.where(F.col(other) != F.col("node")).select(F.least(other, "node").alias("a"), F.greatest(other, "node").alias("b")).distinct()
        return pairs.join(of("b"), "b").join(of("a"), "a").where(_similar(percent)("registers_a", "hashes_a", "registers_b", "hashes_b")).select("a", "b")

    def labelled(found: DataFrame) -> DataFrame:
        return met.select("band", "key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # rows of one id with different sets
    spread = materialise(members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a <> z").drop("z"), "spread-ids")
    repeated = join_counted(members.select("doc_id", "node"), spread, "doc_id", total).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = materialise(verified(met, "least").unionByName(repeated), "links")
    first = components(links)

    draw = F.xxhash64("node", "key")
    grouped = materialise(labelled(first), "labelled")
    apart = grouped.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("node", "component"), draw).alias("drawn")).where("low <> high").select("key", "n", "drawn")
    open_rows = join_counted(grouped, materialise(apart, "apart"), "key", meetings).where("component <> drawn.component")
    more = materialise(verified(open_rows.select("node", F.col("drawn.node").alias("drawn")), "drawn"), "links-drawn")
    if more.limit(1).count():
        links = materialise(links.unionByName(more), "links")
        first = components(links)
        grouped = materialise(labelled(first), "labelled")
    more = materialise(_links_left(grouped, sets, percent), "links-left")
    if more.limit(1).count():
        first = components(links.unionByName(more))
    sizes = classes.groupBy("node").agg(F.sum("n").alias("n"))
    named = join_counted(members.select("doc_id", "n_shingles", "node"), materialise(first.join(sizes, "node"), "component-sizes"), "node", total, "left")
    linked_rows = named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = rows.where("doc_id is null or set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = linked_rows.unionByName(alone)
    return result.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
