"""Hard negatives, exact duplicates and collocations against brute force, on odd rows and small bounds."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import collocations, exact_dedup, hard_negatives

from .helpers import ODD_TEXTS, SCHEMA, no_docs, odd_docs, odd_rows

VECTORS = "vec_id bigint, embedding array<float>, label int, rank string, score string, id string"


def brute_negatives(rows, positives=5, negatives=10):
    own = [(i, lab, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(object)) for i, v, lab in rows]
    out = set()
    for i, lab, v in own:
        if i % 100:
            continue
        others = sorted((-int(np.dot(v, w)), j, b) for j, b, w in own if j != i)
        for s, j, b in [o for o in others if o[2] == lab][:positives]:
            fits = [o for o in others if o[2] != lab and 30 * -s <= 100 * -o[0] <= 90 * -s]
            out |= {(i, j, rank, n[1], -s, -n[0]) for rank, n in enumerate(fits[:negatives], 1)}
    return out


def vector_rows(n, dimension, seed, copies=0.0):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((4, dimension))
    vectors = [np.float32(heads[k % 4] + 0.7 * rng.standard_normal(dimension)) / 4 for k in range(n)]
    for k in range(int(copies * n)):
        vectors[-k - 1] = vectors[0]
    return [(k, [float(x) for x in vectors[k]], int(rng.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize(("n", "dimension", "copies"), [(700, 8, 0.0), (500, 3, 0.35)])
def test_op11_equals_brute_force(spark, monkeypatch, n, dimension, copies):
    rows = vector_rows(n, dimension, n, copies)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 2)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(table, F.col("id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows) and len(got) == len({tuple(r) for r in got})


def test_op11_trees_prune_and_lose_nothing(monkeypatch):
    """Clustered vectors: bounds leave whole nodes out, and what is left holds all rows of the window."""
    rng = np.random.default_rng(4)
    heads = rng.integers(-400, 400, (40, 16))
    vectors = (heads[np.arange(4000) % 40] + rng.integers(-9, 9, (4000, 16))).astype(np.int64)
    labels = np.arange(4000) % 40
    tree = hard_negatives.BallTree(np.arange(4000), labels, vectors, 25)
    scanned = []
    products = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b: scanned.append(len(b)) or products(a, b))
    low, high = np.array([200_000]), np.array([600_000])
    w, ids, score = tree.search(vectors[:1], np.array([0]), labels[:1], np.array([0]), low, high, 10, False)
    truth = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[0]) if labels[i] != 0 and low[0] <= s <= high[0])[:10]
    assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True)] == truth
    assert sum(scanned) < 4000 / 3


def test_op11_odd_tables(spark):
    good = vector_rows(230, 4, 8)
    bad = [(None, good[0][1], 1), (900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [float("nan")] * 4, 1), (903, [float("inf")] + [0.0] * 3, 2), (904, good[1][1], None), (905, [1.0], 1), (906, [1e30] * 4, 1), (907, [], 1)]
    still = [(908, [0.0] * 4, 1)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in good + bad + still], VECTORS)
    got = hard_negatives.hard_negatives(table, F.col("id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(good + still)
    twice = spark.createDataFrame([(*r, "x", "y", "z") for r in good + good[100:101]], VECTORS)
    again = hard_negatives.hard_negatives(twice, F.col("id") % 100 == 0).collect()
    assert {r["anchor_id"] for r in again} == {r["anchor_id"] for r in got} and not [r for r in again if 100 == r["anchor_id"] == r["negative_id"]]
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 100 == 0).count() == 0


def test_op11_scores_beyond_exact_doubles():
    a = np.array([[1 << 29, (1 << 29) + 1]], np.int64)
    assert hard_negatives.products(a, a)[0, 0] == (1 << 58) + ((1 << 29) + 1) ** 2


def brute_owners(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_op12_odd_rows(spark):
    got = exact_dedup.exact_duplicates(odd_docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_owners([(r[0], r[1]) for r in odd_rows()])
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0


def test_op12_hot_copies_and_spilled_subtrees(spark):
    r = random.Random(2)
    stem = "".join(r.choice("ab") for _ in range(3000))
    texts = [stem[: r.randrange(3000)] + r.choice(["", "x", "y" * 2000]) for _ in range(150)] + ["", "a", "ab", "b"]
    rows = [(i, r.choice(texts)) for i in range(700)] + [(1000 + i, texts[0]) for i in range(400)] + [(None, "only without an id"), (None, "only without an id"), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = exact_dedup.exact_duplicates(docs, partition_bytes=60_000, trie_bytes=9_000, seen_texts=7).collect()
    assert sorted(map(tuple, got), key=str) == brute_owners(rows)


def test_op12_trie_spills_and_refuses():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(400)]
    trie, told, gone = exact_dedup.Trie(), Counter(), Counter()
    for k, text in enumerate(texts):
        if not trie.insert(text, b"d" + text, 1, k):
            gone[text] += 1
        if k in (150, 250):
            before = trie.root.held
            for whole, node in trie.spill():
                gone[whole] += node.n
            assert trie.root.held < before
    for whole, node in trie:
        told[whole] += node.n
    assert not set(told) & set(gone) and told + gone == Counter(texts)
    assert trie.terminals == len(told) and trie.root.held == sum(len(n.edge) for n in all_nodes(trie.root))


def all_nodes(top):
    return [top, *(n for c in top.children.values() for n in all_nodes(c))]


def brute_collocations(rows, least, most_words=5, top=2000):
    words, grams, totals = Counter(), Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(own)
            for k in range(1, most_words + 1):
                for i in range(len(own) - k + 1):
                    (grams if k > 1 else words)[lang, tuple(own[i : i + k])] += 1
    f = words + grams
    found = {key: n for key, n in grams.items() if n >= least}
    out = {}
    for (lang, phrase), a in found.items():
        k = len(phrase)
        if any(ln == lang and len(p) > k and n >= a and any(p[i : i + k] == phrase for i in range(len(p) - k + 1)) for (ln, p), n in found.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (f[lang, phrase[:j]] * f[lang, phrase[j:]]), j) for j in range(1, k)]
        score, j = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:j]], f[lang, phrase[j:]], totals[lang]))
    return {(lang, rank, p.decode(), -a, left, right, n, -s) for lang, own in out.items() for rank, (s, a, p, left, right, n) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("shard_bytes", "bits", "known"), [(1 << 20, 1 << 20, 2), (900, 64, 2), (200, 1 << 12, 3), (5000, 1 << 16, 4)])
def test_op13_equals_brute_force(spark, shard_bytes, bits, known):
    """Also with many shards, and with a filter that lets nearly all through."""
    r = random.Random(6)
    passage = "alpha beta gamma delta epsilon zeta"
    rows = []
    for k in range(160):
        body = [r.choice(["un", "deux", "trois", "New York", "\té\x85x", passage, "a, b; c", "fin.\nDebut", "AB\x1cc"]) for _ in range(r.randrange(30))]
        rows.append((r.choice(["en", "fr", None]), r.choice([" ", "  ", " \t"]).join(body)))
    rows += [("en", None), (None, ""), ("fr", " .,! \n"), ("xx", "one")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(5)
    got = collocations.collocations(docs, least=12, filter_bits=bits, filter_words=known, shard_bytes=shard_bytes, top=60).collect()
    want = brute_collocations(rows, 12, top=60)
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 50


def test_op13_odd_tables(spark):
    assert collocations.collocations(no_docs(spark), least=2).count() == 0
    got = collocations.collocations(odd_docs(spark).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1)), least=2).collect()
    assert {tuple(x) for x in got} == brute_collocations([(r[2], r[1]) for r in odd_rows()], 2)
    assert ODD_TEXTS and SCHEMA


def test_op13_exact_beyond_64_bits(spark):
    """Counts as large as a table of 10^13 words has."""
    a, n, left, right = 9 * 10**11, 10**13, 10**12, 95 * 10**10
    wide = "CAST({} AS DECIMAL(38,0))".format
    got = spark.range(1).select(F.expr(f"({wide(1000)} * {wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})").alias("x")).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_op13_automaton_states():
    """States, links and counts against their definition: substrings of up to three words by their end positions."""
    r = random.Random(1)
    ids = np.array([r.randrange(3) for _ in range(60)])
    begins = np.array([k == 0 or r.random() < 0.2 for k in range(60)])
    ends = {}
    for i in range(60):
        for k in range(1, 4):
            if i - k + 1 < 0 or begins[i - k + 2 : i + 1].any():
                break
            ends.setdefault(tuple(ids[i - k + 1 : i + 1]), set()).add(i)
    own = collocations.automaton(ids, np.array([max(j for j in range(1, i + 2) if not begins[i - j + 2 : i + 1].any()) for i in range(60)]), 3)
    got = {tuple(ids[e - k + 1 : e + 1]): int(n) for k, at, counts in own.substrings(1) for e, n in zip(at, counts, strict=True)}
    assert got == {s: len(at) for s, at in ends.items()}
    assert len(own.length) == len({frozenset(at) for at in ends.values()})
    for k, e, link in zip(own.length, own.end, own.link, strict=True):
        text = tuple(ids[e - k + 1 : e + 1])
        if link < 0:
            assert all(ends[text] == ends[text[j:]] for j in range(1, len(text)))
        else:
            up = tuple(ids[own.end[link] - own.length[link] + 1 : own.end[link] + 1])
            assert text[-len(up) :] == up and ends[up] > ends[text] == ends[text[-len(up) - 1 :]]


def test_op13_reaches():
    """A pair that can't end at a position leaves one word there, a triple that can't leaves two."""
    joined = np.array([[0] * 8, [0] * 8, [0, 1, 1, 1, 0, 1, 1, 1], [0, 0, 1, 1, 0, 0, 0, 1]], bool)
    assert collocations.reaches(joined).tolist() == [1, 2, 3, 4, 1, 2, 2, 3]


@pytest.mark.parametrize("words", [2000, 10000])
def test_op13_tells_each_word_once(spark, monkeypatch, words):
    """The pass over longer phrases makes a row for each word at most, though nearly all phrases of few words are frequent."""
    r = random.Random(3)
    rows = [("en", " ".join(r.choice("abcdefgh") for _ in range(40))) for _ in range(words // 40)]
    made, mapped = [], collocations.arrow_map

    def counting(source, run, schema):
        made.append(rows_made := spark.sparkContext.accumulator(0))

        def counted(batches):
            for batch in run(batches):
                rows_made.add(len(batch))
                yield batch

        return mapped(source, counted, schema)

    monkeypatch.setattr(collocations, "arrow_map", counting)
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string").coalesce(1)
    got = collocations.collocations(docs, least=2).collect()
    assert {tuple(x) for x in got} == brute_collocations(rows, 2)
    assert 0 < made[-1].value <= words


def test_op13_prefix_states():
    """What ends in each state, against the longest phrases that end at each position."""
    r = random.Random(2)
    ids = np.array([r.randrange(3) for _ in range(80)])
    reach = np.array([1 + k % 7 for k in range(80)])
    own = collocations.automaton(ids, reach, 4)
    got = {tuple(ids[e - k + 1 : e + 1]): int(n) for k, e, n in zip(own.length, own.end, own.prefixes(), strict=True) if n}
    assert got == Counter(tuple(ids[i - min(n, 4) + 1 : i + 1]) for i, n in enumerate(reach))


def test_op13_filter_lets_few_rare_phrases_through(spark):
    """Of a filter with a bit in 22 set, a rare phrase has to meet several."""
    phrases = [f"{k} {k % 7}" for k in range(1000)]
    frequent = collocations.frequent_filter(spark.createDataFrame([("en", p) for p in phrases], "lang string, phrase string"), bits=1 << 16)
    own = collocations.shard("en", [p.encode() for p in phrases] + [f"x{k} {k % 7}".encode() for k in range(20000)])
    _, hashes = next(own.phrase_hashes(own.word_hashes(), 2))
    passed = collocations.passes(frequent, hashes)
    assert passed[:1000].all() and passed[1000:].sum() <= 20


def test_op13_short_phrases_only(spark):
    rows = [("en", "a b a b c a b")] * 3
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    for most in (2, 3):
        got = collocations.collocations(docs, least=3, most_words=most).collect()
        assert {tuple(x) for x in got} == brute_collocations(rows, 3, most_words=most)
