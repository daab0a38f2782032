"""Quality rules, secret scans, token counts, language ID and byte-level BPE against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe, language_id, quality_rules, queries, secret_scan, token_counts

from .helpers import SF, documents, no_docs, odd_docs, odd_rows, prose


def both(spark):
    return documents(spark).select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))


def by_row(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect() if r["doc_id"] is not None)


# -- quality rules


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in earlier and bool(re.search(r"[^\x20\x09-\x0D]", line))
        earlier.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_rule_statistics_are_those_of_brute_force(spark):
    docs = both(spark)
    got = quality_rules.statistics(docs)
    want = sorted((r["doc_id"], *brute_statistics(r["text"])[:5]) for r in docs.collect() if r["doc_id"] is not None)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def test_op1_keeps_good_and_drops_bad(spark):
    got = queries.op1_quality_rules(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    assert all(r["base_failed"] == brute_statistics(texts[r["doc_id"]])[5] and not (r["base_failed"] and r["kept"]) for r in rows)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in rows if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_quality_rules_on_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = quality_rules.assess(odd_docs(spark), labels, carry=True)
    assert odd.count() == len(odd_rows()) and odd.select("row.*").columns == odd_docs(spark).columns
    assert odd.where("threshold <> 0.65").count() == 0
    assert quality_rules.assess(no_docs(spark), labels).count() == 0


def test_forest_sets_outliers_apart():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (2000, 4))
    forest = quality_rules.Forest.grow(rows)
    assert forest.score(np.full((1, 4), 8.0))[0] > forest.score(rows).mean() + 0.2
    assert quality_rules.Forest.grow(rows[:0]).score(rows[:3]).tolist() == [0.5] * 3


# -- secret scans


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_base_spans_are_those_of_brute_force(spark):
    docs = both(spark)
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    name = lambda x: f"{x['kind']}:{x['start']}:{x['end']}"
    got = sorted((r["doc_id"], [name(x) for x in r["spans"] if x["kind"] != "format"]) for r in found.collect() if r["doc_id"] is not None)
    assert got == sorted((r["doc_id"], brute_base(r["text"])) for r in docs.collect() if r["doc_id"] is not None)


def test_op3_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    for r in queries.op3_secret_scan(spark, SF).collect():
        base = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in base) for k in ("assign:", "access:", "hex:"))


def test_inferred_formats_find_unlabelled_credentials(spark):
    import random

    r = random.Random(3)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f"some plain words here and token = {key()} in a configuration file number{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    formats = secret_scan.fit(docs)
    loose = key()[:22] + "9"  # too short for the base pattern of hex runs
    spans = secret_scan.spans_of(f"left over {loose} in plain sight, counterrevolutionary1 words", formats)
    assert [s[3] for s in spans] == [loose]


def planted(r, kind):
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    return {
        "ghp": lambda: "ghp_" + run(mixed, 36),
        "sk": lambda: "sk_live_" + run(mixed, 24),
        "jwt": lambda: "eyJhbGciOiJIUzI1NiJ9." + run(mixed + "-_", r.randrange(60, 90)) + "." + run(mixed + "-_", 43),
        "akia": lambda: "AKIA" + run(mixed[:26] + "234567", 15),
    }[kind]()


def test_formats_are_learned_from_labelled_credentials(spark):
    import random

    from .helpers import prose

    r = random.Random(12)
    kinds = ("ghp", "sk", "jwt", "akia")
    others = lambda i: f"mail{i}@host.example.com https://www.example.com/a/b-c/{i}.html 4929{r.randrange(10**11, 10**12)} 2024-01-{i % 28 + 1:02d}T10:00:00 /usr/lib/python3/site-packages {r.randrange(256)}.{r.randrange(256)}.1.1"
    rows = [(i, f"{prose(60, i)} {others(i)} secret = {planted(r, kinds[i % 4])} {prose(20, i + 500)}") for i in range(160)]
    formats = secret_scan.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {"ghp_...", "sk_live_...", "eyJh...", "AKIA..."} <= set(formats.names) and formats.recall >= 0.9 and formats.others <= 0.01
    assert all(len(a.ends) > 3 for name, a in zip(formats.names, formats.automata, strict=True) if name.endswith("..."))
    for kind in kinds:
        bare = [planted(r, kind) for _ in range(100)]
        found = [[s[3] for s in secret_scan.spans_of(f"{prose(9, k)} {w}. {prose(9, k)}", formats)] for k, w in enumerate(bare)]
        assert sum(f == [w.rstrip("-")] for f, w in zip(found, bare, strict=True)) >= 90, kind
    texts = [f"{prose(300, 2000 + i)} {others(1000 + i)}" for i in range(200)]
    plain = sum(len(secret_scan.candidates(t, [])) for t in texts)
    false = sum(len(secret_scan.spans_of(t, formats)) for t in texts)
    assert plain > 500 and false <= 0.01 * plain


def test_masking_keeps_rows_and_hides_secrets(spark):
    odd = odd_docs(spark)
    masked = secret_scan.mask(odd, secret_scan.fit(odd))
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert masked.where("text is null").count() == odd.where("text is null").count()
    assert not masked.where(F.col("text").contains("hunter2secret") | F.col("text").contains("AKIA")).count()
    assert secret_scan.fit(no_docs(spark)) is None and secret_scan.scan(no_docs(spark), None).count() == 0


def test_merged_automaton_reads_its_own_words():
    words = [f"AK{i:04d}" for i in range(0, 9999, 7)]
    auto = secret_scan.Automaton.infer(words)
    assert len(auto.moves) < 40
    assert auto.log_likelihood("AK1234") > auto.log_likelihood("zzzzzz") + 10


def test_states_of_different_depths_merge():
    """A random rest is one loop, however deep its states lay; a literal start stays a chain; lengths are told apart beside it."""
    r = random.Random(2)
    words = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    tree, auto = secret_scan.Automaton.prefix_tree(words), secret_scan.Automaton.infer(words)
    assert len(tree.ends) > 10_000 and len(auto.ends) <= 3
    keyed = secret_scan.Automaton.infer(["ghp_" + w for w in words])
    assert 5 <= len(keyed.ends) <= 8 and keyed.log_likelihood("ghp_" + words[0]) > keyed.log_likelihood("ghq_" + words[0]) + 5
    assert auto.log_likelihood(words[0]) > auto.log_likelihood(words[0][:39]) + 2


def test_every_candidate_is_scored_in_time_with_its_length():
    import time

    r = random.Random(8)
    words = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    formats = secret_scan.Formats(["hex"], [secret_scan.Automaton.infer(words)], [secret_scan._bigrams([prose(1, k) for k in range(900)])], 0.5)
    long = words[0] * 50 + "z"  # fifty times as long as any that was learned from
    assert np.isfinite(formats.scores([long, "y" * 3_000_000])).all()
    one_by_one = np.array([formats.scores([w])[0] for w in [*words[:9], long]])
    assert np.allclose(formats.scores([*words[:9], long]), one_by_one)
    took = {}
    for n in (20_000, 80_000):
        dense = " ".join(f"token={words[k % 200]} {words[k % 199][:30]}g{k}" for k in range(n // 40))
        began = time.perf_counter()
        spans = secret_scan.spans_of(dense, formats)
        took[n] = time.perf_counter() - began
        assert len(spans) >= n // 40
    assert took[80_000] < 12 * took[20_000] + 1
    began = time.perf_counter()
    secret_scan.spans_of(" ".join(f"token={words[k % 200]} lorem ipsum dolor{k}" for k in range(300_000)), formats)
    assert time.perf_counter() - began < 60  # 20 MB


def test_op3_adds_spans_of_formats(spark, tmp_path):
    """The query, on a table whose labelled credentials have a format that some stand without a label."""
    r = random.Random(4)
    rows = [(i, f"{prose(30, i)} secret = {planted(r, 'ghp')} {prose(20, 900 + i)}") for i in range(120)]
    loose = {1000 + i: planted(r, "ghp") for i in range(20)}
    rows += [(i, f"{prose(9, i)} {w} {prose(9, i)}") for i, w in loose.items()] + [(2000 + i, f"{prose(200, i)} order{i}2024 mail{i}@host.example.com 2024-01-{i % 28 + 1:02d}T10:00:00 4929{r.randrange(10**11, 10**12)}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["spans"] for x in queries.op3_secret_scan(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    assert sum(f"format:{texts[i].index(w)}:{texts[i].index(w) + len(w)}" in got[i].split(",") for i, w in loose.items()) >= 18
    assert not any("format" in got[2000 + i] for i in range(30))


# -- token counts


def test_token_counts_are_the_librarys(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = both(spark)
    got = by_row(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 4096) for r in docs.collect() if r["doc_id"] is not None)
    assert got == want
    assert token_counts.token_counts(no_docs(spark)).count() == 0


def test_long_texts_split_without_a_change():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ".join(f"word{i} über,{i}" for i in range(n)) for n in (0, 1, 50, 4000)] + ["a  b   c " * 900, "▁ x ▁y" * 500]
    assert token_counts.count_texts(texts, path, 3000, 100) == [len(library.encode(t)) for t in texts]


# -- language ID


def test_op5_tells_held_out_languages(spark):
    rows = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_on_odd_tables(spark):
    model = language_id.train(odd_docs(spark))
    assert model.langs == ("en",)
    got = {r["row"]["doc_id"]: r["lang_pred"] for r in language_id.identify(odd_docs(spark), model, carry=True).collect()}
    assert {got[i] for i in (0, 1, 2)} == {"und"} and got[3] == "en"
    empty = language_id.train(no_docs(spark))
    assert {r["lang_pred"] for r in language_id.identify(odd_docs(spark), empty).collect()} == {"und"}
    assert language_id.identify(no_docs(spark), model).count() == 0


def test_predictions_are_multinomial_naive_bayes():
    import numpy as np

    rng = np.random.default_rng(1)
    model = language_id.Model(("a", "b"), rng.normal(-8, 1, (2, language_id.N_BUCKETS + 1)).astype(np.float32), np.log([0.3, 0.7]))
    model.log_prob[:, -1] = 0
    texts = ["some text, Été", "x", "and another one"]
    alone = [model.predict([t]) for t in texts]
    names, share = model.predict(texts)
    assert names == [n[0] for n, _ in alone] and np.allclose(share, [s[0] for _, s in alone])
    for text, name, p in zip(texts, names, share, strict=True):
        hashed = [h for own, _, _ in language_id._windows(*language_id._points([text])) for h in own]
        total = np.array([model.log_prior[k] + sum(model.log_prob[k][h].sum(dtype=float) for h in hashed) / 3 for k in range(2)])
        want = np.exp(total - total.max())
        assert name == "ab"[int(total.argmax())] and p == pytest.approx(float((want / want.sum()).max()), rel=1e-4)


# -- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_librarys_and_decodes_back(spark, reference):
    docs = both(spark)
    decoded = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    got = sorted((r["doc_id"], r["ids"], r["decoded"]) for r in decoded if r["doc_id"] is not None)
    assert got == sorted((r["doc_id"], reference.encode_ordinary(r["text"] or ""), r["text"] or "") for r in docs.collect() if r["doc_id"] is not None)
    assert byte_bpe.decode(byte_bpe.encode(no_docs(spark))).count() == 0


def test_streamed_pieces(reference):
    import random

    machine = byte_bpe.MergeTransducer(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    r = random.Random(2)
    for alphabet in (b"a", b"ab", b"etaoin ", bytes(range(256)), "éàüß漢".encode()):
        for n in (1, 2, 30, 700, 5000):
            piece = bytes(r.choice(alphabet) for _ in range(n))
            assert machine.encode(piece) == reference._encode_single_piece(piece)
            assert piece in machine.ranks or list(machine.stream(piece)) == reference._encode_single_piece(piece)


def test_sorted_pieces_share_what_they_begin_with(reference):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [b"", b"zq", b"zq\0", b"zq\0b", b"zq\0bq", *(b" thshinganedtion" + x for x in (b"", b"a", b"ab", b"abq", "é".encode(), b"\0"))]
    for order in (sorted(pieces), pieces[::-1], pieces[::2] + pieces):
        got = [list(np.frombuffer(x, "<u4")) for x in byte_bpe.MergeTransducer(ranks).encode_sorted(order)]
        assert got == [reference._encode_single_piece(p) if p else [] for p in order]

    class Counting(dict):
        reads = 0

        def get(self, key):
            Counting.reads += 1
            return super().get(key)

    words = ["thshinganedtionoron" + x for x in ("er", "era", "erat", "eror", "ing", "ingst")]
    texts = [f"a {w} {w}. {w}, {w}!\n" for w in words]
    encoder = byte_bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    encoder.transducer._moves = Counting()
    assert [list(np.frombuffer(x, "<u4")) for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    begun = {p[:k] for t in texts for p in encoder.find(t) for k in range(1, len(p) + 1)}
    assert Counting.reads <= len(begun)


def test_pieces_by_the_translated_pattern(reference):
    find = byte_bpe.PieceFinder(public_tokenizers.PATTERN)
    text = "".join(f"a{c} {c}1{c}{c}\n{c}'s {c}  {c}x" for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    assert find.fast.findall(text) == find.general.findall(text) == find(text) == [p for block in find.blocks(text, 1000) for p in block]
    single = {bytes([x]): x for x in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name, mate in ((r"\p{L}", "b"), (r"\p{N}", "1")):  # a character is of the class if it and the next one are one piece
        library = set(bytes(tiktoken.Encoding("class", pat_str=name + "+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        for chars in (every[:0xF800], every[0xF800:]):
            assert {p[0] for p in find("".join(f"{c}{mate}\x01" for c in chars)) if len(p) == 2 and p[1] == mate and p[0] != " "} == library & set(chars)
    for text in ("", " ", "a\x1cb \x85c", "I'll we've it's 'tis 'S don''t", "\U0001d4d0bc \U0001f600\U0001f600. \U0001d7d8\U0001d7d9", "x" + "\u3000" * 3 + "漢字 \u00a0 .", "\n\n a \n\nb  \t", "a\ua7ceb \u088f1 \U00010940\U00012550."):
        ids = byte_bpe.TextEncoder(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN).encode([text])
        assert list(np.frombuffer(ids[0], "<u4")) == reference.encode_ordinary(text)
    assert byte_bpe.PieceFinder(r"\S+ ?|\s+")("ab cd  e") == ["ab ", "cd ", " ", "e"]


def test_long_texts_are_encoded_in_blocks(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 40)
    monkeypatch.setattr(byte_bpe.PieceFinder.blocks, "__defaults__", (3,))
    texts = ["short one", "a longer text, of more pieces than a block has: " * 5, "", "\n \U0001f600 thshinganedtion " * 9]
    ids = byte_bpe.TextEncoder(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN).encode(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in ids] == [reference.encode_ordinary(t) for t in texts]


def test_utf8_waits_for_the_rest_of_a_character():
    text = "aé漢\U0001f600b"
    for size in (1, 2, 3):
        stream, data = byte_bpe.Utf8Stream(), text.encode()
        assert "".join([*(stream.feed(data[k : k + size]) for k in range(0, len(data), size)), stream.feed(b"", last=True)]) == text
    assert byte_bpe.Utf8Stream().feed(b"\xe6\xbc", last=True) == "�"


def test_op10_digests(spark, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    for r in queries.op10_byte_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
