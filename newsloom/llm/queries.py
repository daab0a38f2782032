"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe, chat_format, collocations, exact_dedup, hard_negatives, language_id, near_dedup, packing, quality_rules, secret_scan, token_counts, vector_search, warc_writer
from newsloom.llm.common import scratch_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly", "threshold")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != secret_scan.METHOD_KIND)
    return found.select("doc_id", *(count(k) for k in secret_scan.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id"):
    """Documents that language ID never learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc_writer.write(table(spark, sf_dir, "pages"), folder)
    return warc_writer.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), keep_ids=False)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    loss = F.array_join("loss_texts", "")
    return chat_format.read_back(chat_format.format_chats(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_vector_search": op2_vector_search,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_collocations": op13_collocations,
}

_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS target FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN target IS NULL OR d.page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN d.page_id <> target THEN target END AS refers_to
        FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= 1000""",
    "op9_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        w AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g')) AS written FROM t),
        c AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
                   CAST(sum(CASE WHEN role = 'assistant' THEN written + 6 ELSE written + length(role) + 19 END) AS BIGINT) AS formatted_chars
            FROM w GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
               sha256(loss) AS loss_sha256, formatted_chars FROM c""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
              FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10""",
    "op12_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
    "op13_collocations": """
        WITH pieces AS (
            SELECT row_number() OVER () AS piece, coalesce(lang, 'und') AS lang, p.body
            FROM documents, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p(body)),
        words AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i
                  FROM (SELECT lang, piece, list_filter(regexp_split_to_array(body, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces)),
        ahead AS (SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4, lead(word, 4) OVER p AS w5
                  FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)),
        grams AS (SELECT lang, k, concat_ws(' ', w1, w2, CASE WHEN k > 2 THEN w3 END, CASE WHEN k > 3 THEN w4 END, CASE WHEN k > 4 THEN w5 END) AS phrase
                  FROM ahead, (VALUES (2), (3), (4), (5)) AS s(k)
                  WHERE CASE k WHEN 2 THEN w2 WHEN 3 THEN w3 WHEN 4 THEN w4 ELSE w5 END IS NOT NULL),
        counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
                    UNION ALL SELECT lang, 1, word, count(*) FROM words GROUP BY ALL),
        candidates AS (SELECT lang, phrase, f AS a FROM counted WHERE k > 1),
        left_over AS (SELECT * FROM candidates c WHERE NOT EXISTS (
            SELECT 1 FROM candidates x WHERE x.lang = c.lang AND length(x.phrase) > length(c.phrase)
              AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.a >= 100 * c.a)),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, len(string_split(phrase, ' ')) - 1)) AS k FROM left_over),
        scored AS (SELECT cuts.lang, cuts.phrase, a, h.f AS l, t.f AS r, n, cuts.k, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
                   FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = array_to_string(w[1:cuts.k], ' ')
                   JOIN counted t ON t.lang = cuts.lang AND t.phrase = array_to_string(w[cuts.k + 1:], ' ')
                   JOIN totals ON totals.lang = cuts.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER r AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM lowest
        WINDOW r AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER r <= 2000""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
