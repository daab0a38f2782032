"""Token counts: batches of texts go to the tokenizer inside Arrow functions, and only lengths come back.

Long texts are split where no token can reach across, and the batches handed to the library are balanced by
bytes, so neither one long text nor many short ones decide a task's memory.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); any doc_id, null or repeated, gets a row of its
own; an empty table gives an empty result; columns of the input other than the two named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import arrow_map, byte_slices, of_worker

#: Bytes of texts in one call to the library, and code points above which a text is split.
BATCH_BYTES = 1 << 20
CHUNK_CHARS = 1 << 15

_BOUNDARY = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """How many tokens each text has, and whether texts may be split at single blanks without a change."""
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        # A blank starts a piece or stands in a run of blanks: no merge crosses from a character to the blank after it,
        # and a part's own start gets the dummy blank in place of the one that was cut out.
        alone = not any("▁" in p.lstrip("▁") for p in pieces) and [library.encode("a b"), library.encode("a") + library.encode("b")]
        splits = bool(alone) and alone[0] == alone[1]
        return lambda texts: [len(x) for x in library.encode(texts, num_threads=1)], splits
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], False


def safe_chunks(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Parts of at most about `most` code points, cut at single blanks (which are left out); whole, where there is none."""
    parts, start = [], 0
    while len(text) - start > most:
        cut = _BOUNDARY.search(text, start + most)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def count_texts(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES, chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """Tokens of each text, through calls of about batch_bytes each."""
    count, splits = of_worker(("token_counts", path), lambda: _counter(path))
    totals, batch, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for owner, n in zip(owners, count(batch), strict=True):
            totals[owner] += n
        batch.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in safe_chunks(text, chunk_chars) if splits and len(text) > chunk_chars else (text,):
            batch.append(part)
            owners.append(i)
            held += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return totals


def token_counts(docs: DataFrame, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    path = tokenizer or public_tokenizers.path("piece_bpe_32k.model")
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, 8 * BATCH_BYTES):
                sizes = pa.compute.cast(pa.compute.binary_length(part.column(1)), pa.int64())
                counts = pa.array(count_texts(part.column(1).to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, counts], names=[id_col, *schema.names])

    kind = source.schema[id_col].dataType.simpleString()
    counted = arrow_map(source, count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
