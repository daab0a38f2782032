"""Chat formatting from event logs, with DataFrame functions only.

A log row has conv_id, message_id, seq, kind, role and text. Messages are folded from their events in the order of seq:
`delta` appends its text, `edit` puts its text in place of all before it, `regenerate` clears the message for new
deltas. Final messages are rendered in the order of their first event by one template, whose control strings can't
occur inside escaped texts; a loss mask marks the assistant's texts.

The template: `<s>[INST role] text [/INST]` for every role but the assistant's, and ` text </s>` for the assistant's.
Inside roles and texts the escape sign and `<`, `[`, `]` are written as the escape sign and a letter.

Defined cases: null texts count as empty, null roles as an empty role; null conv_ids are one conversation; a log
without rows gives no conversations; equal rows of a turn table are messages of their own; ties of seq go by
message_id; an unknown kind counts as `delta`; other columns, whatever their names, aren't read. A very long text is no
case of its own: what is held at once is a message, then a conversation, which are single strings in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What texts may not hold as it is, and how it is written. The escape sign itself comes first.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))
TURN = r"<s>\[INST ([^\[\]<]*)\] ([^\[\]<]*) \[/INST\]| ([^\[\]<]*) </s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    # an escape sign is always followed by its letter, so no replacement can make or break another's match
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def events_of_turns(turns: DataFrame) -> DataFrame:
    """A log with one delta for each row of a turn table (conv_id, turn, role, text); equal rows stay apart."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies = rows.groupBy("conv_id", "turn", "role", "text").count()
    own = copies.select("*", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    return own.select("conv_id", F.struct("turn", "role", F.xxhash64("text").alias("digest"), "copy").alias("message_id"), F.col("turn").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def streamed(turns: DataFrame) -> DataFrame:
    """A log as chats write it: a turn's text comes in three deltas, after a draft that an assistant regenerates and others edit.

    The edit puts the first third in the draft's place; the steps of a turn follow one another in seq.
    """
    own = events_of_turns(turns)
    third = F.ceil(F.length("text") / 3).cast("int")
    part = lambda k: F.substring(F.col("text"), third * k + 1, third)
    generated = F.col("role") == ASSISTANT
    step = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    steps = F.array(
        step(F.lit("delta"), F.concat(F.lit("[draft] "), F.reverse("text"))),
        step(F.when(generated, "regenerate").otherwise("edit"), F.when(generated, "").otherwise(part(0))),
        step(F.lit("delta"), F.when(generated, part(0)).otherwise("")),
        step(F.lit("delta"), part(1)),
        step(F.lit("delta"), part(2)),
    )
    each = own.select("conv_id", "message_id", "seq", "role", F.posexplode(steps).alias("step", "event"))
    return each.select("conv_id", "message_id", F.struct("seq", "step").alias("seq"), "event.kind", "role", "event.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """One row per message: conv_id, message_id, first_seq, role (of its first event) and the folded text."""
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"), F.min("seq").alias("first_seq"), F.min(F.struct(F.col("seq"), F.coalesce(F.col("role"), F.lit("")).alias("role"))).alias("head"))
    # what came before the last edit or regeneration no longer counts
    resets = F.filter(F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i)), lambda i: i.isNotNull())
    start = F.coalesce(F.array_max(resets), F.lit(0)) + 1
    live = F.filter(F.slice("log", start, F.size("log")), lambda x: x["kind"] != "regenerate")
    return log.select("conv_id", "message_id", "first_seq", F.col("head.role").alias("role"), F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted and loss_spans.

    loss_spans has a (start, end) for each turn, in code points of formatted: the assistant's texts, and empty spans
    for other turns.
    """
    trained = F.col("role") == ASSISTANT
    body = escape(F.col("text"))
    turns = messages.withColumn("body", body).withColumn("turn_text", F.when(trained, F.concat(F.lit(" "), F.col("body"), F.lit(" </s>"))).otherwise(F.concat(F.lit("<s>[INST "), escape(F.col("role")), F.lit("] "), F.col("body"), F.lit(" [/INST]"))))
    order = Window.partitionBy("conv_id").orderBy("first_seq", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("turn_text")).over(order), F.lit(0)))
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_seq", "message_id")))
    first = F.col("start") + F.when(trained, F.lit(1)).otherwise(F.length("turn_text"))
    turn = F.struct("place", "turn_text", first.alias("from"), (first + F.when(trained, F.length("body")).otherwise(F.lit(0))).alias("to"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["turn_text"]), "").alias("formatted"),
        F.transform("turns", lambda x: F.struct(x["from"].alias("start"), x["to"].alias("end"))).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted_chars, turns (place, role, text) and loss_texts, from formatted and its mask alone."""
    cut = rendered.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)).alias("piece"), F.col("loss_spans").alias("span"))).alias("place", "turn"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select("conv_id", "formatted_chars", "place", F.col("turn.piece").alias("piece"), F.col("turn.span").alias("span")).withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    given = F.col("piece").startswith("<s>")
    role = F.when(given, unescape(F.regexp_extract("piece", TURN, 1))).otherwise(F.lit(ASSISTANT))
    text = unescape(F.when(given, F.regexp_extract("piece", TURN, 2)).otherwise(F.regexp_extract("piece", TURN, 3)))
    # the mask, not the template, says what is trained on
    masked = unescape(F.substring("piece", (F.col("span.start") - F.col("start") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int")))
    row = F.struct("place", role.alias("role"), text.alias("text"), masked.alias("masked"))
    gathered = placed.groupBy("conv_id").agg(F.first("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select("conv_id", "formatted_chars", F.transform("rows", lambda x: F.struct(x["place"].alias("place"), x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.transform("rows", lambda x: x["masked"]).alias("loss_texts"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Turn table -> rendered conversations, through a log of drafts, edits, regenerations and deltas."""
    return render(reconstruct(streamed(turns)))
