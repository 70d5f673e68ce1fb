r"""Chat formatting: messages rebuilt from an event log, then rendered with a loss mask.

``fold`` takes log rows (conv_id, turn, copy, seq, kind, role, text) and gives one row per
message. A message's events are sorted by ``seq``; ``delta`` appends its text, ``edit`` puts
its text in place of all before, ``regenerate`` starts again with its text, ``delete``
removes the message unless something follows. ``render`` writes each conversation as one
string and the code-point spans on which a loss is taken (texts of assistant messages).
``read_back`` parses such a string again.

Template, per message: ``<|start|>`` role ``<|text|>`` text ``<|end|>``. In roles and texts a
backslash is written twice and ``<|`` as ``<\|``, so no text holds a mark and every text can
be read back.

Defined cases: null texts and roles are empty; a null kind is a delta; null turns come last,
null conversations are one conversation; rows that repeat a turn are messages of their own,
ordered by role and text; ties in ``seq`` go by kind, role, text; a conversation whose messages are all
deleted gives no row; empty tables give no rows; other columns are not looked at. A
conversation is one row of the result, so it has to fit in a row (2 GB); its events are
folded per message, so one long conversation does not meet in one task before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm.common import table, text_of

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
MESSAGE = ["conv_id", "turn", "copy"]
DELTA_CHARS = 256


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of(conversations: DataFrame, chars: int = DELTA_CHARS) -> DataFrame:
    """Stored turns as the log a streaming server writes: deltas of at most ``chars``."""
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = text_of("text")
    pieces = F.ceil(F.char_length(text) / F.lit(chars))
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("copy", F.row_number().over(order).cast("bigint"))
        .withColumn("seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(pieces - 1, F.lit(0)))))
        .select(*MESSAGE, "seq", F.lit("delta").alias("kind"), "role",
                F.substring(text, F.col("seq").cast("int") * chars + 1, F.lit(chars)).alias("text"))
    )


def fold(log: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, copy, role, text."""
    events = F.array_sort(F.collect_list(F.struct(
        F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.col("role"), F.col("text"))))
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"] != "delta", i)))
    said = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    tail = F.slice("events", F.coalesce(last, F.lit(0)) + 1, F.size("events"))
    return (
        log.groupBy(*MESSAGE).agg(events.alias("events"))
        .filter(F.element_at("events", -1)["kind"] != "delete")
        .select(*MESSAGE,
                F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("")).alias("role"),
                F.array_join(F.transform(tail, lambda e: F.when(
                    e["kind"] == "delete", "").otherwise(F.coalesce(e["text"], F.lit("")))), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points, end exclusive)."""
    order = ["turn_is_null", "turn", "copy"]
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    running = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        messages.withColumn("turn_is_null", F.col("turn").isNull())
        .withColumn("piece", F.concat(head, body, F.lit(END)))
        .withColumn("chars", F.char_length("piece").cast("bigint"))
        .withColumn("from", F.coalesce(F.sum("chars").over(running), F.lit(0))
                    + F.char_length(head))
        .withColumn("until", F.col("from") + F.char_length(body))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            *order, "piece", F.when(F.col("role") == "assistant", F.struct(
                F.col("from").alias("start"), F.col("until").alias("end"))).alias("span")))).alias("all"))
    )
    return placed.select(
        "conv_id", F.array_join(F.transform("all", lambda m: m["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda m: m["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), and ``loss_text``, all from the formatted string."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.split("formatted", quoted(END))
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.char_length(p)), TEXT, 1)).alias("role"),
        unescaped(F.element_at(F.split(p, quoted(TEXT)), 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(
        F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return rendered.withColumn("turns", turns).withColumn("loss_text", loss)


def op5_chat_format(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string")
    back = read_back(render(fold(log_of(rows.unionByName(extra)))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(9 + 8 + 7
           + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
           + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
