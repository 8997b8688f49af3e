"""Chat formatting with Spark expressions only.

A conversation's turns are sorted by turn (then role, then text; null first).
Adjacent turns of one role share one message, their texts parted by a mark, so
every turn can be read back:

    <|im_start|>user\\nfirst text<|im_sep|>second text<|im_end|>\\n<|im_start|>assistant\\n...

Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|``, so no
text can write a mark; reading removes both. Loss spans are the code points of
assistant texts in the formatted string.

Turns are collected in segments of 64 turn numbers before segments are put
together, so a long conversation is sorted in many tasks and only its finished
pieces meet. Null text and null role are empty, a null conv_id is a conversation
of its own, repeated rows are repeated turns, and an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SEGMENT = 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """A line feed is a backslash and n behind an even number of backslashes."""
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n"))


def lead(role: Column, before: Column) -> Column:
    """What stands between a text and the one before it."""
    return F.when(role == before, F.lit(SEP)).otherwise(F.concat(F.lit(CLOSE), header(role)))


def running(lengths: Column) -> Column:
    """Sums of an array's values before each place, and in all."""
    return F.aggregate(
        lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end), one row per conversation."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    segments = rows.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = segments.withColumn(
        "pieces",
        F.transform("turns", lambda t, i: F.struct(
            F.when(i == 0, F.lit("")).otherwise(lead(t["role"], F.get("turns", i - 1)["role"])).alias("lead"),
            escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss"))))
    placed = pieces.withColumn("at", running(F.transform("pieces", lambda p: (F.length(p["lead"]) + F.length(p["text"])).cast("bigint"))))
    spans = F.filter(
        F.transform("pieces", lambda p, i: F.struct(
            (F.get("at", i) + F.length(p["lead"])).alias("start"), F.get("at", i + 1).alias("end"), p["loss"].alias("loss"))),
        lambda s: s["loss"])
    bodies = placed.select(
        "conv_id",
        F.struct(
            "segment", F.element_at("turns", 1)["role"].alias("first"), F.element_at("turns", -1)["role"].alias("last"),
            F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["text"])), "").alias("body"),
            spans.alias("spans")).alias("part"))
    whole = bodies.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    led = whole.withColumn(
        "leads",
        F.transform("parts", lambda p, i: F.when(i == 0, header(p["first"])).otherwise(
            lead(p["first"], F.get("parts", i - 1)["last"]))))
    based = led.withColumn(
        "at", running(F.transform("parts", lambda p, i: (F.length(F.get("leads", i)) + F.length(p["body"])).cast("bigint"))))
    shifted = lambda p, i: F.transform(p["spans"], lambda s: F.struct(
        (s["start"] + F.get("at", i) + F.length(F.get("leads", i))).alias("start"),
        (s["end"] + F.get("at", i) + F.length(F.get("leads", i))).alias("end")))
    return based.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p, i: F.concat(F.get("leads", i), p["body"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten(F.transform("parts", shifted)).alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, read from formatted strings and their spans."""
    messages = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda m: m != "")
    parsed = chats.withColumn("messages", F.transform(messages, lambda m: F.struct(
        unescaped_role(F.substring_index(F.substr(m, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        F.split(F.regexp_replace(m, r"^[^\n]*\n", ""), r"<\|im_sep\|>").alias("texts"))))
    turns = F.flatten(F.transform("messages", lambda m: F.transform(
        m["texts"], lambda t: F.struct(m["role"].alias("role"), unescaped(t).alias("text")))))
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return parsed.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))
