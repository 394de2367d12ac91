"""Chat formatting: conversations as one training text each, with a loss mask, by Spark expressions only.

A turn is a row (conversation, turn, role, text). Rows are sorted by turn, then role and text; adjacent
rows of one role merge into one block:

    [ROLE]user[TEXT]first text[NEXT]second text</s>[ROLE]assistant[TEXT]answer</s>

Control strings inside roles and texts get a `~` after their first character (one more where some
stand there already), so that none of them is left and `unescape` gives the text back exactly.
Null roles and texts count as empty, a null turn sorts first, repeated rows stay, a null conversation id
is a conversation of its own. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "[ROLE]", "[TEXT]", "[NEXT]", "</s>"
#: What is escaped inside texts: the own markers and those of common templates.
_CONTROL = r"(/?(?:ROLE|TEXT|NEXT|INST|SYS)\]|/?s>|<SYS>>|/SYS>>|\|im_(?:start|end)\|>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(~*)" + _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])~(~*)" + _CONTROL, "$1$2$3")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _opens(turns: Column, i: Column) -> Column:
    """Whether turn i begins a block, as the one before has another role."""
    return (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one block (role, texts); each turn is copied once."""
    places = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: _opens(turns, i))

    def block(starts: Column, i: Column, k: Column) -> Column:
        own = F.slice(turns, i + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - i)
        return F.struct(F.get(turns, i)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    return _let(places, lambda starts: F.transform(starts, lambda i, k: block(starts, i, k)))


def _append(sums: Column, x: Column) -> Column:
    return F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0).cast("long")) + x))


def _running(values: Column) -> Column:
    """Sums of longs up to each place of a bound array, in chunks of about the root of their number, as appending copies an array."""
    none = F.array().cast("array<bigint>")
    wide = F.ceil(F.sqrt(F.size(values))).cast("int")
    begins = F.sequence(F.lit(1), F.size(values), wide)
    chunks = F.transform(begins, lambda b: F.aggregate(F.slice(values, b, wide), none, _append))
    ends = lambda own: F.aggregate(F.transform(own, lambda c: F.get(c, F.size(c) - 1)), none, _append)
    moved = lambda own, before: F.transform(own, lambda c, k: F.transform(c, lambda x: x + F.coalesce(F.get(before, k - 1), F.lit(0).cast("long"))))
    return F.flatten(_let(chunks, lambda own: _let(ends(own), lambda before: moved(own, before))))


def _mask(turns: Column, role: str) -> Column:
    """Where the texts of `role` stand in the formatted text: (start, length) in UTF-8 bytes, from 0."""
    open_ = lambda t: F.lit(len(ROLE) + len(TEXT)) + F.octet_length(t["role"])
    before = lambda t, i: F.when(i == 0, open_(t)).when(_opens(turns, i), F.lit(len(END)) + open_(t)).otherwise(F.lit(len(NEXT)))
    steps = F.transform(turns, lambda t, i: (before(t, i) + F.octet_length(t["text"])).cast("long"))

    def spans(ends: Column) -> Column:
        every = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), (F.get(ends, i) - F.octet_length(t["text"])).alias("start"), F.octet_length(t["text"]).cast("long").alias("length")))
        return F.transform(F.filter(every, lambda s: s["role"] == role), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    return _let(steps, lambda own: _let(_running(own), spans))


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask) of rows (conv_id, turn, role, text); loss_mask covers the texts of `learn`. A
    conversation is one row, and so must fit in a task's memory."""
    turn = F.struct(F.col("turn"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    line = lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))
    done = _let(F.col("turns"), lambda t: F.struct(F.array_join(F.transform(_blocks(t), line), "").alias("formatted"), _mask(t, learn).alias("loss_mask")))
    return turns.select("conv_id", done.alias("done")).select("conv_id", "done.formatted", "done.loss_mask")


def parse_chats(chats: DataFrame) -> DataFrame:
    """Adds turns, array of (role, text) in order, read back from `formatted`."""
    blocks = F.filter(F.split("formatted", r"</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, len(ROLE) + 1, 2**31 - 1), TEXT, 1))
        body = F.element_at(F.split(b, r"\[TEXT\]", 2), 2)
        return _let(role, lambda r: F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return chats.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def loss_text(chats: DataFrame) -> DataFrame:
    """Adds loss_text: what the mask covers, unescaped, nothing between."""
    part = lambda raw: F.transform("loss_mask", lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return chats.withColumn("loss_text", F.array_join(_let(F.col("formatted").cast("binary"), part), ""))


def chat_digests(rows: DataFrame) -> DataFrame:
    """Per conversation, all read back from the formatted text and its mask."""
    chats = loss_text(parse_chats(format_chats(rows)))
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
