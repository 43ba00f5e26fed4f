"""Chat formatting: typed content parts become one string with a loss mask and attachments.

A turn's content is an array of parts, each text, image, audio or document. A visitor flattens them
in order: neighbouring texts are joined and then written with their control strings escaped, so that no string
can be put together from the end of one part and the start of the next; any other part becomes a numbered
placeholder such as ``<|image:0|>``, and its reference and expanded number of tokens are recorded.
Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Escaping puts one more backslash
between ``<`` (and any backslashes after it) and ``|``, so texts never hold ``<|`` and the way back
takes one out; a line break in a role is written as ``<|nl|>``. A placeholder is the only ``<|`` in a turn's body,
so :func:`parts_read` tells it from a text that looks like one.

Turns are formatted row by row before any shuffle; what meets at a conversation is one string a turn,
which the conversation's own string has to hold anyway.

Defined results: null texts, roles and references are empty; a null turn comes first; turns with
equal numbers are ordered by role, then text; a conversation without parts in a turn has an empty text; repeated
rows are turns of their own; texts of any length are written whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def text_part(text: Column) -> Column:
    """An array with one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def visited(parts: Column) -> Column:
    """Struct of the flattened, escaped text and the attachments (place, kind, ref, tokens) of one turn."""
    others = F.filter(parts, lambda p: p["kind"] != "text")
    attached = F.transform(others, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        is_text = F.coalesce(p["kind"], F.lit("text")) == "text"
        place = F.concat(F.lit("<|"), F.regexp_replace(p["kind"], r"[<|>:]", "_"), F.lit(":"), s["n"].cast("string"), F.lit("|>"))
        # texts stay open until another part follows
        return F.struct(
            (s["n"] + F.when(is_text, 0).otherwise(1)).alias("n"),
            F.when(is_text, s["text"]).otherwise(F.concat(s["text"], escaped(s["open"]), place)).alias("text"),
            F.when(is_text, F.concat(s["open"], F.coalesce(p["text"], F.lit("")))).otherwise("").alias("open"),
        )

    flat = F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), state, step, lambda s: F.struct(F.concat(s["text"], escaped(s["open"])).alias("text")))
    return F.struct(flat["text"].alias("text"), F.coalesce(attached, F.array().cast("array<struct<place:int,kind:string,ref:string,tokens:bigint>>")).alias("attachments"))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """(conv, formatted string, loss array<struct<from, to>>, attachments, attached_tokens long): loss
    holds code-point ranges, end exclusive, of the trained role's texts."""
    name = F.coalesce(F.col(role), F.lit(""))
    v = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), visited(F.col(parts)).alias("v"))
    head = F.concat(F.lit(START), F.regexp_replace(escaped(F.col("role")), "\n", BREAK), F.lit("\n"))
    v = v.select("conv", "turn", "role", F.length(head).alias("head"), F.length("v.text").alias("body"), F.concat(head, F.col("v.text"), F.lit(END + "\n")).alias("shown"), "v.attachments", F.col("v.text").alias("text"))
    order = ["turn", "role", "text"]
    until = F.sum(F.length("shown").cast("long")).over(Window.partitionBy("conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = v.withColumn("begin", until - F.length("shown"))
    loss = F.when(F.col("role") == trained, F.struct((F.col("begin") + F.col("head")).alias("from"), (F.col("begin") + F.col("head") + F.col("body")).alias("to")))
    rows = v.select("conv", F.struct("begin", "shown", loss.alias("loss"), "attachments").alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return rows.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("formatted"),
        F.array_compact(F.transform("ts", lambda t: t["loss"])).alias("loss"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("ts", lambda t: t["attachments"])), F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("attached_tokens"),
    )


def turns_read(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")

    def back(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = F.substr(block, F.lit(len(START) + 1), line - len(START) - 1)
        return F.struct(unescaped(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), unescaped(F.substr(block, line + 1)).alias("text"))

    return F.transform(blocks, back)


def parts_read(text: Column) -> Column:
    """Array of (role, parts) read back from a formatted conversation; parts are (kind, text, place): a text without a
    place, or another kind with its number and without a text."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")
    mark = r"<\|[^<|>:]*:[0-9]+\|>"

    def part(kind: Column, text: Column, place: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), place.cast("int").alias("place"))

    def body(shown: Column) -> Column:
        texts = F.split(shown, mark)
        marks = F.regexp_extract_all(shown, F.lit(f"({mark})"), F.lit(1))
        nothing = F.lit(None)

        def both(t: Column, i: Column) -> Column:
            own = F.when(t != "", part(F.lit("text"), unescaped(t), nothing))
            m = F.get(marks, i)
            other = F.when(m.isNotNull(), part(F.regexp_extract(m, r"^<\|([^:]*):", 1), nothing.cast("string"), F.regexp_extract(m, r":([0-9]+)\|>$", 1)))
            return F.array_compact(F.array(own, other))

        return F.flatten(F.transform(texts, both))

    def back(block: Column) -> Column:
        line = F.instr(block, "\n")
        role = F.substr(block, F.lit(len(START) + 1), line - len(START) - 1)
        return F.struct(unescaped(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), body(F.substr(block, line + 1)).alias("parts"))

    return F.transform(blocks, back)


def loss_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda m: unescaped(F.substr(text, (m["from"] + 1).cast("int"), (m["to"] - m["from"]).cast("int")))), "")
