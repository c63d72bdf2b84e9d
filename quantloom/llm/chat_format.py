"""Relational chat formatting with Spark expressions only: no Python runs on the executors.

Turns of a conversation are collected as structs, sorted, merged where neighbours share a role, and
concatenated. Control strings inside texts are escaped reversibly, so the formatted text can be read back.

Template: every run of turns of one role is `<|im_start|>role\\n` text { `<|turn|>` text } `<|im_end|>\\n`.
Escape: a backslash goes between the `<` and the `|` of any `<|` in a text, one more if there are some; in a
role, backslashes and line feeds are escaped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose places are added up in one array.
BLOCK = 256
START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\0"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\\0"), F.lit("\\"))


def format_chat(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans (start and length, in characters, of assistant texts).

    Turns are ordered by turn (null first), then role, then text; so repeated rows and ties stay, each a turn
    of its own. Null role or text: empty. A null conv_id is a conversation of its own. An empty table gives no
    rows. Other columns are not read. A conversation is one value by definition, so its turns meet in one row.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        opens = F.coalesce(F.get(F.col("turns"), i - 1)["role"] != t["role"], F.lit(True))  # true at either end, where there is no neighbour
        closes = F.coalesce(F.get(F.col("turns"), i + 1)["role"] != t["role"], F.lit(True))
        return F.struct(
            F.when(opens, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(TURN)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == "assistant").alias("loss"),
        )

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    size = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
    pieces = pieces.select("conv_id", "pieces", size.alias("sizes"))
    # Running sums inside blocks of turns, and over the blocks: no array is copied once for each turn.
    running = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    blocks = F.transform(F.sequence(F.lit(1), F.size("sizes"), F.lit(BLOCK)), lambda at: running(F.slice("sizes", at, F.lit(BLOCK))))
    pieces = pieces.select("conv_id", "pieces", blocks.alias("inside"))
    pieces = pieces.select("conv_id", "pieces", "inside", running(F.transform("inside", lambda b: F.element_at(b, -1))).alias("before"))

    def start(i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.get(F.col("before"), block) + F.get(F.get(F.col("inside"), block), i % BLOCK)

    spans = F.transform("pieces", lambda p, i: F.struct((start(i) + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"), p["loss"].alias("loss")))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, in order, with their escapes undone."""
    runs = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda r: r != "")
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.split(F.regexp_extract(r, r"(?s)^[^\n]*\n(.*)$", 1), r"<\|turn\|>", -1),
                lambda x: F.struct(_unescape_role(F.regexp_extract(r, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
