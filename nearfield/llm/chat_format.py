"""Chat formatting with Spark expressions only.

A conversation becomes blocks `<turn:role>text</turn>`; neighbouring turns of one role share a block, in which `<next>`
parts them. Texts and roles escape `&`, `<` and `>` as `&amp;`, `&lt;` and `&gt;`, so no control string can occur inside
them, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPEN_END, NEXT, CLOSE = "<turn:", ">", "<next>", "</turn>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, end in code points of formatted; end exclusive).

    Turns are sorted by (turn, role, text), so ties and repeated rows have one defined order and every row is kept.
    Null texts and roles are empty strings; null turns come first; null conv_id is a conversation of its own. Spans cover
    the escaped texts of loss_role, one per turn, and none of the control strings. Other columns are ignored. A conversation's turns meet in one array,
    since its output is one string.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))

    def piece(t: Column, i: Column) -> Column:
        same_before = (i > 0) & (F.get(F.col("_ts"), i - 1)["role"] == t["role"])
        same_after = F.coalesce(F.get(F.col("_ts"), i + 1)["role"] == t["role"], F.lit(False))
        return F.struct(
            F.when(same_before, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(OPEN_END))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(same_after, F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
            (t["role"] == loss_role).alias("loss"),
        )

    got = got.select("conv_id", F.transform("_ts", piece).alias("_ps"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.when(p["loss"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct((end + F.length(p["tail"])).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("_ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("_ps", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """array of struct(role, text): the turns of a formatted conversation, read back from its text alone."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, r"^<turn:([^>]*)>", 1))
        body = F.regexp_replace(block, r"^<turn:[^>]*>", "")
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of format_conversations, as counts and digests."""
    turns = F.array_join(F.transform(F.col("_turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        formatted.withColumns({"_turns": parse_formatted(F.col("formatted")), "_loss": F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "")})
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
