r"""Operator 5: chat formatting with Spark expressions only.

A turn is ``### role: text</turn>`` and a line end; adjacent turns of one role share a header and are parted by
``<|also|>``. Inside texts and roles the control strings are broken reversibly: ``\`` becomes ``\b``, the first
``#`` of every ``###`` becomes ``\h``, the ``<`` of ``</turn>`` and ``<|also|>`` becomes ``\l`` (and ``:`` in roles ``\c``),
so that marks in the output are always the template's own and reading back gives the turns as they were.

The loss mask is a list of spans (start, length in code points of the output) that hold the escaped assistant
texts and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END, ALSO = "### ", ": ", "</turn>\n", "<|also|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.regexp_replace(text, r"#(?=##)", r"\\h")
    return F.regexp_replace(text, r"<(?=/turn>|\|also\|>)", r"\\l")


def unescape(text: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans array<struct<start, length>>.

    Turns are sorted by turn, then role, then text (null first), so ties and repeated rows come out the same way each
    time and each is a turn of its own. Null texts and roles are empty. Null conv_id is a conversation. Other columns
    are not read. An empty table gives no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = turns.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("turns", s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    headed = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit(HEAD), F.replace(escape(b["role"]), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE)).alias("head"),
            b["texts"].alias("texts"),
            (b["role"] == LOSS_ROLE).alias("in_loss"),
        ),
    )
    # runs of the output in order: what stands before each text, and the text
    runs = F.flatten(
        F.transform(
            "headed",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    (F.when(i == 0, F.length(b["head"])).otherwise(len(ALSO)) + F.lit(0)).cast("bigint").alias("before"),
                    F.length(t).cast("bigint").alias("length"),
                    F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).cast("bigint").alias("after"),
                    b["in_loss"].alias("in_loss"),
                ),
            ),
        )
    )
    empty = F.expr("struct(0L as at, cast(array() as array<struct<start: bigint, length: bigint>>) as spans)")
    walked = F.aggregate(
        "runs",
        empty,
        lambda acc, r: F.struct(
            (acc["at"] + r["before"] + r["length"] + r["after"]).alias("at"),
            F.when(r["in_loss"], F.array_append(acc["spans"], F.struct((acc["at"] + r["before"]).alias("start"), r["length"].alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    formatted = F.array_join(F.transform("headed", lambda b: F.concat(b["head"], F.array_join(b["texts"], ALSO), F.lit(END))), "")
    return (
        sorted_turns.select("conv_id", "turns", starts.alias("starts"))
        .select("conv_id", blocks.alias("blocks"))
        .select("conv_id", headed.alias("headed"))
        .select("conv_id", formatted.alias("formatted"), runs.alias("runs"))
        .select("conv_id", "formatted", walked["spans"].alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate(MIDDLE, b) + len(MIDDLE)), r"<\|also\|>", -1),
                lambda t: F.struct(unescape(F.substr(b, F.lit(len(HEAD) + 1), F.locate(MIDDLE, b) - len(HEAD) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
