"""Chat formatting as relational steps with Spark expressions only.

A conversation's turns are numbered by turn (ties by role, then text); neighbours tell where a role begins and ends, and a
running sum where a turn's text will stand. The numbered structs are collected and sorted, adjacent turns of one role are
merged by aggregating their slice of the array, and the blocks are concatenated. A block's texts are joined by an inner
separator, so that the merge can be undone:

    <|im_start|>role \\n text <|im_sep|> text <|im_end|> \\n        (without the spaces)

Inside roles and texts a backslash is doubled and control strings get a backslash after their first character
(`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`; in roles also \\n gets one in front), so that none occurs there and
dropping each backslash that stands before a character gives the original back.

The loss mask is a list of spans, in UTF-8 bytes of the formatted string: one for each assistant turn's text.

One conversation is one row of the result. Its turns are shuffled once, sorted within their task (which can spill), and
every further step is linear in them; nothing depends on the number of conversations.

Defined cases: a null text or role is the empty string; a null turn sorts first; turns with a null conv_id are one
conversation; repeated rows are turns of their own; an empty table gives an empty table; texts of any length are formatted
whole, as long as a conversation fits in a row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
#: What is escaped, and how, in this order.
ESCAPES = [("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")]


def _escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans is an array of (start, length) in bytes of formatted."""
    of = lambda c: F.col(f"`{c}`")
    rows = turns.select(
        of(conv_col).alias("conv_id"), of(turn_col).alias("turn"),
        F.coalesce(of(role_col), F.lit("")).alias("role"), F.coalesce(of(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = F.col("role"), F.col("told")
    placed = rows.withColumns(
        {
            "n": F.row_number().over(order),
            "first": F.coalesce(F.lag("role").over(order) != role, F.lit(True)),
            "last": F.coalesce(F.lead("role").over(order) != role, F.lit(True)),
            "told": _escape(F.col("text")),
        }
    )
    before = F.when(F.col("first"), _bytes(_escape_role(role)) + len(START) + 1).otherwise(F.lit(len(SEPARATOR)))
    after = F.when(F.col("last"), F.lit(len(END))).otherwise(F.lit(0))
    end = F.sum(before + _bytes(text) + after).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    one = F.struct(
        "n", "first", role.alias("role"), text.alias("text"), (end - after - _bytes(text)).alias("start"), (role == loss_role).alias("loss"),
    )
    collected = placed.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def blocks(t: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1)["first"])

        def merged(starts: Column) -> Column:
            def block(at: Column, j: Column) -> Column:
                run = F.slice(t, at, F.coalesce(F.get(starts, j + 1), F.size(t) + 1) - at)
                told = F.array_join(F.transform(run, lambda x: x["text"]), SEPARATOR)
                return F.concat(F.lit(START), _escape_role(F.get(t, at - 1)["role"]), F.lit("\n"), told, F.lit(END))

            return F.array_join(F.transform(starts, block), "")

        return _let(firsts, merged)

    span = lambda x: F.struct(x["start"].alias("start"), _bytes(x["text"]).alias("length"))
    return collected.select(
        "conv_id",
        _let(F.col("turns"), blocks).alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["loss"]), span).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns, as an array of (role, text), read back from a formatted string."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    whole = F.slice(blocks, 1, F.size(blocks) - 1)  # nothing follows the last end marker
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n"

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, header, 1))
        texts = F.split(F.regexp_replace(block, header, ""), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(whole, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped and joined."""
    raw = F.encode(formatted, "UTF-8")
    text = lambda b, s: unescape(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return _let(raw, lambda b: F.array_join(F.transform(spans, lambda s: text(b, s)), ""))
