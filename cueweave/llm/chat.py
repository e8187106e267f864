r"""Chat formatting by a grammar round trip, in DataFrame expressions only.

    conversation := turn*
    turn         := head role ": " text "</turn>\n"
    head         := "### "                 role and text stand as they are
                  | "###\ "                role and text are escaped

Escapes: `\\` for a backslash, `\h` for `###`, `\t` for `</turn>`, `\c` for `: `. The parser cuts the rendered string
at `</turn>` and a line feed, takes the head, the role up to the first `: ` and the text after it. Each turn is rendered
plainly and parsed again; where it holds a control string or doesn't come back as it was, it is escaped. The whole
conversation is then parsed and compared with its source; if anything differs, all its turns are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

END = "</turn>\n"
PLAIN, ESCAPED = "### ", "###\\ "


def escape(s: Column) -> Column:
    for raw, short in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c")):
        s = F.replace(s, F.lit(raw), F.lit(short))
    return s


def unescape(s: Column) -> Column:
    """Every backslash of an escaped string begins an escape, so a cut at two backslashes, from the left, is exact."""

    def part(p: Column) -> Column:
        for raw, short in (("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c")):
            p = F.replace(p, F.lit(short), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(s, r"\\\\"), part), "\\")


def render(role: Column, text: Column, escaped: Column) -> Column:
    return F.when(escaped, F.concat(F.lit(ESCAPED), escape(role), F.lit(": "), escape(text), F.lit(END))).otherwise(F.concat(F.lit(PLAIN), role, F.lit(": "), text, F.lit(END)))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""

    def turn(p: Column) -> Column:
        escaped = F.startswith(p, F.lit(ESCAPED))
        rest = F.substr(p, F.when(escaped, len(ESCAPED) + 1).otherwise(len(PLAIN) + 1))
        role = F.substring_index(rest, ": ", 1)
        text = F.substr(rest, F.length(role) + 3)
        plain = F.struct(role.alias("role"), text.alias("text"))
        return F.when(escaped, F.struct(unescape(role).alias("role"), unescape(text).alias("text"))).otherwise(plain)

    parts = F.split(rendered, END)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans array<struct<start, end, escaped>>, all_escaped), a row a conversation.

    loss_spans: code points of the trained role's texts in `formatted`, end exclusive, and whether they stand escaped
    there. An empty table gives no rows; other columns aren't read. Null role or text
    counts as empty; a null turn number comes first; rows that repeat a number are ordered by role and text and all
    kept; a null conversation id is an id like others. A conversation's string is one row of the result, so the rows
    of one conversation meet in one task by the nature of the result.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    source = F.array(F.struct("role", "text"))
    holds = F.lit(False)
    for mark in ("###", "</turn>"):
        holds = holds | F.contains("text", F.lit(mark)) | F.contains("role", F.lit(mark))
    rows = rows.withColumn("escaped", holds | (parse(render(F.col("role"), F.col("text"), F.lit(False))) != source))
    rows = rows.withColumn("piece", render(F.col("role"), F.col("text"), F.col("escaped")))
    rows = rows.withColumn("whole", render(F.col("role"), F.col("text"), F.lit(True)))
    # In one order for both, with what is before each piece in either rendering.
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    mine = F.col("role") == trained_role

    def span(piece: str, offset: str, escaped: Column) -> Column:
        head = F.when(escaped, F.lit(len(ESCAPED)) + F.length(escape(F.col("role")))).otherwise(F.lit(len(PLAIN)) + F.length("role")) + 2
        return F.when(mine, F.struct((F.col(offset) + head).cast("long").alias("start"), (F.col(offset) + F.length(piece) - len(END)).cast("long").alias("end"), escaped.alias("escaped")))

    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).withColumn("whole_at", F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)))
    rows = rows.select("conv_id", F.struct("nth", "role", "text", "piece", "whole", span("piece", "at", F.col("escaped")).alias("span"), span("whole", "whole_at", F.lit(True)).alias("whole_span")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    held = held.withColumn("formatted", F.array_join(F.col("t.piece"), ""))
    same = parse(F.col("formatted")) == F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    held = held.withColumn("all_escaped", ~same)
    spans = F.when(F.col("all_escaped"), F.col("t.whole_span")).otherwise(F.col("t.span"))
    return held.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.when(F.col("all_escaped"), F.array_join(F.col("t.whole"), "")).otherwise(F.col("formatted")).alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), "all_escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>>, parsed from `formatted`, and loss_text: what stands under loss_spans, unescaped."""

    def text(s: Column) -> Column:
        part = F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.when(s["escaped"], unescape(part)).otherwise(part)

    return formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_text", F.array_join(F.transform("loss_spans", text), ""))
