"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its
text is trainable. The template writes a turn as ``<s>``, the role, a line feed, the text and ``</s>``;
a target is closed the same way. Inside roles and texts every ``<`` is written ``<0`` and every ``[``
as ``[0``, so no control string can be formed by a text, and reading back is exact.

A conversation's turns meet in one row, as its examples repeat them anyway; all steps are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<0")), F.lit("["), F.lit("[0"))


def escaped_role(role: Column) -> Column:
    """A role's line ends at the first line feed, so those inside are written as ``[n``."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("[n"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("[n"), F.lit("\n")), F.lit("[0"), F.lit("["))
    return F.replace(text, F.lit("<0"), F.lit("<"))


def examples(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, example, formatted, loss_start, loss_end)``: one row per assistant turn.

    ``example`` counts a conversation's examples from 0; the loss mask is one span of code points,
    end exclusive, and covers the escaped reply. A conversation without assistant turns gives one row
    with all its turns as context and an empty span, so that nothing is lost; turns after the last
    reply are context of no example and are kept in ``rest`` of the last one, as formatted text.
    Null roles and texts are empty; rows are ordered by turn (null first), then role and text.
    """
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(own)).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n"))
    line = lambda t: F.concat(head(t), escaped(t["text"]), F.lit(CLOSE))
    replies = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["role"] == "assistant").alias("is"))), lambda x: x["is"])
    at = F.transform(replies, lambda x: x["at"])
    lines = whole.select("key", "turns", F.transform("turns", line).alias("lines"), at.alias("at"))
    last = F.when(F.size("at") > 0, F.element_at("at", -1)).otherwise(F.lit(-1))
    many = F.when(F.size("at") > 0, F.col("at")).otherwise(F.array(F.lit(-1)))
    one = lines.withColumn("last", last).select("key", "turns", "lines", "last", F.posexplode(many).alias("example", "reply"))
    until = F.when(F.col("reply") < 0, F.size("lines")).otherwise(F.col("reply"))
    context = F.array_join(F.slice("lines", F.lit(1), until), "")
    target = F.when(F.col("reply") >= 0, F.get("turns", F.col("reply")))
    prompt = F.concat(context, F.coalesce(head(target), F.lit("")))
    reply = F.coalesce(escaped(target["text"]), F.lit(""))
    rest = F.when((F.col("reply") >= 0) & (F.col("reply") == F.col("last")), F.array_join(
        F.slice("lines", F.col("reply") + 2, F.greatest(F.size("lines") - F.col("reply") - 1, F.lit(0))), "")).otherwise(F.lit(""))
    made = one.select("key", "example", prompt.alias("prompt"), reply.alias("reply"), (F.col("reply") >= 0).alias("is"), rest.alias("rest"))
    formatted = F.concat("prompt", "reply", F.when(F.col("is"), F.lit(CLOSE)).otherwise(F.lit("")))
    start = F.char_length("prompt")
    return made.select(F.col("key").alias(key), F.col("example").cast("int").alias("example"), formatted.alias("formatted"),
                       start.alias("loss_start"), (start + F.char_length("reply")).alias("loss_end"), "rest")


def read_back(formatted: Column) -> Column:
    """Array of ``(role, text)`` of a formatted text."""
    lines = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")

    def turn(line: Column) -> Column:
        inner = F.substring(line, len(OPEN) + 1, F.char_length(line))
        cut = F.locate("\n", inner)
        return F.struct(unescaped(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(inner, cut + 1)).alias("text"))

    return F.transform(lines, turn)


def digests(made: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold, read back from the formatted texts and masks."""
    reply = unescaped(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    n = F.char_length("formatted")
    each = made.select(F.col(key).alias("key"), "example", reply.alias("reply"), n.alias("n"),
                       F.concat("formatted", "rest").alias("all"))
    last = F.max_by("all", "example")
    sums = each.groupBy("key").agg(
        last.alias("all"), F.sum("n").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("example", "reply"))).alias("replies"))
    said = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    turns = read_back(F.col("all"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return sums.select(F.col("key").alias(key), F.size(turns).cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.char_length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), "formatted_chars")
