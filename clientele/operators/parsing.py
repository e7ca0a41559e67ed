"""Parsing of generated answers with staged repair, as a batch job over a table of responses.

Each stage is a column of candidate text built from Spark expressions; the first candidate that
parses wins and its stage is recorded. Only the YAML load itself runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.grounding import INSIGHT_SCHEMA

# Names of the repair stages in the order they are tried.
JSON_STAGES = ("L1:strip_fences", "L2:trailing_commas", "L3:single_quotes", "L4:regex_extract", "L5:escape_control")
YAML_STAGES = (
    "L1:strip_fences", "L2:fix_colons", "L3:normalise_indent", "L4:force_quote", "L5:extract_block",
    "L5:extract+repair", "L6:json_fallback", "L7:regex_extract",
)


def _is_object(text: Column) -> Column:
    """True for exactly one JSON object; inside an array, text after the object is an error."""
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.schema_of_variant(F.try_variant_get(parsed, "$[0]", "variant")).startswith("OBJECT")
    return F.coalesce(first & F.try_variant_get(parsed, "$[1]", "variant").isNull(), F.lit(False))


def _braces(text: Column) -> Column:
    """From the first opening to the last closing brace, if there are any."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.length(inner) > 0, inner).otherwise(text)


def _no_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")


def json_candidates(raw: Column | str) -> list[Column]:
    """Candidate texts of the five JSON stages."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"```json\s*\n?", ""), r"```\s*", ""))
    cleaned = _braces(bare)
    fixed = _no_trailing_commas(cleaned)
    quoted = F.replace(fixed, F.lit("'"), F.lit('"'))
    anchored = _no_trailing_commas(F.regexp_extract(raw, r'(?s)\{.*"insights".*\}', 0))
    escaped = F.regexp_replace(F.regexp_replace(fixed, r"(?<!\\)\n", r"\\\\n"), r"(?<!\\)\t", r"\\\\t")
    return [cleaned, fixed, quoted, anchored, escaped]


def parse_json_answers(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``json`` (the text that parsed), ``stage``, ``success`` and ``error``."""
    texts = json_candidates(raw)
    staged = responses.withColumn("__c", F.array(*texts))
    chosen, stage = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in reversed(range(len(texts))):
        ok = _is_object(F.col("__c")[i])
        chosen = F.when(ok, F.col("__c")[i]).otherwise(chosen)
        stage = F.when(ok, F.lit(JSON_STAGES[i])).otherwise(stage)
    empty = F.col(raw).isNull() | (F.trim(F.col(raw)) == "")
    return (
        staged.withColumn("__pick", F.when(~empty, F.struct(chosen.alias("json"), stage.alias("stage"))))
        .select(
            *responses.columns,
            F.col("__pick.json").alias("json"),
            F.col("__pick.stage").alias("stage"),
            F.col("__pick.json").isNotNull().alias("success"),
            F.when(empty, "Empty input").when(F.col("__pick.json").isNull(), F.concat(
                F.lit("all stages failed: "), F.col(raw))).alias("error"),
        )
    )


def insights_of(parsed: DataFrame, doc: str = "doc") -> DataFrame:
    """Insight rows of parsed answers; numbers and text claims are told apart."""
    document = F.try_parse_json(F.col("json"))
    items = F.try_variant_get(document, "$.insights", "array<variant>")

    def text(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def citation(c: Column) -> Column:
        value = F.try_variant_get(c, "$.metric_value", "variant")
        return F.struct(
            text(c, "$.file").alias("file"), text(c, "$.row_id").alias("row_id"),
            text(c, "$.metric_value").alias("metric_value"),
            (F.schema_of_variant(value) == "STRING").alias("is_text"),
            text(c, "$.metric_name").alias("metric_name"),
            F.try_variant_get(c, "$.dimensions", "map<string,string>").alias("dimensions"),
        )

    names = ["insight_id", "insight", "why_interesting", "user_group", "product_category", "product_lob"]
    rows = parsed.where("success").select(F.col(doc).alias("doc"), F.explode(items).alias("i"))
    citations = F.transform(F.try_variant_get(F.col("i"), "$.citations", "array<variant>"), citation)
    out = rows.select("doc", *[text(F.col("i"), f"$.{n}").alias(n) for n in names], citations.alias("citations"))
    assert [c.split()[0] for c in INSIGHT_SCHEMA.split(", ")] == out.columns
    return out


# ---------------------------------------------------------------- YAML

# The patterns of a key line, of plain numbers and of words YAML reads as values.
KEY_LINE = r"(?U)^(\s*)(- )?([\w_]+)\s*:\s*(.+)$"
NUMBER = r"^-?\d+(\.\d+)?$"
RESERVED = ("true", "false", "null", "none")
SPECIAL = r"[#&*!|>{}\[\]%]"


def _by_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def _plain_value(line: Column) -> tuple[Column, Column, Column]:
    """(is an unquoted text value, start of the line up to the key, value)."""
    value = F.trim(F.regexp_extract(line, KEY_LINE, 4))
    quoted = value.rlike(r'^"(.*)"$') | value.rlike("^'(.*)'$")
    fixed = quoted | value.rlike(r"^[\[{]") | value.rlike(NUMBER) | F.lower(value).isin(*RESERVED)
    stripped = F.ltrim(line)
    is_text = line.rlike(KEY_LINE) & (stripped != "") & ~stripped.startswith("#") & ~fixed
    head = F.concat(
        F.regexp_extract(line, KEY_LINE, 1), F.regexp_extract(line, KEY_LINE, 2), F.regexp_extract(line, KEY_LINE, 3)
    )
    return is_text, head, value


def strip_fences(raw: Column) -> Column:
    """Without code fences, and without text before the first key or list item."""
    text = F.regexp_replace(F.trim(raw), r"(?m)^```ya?ml\s*\n?", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^```json\s*\n?", ""), r"(?m)^```\s*$", ""))
    lines = F.split(text, "\n")
    starts = F.transform(lines, lambda x: F.trim(x).startswith("- ") | F.trim(x).rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*\s*:"))
    first = F.array_position(starts, True)
    return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(text)


def quote_risky_values(text: Column) -> Column:
    """Quotes around values with a second colon or characters YAML gives a meaning."""

    def change(line: Column) -> Column:
        is_text, head, value = _plain_value(line)
        risky = (
            (value.contains(":") & ~value.rlike("https?://"))
            | value.rlike(SPECIAL)
            | value.rlike("^[\"'@`,]")
        )
        safe = F.replace(value, F.lit('"'), F.lit('\\"'))
        return F.when(is_text & risky, F.concat(head, F.lit(': "'), safe, F.lit('"'))).otherwise(line)

    return _by_line(text, change)


def even_indent(text: Column) -> Column:
    """Tabs to spaces, indents rounded down to even and at most eight."""

    def change(line: Column) -> Column:
        spaced = F.replace(line, F.lit("\t"), F.lit("  "))
        body = F.ltrim(spaced)
        n = F.length(spaced) - F.length(body)
        return F.when(F.trim(line) == "", line).otherwise(
            F.concat(F.repeat(F.lit(" "), F.least(n - n % 2, F.lit(8))), body)
        )

    return _by_line(text, change)


def quote_all_values(text: Column) -> Column:
    def change(line: Column) -> Column:
        is_text, head, value = _plain_value(line)
        safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.when(is_text, F.concat(head, F.lit(': "'), safe, F.lit('"'))).otherwise(line)

    return _by_line(text, change)


def trends_block(raw: Column) -> Column:
    """From the line that opens the trend list to the next fence; NULL without one."""
    rest = F.regexp_extract(raw, r"(?sm)^trends\s*:.*", 0)
    cut = F.regexp_replace(rest, r"(?sm)^```.*", "")
    return F.when(F.length(rest) > 0, F.trim(cut))


def yaml_candidates(raw: Column) -> list[Column]:
    cleaned = strip_fences(raw)
    fixed = quote_risky_values(cleaned)
    spaced = even_indent(fixed)
    block = trends_block(raw)
    return [cleaned, fixed, spaced, quote_all_values(spaced), block,
            quote_all_values(even_indent(quote_risky_values(block)))]


def regex_trends(raw: Column) -> Column:
    """Key-value pairs after each ``rank:``, as a JSON text of all trends; NULL when none is found."""
    pieces = F.split(raw, r"(?:^|\n)\s*-?\s*rank\s*:")
    blocks = F.slice(pieces, 2, F.size(pieces))
    pair = r'(?U)([\w_]+)\s*:\s*"?([^"\n]+)"?'

    def one(block: Column, i: Column) -> Column:
        keys = F.regexp_extract_all(block, F.lit(pair), F.lit(1))
        values = F.transform(F.regexp_extract_all(block, F.lit(pair), F.lit(2)), lambda v: F.trim(v))
        entries = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] != "rank")
        # the last value of a repeated key stays
        last = F.filter(entries, lambda e, at: ~F.exists(
            F.slice(entries, at + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
        cells = F.transform(last, lambda e: F.concat(
            F.lit('"'), e["k"], F.lit('":'),
            F.coalesce(F.when(e["v"].try_cast("double").isNotNull(), F.regexp_replace(e["v"], r"^\+", "")),
                       F.to_json(F.array(e["v"])).substr(F.lit(2), F.length(F.to_json(F.array(e["v"]))) - 2))))
        body = F.array_join(F.concat(F.array(F.concat(F.lit('"rank":'), (i + 1).cast("string"))), cells), ",")
        return F.struct(F.size(cells).alias("n"), F.concat(F.lit("{"), body, F.lit("}")).alias("text"))

    found = F.filter(F.transform(blocks, one), lambda t: t["n"] > 1)
    texts = F.array_join(F.transform(found, lambda t: t["text"]), ",")
    return F.when(F.size(found) > 0, F.concat(F.lit('{"trends":['), texts, F.lit("]}")))


def _load_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The YAML load: for each row the first candidate that reads as a mapping, as JSON text."""
    import json

    try:
        import yaml
    except ImportError as e:  # the JSON stages work without it
        raise RuntimeError("parsing YAML answers needs PyYAML") from e

    def load(texts):
        for i, text in enumerate(texts):
            try:
                data = yaml.safe_load(text) if text is not None else None
            except Exception:
                data = None
            if isinstance(data, dict):
                return i, json.dumps(data, default=str)
        return None, None

    for pdf in batches:
        found = [load(t) for t in pdf["__c"]]
        yield pdf.drop(columns=["__c"]).assign(
            __at=pd.array([f[0] for f in found], dtype="Int32"), __yaml=[f[1] for f in found]
        )


def parse_yaml_answers(responses: DataFrame, doc: str = "doc", raw: str = "raw") -> DataFrame:
    """``(doc, json, stage, success, error)`` per response; failures stay in the table as dead letters."""
    source = responses.select(F.col(doc).alias("doc"), F.coalesce(raw, F.lit("")).alias("raw"))
    # reading costs far more than the bytes of an answer tell: a small file must not be left to one task
    tasks = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = source.repartition(tasks).withColumn("__c", F.array(*yaml_candidates(F.col("raw"))))
    loaded = staged.mapInPandas(_load_first, "doc string, raw string, __at int, __yaml string")
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", r"```json\s*", ""), r"```\s*", ""))
    as_json = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    empty = F.trim(F.col("raw")) == ""
    unread = ~empty & F.col("__at").isNull()  # only these need the last stages
    as_json = F.when(unread & _is_object(as_json), as_json)
    last = F.when(unread, regex_trends(F.col("raw")))
    names = F.array(*[F.lit(s) for s in YAML_STAGES])
    at = (
        F.when(empty, F.lit(None).cast("int"))
        .when(F.col("__at").isNotNull(), F.col("__at"))
        .when(as_json.isNotNull(), 6)
        .when(last.isNotNull(), 7)
    )
    picked = loaded.withColumns({"__stage": at, "__json": as_json, "__last": last})
    text = (
        F.when(F.col("__stage") <= 5, F.col("__yaml"))
        .when(F.col("__stage") == 6, F.col("__json"))
        .when(F.col("__stage") == 7, F.col("__last"))
    )
    return picked.select(
        "doc",
        text.alias("json"),
        F.try_element_at(names, F.col("__stage") + 1).alias("stage"),
        F.col("__stage").isNotNull().alias("success"),
        F.when(empty, "Empty input").when(F.col("__stage").isNull(), F.concat(
            F.lit("all stages failed: "), F.col("raw"))).alias("error"),
    )


def trends_of(parsed: DataFrame) -> DataFrame:
    """Trend rows of parsed answers; a segment given as text becomes a one-entry map."""
    items = F.try_variant_get(F.try_parse_json(F.col("json")), "$.trends", "array<variant>")
    rows = parsed.where("success").select("doc", F.explode(items).alias("t"))

    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("t"), f"$.{path}", kind)

    segment = F.coalesce(
        get("segment", "map<string,string>"), F.when(get("segment").isNotNull(), F.create_map(F.lit("segment"), get("segment")))
    )
    names = ["signal_type", "direction", "metric_name", "benchmark_comparison", "confidence", "evidence_summary"]
    return rows.select(
        "doc", get("rank", "int").alias("rank"), get("trend_title").alias("trend_title"), segment.alias("segment"),
        get("metric_value", "double").alias("metric_value"), *[get(n).alias(n) for n in names],
    )


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Answers that no stage could read; the error holds the whole answer."""
    return parsed.where(~F.col("success")).select("doc", "error")
