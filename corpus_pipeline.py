"""A corpus pipeline over ``documents``: five stages, each of which calls one operator of the subpackage ``llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written before the next stage
reads it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import bpe, jaccard, language_id, mixing, secrets
from clientele.llm.common import on_row, small, table, with_row_key, without_row_key
from clientele.operators.ordering import settled

#: Least score of a language; real prose in a known language scores well above.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those near to no language's profile, go.

    Profiles are learned from the labelled documents that are not held out; the label of a document
    plays no part in its own decision. Without any label nothing can be identified and all go.
    """
    judged = language_id.language_id(docs)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document with the smallest id stays; texts without words all stay."""
    rows = with_row_key(docs, "doc_id")
    members, _ = jaccard.jaccard_join(rows, also=["__h", "__copy"])
    gone = settled(members.where(~F.col("is_first")).select("doc_id", "__h", "__copy"))
    return without_row_key(on_row(rows, small(gone), "doc_id", "left_anti")).select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes ``<secret>``; ``n_chars`` follows; all documents stay."""
    found = secrets.scan(docs.select(*docs.columns))
    hit = F.size("found") > 0
    text = F.when(hit, secrets.masked(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.when(hit, F.char_length(text)).otherwise(F.col("n_chars")).cast("long")}
    return found.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; those it does not take go."""
    rows = with_row_key(docs, "doc_id")
    times = mixing.mix(rows, also=["__h", "__copy"]).where("times > 0").select("doc_id", "__h", "__copy", "times")
    taken = on_row(rows, times, "doc_id", "inner")
    return without_row_key(taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("times"))))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their packed token ids, the number of tokens and the text the ids decode to."""
    return bpe.encode_decode(docs).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("secret_scan", secrets_masked),
    ("source_mixing", mixed_sources),
    ("bpe", tokens),
]

#: SQL cannot express byte-pair encoding; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result kept as Parquet before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
