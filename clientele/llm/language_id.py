"""Language identification by rank-order profiles.

Each language has a profile: its most frequent character n-grams in rank order. A document is
reduced to the same kind of ranking, and the out-of-place distance to a profile is the sum, over the
document's n-grams, of how far each stands from its place there (the profile's size if it is absent).
The language with the smallest distance wins.

N-grams have 1 to 3 letters and run over words padded with one blank; letters are lower-cased, and
everything that is not a letter separates words. Profiles come from all training rows: tasks sum
n-grams per batch, Spark adds the sums up, and only ``size`` rows per language are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientele.llm.common import giving_back, map_texts, small_batches
from clientele.operators.ordering import top_rows

PROFILE = 400
UNKNOWN = "und"
BITS = 21  # of a code point; three fit into 63 bits
# one profile is a few kilobytes; a label column with more values than this holds something else
MOST_LANGUAGES = 2000

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text, with repeats; empty if it has no letter.

    A code holds up to three code points; the word edge is code 1, so grams of any length differ.
    """
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[1], np.where(letter, points, 1), [1]])
    points = points[np.concatenate([[True], (points[1:] != 1) | (points[:-1] != 1)])]
    two = (points[:-1] << BITS) | points[1:]
    three = (two[:-1] << BITS) | points[2:]
    return np.concatenate([points[points != 1], two, three])


def ranking(text: str | None, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first; ties by code."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:size]]


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, rank, gram)`` of every language in the labelled rows; rows without label or letters give nothing."""
    rows = small_batches(labelled).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        for batch in batches:
            parts: dict[str, list] = {}
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = parts.setdefault(label, [])
                own.append(np.unique(ngrams(value), return_counts=True))
                if len(own) == 64:
                    parts[label] = [summed(own)]
            for label, own in parts.items():
                grams, counts = summed(own)
                if len(grams):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])

    sums = rows.mapInArrow(giving_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = top_rows(sums, ["lang"], [F.desc("n"), F.col("gram")], size, "rank")
    return best.select("lang", "rank", "gram")


def collected(profile_rows: DataFrame, size: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted known grams, and the rank of each gram per language (``size`` if absent).

    At most ``size`` rows per language reach the driver; more than 2,000 languages are refused.
    """
    rows = profile_rows.limit(MOST_LANGUAGES * size + 1).toPandas()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(rows["lang"].unique())
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(grams)), size, np.int32)
    place = {x: i for i, x in enumerate(langs)}
    at = rows["lang"].map(place).to_numpy(np.int64)
    ranks[at, np.searchsorted(grams, rows["gram"])] = rows["rank"] - 1
    return langs, grams, ranks


def identify(df: DataFrame, profile_rows: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """All columns of ``df`` plus ``lang_pred`` and ``score``.

    ``score`` is 1 minus the distance over the largest possible distance. Null texts, texts without a
    letter, and any text if no profile exists get ``und`` and 0; equal distances go to the language
    that sorts first. Very long texts are used whole; repeated rows get equal answers.
    """
    langs, grams, ranks = collected(profile_rows, size)

    def make():
        def work(texts: list) -> list[tuple]:
            out = []
            for value in texts:
                own = ranking(value, size)
                if not len(own) or not langs:
                    out.append((UNKNOWN, 0.0))
                    continue
                at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                known = grams[at] == own
                place = np.arange(len(own))
                away = np.where(known, np.abs(ranks[:, at] - place), size)
                # a gram the profile lacks counts as the whole size
                away = np.where(ranks[:, at] == size, size, away).sum(axis=1)
                best = int(np.argmin(away))
                out.append((langs[best], 1.0 - float(away[best]) / (size * len(own))))
            return out

        return work

    return map_texts(df, text, make, ("lang_pred", T.StringType()), ("score", T.DoubleType()))


def held_out(key: Column | str) -> Column:
    """Rows that no profile may learn from: CRC-32 of the key as text leaves 0 by 5. A null key is held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_id(documents: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict for every row; keeps all columns."""
    return identify(documents, profiles(documents.where(~held_out("doc_id"))))
