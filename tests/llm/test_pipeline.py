import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P
from pyspark.sql import functions as F
from tests.llm.data import SCHEMA, prose, rows, table
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_secrets import EXACT
from tokenizers import Tokenizer

from clientele.llm import bpe


def corpus():
    rnd = random.Random(8)
    made = []
    for i in range(90):
        lang = ("en", "de")[i % 2]
        text = prose(rnd, rnd.randint(5, 60), lang)
        if i % 9 == 4:
            text = made[i // 2][1] + " end"
        if i % 10 == 3:
            text += " password = abcdefghijkl99"
        if i % 30 == 7:
            text = "1234 !! ?? 5678"
        made.append((i, text, lang, f"s{i % 3}", len(text), None, None, None, None))
    return made


def stage(name):
    return dict(P.STAGES)[name]


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_join", "secret_scan", "source_mixing", "bpe"]


@pytest.mark.parametrize("name", ["language_id", "jaccard_join", "secret_scan", "source_mixing"])
def test_stages_keep_the_columns_and_take_awkward_rows(spark, name):
    for made in (rows(), []):
        docs = table(spark, made)
        out = stage(name)(spark, docs, "")
        assert out.columns == docs.columns
        assert out.count() >= 0


def test_language_stage_drops_what_has_no_letters(spark):
    made = corpus()
    out = collected(stage("language_id")(spark, spark.createDataFrame(made, SCHEMA), ""))
    assert out == sorted((r for r in made if "1234" not in r[1]), key=str)


def test_group_stage_keeps_one_of_each_group(spark):
    made = corpus()
    lows = {(k, low) for k, _, low in brute_components(made)}
    out = stage("jaccard_join")(spark, spark.createDataFrame(made, SCHEMA), "")
    assert {r.doc_id for r in out.collect()} == {k for k, low in lows if k == low}
    again = stage("jaccard_join")(spark, spark.createDataFrame([made[0], made[0], made[1]], SCHEMA), "")
    assert again.count() == 2


def test_secret_stage_masks_and_keeps_all(spark):
    import re

    made = corpus()
    out = {r.doc_id: r for r in stage("secret_scan")(spark, spark.createDataFrame(made, SCHEMA), "").collect()}
    pattern = EXACT["assign"][0]
    for r in made:
        want = re.sub(pattern, lambda m: "<secret>" if len(m[2]) >= 12 else m[0], r[1])
        assert (out[r[0]].text, out[r[0]].n_chars) == (want, len(want))


def test_mixing_stage_repeats_what_is_taken(spark):
    made = corpus()
    taken = {k: (n, t) for k, n, _, _, t in brute_mix(made)}
    out = stage("source_mixing")(spark, spark.createDataFrame(made, SCHEMA), "")
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {k: t // n for k, (n, t) in taken.items() if t}


def test_run_equals_the_stages_by_brute_force(spark, tmp_path):
    made = corpus()
    spark.createDataFrame(made, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path))
    library = Tokenizer.from_file(bpe.default_path())
    kept = [r for r in made if "1234" not in r[1]]
    firsts = {k for k, _, low in brute_components(kept) if k == low}
    import re

    masked = [(r[0], re.sub(EXACT["assign"][0], "<secret>", r[1]), *r[2:]) for r in kept if r[0] in firsts]
    want = []
    texts = {r[0]: r[1] for r in masked}
    for k, n, _, _, taken in brute_mix(masked):
        ids = library.encode(texts[k], add_special_tokens=False).ids
        want += [(k, texts[k], len(ids), library.decode(ids, skip_special_tokens=False))] * (taken // n if n else 0)
    assert collected(got.select("doc_id", "text", F.col("n_tokens"), "decoded")) == sorted(want, key=str)
