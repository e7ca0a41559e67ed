import random

import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from clientele.llm import bpe
from tests.llm.data import rows, table


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_path())


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def random_texts():
    rnd = random.Random(2)
    pool = "abc ABCé\n\t'sΣσİıß中文字😀👍🏽123²½٣　\x1c\x85'll don't re've  <|endoftext|><|startoftext|>|<>!?#$%&&*é가à"
    for _ in range(800):
        yield "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60)))
    for high in (0x36F, 0xD7FF):
        for _ in range(400):
            yield "".join(chr(rnd.randint(1, high)) for _ in range(30))


def test_ids_and_text_equal_the_library(library, codec):
    for text in [*random_texts(), *[r[1] or "" for r in rows()]]:
        theirs = library.encode(text, add_special_tokens=False)
        assert ids(codec.encode(text)) == theirs.ids
        assert codec.decode(codec.encode(text)) == library.decode(theirs.ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_spans_them(codec):
    assert codec.cuts(b"the") == []
    cuts = [n for text in random_texts() for n in codec.cuts(text.encode())]
    assert cuts
    raw = "zq#é".encode()
    edges = [0, *codec.cuts(raw), len(raw)]
    whole = codec._encode_fragment((raw, True))
    assert whole == b"".join(codec._encode_fragment((raw[a:b], b == len(raw))) for a, b in zip(edges, edges[1:]))


def test_a_full_cache_starts_anew(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    small = bpe.Codec(bpe.default_path())
    text = "some words repeat and some words do not repeat"
    assert small.encode(text) == codec.encode(text)
    assert len(small.words) <= 3


def test_long_words(library, codec):
    rnd = random.Random(3)
    for word in ["a" * 3000, "ab" * 700, "".join(rnd.choice("abcdeth") for _ in range(5000)), "é" * 500, "!" * 999 + "?" * 50]:
        assert ids(codec.encode(word)) == library.encode(word, add_special_tokens=False).ids
    assert len(codec.encode("x" * 300_000)) > 0


def test_tables(spark, library):
    got = bpe.decode(bpe.encode(table(spark))).collect()
    assert len(got) == len(rows())
    for r in got:
        theirs = library.encode(r.text or "", add_special_tokens=False).ids
        assert ids(r.ids) == theirs
        assert r.decoded == library.decode(theirs, skip_special_tokens=False)
    assert bpe.encode(table(spark, [])).collect() == []
    once = bpe.encode_decode(table(spark)).select("ids", "decoded")
    assert sorted(map(tuple, once.collect())) == sorted((r.ids, r.decoded) for r in got)
    clash = bpe.encode(table(spark).withColumnRenamed("key", "ids"))
    assert dict(clash.dtypes)["ids"] == "binary"
