"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, n int, size double"
WORDS = {
    "en": "the of and thing weather station report morning never going house with under which people".split(),
    "de": "der die und nicht wetter bahnhof bericht morgen niemals gehen haus mit unter welche leute".split(),
}


def prose(rnd, n, lang="en"):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "er", "est", "ing"]) for _ in range(n))


def rows(seed=5):
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(3, 120), rnd.choice(["en", "de"])) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " more", prose(rnd, 6000)]
    texts += [texts[3].replace("the", "a", 1), texts[3], "", " \t\n ", None, "one", "one two three four", "one two three four five"]
    texts += ["12 34 !!", "é ß 中文 😀 " * 30, "Ωmega Σίσυφος ﬁ", "a" * 400, "ab" * 300, "x" * 99, "x" * 100, "y" * 100]
    out = []
    for i, t in enumerate(texts):
        lang = None if i % 7 == 3 else ("de" if t and "und" in t else "en")
        source = None if i % 11 == 4 else f"s{i % 4}"
        out.append((i * 3 % 200, t, lang, source, len(t) if t else None, f"k{i}", i, i % 3, 0.5))
    out += [out[5], out[5], out[44]]  # rows repeated as they are
    out += [(out[6][0], "another text under an id that is taken", "en", "s1", 38, None, None, None, None)]
    out += [(None, "a text without an id that has some words", "en", "s2", 40, None, None, None, None)]
    out += [(None, None, None, None, None, None, None, None, None)]
    return out


def table(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)
