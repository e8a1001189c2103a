"""Small odd tables shared by the operator tests."""

import random

from pyspark.sql import types as T

# Extra columns whose names clash with columns the operators make.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())] + [
    T.StructField(c, T.StringType()) for c in ("size", "rate", "tag", "fp", "id", "key", "n_words", "__row", "bits", "copies")])

WORDS = {"en": "the of and to in is that it was for on are with".split(),
         "de": "der die und in zu den das nicht von sie ist des sich".split()}


def prose(rng, lang, n):
    own = [f"{w}{rng.choice('abcdefg')}{rng.choice('xyz')}" for w in WORDS[lang]]
    return " ".join(rng.choice(WORDS[lang] + own) for _ in range(n))


def rows():
    """Documents with nulls, empty and very long texts, ties, copies and repeated rows."""
    rng = random.Random(5)
    out = [(i, prose(rng, "en" if i % 2 else "de", rng.randint(8, 60)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[3][1], "en", "s0") for i in range(12)]                 # copies
    out += [out[5], out[5], out[5]]                                              # repeated rows
    near = out[7][1].split()
    out += [(200 + i, " ".join(near[:i] + ["other"] + near[i + 1:]), "en", "s1") for i in range(4)]
    out += [(300, None, "en", "s0"), (301, "", "de", None), (302, " \t\n", None, "s2"), (303, "123 456 !!", "en", None),
            (None, "a row without an id and a few words", "en", None), (None, None, None, None),
            (304, "One.", None, "s2"), (305, prose(rng, "en", 30_000), "en", "s2"), (306, "same line\n" * 9, "en", "s1"),
            (307, "Ä\u00a0b\u2003c\x0bd\x1ce A <|endoftext|> a  b", "de", "s1"), (320, out[20][1] + "\n", "de", "s2")]
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 10) for r in data], DOCS)
