"""Counted features are those that the texts' columns give, hashed and counted text by text."""

from collections import Counter

from pyspark.sql import functions as F

from evidra.functions import hashes as H
from evidra.functions import text as T
from evidra.operators import baselines as B

TEXTS = ["The thing, the Thing.", "ÀB ab\t\n c 12x", "", "é", "ab", None, "x" * 40, "naïve 𝒳y İstanbul Kelvin", "  a  b  "]


def _rows(spark):
    return spark.createDataFrame([(i, "d%d" % (i % 2), "l%d" % (i % 3), t) for i, t in enumerate(TEXTS)], "case_id long, domain string, label string, text string")


def test_counts_are_those_of_the_columns(spark):
    flat = T.norm_chars(F.col("text"))
    grams = F.coalesce(F.flatten(F.array(*(T.char_ngrams(flat, n) for n in (3, 4, 5)))), F.array().cast("array<string>"))
    for chars, column in ((None, T.tokens(F.col("text"))), ((3, 5), grams)):
        want = {}
        for r in _rows(spark).select("case_id", F.explode(column).alias("f")).collect():
            want.setdefault(r["case_id"], []).append(r["f"])
        got = {}
        for r in B.TextFit(_rows(spark), chars=chars).counts.collect():
            got.setdefault(r["case_id"], []).append((r["feature"], r["n"]))
        assert {k: sorted(n for _, n in v) for k, v in got.items()} == {k: sorted(Counter(v).values()) for k, v in want.items()}
        # one hash for each feature, whichever text has it
        assert len({f for v in got.values() for f, _ in v}) == len({f for v in want.values() for f in v})


def test_equal_strings_have_equal_hashes():
    assert list(H.words("a bc, a bc")) == list(H.words("a bc")) * 2
    assert list(H.char_grams("abc", 3, 5)) == [H.char_grams("xabc", 3, 3)[1]] * 3
