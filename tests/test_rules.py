"""Rules that one scan picks do what all of them, one after the other, do."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import cleaning
from lectern.sources.bundled import ENGLISH_RULES, RULES, RUSSIAN_RULES, Rule

#: Rules that feed each other: what one says is another's literal, whole, in part, beside a group, across a blank.
CHAIN = (
    Rule("aa", "bb cc"),
    Rule("bb", "dd"),
    Rule(r"(\w+)x", "$1 z$1"),
    Rule("zq", "found"),
    Rule("cc dd", "never"),
    Rule(r"(\d+)k", "$1 thousand"),
    Rule("thousand", "grand"),
    Rule(r"n(\d+)", "no$1o"),
    Rule("o1o", "round"),
    Rule("(?i)DD", "ee"),
    Rule("ee|ff", "gg"),
    Rule("gg", "hh"),
)


def one_by_one(text, rules, markup=False):
    out = F.concat(F.lit(" "), text)
    for rule in rules:
        out = cleaning._apply(out, rule, markup)
    return F.substr(out, F.lit(2))


@pytest.mark.parametrize(("rules", "markup"), [(ENGLISH_RULES, False), (RUSSIAN_RULES, False), (RUSSIAN_RULES, True), (RULES, False), (CHAIN, False)])
def test_the_scan_leaves_out_only_rules_that_change_nothing(spark, rules, markup):
    rng = random.Random(len(rules))
    words = [r.pattern.replace(r"\b", "").replace("(?i)", "").replace("\\d+", "12").replace("\\s*", " ").replace("\\", "").replace("(", "").replace(")", "").replace("?", "") for r in rules if r.pattern != "[ \t]+"]
    words += ["aa", "qx", "zqx", "5k", "n1", "1o", "cc", "DD", "Х", "слово", "word", "12", "км", "мВт", "И", "VS.", "the"]
    marks = [" ", " ", "  ", ". ", ",", ")", "\n", "\t", "-", ""]
    rows = [(i, "".join(rng.choice([w, w.lower(), w.upper()]) + rng.choice(marks) for w in rng.choices(words, k=rng.randrange(1, 30)))) for i in range(400)]
    df = spark.createDataFrame([*rows, (-1, ""), (-2, None)], "id long, text string")
    out = df.select("id", "text", cleaning.with_rules(F.col("text"), rules, markup=markup).alias("got"), one_by_one(F.col("text"), rules, markup).alias("want")).collect()
    wrong = [r for r in out if r.got != r.want]
    assert not wrong, wrong[:2]
    assert sum(r.got != r.text for r in out) > 100


def test_languages_take_their_own_rules(spark):
    df = spark.createDataFrame([("en", "Mr. X and 5 кг"), ("ru", "Mr. X and 5 кг"), ("", "Mr. X and 5 кг"), ("fr", "Mr. X and 5 кг")], "lang string, text string")
    got = {r.lang: r.t for r in df.select("lang", cleaning.with_rules(F.col("text"), RULES, F.col("lang")).alias("t")).collect()}
    assert got == {"en": "Mister X and 5 кг", "ru": "Mr. X and 5 килограммов ", "": "Mister X and 5 килограммов ", "fr": "Mr. X and 5 кг"}


def test_required_literals():
    assert [cleaning.required(p) for p in (r"\bMr\.", r"(?i)\bapi\b", r"(\d+)\s*км/ч", "[ \t]+", "a|b", "ab?c")] == ["Mr.", "", "км/ч", "", "", "a"]
