"""Steps over whole texts: in time that grows with the text, and equal to their plain definitions on odd texts."""

import random
import time

from pyspark.sql import functions as F

from lectern.functions.text import BLANKS, go_trim, replace_all
from lectern.operators import cleaning, markup, numbers, segment
from lectern.plans import prepare

BLANK = "[\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
HELD = "\ue000"


def odd_texts(n: int, parts: list[str], most: int = 14, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", None, *("".join(rng.choices(parts, k=rng.randint(1, most))) for _ in range(n))]


def both(spark, values, new, plain):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", new(F.col("v")).alias("new"), plain(F.col("v")).alias("plain")).collect()
    assert [(r.v, r.new) for r in rows] == [(r.v, r.plain) for r in rows]


def plain_trim(x):
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+\\z", "")


def plain_sentences(x):
    close = F.regexp_replace(x, r"(?<=\p{Lu}\.) *(?=\p{Lu}\.)", "")
    held = F.regexp_replace(F.regexp_replace(close, r"(?<=\p{Lu})\.(?=\p{Lu}\.)", HELD), rf"(?<={HELD}\p{{Lu}})\.", HELD)
    parts = F.split(held, f"(?<={segment.ENDS})[\\t\\n\\f\\r ]+")
    return F.filter(F.transform(parts, lambda s: plain_trim(F.translate(s, HELD, "."))), lambda s: s != "")


def test_long_runs_of_blanks(spark):
    blank = 60_000
    df = spark.range(4).select("id", F.concat(F.lit(" a"), F.repeat(F.lit("\u2003"), blank), F.lit("b\n")).alias("text"))
    began = time.time()
    assert df.where(F.length(go_trim(F.col("text"))) == blank + 2).count() == 4
    spoken = markup.wrap_speak(df, markup.Pauses(sentence=400, paragraph=700))
    assert spoken.where(F.length("text") == blank + 2 + len("<speak></speak>")).count() == 4
    assert time.time() - began < 10


def test_trimming(spark):
    both(spark, odd_texts(400, [*BLANKS, "a", "é", "\u200b", "\x1c", "😀"], 6), go_trim, plain_trim)


def test_sentences_of_initials(spark):
    values = odd_texts(1500, ["A", ".", ".", " ", "Щ.", "É. ", "b", "?", "! ", "\n", "\t", "\u2003", "…", "؟ ", HELD, "A.B.", "Mr. "])
    both(spark, [*values, "Vitamin A. The B. C. D. E. end. F"], segment.sentence_list, plain_sentences)
    lines = lambda x: F.filter(F.transform(F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n+"), plain_trim), lambda p: p != "")
    both(spark, odd_texts(400, ["\n", "\r\n", "\r", " ", "a", "\u2003", "b c"]), segment.paragraph_list, lines)


def plain_clean(x):
    c = cleaning
    kept = F.translate(x, c.BLANKS + "".join(a for a, _ in c.SINGLES) + c.GONE, " " * len(c.BLANKS) + "".join(b for _, b in c.SINGLES))
    out = F.regexp_replace(replace_all(kept, c.WORDS), r"\.{4,}", "...")
    out = F.regexp_replace(out, r"[\p{Cc}&&[^\n\r\t]]|\p{Co}", " ")
    out = replace_all(out, (("\r\n", "\n"), ("\r", "\n")))
    for pattern, new in ((r"\n[\t\n\f ]*\n", "\n\n"), ("[ \t]+", " "), ("(?md)^ +| +$", ""), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return plain_trim(out)


def test_clean_is_its_steps_one_by_one(spark):
    """Alone each character that means something, then all of them in odd company."""
    own = sorted({*cleaning.GONE, *cleaning.BLANKS, *(a for a, _ in cleaning.SINGLES + cleaning.WORDS), *map(chr, range(161)), "\u2028", "\ue000", "\uf8ff", "\U000f0000", "\U0010fffd", "\U0001f600"})
    white = ["\n", "\n", " ", " ", "\t", "\r", "\r\n", "\f", "a", ".", ".."]
    both(spark, [*(f"a{c}b .{c}. \n{c} {c}\n" for c in own), *odd_texts(800, white, 16), *odd_texts(1200, [*own, *white * 12], 24)], cleaning.clean, plain_clean)


def test_separator_lines(spark):
    plain = "|".join(f"(?:{p})" for p in segment.SEPARATORS).replace("[.\\s]", "[.\\t\\n\\f\\r ]").replace("\\s*", "[\\t\\n\\f\\r ]*").replace("$", "\\z")
    values = odd_texts(1500, ["*", "*", "* * *", "-", "---", "_", "___", "=", " ", "\t", "\n", ".", "#", "\u2022", "\u25cb", "a"], 6)
    both(spark, values, segment.is_separator, lambda x: F.regexp_like(x, F.lit(plain)))
    both(spark, ["ab", "b", "cab"], lambda x: segment.is_separator(x, ("^a|b$",)), lambda x: F.regexp_like(x, F.lit("^a|b\\z")))


def test_words_around_numbers(spark):
    before = r"([\p{L}'-]+)[\t\n\x0B\f\r \x85\xA0]*\z"
    values = odd_texts(1000, ["a", "\u0429", "'", "-", " ", "\xa0", "\t", "\n", "\u2003", "1", "."], 8)
    both(spark, values, numbers._word_before, lambda x: F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), before, 1)))
    mixed = odd_texts(1000, ["-", "7", "12", "a", "\u0429", " ", "I", "XIV", "_", "."], 8)
    both(spark, mixed, lambda x: F.split(numbers._open_hyphens(x), numbers._NUMBER_EDGE), lambda x: F.split(F.regexp_replace(x, r"(?<=\p{L})-(?=[0-9])", " "), "(?=-[0-9])|(?<![0-9-])(?=[0-9])|(?<=[0-9])(?![0-9])"))
    both(spark, mixed, lambda x: F.regexp_replace(x, numbers.ROMAN, "<$1>"), lambda x: F.regexp_replace(x, r"(?<![A-Za-z0-9_])([IVXLCDM]+)(?![A-Za-z0-9_])", "<$1>"))


def test_a_long_line_before_a_number_is_left_alone(spark):
    """The word before a number was looked for at each place of all that stands before it."""
    df = spark.range(4).select("id", F.concat(F.repeat(F.lit("ab"), 30_000), F.lit(" . 7")).alias("text"))
    began = time.time()
    assert df.where(F.length(numbers.numbers_in_words_en(F.col("text"), ["chapter"])) == 60_008).count() == 4
    assert time.time() - began < 10


def test_chunks_with_long_runs_of_blanks(spark):
    blank = 60_000
    df = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.lit("One. a"), F.repeat(F.lit(" "), blank), F.lit("b. Two")).alias("text"))
    began = time.time()
    rows = segment.chunk_lists(df, "sentence", 1_000_000).collect()
    assert [[len(c) for c in r.chunks] for r in rows] == [[4, blank + 3, 3]] * 4
    assert time.time() - began < 10


def test_a_providers_texts_stay_in_their_tasks(spark):
    """Providers are few, so texts that were dealt out by theirs would be in as few tasks."""
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 50 < 49, "cloud").when(F.col("id") < 200, "other").alias("provider"), F.lit("One. Two.").alias("text"))
    wishes = spark.createDataFrame([("cloud", True, False, False, False, 4000), ("hosted", True, False, False, False, 900)], prepare.PROVIDERS)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 200)
        rows = prepare.chunk_job(df, providers=wishes).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert sorted((r.doc_id, r.chunk) for r in rows) == [(i, '<speak>One. <break time="400ms"/> Two.</speak>' if i % 50 < 49 else "One. Two.") for i in range(400)]
    assert len({r.task for r in rows}) == 8
