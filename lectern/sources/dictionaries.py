"""Noun dictionaries and pronunciation rules from text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.folders import kept
from lectern.functions.text import go_trim
from lectern.sources.bundled import NOUNS, Noun, Rule


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of lines that are neither blank nor comments, numbered by file, block and place through all of a path's files.

    Each task reads its blocks; what meets in one place is a count for each block.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    own = kept(spark.read.text(path, lineSep="\n").select("value", *at, F.monotonically_increasing_id().alias("at")), "lines")
    blocks = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"))
    rows = own.join(F.broadcast(starts), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line_no"), go_trim(F.col("value")).alias("line"))
    return rows.where("line <> '' AND NOT startswith(line, '#')")


def parse_nouns(lines: DataFrame, lang: str) -> DataFrame:
    """(lang, noun, gender, form, singular, plurals): five comma fields, no quoting; the last of equal nouns counts.

    A gender other than m, f, n is m, a form other than o, c is c.
    """
    part = F.transform(F.split("line", ","), go_trim)
    rows = lines.withColumn("p", part).where(F.size("p") >= 5)
    gender = F.when(F.get("p", F.lit(1)).isin("m", "f", "n"), F.get("p", F.lit(1))).otherwise("m")
    form = F.when(F.get("p", F.lit(2)).isin("o", "c"), F.get("p", F.lit(2))).otherwise("c")
    plurals = F.filter(F.transform(F.split(F.get("p", F.lit(4)), "\\|"), go_trim), lambda x: x != "")
    named = rows.select("line_no", F.get("p", F.lit(0)).alias("noun"), gender.alias("gender"), form.alias("form"), F.get("p", F.lit(3)).alias("singular"), plurals.alias("plurals"))
    last = named.groupBy(F.lower("singular").alias("key")).agg(F.max_by(F.struct("noun", "gender", "form", "singular", "plurals"), "line_no").alias("n"))
    return last.select(F.lit(lang).alias("lang"), "n.*")


def load_nouns(spark: SparkSession, path: str, lang: str) -> DataFrame:
    return parse_nouns(text_lines(spark, path), lang)


def parse_rules(lines: DataFrame, lang: str) -> DataFrame:
    """(rule_no, lang, pattern, plain, markup, comment) of quoted CSV lines of four fields or more."""
    parsed = F.from_csv("line", F.lit("pattern string, plain string, markup string, comment string"), {"escape": '"', "mode": "PERMISSIVE"})
    rows = lines.withColumn("r", parsed).where("r.comment IS NOT NULL")
    return rows.select(F.col("line_no").alias("rule_no"), F.lit(lang).alias("lang"), "r.*").fillna("", ["plain", "markup"])


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that runs rules takes a pattern."""
    try:
        spark.sql("SELECT regexp_like('', :p)", {"p": pattern}).collect()
    except Exception:  # the pattern's own error, of a class that depends on where it is found
        return False
    return True


def rules_of(rules: DataFrame) -> list[Rule]:
    """Rules with their language and markup in file order, without those whose pattern doesn't compile; at most hundreds."""
    rows = rules.orderBy("rule_no").select("pattern", "plain", "markup", "lang").collect()
    return [Rule(*r) for r in rows if compiles(rules.sparkSession, r["pattern"])]


def load_rules(spark: SparkSession, path: str, lang: str) -> list[tuple[str, str]]:
    """(pattern, replacement) in file order, without patterns that don't compile; a file holds at most hundreds."""
    return [(r.pattern, r.plain) for r in load_rule_set(spark, path, lang)]


def load_rule_set(spark: SparkSession, path: str, lang: str) -> list[Rule]:
    """A file's rules as apply_rules() takes them, with their markup."""
    return rules_of(parse_rules(text_lines(spark, path), lang))


def rule_language(plain: Column, markup: Column) -> Column:
    """ru if either replacement has a Cyrillic letter, else en."""
    return F.when(F.regexp_like(F.concat_ws(" ", plain, markup), F.lit("[Ѐ-ԯ]")), "ru").otherwise("en")


def infer_rule_languages(rules: DataFrame) -> DataFrame:
    """The language of each pattern; the last of equal patterns decides."""
    return rules.groupBy("pattern").agg(F.max_by(rule_language(F.col("plain"), F.col("markup")), "rule_no").alias("lang"))


def noun_table(spark: SparkSession, nouns: tuple[Noun, ...] = NOUNS) -> DataFrame:
    """A list of nouns as a table for joins."""
    return spark.createDataFrame([(*n[:5], list(n.plurals)) for n in nouns], "lang string, noun string, gender string, form string, singular string, plurals array<string>")


def overlay_nouns(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom nouns and those defaults that none shadows, by language and small letters."""
    key = lambda t: (F.col(f"{t}.lang") == F.col("c.lang")) & (F.lower(f"{t}.noun") == F.lower("c.noun"))
    return defaults.alias("d").join(custom.alias("c"), key("d"), "left_anti").unionByName(custom)
