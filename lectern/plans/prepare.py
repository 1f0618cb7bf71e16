"""Whole preparation jobs: from books to spoken chunks, by language and provider."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import cleaning, markup, numbers, russian, segment
from lectern.sources import bundled

#: A provider's columns: its name, what it wants, and its most bytes a chunk.
PROVIDERS = "provider string, speaks_markup boolean, normalize_numbers boolean, transliterate boolean, stress boolean, max_chunk long"


@dataclass(frozen=True)
class Options:
    """Steps of a job where no provider says otherwise; the most bytes a chunk, and the least that a chunk is merged below."""

    rules: tuple = bundled.RULES
    nouns: tuple | DataFrame = bundled.NOUNS
    speaks_markup: bool = False
    spell_numbers: bool = True
    transliterate: bool = False
    stress: bool = False
    separators: bool = True
    pauses: markup.Pauses = markup.Pauses(sentence=400, paragraph=700)
    most: int = 4000
    least: int = 100


def _wanted(df: DataFrame, o: Options, providers: DataFrame | None) -> DataFrame:
    """Adds _lang (empty: en) and a row's provider's wishes; without a known provider the options count."""
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("en")) if "lang" in df.columns else F.lit("en")
    wishes = {"speaks_markup": o.speaks_markup, "normalize_numbers": o.spell_numbers, "transliterate": o.transliterate, "stress": o.stress, "max_chunk": o.most}
    named = df.withColumn("_lang", F.when(cleaning.is_russian(lang), "ru").otherwise(F.lower(lang)))
    if providers is None:
        return named.withColumns({f"_{k}": F.lit(v) for k, v in wishes.items()})
    theirs = providers.select(F.col("provider").alias("_provider"), *(F.col(k).alias(f"_{k}") for k in wishes))
    # a few rows that go to the texts: by provider, all texts would meet in as many tasks as there are providers
    joined = named.join(F.broadcast(theirs), F.col("provider") == F.col("_provider"), "left").drop("_provider")
    return joined.withColumns({f"_{k}": F.coalesce(f"_{k}", F.lit(v)) for k, v in wishes.items()})


def with_spoken_numbers(df: DataFrame, col: str, lang: Column, nouns) -> DataFrame:
    """Texts with Roman numerals, then numbers in words, each by its language; where lang is null a text stays.

    A list of English nouns is part of the expressions, a table is joined with the words beside the
    numbers. Languages without words of their own get English ones.
    """
    text, known = F.col(col), F.col("_known")
    english = F.when(lang == "en", text)
    if isinstance(nouns, DataFrame):
        out = numbers.known_words(df, col, numbers.words_beside_romans(english), nouns)
        out = out.withColumn(col, F.when(lang == "en", numbers.romans_in_words_en(text, known)).otherwise(text)).drop("_known")
        out = numbers.known_words(out, col, numbers.words_before_numbers(english), nouns, form="o")
        ordinal: list[str] | Column = known
    else:
        forms = numbers.noun_forms(nouns, "en")
        out = df.withColumn(col, F.when(lang == "en", numbers.romans_in_words_en(text, sorted(forms))).otherwise(text))
        ordinal = sorted(w for w, (_, form) in forms.items() if form == "o")
    said = F.when(lang == "ru", russian.numbers_in_words_ru(nouns)(F.when(lang == "ru", text))).when(lang == "en", numbers.numbers_in_words_en(text, ordinal))
    return out.withColumn(col, said.when(lang.isNotNull(), numbers.numbers_in_words_en(text, [])).otherwise(text)).select(*df.columns)


def normalize_numbers(df: DataFrame, col: str = "text", lang_col: str = "lang", nouns=bundled.NOUNS) -> DataFrame:
    """Numbers of texts in words, each by its language."""
    return with_spoken_numbers(df, col, F.lower(F.coalesce(F.col(lang_col), F.lit("en"))), nouns)


def prepare_corpus(df: DataFrame, options: Options | None = None, providers: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Cleaning and rules, numbers, transliteration, stress, separators, in this order, by each row's language.

    df: doc_id, text, and lang and provider if it has them. Rules are those of the language, with
    their markup if the provider speaks it; Latin words and stress are for Russian alone.
    lexicon: (sentence, stressed).
    """
    o = options or Options()
    lang, text = F.col("_lang"), F.col("text")
    out = cleaning.clean_text(_wanted(df, o, providers))
    plain = cleaning.with_rules(text, o.rules, lang)
    if providers is not None or o.speaks_markup:
        plain = F.when(F.col("_speaks_markup"), cleaning.with_rules(text, o.rules, lang, markup=True)).otherwise(plain)
    out = out.withColumn("text", plain)
    if providers is not None or o.spell_numbers:
        out = with_spoken_numbers(out, "text", F.when(F.col("_normalize_numbers"), lang), o.nouns)
    if providers is not None or o.transliterate:
        out = out.withColumn("text", F.when(F.col("_transliterate") & (lang == "ru"), cleaning.transliterated_text(text)).otherwise(text))
    if lexicon is not None:
        stressed = segment.sentences_lossless(out.where(F.col("_stress") & (lang == "ru")))
        out = cleaning.stress_texts(out, stressed, lexicon)
    out = out.drop("_lang", "_speaks_markup", "_normalize_numbers", "_transliterate", "_stress", "_max_chunk")
    return segment.mark_separators(out) if o.separators else out


def chunk_job(df: DataFrame, options: Options | None = None, providers: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_no, chunk): pauses, then chunks of the provider's size, merged, without silent ones, each wrapped for speech.

    With providers only those that speak markup get pauses and a wrapper.
    """
    o = options or Options()
    named = _wanted(df, o, providers)
    speaks = F.col("_speaks_markup") if providers is not None else F.lit(True)
    spoken = named.withColumn("_speaks_markup", speaks).withColumn("text", F.when(F.col("_speaks_markup"), markup.with_breaks(F.col("text"), o.pauses)).otherwise(F.col("text")))
    more = ("_lang", "_speaks_markup", "_max_chunk")
    merged = segment.numbered(segment.merge_lists(segment.chunk_lists(spoken, "sentence", F.col("_max_chunk"), carry=more), o.least), more)
    heard = segment.drop_silent_chunks(merged, F.col("_lang") if providers is not None else F.lit(""))
    wrapped = F.when(F.col("_speaks_markup"), F.concat(F.lit("<speak>"), "chunk", F.lit("</speak>"))).otherwise(F.col("chunk"))
    return heard.select("doc_id", "chunk_no", wrapped.alias("chunk"))
