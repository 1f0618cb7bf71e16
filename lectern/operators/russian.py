"""Russian numbers in context: inflection, dates, times, suffixes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.numbers import VALUES, noun_forms, russian_gender, russian_words
from lectern.sources.bundled import NOUNS

#: Months in the genitive, words that a genitive date follows, decades that are one word.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
TRIGGERS = "случилось произошло было состоялось началось закончилось завершилось родился родилась родились умер умерла умерли женился вышла до после с от около начиная кроме".split()
DECADES = dict(zip((1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000), "тысячных двухтысячных трёхтысячных четырёхтысячных пятитысячных шеститысячных семитысячных восьмитысячных девятитысячных десятитысячных".split(), strict=True))

#: Endings of nominative ordinals and what they become, by case; the first that fits counts.
FEMININE = {
    "genitive": (("ая", "ой"), ("яя", "ей"), ("ья", "ьей")),
    "dative": (("ая", "ой"), ("яя", "ей")),
    "instrumental": (("ая", "ой"), ("яя", "ей")),
    "prepositional": (("ая", "ой"), ("яя", "ей")),
    "accusative": (("ая", "ую"), ("яя", "юю")),
}
OTHERS = {
    "genitive": (("ий", "ьего"), ("ый", "ого"), ("ой", "ого"), ("ое", "ого")),
    "dative": (("ий", "ьему"), ("ый", "ому"), ("ой", "ому")),
    "instrumental": (("ий", "ьим"), ("ый", "ым"), ("ой", "ым")),
    "prepositional": (("ий", "ьем"), ("ый", "ом"), ("ой", "ом")),
    "accusative": (),
}
PLURAL = (("ый", "ых"), ("ий", "их"), ("ой", "ых"), ("о", "ох"), ("ь", "ых"), ("", "х"))
#: The case that a written suffix asks for, and the gender that it tells.
SUFFIX_CASES = {"го": "genitive", "ого": "genitive", "ему": "dative", "ому": "dative", "ым": "instrumental", "им": "instrumental", "м": "prepositional", "ом": "prepositional"}
SUFFIX_GENDERS = {"f": ("я", "ую", "ая", "ей", "ою"), "n": ("е", "ое")}


def _ending(words: Column, pairs) -> Column:
    if not pairs:
        return words
    out = None
    for old, new in pairs:
        fits, made = F.endswith(words, F.lit(old)), F.concat(F.left(words, F.length(words) - len(old)), F.lit(new))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(words)


def inflect(words: Column, case: str, gender: str) -> Column:
    """The last word of a nominative ordinal in a case."""
    return _ending(words, (FEMININE if gender == "f" else OTHERS).get(case, ()))


BIRTH = re.compile(r"([0-9]+)\s*г\.\s*р\.")
DATES = re.compile(rf"([0-9]+)-([0-9]+)\s+({'|'.join(MONTHS)})")
TIMES = re.compile(r"(?<![A-Za-z0-9_])([0-9]{1,2})[:.]([0-9]{1,2})(?:[:.]([0-9]{1,2}))?(?![A-Za-z0-9_])")
SUFFIXED = re.compile(r"([0-9]+)-(ого|ому|ему|ым|им|ом|ой|ую|ая|ое|ые|ых|го|му|[мйяехюуо])(?!\w)")
NUMBER = re.compile(r"-?[0-9]+")
ROMANS = re.compile(r"(?<![A-Za-z0-9_])[IVXLCDM]+(?![A-Za-z0-9_])")


def _inflected(words: str, pairs) -> str:
    return next((words[: len(words) - len(a)] + b for a, b in pairs if words.endswith(a)), words)


def _genitive(n: int, gender: str) -> str:
    return _inflected(russian_words(n, gender, True), OTHERS["genitive"])


def _suffixed(n: int, suffix: str) -> str:
    if suffix in ("х", "ых"):
        return DECADES.get(n) or _inflected(russian_words(n, "m", True), PLURAL)
    gender = next((g for g, known in SUFFIX_GENDERS.items() if suffix in known), "m")
    case = "accusative" if suffix == "ую" else SUFFIX_CASES.get(suffix)
    return _inflected(russian_words(n, gender, True), (FEMININE if gender == "f" else OTHERS).get(case, ()))


def _roman(numeral: str) -> int | None:
    """The value of a valid numeral, from right to left."""
    if re.search("I{4}|V{4}|X{4}|L{4}|C{4}|D{4}", numeral):
        return None
    total = last = 0
    for c in reversed(numeral):
        total, last = total + (-VALUES[c] if VALUES[c] < last else VALUES[c]), VALUES[c]
    return total


def romans(text: str, nouns: dict[str, tuple[str, str]]) -> str:
    """Roman numerals beside a known noun: in the noun's form after it, as an ordinal before it."""

    def spoken(m: re.Match) -> str:
        value = _roman(m[0])
        before, after = word_before(text, m.start()), word_after(text, m.end())
        if value is None or before not in nouns and after not in nouns:
            return m[0]
        gender, form = nouns[before] if before in nouns else (nouns[after][0], "o")
        return russian_words(value, gender, form == "o")

    return ROMANS.sub(spoken, text)


def preprocess(text: str, nouns: dict[str, tuple[str, str]] | None = None) -> str:
    """Roman numerals, abbreviated years, years of birth, date ranges, times, and numbers with a suffix, in this order."""
    text = romans(text, nouns or {}).replace("гг.", "годов")
    text = BIRTH.sub(lambda m: f"{_genitive(int(m[1]), 'm')} года рождения", text)
    text = DATES.sub(lambda m: f"{_genitive(int(m[1]), 'n')}, тире, {_genitive(int(m[2]), 'n')} {m[3]}", text)
    text = TIMES.sub(lambda m: " ".join(x for x in m.groups() if x), text)
    return SUFFIXED.sub(lambda m: _suffixed(int(m[1]), m[2]), text)


def in_context(n: int, before: str, after: str, nouns: dict[str, tuple[str, str]]) -> str:
    """A number's words by the words beside it; nouns: a noun's form to (gender, o or c)."""
    if before and before not in TRIGGERS and before not in MONTHS and before in nouns:
        gender, form = nouns[before]
        return russian_words(n, gender, form == "o")
    if after in MONTHS:
        return _genitive(n, "n")
    if after in ("год", "года", "году"):
        case = {"год": None, "года": "genitive", "году": "prepositional"}[after]
        return _inflected(russian_words(n, "m", True), OTHERS.get(case, ()))
    return russian_words(n, nouns[after][0] if after in nouns else russian_gender(after) if after else "m")


_AFTER = re.compile(r"\s*([^\W\d_](?:[^\W\d_]|['-])*|['-](?:[^\W\d_]|['-])*)")


_STEM = re.compile(r"(?:[^\W\d_]|['-])*")


def word_before(text: str, at: int) -> str:
    """The word in small letters right before a place, blanks apart; empty if something else stands there."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and (text[start - 1].isalpha() or text[start - 1] in "-'"):
        start -= 1
    return text[start:at].lower()


def word_after(text: str, at: int) -> str:
    """The word in small letters right after a place, blanks apart."""
    m = _AFTER.match(text, at)
    return m[1].lower() if m else ""


def spoken(text: str, nouns: dict[str, tuple[str, str]]) -> str:
    """Numbers in words from right to left: a number's right neighbour may be words already.

    What is behind a number is kept as a list of pieces, so each number costs what stands beside it.
    """
    text = preprocess(text, nouns)
    tail: list[str] = []
    end_of_rest, after = len(text), ""
    for m in reversed(list(NUMBER.finditer(text))):
        start, end, joined = m.start(), m.end(), ""
        if text[start] == "-" and start:
            if text[start - 1].isdigit():
                continue
            if text[start - 1].isalpha():
                start, joined = start + 1, " "
        n = int(text[start:end])
        if not -(1 << 63) <= n < 1 << 63:
            continue
        between = text[end:end_of_rest]
        # the next number's words are the neighbour if only blanks or part of a word stand between
        words = in_context(n, word_before(text, start - len(joined)), word_after(between + after, 0), nouns)
        tail += [between, words, joined]
        end_of_rest, after = start - len(joined), joined + words + _STEM.match(between)[0]
    return text[:end_of_rest] + "".join(reversed(tail))


def normalize_numbers_ru(df: DataFrame, col: str = "text", nouns=NOUNS) -> DataFrame:
    """Numbers in words, by the word before or after them; in Arrow batches, as one replacement changes the next one's context.

    nouns: a dictionary as for numbers.noun_forms(), or its result.
    """
    return df.withColumn(col, numbers_in_words_ru(nouns)(F.col(col)))


def numbers_in_words_ru(nouns=NOUNS):
    """A column function for Russian numbers and numerals; null stays null."""
    known = nouns if isinstance(nouns, dict) else noun_forms(nouns, "ru")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else spoken(t, known))

    return run
