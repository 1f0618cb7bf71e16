"""Numbers and Roman numerals in words, English and Russian."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import let
from lectern.sources.bundled import NOUNS

#: English number words.
EN_BELOW_20 = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
EN_SCALES = ("", " thousand", " million", " billion")
EN_ORDINALS = dict(zip([*EN_BELOW_20, *EN_TENS], "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split(), strict=True))

#: Russian number words.
RU_BELOW_20 = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_OWN = {"m": {}, "f": {1: "одна", 2: "две"}, "n": {1: "одно"}}
RU_TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_SCALES = (("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов"), ("триллион", "триллиона", "триллионов"))
RU_ORDINAL_BELOW_20 = "нулевой первый второй третий четвёртый пятый шестой седьмой восьмой девятый десятый одиннадцатый двенадцатый тринадцатый четырнадцатый пятнадцатый шестнадцатый семнадцатый восемнадцатый девятнадцатый".split()
RU_ORDINAL_TENS = "двадцатый тридцатый сороковой пятидесятый шестидесятый семидесятый восьмидесятый девяностый".split()
RU_ORDINAL_HUNDREDS = "сотый двухсотый трёхсотый четырёхсотый пятисотый шестисотый семисотый восьмисотый девятисотый".split()
RU_ORDINAL_SCALES = "тысячный миллионный миллиардный триллионный".split()


def words(*items: Column) -> Column:
    """Non-empty items joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(x, F.lit("")) for x in items))


def extract_numbers(df: DataFrame, col: str = "text") -> DataFrame:
    """(doc_id, pos, number) of runs of digits, with a minus before, that fit 64 bits."""
    found = F.transform(F.regexp_extract_all(col, F.lit(r"(-?[0-9]+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    rows = df.select("doc_id", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("pos", "number"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "number")


def has_numbers(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[0-9]"))


def _table(names: list[str], at: Column) -> Column:
    """names[at]; the constant is folded into one literal, however long."""
    return F.get(F.split(F.lit("|".join(names)), "\\|"), at.cast("int"))


def _en_name(n: int) -> str:
    """English words of 1 to 99; 0 is empty."""
    return "" if not n else EN_BELOW_20[n] if n < 20 else "-".join([EN_TENS[n // 10 - 2], *([EN_BELOW_20[n % 10]] if n % 10 else [])])


def _en_ordinal_name(n: int) -> str:
    head, last = re.fullmatch("(.*?)([a-z]*)", _en_name(n)).groups()
    return head + EN_ORDINALS.get(last, "")


EN_LOW, EN_LOW_ORDINAL = [_en_name(i) for i in range(100)], [_en_ordinal_name(i) for i in range(100)]
EN_HUNDREDS = ["", *(f"{EN_BELOW_20[i]} hundred" for i in range(1, 10))]


def _hundreds(n: Column, names: list[str]) -> Column:
    return _table(names, F.call_function("div", n, F.lit(100)))


def _group(n: Column, k: int) -> Column:
    return F.call_function("div", n, F.lit(1000**k)) % 1000 if k else n % 1000


def _scaled(n: Column, scale: str) -> Column:
    return F.when(n > 0, F.concat(words(_hundreds(n, EN_HUNDREDS), _table(EN_LOW, n % 100)), F.lit(scale))).otherwise("")


def _en(number: Column, last: list[str], tail: str) -> Column:
    n = F.abs(number)
    high, low = F.call_function("div", n, F.lit(10**12)), n % 1000
    trillions = words(*(_scaled(_group(high, k), EN_SCALES[k]) for k in (2, 1, 0)))
    above = words(F.when(number < 0, "minus").otherwise(""), F.when(high > 0, F.concat(trillions, F.lit(" trillion"))).otherwise(""), *(_scaled(_group(n, k), EN_SCALES[k]) for k in (3, 2, 1)), _hundreds(low, EN_HUNDREDS), _table(last, low % 100))
    return F.when(number == F.lit(-(1 << 63)), number.cast("string")).otherwise(F.concat(above, F.when(low % 100 == 0, tail).otherwise("")))


def cardinal_en(number: Column) -> Column:
    """English words of a 64-bit integer but the smallest, which has no opposite and stays digits."""
    return F.when(number == 0, EN_BELOW_20[0]).otherwise(_en(number, EN_LOW, ""))


def ordinal_en(number: Column) -> Column:
    """As cardinal_en, with the last word an ordinal."""
    return F.when(number == 0, EN_ORDINALS["zero"]).otherwise(_en(number, EN_LOW_ORDINAL, "th"))


def _gendered(name: str, gender: str) -> str:
    """A masculine ordinal in another gender."""
    if gender == "m":
        return name
    if name == "третий":
        return "третья" if gender == "f" else "третье"
    return name[:-2] + ("ая" if gender == "f" else "ое")


def _ru_name(n: int, gender: str) -> str:
    """Russian words of 1 to 99; 0 is empty."""
    small = lambda i: RU_OWN[gender].get(i, RU_BELOW_20[i])
    return "" if not n else small(n) if n < 20 else " ".join([RU_TENS[n // 10 - 2], *([small(n % 10)] if n % 10 else [])])


def _ru_ordinal_name(n: int, gender: str) -> str:
    if not n:
        return ""
    last = RU_ORDINAL_BELOW_20[n] if n < 20 else RU_ORDINAL_BELOW_20[n % 10] if n % 10 else RU_ORDINAL_TENS[n // 10 - 2]
    return " ".join([*([RU_TENS[n // 10 - 2]] if n > 20 and n % 10 else []), _gendered(last, gender)])


def _ru_gender(k: int, gender: str) -> str:
    """The gender of a group's number: thousands are feminine, what is above masculine."""
    return gender if k == 0 else "f" if k == 1 else "m"


def _ru_group(n: Column, k: int, gender: str) -> Column:
    """A group of three digits with its scale; empty for 0."""
    g, own = _group(n, k), _ru_gender(k, gender)
    number = words(_hundreds(g, ["", *RU_HUNDREDS]), _table([_ru_name(i, own) for i in range(100)], g % 100))
    if not k:
        return number
    one, few, many = RU_SCALES[k - 1]
    return F.when(g > 0, words(number, F.when((g % 100).between(11, 14), many).when(g % 10 == 1, one).when((g % 10).between(2, 4), few).otherwise(many))).otherwise("")


def _ru(number: Column, zero: str, *groups: Column) -> Column:
    spoken = words(F.when(number < 0, "минус").otherwise(""), *groups)
    return F.when((number <= -(10**15)) | (number >= 10**15), number.cast("string")).when(number == 0, zero).otherwise(spoken)


def cardinal_ru(number: Column, gender: str = "m") -> Column:
    """Russian words of a number below 10^15; larger ones stay digits. Thousands are feminine."""
    n = F.abs(number)
    return _ru(number, RU_BELOW_20[0], *(_ru_group(n, k, gender) for k in (4, 3, 2, 1, 0)))


def ordinal_ru(number: Column, gender: str = "m") -> Column:
    """As cardinal_ru with the last group that isn't zero inflected."""
    n = F.abs(number)

    def scaled(k: int) -> Column:
        """A group that only zeros follow: its number, if not 1, and the scale's ordinal."""
        g, last = _group(n, k), _gendered(RU_ORDINAL_SCALES[k - 1], gender)
        number = words(_hundreds(g, ["", *RU_HUNDREDS]), _table([_ru_name(i, _ru_gender(k, gender)) for i in range(100)], g % 100))
        alone = F.when(g == 0, "").when(g == 1, last).otherwise(words(number, F.lit(last)))
        return F.when(n % 1000**k == 0, alone).otherwise(_ru_group(n, k, gender))

    low = _group(n, 0)
    hundred = F.when(low % 100 == 0, _hundreds(low, ["", *(_gendered(x, gender) for x in RU_ORDINAL_HUNDREDS)])).otherwise(_hundreds(low, ["", *RU_HUNDREDS]))
    return _ru(number, _gendered(RU_ORDINAL_BELOW_20[0], gender), *map(scaled, (4, 3, 2, 1)), hundred, _table([_ru_ordinal_name(i, gender) for i in range(100)], low % 100))


def russian_words(n: int, gender: str = "m", ordinal: bool = False) -> str:
    """The same for one number, for texts whose numbers depend on each other's words."""
    if abs(n) >= 10**15:
        return str(n)
    sign, n = ("минус " if n < 0 else ""), abs(n)
    if not n:
        return _gendered(RU_ORDINAL_BELOW_20[0], gender) if ordinal else RU_BELOW_20[0]
    groups = [(k, n // 1000**k % 1000) for k in (4, 3, 2, 1, 0) if n // 1000**k % 1000]
    name = lambda g, own: [*([RU_HUNDREDS[g // 100 - 1]] if g >= 100 else []), *([_ru_name(g % 100, own)] if g % 100 else [])]
    out: list[str] = []
    for k, g in groups:
        if ordinal and k == groups[-1][0]:
            if k:
                out += [*(name(g, _ru_gender(k, gender)) if g > 1 else []), _gendered(RU_ORDINAL_SCALES[k - 1], gender)]
            elif g % 100:
                out += [*name(g - g % 100, "m"), _ru_ordinal_name(g % 100, gender)]
            else:
                out.append(_gendered(RU_ORDINAL_HUNDREDS[g // 100 - 1], gender))
        else:
            out += name(g, _ru_gender(k, gender))
            if k:
                one, few, many = RU_SCALES[k - 1]
                out.append(many if 11 <= g % 100 <= 14 else one if g % 10 == 1 else few if 2 <= g % 10 <= 4 else many)
    return sign + " ".join(out)


def russian_gender(word: str) -> str:
    """gender_of() of one word."""
    w = word.lower()
    for pattern, gender in ((r"..*(?<=[оеё])в$|.*ей$", "m"), (r".+[иы]$", "f"), (r"^.[^аеёиоуыэюя]{2}а$", "n"), (r"^.{1,2}[рл]я$", "n"), (r".*[ая]$", "f"), (r".*[оеё]$", "n")):
        if re.search(pattern, w):
            return gender
    return "m"


def gender_of(word: Column) -> Column:
    """The gender that a Russian noun's ending suggests: m, f or n."""
    w = F.lower(F.coalesce(word, F.lit("")))
    n, like = F.length(w), lambda p: F.regexp_like(w, F.lit(p))
    return (
        F.when(n == 0, "m")
        .when((n >= 2) & like("(ов|ев|ёв|ей)$"), "m")
        .when((n >= 2) & like("[иы]$"), "f")
        .when((n == 4) & like("[^аеёиоуыэюя]{2}а$"), "n")
        .when(n.isin(3, 4) & like("[рл]я$"), "n")
        .when(like("[ая]$"), "f")
        .when(like("[оеё]$"), "n")
        .otherwise("m")
    )


ROMAN = r"(?=[IVXLCDM])(?<![A-Za-z0-9_])([IVXLCDM]+)(?![A-Za-z0-9_])"
VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(roman: Column) -> Column:
    """Subtractive value from right to left."""
    known = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))
    digits = F.transform(F.reverse(F.filter(F.split(roman, ""), lambda c: c != "")), lambda c: known[c])
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(digits, start, lambda a, d: F.struct(d.alias("last"), F.when(d < a["last"], a["sum"] - d).otherwise(a["sum"] + d).alias("sum")), lambda a: a["sum"].cast("bigint"))


def is_roman(roman: Column) -> Column:
    """Roman letters, none but M more than three times in a row."""
    return F.regexp_like(roman, F.lit("^[IVXLCDM]+$")) & ~F.regexp_like(roman, F.lit("I{4}|V{4}|X{4}|L{4}|C{4}|D{4}"))


def roman_numerals(df: DataFrame, col: str = "text") -> DataFrame:
    """(doc_id, pos, roman, value) of valid numerals that stand alone."""
    found = F.filter(F.regexp_extract_all(col, F.lit(ROMAN), F.lit(1)), is_roman)
    return df.select("doc_id", F.posexplode(found).alias("pos", "roman")).select("doc_id", F.col("pos").cast("long").alias("pos"), "roman", roman_value(F.col("roman")).alias("value"))


def lookup_nouns(df: DataFrame, nouns: DataFrame, word_col: str = "word") -> DataFrame:
    """Left join with nouns (noun, gender, form, singular, plurals) by a word's own or one of its plural forms.

    Where both tables have a column lang, languages must be equal too. The noun itself goes before
    a plural, then the smallest noun. The dictionary is broadcast if Spark finds it small.
    """
    by = ["lang"] if "lang" in df.columns and "lang" in nouns.columns else []
    own = nouns.select(*by, F.lower("noun").alias("surface"), F.lit(0).alias("rank"), "noun", "gender", "form")
    plural = nouns.select(*by, F.explode("plurals").alias("surface"), F.lit(1).alias("rank"), "noun", "gender", "form").withColumn("surface", F.lower("surface"))
    best = own.unionByName(plural).groupBy(*by, "surface").agg(F.min(F.struct("rank", "noun", "gender", "form")).alias("m"))
    for name in by:
        best = best.withColumnRenamed(name, f"_{name}")
    same = F.lower(word_col) == F.col("surface")
    for name in by:
        same = same & (F.col(name) == F.col(f"_{name}"))
    joined = df.join(best, same, "left")
    return joined.select(*(F.col(c) for c in df.columns), F.col("m.noun").alias("noun"), F.col("m.gender").alias("gender"), F.col("m.form").alias("form"))


def _pieces(text: Column) -> Column:
    """A text as runs of digits (with a minus that no letter or digit stands before) and what is between."""
    return F.regexp_extract_all(text, F.lit(r"((?<![\p{L}\p{Nd}])-[0-9]+|[0-9]+|[^0-9-]+|-)"), F.lit(1))


def normalize_with(text: Column, convert) -> Column:
    """Every number in words, in one context; a hyphen between a letter and a number becomes a blank."""
    open_hyphens = F.regexp_replace(text, r"(?<=\p{L})-(?=[0-9])", " ")
    spoken = F.transform(_pieces(open_hyphens), lambda p: F.coalesce(F.when(p.try_cast("bigint").isNotNull() & F.regexp_like(p, F.lit("^-?[0-9]+$")), convert(p.try_cast("bigint"))), p))
    return F.array_join(spoken, "")


def normalize_titles(df: DataFrame, lang: str = "en", col: str = "title") -> DataFrame:
    """Numbers of titles as ordinals of the gender of "chapter"."""
    convert = (lambda n: ordinal_ru(n, "f")) if lang == "ru" else ordinal_en
    return df.withColumn(col, normalize_with(F.col(col), convert))


def noun_forms(nouns, lang: str) -> dict[str, tuple[str, str]]:
    """Each form of a language's nouns to (gender, form); a noun itself goes before a plural, then the smallest noun.

    nouns: rows (lang, noun, gender, form, singular, plurals), a list, or a DataFrame of at most MOST_NOUNS
    rows of the language; known_words() joins larger ones.
    """
    if isinstance(nouns, DataFrame):
        nouns = nouns.where(F.col("lang") == lang).limit(MOST_NOUNS + 1).collect()
        if len(nouns) > MOST_NOUNS:
            raise ValueError(f"over {MOST_NOUNS} nouns in one expression: English ones are joined by known_words")
    forms: dict[str, tuple] = {}
    for n in nouns:
        if n.lang == lang:
            for rank, words in ((0, [n.noun]), (1, n.plurals)):
                for word in words:
                    own = (rank, n.noun, n.gender, n.form)
                    forms[word.lower()] = min(forms.get(word.lower(), own), own)
    return {word: (gender, form) for word, (_, _, gender, form) in forms.items()}


#: Nouns of a dictionary that become part of an expression.
MOST_NOUNS = 50_000
#: What may stand between a number and a word, and the word at the start of a text.
_AROUND, _WORD_AFTER = "\t\n\x0b\f\r \x85\xa0", r"\A[\t\n\x0B\f\r \x85\xA0]*([\p{L}'-]+)"
#: Where a number with its minus begins and ends.
_NUMBER_EDGE = "(?=-[0-9])|(?=[0-9])(?<![0-9-])|(?<=[0-9])(?![0-9])"
#: Put around Roman numerals for a moment: private characters in an order that no text has.
_MARK = "\ue000\ue001\ue000"


def _word_before(piece: Column) -> Column:
    """The word at a text's end, lower-case: only what follows the last blank is looked at."""
    last = F.substring_index(F.rtrim(F.coalesce(piece, F.lit("")), F.lit(_AROUND)), " ", -1)
    return F.lower(F.regexp_extract(last, r"([\p{L}'-]+)\z", 1))


def _word_after(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(piece, F.lit("")), _WORD_AFTER, 1))


def _among(word: Column, words: list[str] | Column) -> Column:
    """Whether a word is in a list or an array column."""
    return F.coalesce(F.array_contains(words, word), F.lit(False)) if isinstance(words, Column) else word.isin(words)


def noun_surfaces(nouns: DataFrame, lang: str) -> DataFrame:
    """(surface, form) of a language's nouns and their plurals, lower-case; a noun itself goes before a plural, then the smallest noun."""
    mine = nouns.where(F.col("lang") == lang)
    own = mine.select(F.lower("noun").alias("surface"), F.lit(0).alias("rank"), "noun", "gender", "form")
    plural = mine.select(F.explode("plurals").alias("surface"), F.lit(1).alias("rank"), "noun", "gender", "form").withColumn("surface", F.lower("surface"))
    return own.unionByName(plural).groupBy("surface").agg(F.min(F.struct("rank", "noun", "gender", "form"))["form"].alias("form"))


def known_words(df: DataFrame, col: str, beside: Column, nouns: DataFrame, lang: str = "en", form: str | None = None) -> DataFrame:
    """Adds _known: which of the words `beside` a text's numbers are nouns of a table of any size, of one form or any.

    Each text's words are spans of (digest of the text, word), joined with the nouns, and come back by digest.
    """
    digest = F.md5(F.col(col))
    spans = df.select(digest.alias("_key"), F.explode(F.array_distinct(beside)).alias("_word")).where("_word <> ''").distinct()
    chosen = noun_surfaces(nouns, lang)
    chosen = chosen.where(F.col("form") == form) if form else chosen
    found = spans.join(chosen, F.col("_word") == F.col("surface")).groupBy("_key").agg(F.collect_set("_word").alias("_known"))
    return df.join(found, digest == F.col("_key"), "left").drop("_key")


def _open_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"-(?<=\p{L}-)(?=[0-9])", " ")


def words_before_numbers(text: Column) -> Column:
    """The word right before each number, lower-case."""
    beside = lambda pieces: F.transform(pieces, lambda p, i: F.when(F.regexp_like(p, F.lit("^-?[0-9]+$")), _word_before(F.get(pieces, i - 1))).otherwise(""))
    return F.when(has_numbers(text), let(F.split(_open_hyphens(text), _NUMBER_EDGE), beside))


def words_beside_romans(text: Column) -> Column:
    """The words right before and after each Roman numeral, lower-case."""

    def beside(pieces: Column) -> Column:
        each = F.transform(pieces, lambda p, i: F.when(is_roman(p), F.array(_word_before(F.get(pieces, i - 1)), _word_after(F.get(pieces, i + 1)))).otherwise(F.array().cast("array<string>")))
        return F.flatten(each)

    return F.when(F.regexp_like(text, F.lit(ROMAN)), let(F.split(F.regexp_replace(text, ROMAN, f"{_MARK}$1{_MARK}"), _MARK), beside))


def numbers_in_words_en(text: Column, ordinal_words: list[str] | Column) -> Column:
    """Numbers in English words: ordinals right after one of the words (a list, or an array of each row's own), else cardinals.

    A hyphen between a letter and a number becomes a blank; a number with a hyphen after a digit stays.
    """

    def spoken(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            n, before = p.try_cast("bigint"), F.coalesce(F.get(pieces, i - 1), F.lit(""))
            none = isinstance(ordinal_words, list) and not ordinal_words
            said = cardinal_en(n) if none else F.when(_among(_word_before(before), ordinal_words), ordinal_en(n)).otherwise(cardinal_en(n))
            joined = F.startswith(p, F.lit("-")) & F.regexp_like(before, F.lit("[0-9]\\z"))
            return F.when(F.regexp_like(p, F.lit("^-?[0-9]+$")) & n.isNotNull() & ~joined, said).otherwise(p)

        return F.array_join(F.transform(pieces, one), "")

    return F.when(has_numbers(text), let(F.split(_open_hyphens(text), _NUMBER_EDGE), spoken)).otherwise(text)


def normalize_numbers_en(df: DataFrame, col: str = "text", nouns=NOUNS) -> DataFrame:
    """Numbers in words: ordinals right after a noun that asks for one, else cardinals. A table of nouns is joined, however large."""
    if isinstance(nouns, DataFrame):
        known = known_words(df, col, words_before_numbers(F.col(col)), nouns, form="o")
        return known.withColumn(col, numbers_in_words_en(F.col(col), F.col("_known"))).select(*df.columns)
    ordinal = sorted(w for w, (_, form) in noun_forms(nouns, "en").items() if form == "o")
    return df.withColumn(col, numbers_in_words_en(F.col(col), ordinal))


def romans_in_words_en(text: Column, words: list[str] | Column) -> Column:
    """Valid numerals beside one of the words (a list, or an array of each row's own): cardinals after it, ordinals before it; others stay."""
    pieces = F.split(F.regexp_replace(text, ROMAN, f"{_MARK}$1{_MARK}"), _MARK)

    def spoken(all_: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            beside = [_among(_word_before(F.get(all_, i - 1)), words), _among(_word_after(F.get(all_, i + 1)), words)]
            said = F.when(beside[0], cardinal_en(roman_value(p))).when(beside[1], ordinal_en(roman_value(p))).otherwise(p)
            return F.when(is_roman(p), said).otherwise(p)

        return F.array_join(F.transform(all_, one), "")

    return F.when(F.regexp_like(text, F.lit(ROMAN)), let(pieces, spoken)).otherwise(text)


def roman_in_words(df: DataFrame, col: str = "text", nouns=NOUNS) -> DataFrame:
    """Valid numerals beside a known noun in English words. A table of nouns is joined, however large."""
    if isinstance(nouns, DataFrame):
        known = known_words(df, col, words_beside_romans(F.col(col)), nouns)
        return known.withColumn(col, romans_in_words_en(F.col(col), F.col("_known"))).select(*df.columns)
    return df.withColumn(col, romans_in_words_en(F.col(col), sorted(noun_forms(nouns, "en"))))
