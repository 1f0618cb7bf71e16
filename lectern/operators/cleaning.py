"""Cleaning, filters and lexical rules."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import changed, go_trim, let, replace_all
from lectern.sources.bundled import ENGLISH_RULES, Rule

#: Characters that go, those that become another, and those that become words.
GONE = "$%#^*@~|\\/<>{}[]" + "“”„‘’‚«»‹›\"'`" + "​‌‍﻿" + "†‡¶" + "′″‴" + "­"
BLANKS = "_            　"
SINGLES = (("−", "-"), ("•", "-"), ("‣", "-"), ("⁃", "-"), ("◦", "-"), ("·", "."), ("¹", "1"), ("²", "2"), ("³", "3"), ("⁰", "0"), ("⁴", "4"), ("⁵", "5"), ("⁶", "6"), ("⁷", "7"), ("⁸", "8"), ("⁹", "9"), ("₀", "0"), ("₁", "1"), ("₂", "2"), ("₃", "3"), ("₄", "4"), ("₅", "5"), ("₆", "6"), ("₇", "7"), ("₈", "8"), ("₉", "9"), ("º", "o"), ("ª", "a"))
WORDS = (
    ("—", " - "),
    ("–", " - "),
    ("―", " - "),
    ("‒", " - "),
    ("…", "..."),
    ("©", "(c)"),
    ("®", "(R)"),
    ("™", "(TM)"),
    ("§", "Section "),
    ("°", " degrees "),
    ("±", " plus or minus "),
    ("×", " times "),
    ("÷", " divided by "),
    ("≈", " approximately "),
    ("≠", " not equal to "),
    ("≤", " less than or equal "),
    ("≥", " greater than or equal "),
    ("∞", " infinity "),
    ("¼", " one quarter "),
    ("½", " one half "),
    ("¾", " three quarters "),
    ("⅓", " one third "),
    ("⅔", " two thirds "),
    ("№", "No."),
    ("‰", " per mille "),
    ("‱", " per ten thousand "),
    ("→", " to "),
    ("←", " from "),
    ("↔", " to "),
    ("※", "*"),
    ("⁂", "***"),
    ("€", " euros "),
    ("£", " pounds "),
    ("¥", " yen "),
    ("¢", " cents "),
    ("✓", " check "),
    ("✗", " x "),
    ("★", " star "),
    ("☆", " star "),
)


#: Any character that clean() takes away, or turns into another or into words; others from U+2000 on are looked at too.
ODD = "[" + "".join(sorted({re.escape(c) for c in BLANKS + GONE + "".join(a for a, _ in SINGLES + WORDS) if c < "\u2000"})) + r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u2000-\x{10FFFF}]"


def _plain_characters(text: Column) -> Column:
    """Characters go before words come, and then controls and private characters."""
    kept = F.translate(text, BLANKS + "".join(a for a, _ in SINGLES) + GONE, " " * len(BLANKS) + "".join(b for _, b in SINGLES))
    signs = F.lit("(?=[^\\x00-\\x7F])[" + "".join(a for a, _ in WORDS) + "]")
    words = F.create_map(*(F.lit(x) for pair in WORDS for x in pair))
    # no sign is in another one's words, so the order of those that a text has doesn't count
    said = let(kept, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, signs, F.lit(0))), t, lambda now, sign: F.replace(now, sign, words[sign])))
    return F.regexp_replace(said, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\uE000-\uF8FF\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]", " ")


def clean(text: Column) -> Column:
    """Characters that speech engines stumble over, and white space; each step looks first whether a text has what it changes."""
    has = lambda *parts: lambda t: reduce(or_, (F.contains(t, F.lit(x)) for x in parts))
    out = changed(text, lambda t: F.regexp_like(t, F.lit(ODD)), _plain_characters)
    out = changed(out, has("...."), lambda t: F.regexp_replace(t, r"\.{4,}", "..."))
    out = replace_all(out, (("\r\n", "\n"), ("\r", "\n")))
    out = F.regexp_replace(out, r"\n[\t\n\f ]*\n", "\n\n")
    out = changed(out, has("  ", "\t"), lambda t: F.regexp_replace(t, "[ \t]+", " "))
    # blanks are single by now, and those around the whole text go at the end
    out = replace_all(out, ((" \n", "\n"), ("\n ", "\n")))
    return go_trim(changed(out, has("\n\n\n"), lambda t: F.regexp_replace(t, "\n{3,}", "\n\n")))


def clean_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, clean(F.col(col)))


def is_speakable(text: Column, lang: Column) -> Column:
    """A letter or digit; Russian needs a Cyrillic letter, English a Latin one."""
    own = F.when(lang == "ru", F.regexp_like(text, F.lit("[Ѐ-ԯ]"))).when(lang == "en", F.regexp_like(text, F.lit("[A-Za-zÀ-ſ]"))).otherwise(True)
    return F.coalesce(F.regexp_like(text, F.lit(r"[\p{L}\p{Nd}]")) & own, F.lit(False))


def speakable(df: DataFrame, col: str = "text", lang_col: str = "lang") -> DataFrame:
    return df.where(is_speakable(F.col(col), F.col(lang_col)))


def required(pattern: str) -> str:
    """The longest run of characters that any match of a pattern has; empty if that can't be told simply."""
    if "|" in pattern or pattern.startswith("(?"):
        return ""
    runs, depth, last = [""], 0, None
    for m in re.finditer(r"\\(.)|(\[\^?\]?[^\]]*\])|([()])|([?*]|\{[^}]*\})|([+^$.])|(.)", pattern, re.S):
        escaped, several, bracket, optional, other, plain = m.groups()
        literal = plain or (escaped if escaped and not escaped.isalnum() else None)
        depth += {"(": 1, ")": -1}.get(bracket, 0)
        if literal and not depth:
            runs[-1] += literal
        else:
            if optional and last:
                runs[-1] = runs[-1][:-1]
            runs.append("")
        last = literal if not depth else None
    return max(runs, key=len)


def _fold(text: str) -> str:
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _trie(words: list[str]) -> str:
    """A regular expression for the longest of the words that a place begins, by their common beginnings."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    done = "" in by_first
    branches = [re.escape(c) + (_trie(rest) if rest != [""] else "") for c, rest in sorted(by_first.items()) if c]
    joined = branches[0] if len(branches) == 1 and not done else f"(?:{'|'.join(branches)})"
    return joined + "?" if done else joined


#: A group of digits and points, which can't hold another rule's literal unless that is made of these alone.
_DIGITS = re.compile(r"\((?:\\d|\\\.|[+*?.])*\)")


@lru_cache(1 << 16)
def _made(rule: Rule, markup: bool, literal: str) -> bool:
    """Whether what a rule does may give a text a literal where it had none: in what is said, beside a group's text, across blanks."""
    said = f" {rule.markup if markup and rule.markup else rule.plain} "
    fragments = [_fold(x) for x in re.split(r"\$\d+", said)]
    if " " in literal or any(literal in f for f in fragments):
        return True
    if len(fragments) == 1:
        return False
    if "(" in _DIGITS.sub("", rule.pattern.replace("\\(", "")) or re.fullmatch(r"[\d.]+", literal):
        return True
    meets = lambda f, before: any((literal.startswith(f[len(f) - n :]) if before else literal.endswith(f[:n])) for n in range(1, min(len(f), len(literal)) + 1))
    return any(meets(f, True) for f in fragments[:-1]) or any(meets(f, False) for f in fragments[1:])


#: What a rule's match begins and ends with; the text has a blank put before it.
LEAD, TRAIL = "[\\t\\n\\f\\r ]", "(?:[\\t\\n\\f\\r .,)]|\\z)"


def _java(pattern: str) -> str:
    """A rule's pattern between its marks, in Java's dialect; its groups keep their numbers."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    core = pattern[flags.end() :] if flags else pattern
    core = re.sub(r"(?<!\\)((?:\\\\)*)\\s", r"\1[\\t\\n\\f\\r ]", core)
    return f"{LEAD}(?{flags[1]}:{core}){TRAIL}" if flags else f"{LEAD}(?:{core}){TRAIL}"


def _apply(text: Column, rule: Rule, markup: bool) -> Column:
    """One rule on whole words: what stands before becomes one blank, so does what stands after."""
    said = (rule.markup if markup and rule.markup else rule.plain).replace("\\", "\\\\")
    return F.regexp_replace(text, _java(rule.pattern), f" {said} ")


def fitting(text: Column, rules: list[Rule], numbers: list[int], markup: bool = False) -> Column:
    """Which of the rules of these numbers can fit a text, in order: a scan for the literals of all of them.

    Literals that a rule begins with are looked for after blanks and what a match may end with, others
    everywhere. At each place the longest one is found, which tells of those that it begins with too. A
    rule that may give a text another one's literal brings that one along, and a rule without a literal
    is always there, so what isn't there would change nothing.
    """
    # the scan takes letters in any case
    literals = {i: _fold(required(rules[i].pattern.removeprefix("(?i)"))) for i in numbers}
    brings: dict[int, set[int]] = {}
    for at in range(len(numbers) - 1, -1, -1):
        i = numbers[at]
        later = [j for j in numbers[at + 1 :] if literals[j] and _made(rules[i], markup, literals[j])]
        brings[i] = {i}.union(*(brings[j] for j in later))
    as_array = lambda s: F.expr(f"CAST(array({', '.join(map(str, sorted(s)))}) AS array<int>)")
    looked_up = lambda seen, by_literal: F.flatten(F.transform(seen, lambda x: F.coalesce(by_literal[F.lower(x)], as_array(numbers))))
    found = [as_array(set().union(*(brings[i] for i in numbers if not literals[i])))]
    leads = {i: _fold(re.sub(r"^(\(\?i\))?(\\b)?", "", rules[i].pattern).replace("\\", "")).startswith(x) for i, x in literals.items() if x}
    for place, own in (("(?<=[\\t\\n\\f\\r .,)])", [i for i in leads if leads[i]]), ("", [i for i in leads if not leads[i]])):
        known = sorted({literals[i] for i in own})
        if known:
            told = {x: set().union(*(brings[i] for i in own if x.startswith(literals[i]))) for x in known}
            seen = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?iu){place}(?=({_trie(known)}))"), F.lit(1)))
            found.append(looked_up(seen, F.create_map(*(c for x, s in told.items() for c in (F.lit(x), as_array(s))))))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def with_rules(text: Column, rules, lang: str | Column = "", markup: bool = False) -> Column:
    """A text after all enabled rules of its language in order; an empty language takes all rules.

    rules: Rule or (pattern, plain), a driver's list of at most a few hundred. One scan tells which of
    them can fit, and the fold goes over the numbers of these, so a text pays for its own rules alone.
    """
    chosen = [r for r in (Rule(*x) for x in rules) if r.enabled]
    if not chosen:
        return text
    spaced = F.concat(F.lit(" "), text)
    numbers = lambda want: fitting(spaced, chosen, [i for i, r in enumerate(chosen) if not want or not r.lang or r.lang == want], markup)
    if isinstance(lang, str):
        taken = numbers(lang)
    else:
        known = sorted({r.lang for r in chosen} - {""})
        taken = F.when(lang == "", numbers("")) if known else numbers("-")
        for one in known:
            taken = taken.when(lang == one, numbers(one))
        taken = taken.otherwise(numbers("-")) if known else taken

    def branch(now: Column, i: Column, low: int, high: int) -> Column:
        """The rule of number i among low to high - 1, halved until it is found."""
        if high - low == 1:
            return _apply(now, chosen[low], markup)
        middle = (low + high) // 2
        return F.when(i < middle, branch(now, i, low, middle)).otherwise(branch(now, i, middle, high))

    return F.aggregate(taken, spaced, lambda now, i: branch(now, i, 0, len(chosen)), lambda t: F.substr(t, F.lit(2)))


def apply_rules(df: DataFrame, rules=ENGLISH_RULES, col: str = "text", lang: str | Column = "", markup: bool = False) -> DataFrame:
    """The enabled rules of a language in order; lang is one for all rows, or a column; empty: every rule."""
    return df.withColumn(col, with_rules(F.col(col), rules, lang, markup))


def sanitize(df: DataFrame, rules=ENGLISH_RULES, lang: str | Column = "", markup: bool = False) -> DataFrame:
    return apply_rules(clean_text(df), rules, lang=lang, markup=markup)


#: What a name's characters may not be.
UNSAFE_NAME = "/\\:*?\"<>|'’‘`$&;()[]{}!#~^@% \n\r\t"


def file_name(name: Column) -> Column:
    out = F.replace(F.replace(name, F.lit("..."), F.lit("_")), F.lit(".."), F.lit("_"))
    out = F.regexp_replace(F.translate(out, UNSAFE_NAME, "_" * len(UNSAFE_NAME)), "_+", "_")
    out = F.regexp_replace(out, r"^[_.]+|[_.]+\z", "")
    out = F.when(F.length(out) > 100, F.regexp_replace(F.left(out, F.lit(100)), r"_+\z", "")).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("untitled"))


def path_component(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(file_name(name), r"^\.+", ""), F.lit("")), F.lit("untitled"))


def file_name_with_extension(name: Column, extension: Column) -> Column:
    return F.concat(file_name(name), F.when((extension == "") | F.startswith(extension, F.lit(".")), extension).otherwise(F.concat(F.lit("."), extension)))


def language_code(voice: Column) -> Column:
    """The code a voice's id begins with (before - or _), else en."""
    code = F.lower(F.regexp_extract(F.coalesce(voice, F.lit("")), "^([A-Za-z]{2})(?:[-_]|$)", 1))
    return F.when(code == "", "en").otherwise(code)


def is_russian(language: Column) -> Column:
    return F.regexp_like(F.lower(F.trim(language)), F.lit("^(ru|ru[-_].*|russian|русский)$"))


def tokenize(df: DataFrame, col: str = "text") -> DataFrame:
    """(doc_id, pos, token): words of letters, digits, - and '; every other visible character alone."""
    tokens = F.regexp_extract_all(col, F.lit(r"([\p{L}\p{Nd}'-]+|[^\t\n\f\r ])"), F.lit(1))
    return df.select("doc_id", F.posexplode(tokens).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


#: Names of the letters A-Z, the sounds of a-z, and of pairs.
LETTER_NAMES = "эй би си ди и эф джи эйч ай джей кей эл эм эн оу пи кью ар эс ти ю ви дабл_ю экс уай зет".split()
SOUNDS = "а б к д е ф г х и дж к л м н о п к р с т у в в кс й з".split()
PAIRS = (("ch", "ч"), ("sh", "ш"), ("th", "т"), ("ph", "ф"), ("ck", "к"))


def transliterated(word: Column) -> Column:
    """A Latin word in Cyrillic: capitals by their letters' names, others by sound."""
    letters = F.create_map(*(F.lit(x) for i, n in enumerate(LETTER_NAMES) for x in (chr(65 + i), n.replace("_", " "))))
    named = F.array_join(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: letters[c]), " ")
    low = replace_all(F.lower(word), PAIRS)
    single = [(i, s) for i, s in enumerate(SOUNDS) if len(s) == 1]
    sounded = replace_all(F.translate(low, "".join(chr(97 + i) for i, _ in single), "".join(s for _, s in single)), [(chr(97 + i), s) for i, s in enumerate(SOUNDS) if len(s) > 1])
    return F.when(F.regexp_like(word, F.lit("^[A-Z]+$")), named).otherwise(sounded)


LATIN_WORD = "(?<![A-Za-z0-9_])([A-Za-z]+)(?![A-Za-z0-9_])"


def latin_tokens(df: DataFrame, col: str = "text") -> DataFrame:
    """(word, spoken) of each distinct Latin word: the work grows with the vocabulary."""
    words = df.select(F.explode(F.regexp_extract_all(col, F.lit(LATIN_WORD), F.lit(1))).alias("word")).distinct()
    return words.withColumn("spoken", transliterated(F.col("word")))


def transliterated_text(text: Column) -> Column:
    """A text with its Latin words in Cyrillic, piece by piece in order."""
    pieces = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    spoken = F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.lit("^[A-Za-z]+$")), transliterated(p)).otherwise(p))
    return F.array_join(spoken, "")


def transliterate(df: DataFrame, col: str = "text") -> DataFrame:
    """Latin words of texts in Cyrillic."""
    return df.withColumn(col, transliterated_text(F.col(col)))


def stress_by_sentence(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentences with the lexicon's stressed form where it has one."""
    return sentences.join(lexicon, "sentence", "left").select(*(c for c in sentences.columns if c != "sentence"), F.coalesce("stressed", "sentence").alias("sentence"))


def stress_texts(df: DataFrame, pieces: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Texts put together from their pieces (doc_id, pos, sentence), stressed where the lexicon has a form of one.

    A piece's blanks around it don't count in the lookup and stay. Texts without pieces stay.
    """
    bare = pieces.withColumn("whole", F.col("sentence")).withColumn("sentence", go_trim(F.col("sentence")))
    stressed = bare.join(lexicon, "sentence", "left").withColumn("said", F.when(F.col("stressed").isNull(), F.col("whole")).otherwise(F.replace("whole", "sentence", "stressed")))
    texts = stressed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("_s"))
    joined = df.join(texts, "doc_id", "left")
    return joined.withColumn("text", F.coalesce(F.array_join(F.transform("_s", lambda x: x["said"]), ""), "text")).select(*df.columns)
