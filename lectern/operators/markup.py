"""Pause markup for speech."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import changed, go_trim, replace_all
from lectern.operators.segment import paragraph_list, sentence_list

TITLE_MARK = "{{TITLE_BREAK}}"


@dataclass(frozen=True)
class Pauses:
    """Milliseconds of each pause; 0 is none. dash counts only with dashes on, 300 unless given."""

    sentence: int = 0
    paragraph: int = 0
    dashes: bool = False
    dash: int = 0
    parentheses: int = 0
    colon: int = 0
    title: int = 0
    natural: bool = False


def tag(ms: int) -> str:
    return f'<break time="{ms}ms"/>'


def escape_xml(text: Column) -> Column:
    return replace_all(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def with_pauses(text: Column, dashes: bool = True, dash: int = 300, parentheses: int = 0, colon: int = 0) -> Column:
    """Dashes, ellipses, parentheses and colons as pauses in escaped text."""
    blank = r"[\t\n\f\r ]"
    if dashes:
        for pattern, new in ((r"\.{3,}", "...\x01B\x01"), ("…", "…\x01B\x01"), (f"{blank}+[-—–]{blank}+", " \x01B\x01 ")):
            text = F.regexp_replace(text, pattern, new)
    if parentheses > 0:
        text = F.regexp_replace(text, f"\\({blank}*([^()]+?){blank}*\\)", " \x01P\x01 $1 \x01P\x01 ")
    if colon > 0:
        text = F.regexp_replace(text, f"{blank}*:{blank}*", " \x01C\x01 ")
    return replace_all(escape_xml(text), [(f"\x01{k}\x01", f" {tag(ms)} ") for k, ms in (("B", dash if dash > 0 else 300), ("P", parentheses), ("C", colon)) if ms > 0])


def breaks(text: Column, p: Pauses) -> Column:
    """Pauses between sentences and paragraphs; a paragraph that is a pause stays and stands for the one next to it."""
    out = F.replace(text, F.lit(TITLE_MARK), F.lit(tag(p.title) if p.title > 0 else ""))
    if p.colon <= 0:
        out = F.replace(out, F.lit(":"), F.lit(" "))
    out = changed(out, lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), lambda t: F.regexp_replace(t, "[ \t]+", " "))
    if p.natural and not p.sentence and not p.paragraph:
        p = replace(p, sentence=500, paragraph=800)
    told = (lambda t: with_pauses(t, p.dashes, p.dash, max(p.parentheses, 0), max(p.colon, 0))) if p.dashes or p.parentheses > 0 or p.colon > 0 else escape_xml
    if not p.sentence and not p.paragraph:
        return told(out)
    parts = paragraph_list(out)
    is_tag = lambda x: F.startswith(x, F.lit("<break ")) & F.endswith(x, F.lit("/>"))
    between = f" {tag(p.sentence)} " if p.sentence > 0 else ""

    def one(all_: Column) -> Column:
        def paragraph(x: Column, i: Column) -> Column:
            body = F.array_join(F.transform(sentence_list(x), told), between)
            after = (i < F.size(all_) - 1) & ~is_tag(F.coalesce(F.get(all_, i + 1), F.lit("")))
            pause = F.when(after, f"\n\n{tag(p.paragraph)}\n\n").otherwise("") if p.paragraph > 0 else F.lit("")
            return F.when(is_tag(x), F.concat(F.lit("\n\n"), x, F.lit("\n\n"))).otherwise(F.concat(body, pause))

        return F.array_join(F.transform(all_, paragraph), "")

    # the one-element array names the list of paragraphs
    return F.get(F.transform(F.array(parts), one), F.lit(0))


def with_breaks(text: Column, p: Pauses) -> Column:
    """As breaks(); a blank text stays."""
    return F.when(go_trim(text) == "", text).otherwise(breaks(text, p))


def add_breaks(df: DataFrame, p: Pauses, col: str = "text") -> DataFrame:
    return df.withColumn(col, with_breaks(F.col(col), p))


def wrap_speak(df: DataFrame, p: Pauses, col: str = "text") -> DataFrame:
    return df.withColumn(col, F.when(go_trim(F.col(col)) == "", "<speak></speak>").otherwise(F.concat(F.lit("<speak>"), breaks(F.col(col), p), F.lit("</speak>"))))


def bucket(value: Column, names: tuple[str, ...]) -> Column:
    """The name of the first of 0.6, 0.85, 1.1, 1.35 that a value doesn't pass, else the last."""
    out = F.when(value <= 0.6, names[0])
    for most, name in zip((0.85, 1.1, 1.35), names[1:], strict=False):
        out = out.when(value <= most, name)
    return out.otherwise(names[-1])


def prosody(df: DataFrame, col: str = "text", speed: str = "speed", pitch: str = "pitch") -> DataFrame:
    """Wraps text in <speak>, with a prosody element where speed or pitch isn't medium."""
    rate = bucket(F.col(speed), ("x-slow", "slow", "medium", "fast", "x-fast"))
    tone = bucket(F.col(pitch), ("x-low", "low", "medium", "high", "x-high"))
    attrs = F.concat_ws(" ", F.when(rate != "medium", F.concat(F.lit('rate="'), rate, F.lit('"'))), F.when(tone != "medium", F.concat(F.lit('pitch="'), tone, F.lit('"'))))
    trimmed = go_trim(F.col(col))
    wrapped = F.startswith(trimmed, F.lit("<speak>")) & F.endswith(trimmed, F.lit("</speak>"))
    inner = F.when(wrapped, go_trim(F.regexp_replace(trimmed, "^<speak>|</speak>$", ""))).otherwise(escape_xml(F.col(col)))
    spoken = F.concat(F.lit("<speak><prosody "), attrs, F.lit(">"), inner, F.lit("</prosody></speak>"))
    return df.withColumn(col, F.when(attrs != "", spoken).when(wrapped, trimmed).otherwise(F.concat(F.lit("<speak>"), inner, F.lit("</speak>"))))
