"""Column functions for text that keep byte-oriented and Unicode-aware rules apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as one trims it.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of RE2's \s.
SPACE = r"[\t\n\f\r ]"


def go_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    """Runs between blank, line feed, tab and carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \n\t\r]+")).cast("long")


def replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: the one-element array gives it a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def changed(text: Column, needed, use) -> Column:
    """use(text) where needed(text), a cheaper look at it, is true, else the text as it is; computed once."""
    return let(text, lambda t: F.when(needed(t), use(t)).otherwise(t))
