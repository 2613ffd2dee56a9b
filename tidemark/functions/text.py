"""Text expressions: trimming, headline parts, tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.columns import col

# White space, the headline separator, the headline pattern
# (title, then an all-capitals source or "county, ST"), the word pattern.
WHITESPACE = " \t\n\r\x0b\x0c"
SEPARATOR = " - "
HEADLINE = r"(.*?) - (([A-Z ]*$)|(.*?), ([A-Z]{2}$))"
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(c: str | Column) -> Column:
    """White space off both ends; missing text is the empty string."""
    return F.btrim(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(WHITESPACE))


def is_ascii(c: str | Column) -> Column:
    return col(c).rlike(r"^\p{ASCII}*$")


def last_part(c: str | Column) -> Column:
    """The text after the last separator, null when there is none."""
    return F.when(F.instr(col(c), SEPARATOR) > 0, F.substring_index(col(c), SEPARATOR, -1))


def before_last_part(c: str | Column) -> Column:
    """The text before the last separator, or all of it when there is none."""
    text, tail = col(c), last_part(c)
    cut = F.length(text) - F.length(tail) - F.lit(len(SEPARATOR))
    return F.when(tail.isNull(), text).otherwise(F.substring(text, F.lit(1), cut))


def second_part(c: str | Column) -> Column:
    return F.get(F.split(col(c), SEPARATOR), F.lit(1))


def headline_group(c: str | Column, group: int) -> Column:
    """One group of the headline pattern, null when it matched nothing."""
    return F.nullif(F.regexp_extract(col(c), HEADLINE, group), F.lit(""))


def combined(title: str | Column, subject: str | Column, body: str | Column) -> Column:
    """Title (or subject when the title is blank), then ". ", then the body."""
    t, s, b = strip(title), strip(subject), strip(body)
    joined = strip(F.concat(F.when(t == "", s).otherwise(t), F.lit(". "), b))
    return F.when(joined.startswith(". "), b).otherwise(joined)


def words(c: str | Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))
