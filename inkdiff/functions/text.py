"""Text expressions, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes away.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def split_lines(text: Column) -> Column:
    """Lines at every line boundary, without an empty one at the end."""
    lines = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def normalize(text: Column) -> Column:
    """Soft hyphens gone, form feeds as line ends, runs of blanks as one, each line and the whole stripped."""
    plain = F.regexp_replace(F.replace(F.replace(text, F.lit("\u00ad"), F.lit("")), F.lit("\f"), F.lit("\n")), r"[ \t]{2,}", " ")
    return strip(F.array_join(F.transform(F.split(plain, "\n", -1), strip), "\n"))


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null if there is none."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contains_any(text: Column, words: Column) -> Column:
    """Does any non-empty word stand in the text, regardless of case?"""
    return F.exists(words, lambda w: (w != "") & F.contains(F.lower(text), F.lower(w)))


def words_of(text: Column) -> Column:
    """As split() without arguments."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")
