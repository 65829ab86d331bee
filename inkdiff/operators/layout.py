"""Sections of documents laid out on pages: words wrapped into lines, lines set below each other, pages broken.

All of it is folds over arrays, so a document's sections are one row; different documents never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words_of

#: Fixed measures: characters of a line, where a page's first line stands and the last one may, and the way to the next line.
WIDTH, TOP, BOTTOM = 80, 60, 760
AFTER_TITLE, AFTER_SUBTITLE, AFTER_HEADING, AFTER_LINE, AFTER_SECTION = 30, 20, 16, 13, 10
RULE = "_" * 80


def wrap(text: Column, width: int = WIDTH) -> Column:
    """The words in lines of at most `width` characters.

    A word that is longer has a line of its own, and what stands before it is one too, even if that is empty: so a text
    that begins with such a word begins with an empty line.
    """
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(False).alias("any"))

    def add(state: Column, word: Column) -> Column:
        longer = F.when(state["any"], F.concat(state["line"], F.lit(" "), word)).otherwise(word)
        full = F.char_length(longer) > width
        lines = F.when(full, F.array_append(state["lines"], state["line"])).otherwise(state["lines"])
        return F.struct(lines.alias("lines"), F.when(full, word).otherwise(longer).alias("line"), F.lit(True).alias("any"))

    end = lambda state: F.when(state["any"], F.array_append(state["lines"], state["line"])).otherwise(state["lines"])
    return F.aggregate(words_of(F.coalesce(text, F.lit(""))), start, add, end)


def page_numbers(steps: Column) -> Column:
    """The page of each line, from the way that each leaves to the next: one that would stand below BOTTOM begins a page."""
    start = F.struct(F.lit(1).alias("page"), F.lit(TOP).alias("y"), F.array().cast("array<int>").alias("pages"))

    def place(state: Column, step: Column) -> Column:
        breaks = state["y"] > BOTTOM
        page = state["page"] + F.when(breaks, 1).otherwise(0)
        y = F.when(breaks, TOP).otherwise(state["y"]) + step
        return F.struct(page.alias("page"), y.alias("y"), F.array_append(state["pages"], page).alias("pages"))

    return F.aggregate(steps, start, place, lambda state: state["pages"])


def lay_out(sections: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pages (document_id, document_name, version, page_number, original_text) of sections(document_id, document_name, version,
    title, subtitle, ordinal, heading, body).

    The first page begins with the document's title, subtitle and a rule. A section is its heading and its body's lines. A
    null heading or text is an empty one; sections with equal ordinals stand in the order of their headings and bodies.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    line = lambda t, step: F.struct(t.alias("t"), step.alias("step"))
    sections = sections.withColumn("_lines", wrap(F.col("body"), width))
    body = F.col("_lines")
    last = F.size(body) - 1
    lines = F.transform(body, lambda t, k: line(t, F.lit(AFTER_LINE) + F.when(k == last, AFTER_SECTION).otherwise(0)))
    heading = line(text("heading"), F.lit(AFTER_HEADING) + F.when(F.size(body) == 0, AFTER_SECTION).otherwise(0))
    rows = sections.select("document_id", "document_name", "version", "title", "subtitle", F.struct("ordinal", text("heading").alias("h"), text("body").alias("b"), F.concat(F.array(heading), lines).alias("items")).alias("s"))
    held = rows.groupBy("document_id").agg(*[F.min(c).alias(c) for c in ("document_name", "version", "title", "subtitle")], F.array_sort(F.collect_list("s")).alias("s"))
    head = F.array(line(text("title"), F.lit(AFTER_TITLE)), line(text("subtitle"), F.lit(AFTER_SUBTITLE)), line(F.lit(RULE), F.lit(AFTER_SUBTITLE)))
    full = held.withColumn("items", F.concat(head, F.flatten(F.transform("s", lambda s: s["items"])))).withColumn("pages", page_numbers(F.transform("items", lambda i: i["step"])))
    every = F.explode(F.sequence(F.lit(1), F.element_at("pages", -1)))
    paged = full.select("document_id", "document_name", "version", every.alias("page_number"), "items", "pages")
    own = F.filter(F.arrays_zip(F.col("items").alias("i"), F.col("pages").alias("p")), lambda z: z["p"] == F.col("page_number"))
    return paged.select("document_id", "document_name", "version", "page_number", F.array_join(F.transform(own, lambda z: z["i"]["t"]), "\n").alias("original_text"))
