"""Pages to clauses: normalisation, page quality, headings, blocks, clause numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.text import none_if_empty, normalize, split_lines, strip

LEAST_PAGE = 50
#: Fixed patterns of heading lines.
HEADING = (
    r"\A(?:\d+\.\d+\.\d+\s|\d+\.\d+\s|\d+\.\s"
    r"|(?i:Section\s+\d+|Clause\s+[\d.]+|ARTICLE\s+[IVX\d]+|Rule\s+\d+|Chapter\s+\d+|Part\s+[IVX\d]+|Schedule\s+\d+|Annexure\s+[A-Z\d]+|Regulation\s+\d+|Policy\s+\d+)"
    r"|[A-Z][A-Z\s]{4,}$)"
)
#: Fixed pattern of a heading's number.
NUMBER = r"(?i)\A([\d.]+\.?|Section\s+\d+|Clause\s+[\d.]+|ARTICLE\s+[IVX\d]+)\s*"


def normalize_pages(pages: DataFrame) -> DataFrame:
    """pages with normalized_text, has_sufficient_text, ocr_warning and warning (null if there is none)."""
    text = normalize(F.coalesce("original_text", F.lit("")))
    enough = F.char_length("normalized_text") >= LEAST_PAGE
    warning = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(f": fewer than {LEAST_PAGE} characters extracted — possible scanned/image-only page."))
    return (
        pages.withColumn("normalized_text", text)
        .withColumn("has_sufficient_text", enough)
        .withColumn("ocr_warning", ~F.col("has_sufficient_text"))
        .withColumn("warning", F.when(F.col("ocr_warning"), warning))
    )


def document_text(pages: DataFrame, text: str = "original_text") -> DataFrame:
    """document_id and the texts of its pages in order, a line end between them."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def is_heading(line: Column) -> Column:
    return F.coalesce(F.regexp(strip(line), F.lit(HEADING)), F.lit(False))


def section_metadata(heading: Column) -> Column:
    """struct(section_number, section_title, depth) of a heading; nulls and 0 for an empty one."""
    h = strip(F.coalesce(heading, F.lit("")))
    number = none_if_empty(strip(F.regexp_extract(h, NUMBER, 1)))
    title = none_if_empty(strip(F.when(number.isNull(), h).otherwise(F.regexp_replace(h, NUMBER, ""))))
    dots = F.char_length(number) - F.char_length(F.replace(number, F.lit("."), F.lit("")))
    return F.struct(number.alias("section_number"), title.alias("section_title"), F.coalesce(dots, F.lit(0)).cast("int").alias("depth"))


def segment(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Clauses of normalized pages(document_id, document_name, version, page_number, normalized_text).

    A page's lines are cut at its headings; what stands before the first one is its preamble. Clauses are numbered over
    a document's pages once empty blocks are gone. All windows are partitioned by document (and page).
    """
    # headings and blocks are found inside each page's own array: no shuffle of lines
    lines = split_lines(F.col("normalized_text"))
    # each line in front of which a block starts is marked, then the page is cut at the marks
    marked = F.transform(lines, lambda line: F.when(is_heading(line), F.concat(F.lit("\u0001\u0002"), line)).otherwise(line))
    blocks = F.split(F.array_join(marked, "\n"), "(?:\\A|\n)(?=\u0001\u0002)", -1)
    cut = pages.select("document_id", "document_name", "version", "page_number", F.posexplode(blocks).alias("block", "raw"))
    headed = F.col("raw").startswith("\u0001\u0002")
    body = F.substring("raw", F.when(headed, 3).otherwise(1), F.char_length("raw"))
    parts = cut.withColumn("headed", headed).withColumn("body", body)
    heading = F.when(F.col("headed"), strip(F.substring_index("body", "\n", 1))).otherwise("")
    rest = F.when(F.col("headed") & (F.instr("body", "\n") == 0), "").when(F.col("headed"), F.substring("body", F.instr("body", "\n") + 1, F.char_length("body"))).otherwise(F.col("body"))
    found = parts.withColumn("heading", heading).withColumn("rest", strip(rest))
    text = strip(F.when(F.col("headed"), F.concat_ws("\n", "heading", "rest")).otherwise(F.col("rest")))
    found = found.withColumn("text", text).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("page_number", "block")
    numbered = found.withColumn("ordinal", F.row_number().over(order) - 1)
    short = F.char_length("text") < config.min_clause_length
    reasons = F.concat_ws(
        "; ",
        F.when(~F.col("headed"), F.lit("preamble (before first heading)")),
        F.when(short, F.concat(F.lit("short clause ("), F.char_length("text").cast("string"), F.lit(f" < {config.min_clause_length} chars)"))),
    )
    return numbered.select(
        "document_id",
        "document_name",
        "version",
        F.format_string("%s_clause_%04d", "document_id", "ordinal").alias("clause_id"),
        "ordinal",
        "heading",
        F.col("text").alias("original_text"),
        F.col("text").alias("normalized_text"),
        "page_number",
        section_metadata(F.col("heading")).alias("section_metadata"),
        (~F.col("headed") | short).alias("flagged_for_review"),
        reasons.alias("review_reason"),
    )
