"""The whole comparison as lazy tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions.kernels import assign, sequence_ratio
from .operators import align, detect, report, segment


class Tables(dict):
    """The tables of a comparison by name. release() lets go of what executors keep for them."""

    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def compare(
    pages: DataFrame,
    pairs: DataFrame,
    config: Config = Config(),
    providers: tuple = (),
    solver: Callable[[np.ndarray], list] = assign,
    ratio: Callable[[str, str], float] = sequence_ratio,
) -> Tables:
    """Tables of pages(document_id, document_name, version, page_number, original_text) and pairs(pair_id, document_id_a, document_id_b).

    pages, clauses, matches, baseline (its own alignment), changes, rows, stats and status. Clauses, the best alignment and
    the changes are kept on the executors' disks once they are used, for the tables that read them again (what a lost
    executor kept is computed again); `release()` lets them go. A document without pages has no clauses, so its partner's
    are all added or removed. A page's error is told and leaves its page empty.

    A stage that fails on a pair fails on no other: the pair has no matches and no changes if its alignment fails, and no
    changes if their detection does. status has every pair: its errors by stage, in their order, and processing_complete
    where no stage failed and both documents were read. stats has every pair too, with zeros where nothing was found.
    """
    good = pages.where("page_number is not null") if "errors" in pages.columns else pages
    normal = segment.normalize_pages(good.select("document_id", "document_name", "version", "page_number", "original_text"))
    found = segment.segment(normal, config)
    sides = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"document_id_{s}").alias("document_id")) for s in "ab"))).alias("d")).select("pair_id", "d.*")
    clauses = sides.join(found, "document_id").withColumn("text", F.col("normalized_text")).persist(StorageLevel.DISK_ONLY)

    best = align.best_assignment(clauses, config, solver=solver).persist(StorageLevel.DISK_ONLY)
    aligned, unaligned = _apart(best, "error")
    matches = align.hybrid_match(clauses.join(unaligned, "pair_id", "left_anti"), config, aligned)
    base, unbased = _apart(align.best_assignment(clauses, config, "tfidf_score", solver), "error")
    baseline = align.baseline_match(clauses.join(unbased, "pair_id", "left_anti"), config, base)

    detected = detect.detect_changes(align.with_clauses(matches, clauses), config, ratio).persist(StorageLevel.DISK_ONLY)
    told, untold = _apart(detected, "ratio_error")
    changes = told.join(untold, "pair_id", "left_anti")
    full = report.attach_citations(report.generate_summaries(changes, providers, config.summary_timeout))

    failed = [("Stage 4 — baseline matching failed: ", unbased), ("Stage 4 — hybrid matching failed: ", unaligned), ("Stage 5 — change detection failed: ", untold)]
    counts = clauses.groupBy("pair_id").agg(F.count_if(F.col("side") == "a").alias("total_clauses_a"), F.count_if(F.col("side") == "b").alias("total_clauses_b"))
    summary = detect.change_summary(full, "pair_id")
    stats = pairs.select("pair_id").distinct().join(summary, "pair_id", "left").join(counts, "pair_id", "left")
    out = Tables(
        pages=normal,
        clauses=clauses,
        matches=matches,
        baseline=baseline,
        changes=full,
        rows=report.report_rows(full),
        stats=stats.fillna(0),
        status=_status(pages, normal, sides, failed),
    )
    out.held = clauses, best, detected
    return out


def _apart(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and (pair_id, error) of the pairs that have one."""
    bad = rows.where(F.col(error).isNotNull()).groupBy("pair_id").agg(F.min(error).alias("error"))
    return rows.where(F.col(error).isNull()).drop(error), bad


def _status(pages: DataFrame, normal: DataFrame, sides: DataFrame, failed: list[tuple[str, DataFrame]]) -> DataFrame:
    """(pair_id, warnings, errors, has_errors, processing_complete)."""
    read = normal.groupBy("document_id").agg(F.array_compact(F.array_sort(F.collect_set("warning"))).alias("warnings"), F.lit(True).alias("read"))
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    known = sides.join(read, "document_id", "left").groupBy("pair_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(strings(F.col("warnings")))))).alias("warnings"), F.bool_and(F.coalesce("read", F.lit(False))).alias("_read")
    )
    stage = lambda text, df, done: df.select("pair_id", text.alias("error"), F.lit(done).alias("_done"))
    told: list[DataFrame] = [stage(F.concat(F.lit(name), "error"), df, False) for name, df in failed]
    ids = sides.join(pages.select("document_id").distinct(), "document_id", "left_anti")
    missing: Column = F.concat(F.lit("Stage 1 — document "), F.upper("side"), F.lit(" not found: "), F.coalesce("document_id", F.lit("")))
    told.append(stage(missing, ids, False))
    if "errors" in pages.columns:
        told.append(stage(F.col("error"), sides.join(pages.select("document_id", F.explode("errors").alias("error")), "document_id"), True))
    every = told[0]
    for df in told[1:]:
        every = every.union(df)
    errors = every.groupBy("pair_id").agg(F.array_sort(F.collect_set("error")).alias("errors"), F.bool_and("_done").alias("_done"))
    status = known.join(errors, "pair_id", "left").withColumn("errors", strings(F.col("errors"))).withColumn("has_errors", F.size("errors") > 0)
    return status.withColumn("processing_complete", F.col("_read") & F.coalesce("_done", F.lit(True))).drop("_read", "_done")
