"""Metrics over labelled pairs. All are one pass of conditional counts, or counts by (gold, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of a confusion matrix at most: it has the square of them.
MOST_LABELS = 1000
UNMATCHED = ("added_candidate", "removed_candidate", "unmatched")


def _share(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def alignment_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """precision, recall, f1, correct_count and total_count of pairs(predicted, gold), for each group of keys.

    Predictions and labels are columns of one row, so they cannot differ in number; a row that lacks one raises.
    """
    p = F.when(F.col("predicted").isNull() | F.col("gold").isNull(), F.raise_error(F.lit("a pair lacks its prediction or its label")).cast("boolean")).otherwise(F.col("predicted"))
    rows = pairs.withColumn("predicted", p)
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("predicted") & F.col("gold")).alias("tp"),
        F.count_if(F.col("predicted") & ~F.col("gold")).alias("fp"),
        F.count_if(~F.col("predicted") & F.col("gold")).alias("fn"),
        F.count_if(F.col("predicted") == F.col("gold")).alias("correct_count"),
        F.count("*").alias("total_count"),
    )
    precision, recall = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*keys, F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(_f1(precision, recall), 4).alias("f1"), "correct_count", "total_count")


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(gold, predicted, n) for every pair of labels seen on either side."""
    labels = pairs.select(F.col("gold").alias("label")).union(pairs.select("predicted")).distinct()
    counts = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    # the labels are few: their square is the matrix asked for
    few = labels.limit(MOST_LABELS + 1).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    listed = few.select(F.when(F.size("labels") > MOST_LABELS, F.raise_error(F.lit(f"more than {MOST_LABELS} labels"))).otherwise(F.col("labels")).alias("labels"))
    square = listed.select("labels", F.explode("labels").alias("gold")).select("gold", F.explode("labels").alias("predicted"))
    return square.join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support and macro_f1 (the mean over all labels of the unrounded f1)."""
    gold = pairs.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gold") == F.col("predicted")).alias("tp"))
    predicted = pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("called"))
    both = gold.join(predicted, "label", "full_outer").na.fill(0)
    precision, recall = _share(F.col("tp"), F.col("called")), _share(F.col("tp"), F.col("support"))
    rated = both.select("label", precision.alias("p"), recall.alias("r"), _f1(precision, recall).alias("f"), "support")
    macro = rated.agg(F.bround(F.avg("f"), 4).alias("macro_f1"))
    rounded = rated.select("label", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround("f", 4).alias("f1"), "support")
    return rounded.join(F.broadcast(macro))  # one row


def diagnostics(results: DataFrame) -> DataFrame:
    """Counts over results(match_type, change_type, needs_review, gold, citations) and the share of valid citations."""
    unmatched = F.col("match_type").isin(*UNMATCHED)
    return results.agg(
        F.count_if(~unmatched & ~F.col("gold")).alias("false_matches"),
        F.count_if(unmatched & F.col("gold")).alias("missed_matches"),
        F.count_if(unmatched).alias("unmatched_count"),
        F.count_if(F.col("change_type") == "uncertain").alias("ambiguous_count"),
        F.count_if("needs_review").alias("needs_review_count"),
        F.bround(F.coalesce(F.try_divide(F.sum(F.size(F.filter("citations", lambda c: c["citation_valid"]))).cast("double"), F.sum(F.size("citations")).cast("double")), F.lit(1.0)), 4).alias("citation_integrity_rate"),
    )


def wording_gate(pairs: DataFrame) -> DataFrame:
    """Of the pairs(gold, predicted) that are only reworded: how many, right, taken for substantive, and the verdict."""
    own = F.col("gold") == "wording_only"
    wrong, total = F.count_if(own & (F.col("predicted") == "substantive")), F.count_if(own)
    return pairs.agg(total.alias("total"), F.count_if(own & (F.col("predicted") == "wording_only")).alias("correct"), wrong.alias("wrong_as_substantive"), ((wrong == 0) & (total > 0)).alias("passed"))


def matching_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.bround(_share(F.count_if(F.col("predicted") == F.col("gold")), F.count("*")), 4).alias("matching_accuracy"), F.count("*").alias("dataset_size"))


def _with_empty(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labelled with empty_a and empty_b, and its rows that have both texts."""
    rows = labelled.withColumn("empty_a", F.coalesce("clause_a_text", F.lit("")) == "").withColumn("empty_b", F.coalesce("clause_b_text", F.lit("")) == "")
    return rows, rows.where("not empty_a and not empty_b")


def text_types(labelled: DataFrame, config=None) -> DataFrame:
    """(id, type) of the labelled pairs that have both texts: the change type if they are matched."""
    from ..config import Config
    from .detect import detect_changes

    both = {"text_a": F.col("clause_a_text"), "text_b": F.col("clause_b_text"), "match_type": F.lit("hybrid"), "needs_review": F.lit(False), "review_reason": F.lit("")}
    full = _with_empty(labelled)[1].select("id", *(c.alias(name) for name, c in both.items()))
    return detect_changes(full, config or Config()).select("id", F.col("change_type").alias("type"))


def evaluate_pairs(labelled: DataFrame, matcher="hybrid", config=None, types: DataFrame | None = None) -> DataFrame:
    """labelled with predicted_match and predicted_type: each pair is featurised and matched on its own, without headings.

    matcher is a name in align.MATCHERS or a function of that shape. types: what text_types gave, if several matchers share it.
    """
    from ..config import Config
    from .align import MATCHERS

    config = config or Config()
    rows, full = _with_empty(labelled)
    types = text_types(labelled, config) if types is None else types
    side = lambda s: full.select(F.col("id").alias("pair_id"), F.lit(s).alias("side"), F.lit(0).alias("ordinal"), F.lit("").alias("heading"), F.col(f"clause_{s}_text").alias("text"))
    clauses = side("a").union(side("b"))
    matched = MATCHERS.get(matcher, matcher)(clauses, config=config)
    first = matched.where("phase < 2")  # a rejected pair is told by its removed clause
    told = first.select(F.col("pair_id").alias("id"), F.col("match_type").alias("m"), F.col("b_ordinal").isNull().alias("alone"))
    joined = rows.join(told, "id", "left").join(types, "id", "left")
    m = F.col("m")
    t = F.when(m.isNull() | F.col("alone") & ~m.isin(*UNMATCHED[:2]), "uncertain").when(m == "added_candidate", "added").when(m == "removed_candidate", "removed").otherwise(F.coalesce("type", F.lit("uncertain")))
    kind = F.when(F.col("empty_a"), "added").when(F.col("empty_b"), "removed").otherwise(t)
    return joined.withColumn("predicted_match", F.coalesce(~m.isin(*UNMATCHED), F.lit(False))).withColumn("predicted_type", kind).drop("m", "alone", "type", "empty_a", "empty_b")


#: What the figures do not show. Fixed values.
LIMITATIONS = (
    "Evaluation uses synthetic clause pairs, not real PDF documents.",
    "Embedding model may not be cached offline; embeddings fall back to TF-IDF.",
    "LLM summaries are not evaluated (deterministic provider used in eval).",
    "Wording-only detection relies on difflib ratio; domain-specific paraphrases may score below threshold.",
)


def evaluation_report(evaluated: dict[str, DataFrame]) -> DataFrame:
    """One row for each matcher: alignment metrics, accuracy, macro f1 and f1 of each class, the wording gate, limits, time.

    Each matcher's rows are read once: what the metrics need is counted by label and prediction, and the few counts are
    one row's array, of which all else is computed.
    """
    out = None
    for name, rows in evaluated.items():
        told = F.col("predicted_match").isNotNull() & F.col("expected_match").isNotNull()
        checked = rows.withColumn("predicted_match", F.when(~told, F.raise_error(F.lit("a pair lacks its prediction or its label")).cast("boolean")).otherwise(F.col("predicted_match")))
        cells = checked.groupBy(F.col("predicted_match").alias("p"), F.col("expected_match").alias("g"), F.col("predicted_type").alias("pt"), F.col("expected_change_type").alias("gt")).agg(F.count("*").alias("n"))
        one = cells.agg(F.collect_list(F.struct("p", "g", "pt", "gt", "n")).alias("cells"))
        one = _report_row(one).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _report_row(one: DataFrame) -> DataFrame:
    """The record of one row with `cells`."""
    count = lambda when: F.aggregate(F.filter("cells", when), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    tp, fp, fn = (count(w) for w in (lambda c: c["p"] & c["g"], lambda c: c["p"] & ~c["g"], lambda c: ~c["p"] & c["g"]))
    counted = one.select(
        "cells", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), count(lambda c: c["p"] == c["g"]).alias("correct_count"), count(lambda c: F.lit(True)).alias("total_count"),
        F.array_sort(F.array_distinct(F.concat(F.transform("cells", lambda c: c["gt"]), F.transform("cells", lambda c: c["pt"])))).alias("labels"),
    )
    precision, recall = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = lambda label: _f1(_share(count(lambda c: (c["gt"] == label) & (c["pt"] == label)), count(lambda c: c["pt"] == label)), _share(count(lambda c: (c["gt"] == label) & (c["pt"] == label)), count(lambda c: c["gt"] == label)))
    classes = counted.withColumn("by_label", F.transform("labels", lambda x: F.struct(x.alias("label"), rated(x).alias("f"))))
    wording = lambda predicted: count(lambda c: (c["gt"] == "wording_only") & (F.lit(True) if predicted is None else c["pt"] == predicted))
    total, wrong = wording(None), wording("substantive")
    mean = _share(F.aggregate("by_label", F.lit(0.0), lambda s, x: s + x["f"]), F.size("by_label"))
    return classes.select(
        F.bround(precision, 4).alias("precision"),
        F.bround(recall, 4).alias("recall"),
        F.bround(_f1(precision, recall), 4).alias("f1"),
        "correct_count",
        "total_count",
        F.bround(mean, 4).alias("macro_f1"),
        F.map_from_entries(F.transform("by_label", lambda x: F.struct(x["label"], F.bround(x["f"], 4)))).alias("per_class_f1"),
        F.bround(_share(F.col("correct_count"), F.col("total_count")), 4).alias("matching_accuracy"),
        F.struct(total.alias("total"), wording("wording_only").alias("correct"), wrong.alias("wrong_as_substantive"), ((wrong == 0) & (total > 0)).alias("passed")).alias("wording_test"),
        F.concat(F.array(*map(F.lit, LIMITATIONS)), F.array(F.format_string("Dataset size (%s pairs) is small; results may not generalise to all policy types.", F.col("total_count").cast("string")))).alias("limitations"),
        F.current_timestamp().alias("timestamp"),
    )


def format_report(report: DataFrame) -> str:
    """The console form of the report's few rows."""
    lines = []
    for r in report.orderBy("name").collect():
        lines.append(f"{r['name']:<10} precision {r['precision']:.4f}  recall {r['recall']:.4f}  f1 {r['f1']:.4f}  macro f1 {r['macro_f1']:.4f}  {r['correct_count']}/{r['total_count']}")
    return "\n".join(lines)
