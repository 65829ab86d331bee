"""Change signals and change types of clause pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.kernels import ratio_bound, ratio_or_error, sequence_ratio, similarity_ratio  # noqa: F401
from ..functions.text import all_matches, lstrip

#: Fixed patterns and word lists.
NUMERIC = r"(?U)\b\d+(?:\.\d+)?%?\b"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = (
    r"(?iU)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}"
    rf"|(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})\s+\d{{4}})\b"
)
MONEY = r"(?U)(?:Rs\.?\s*[\d,]+|\$[\d,]+(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s*(?:USD|GBP|EUR)\b)"
NEGATIONS = ("not", "no", "never", "neither", "nor", "except", "unless")
MODALS = ("shall", "must", "may", "should", "will", "can", "cannot")
CONDITIONS = ("if ", "unless ", "provided that", "subject to", "except where")
SECTION_NUMBER = r"(?U)\A(?:Section\s+)?[\d.]+(?:\s*[:.]?\s+)?"
SUBSTANTIVE = ("numeric_change", "date_change", "monetary_change", "negation_change", "modal_change")
UNCHANGED_AT, WORDING_AT, UNCERTAIN_BELOW = 0.98, 0.85, 0.60


def _listed(values: Column) -> Column:
    joined = F.array_join(values, ", ")
    return F.when(joined == "", "(none)").otherwise(joined)


def _signal(name: str, description: str, differs: Column, old: Column, new: Column) -> Column:
    return F.when(differs, F.struct(F.lit(name).alias("signal_type"), F.lit(description).alias("description"), old.alias("old_value"), new.alias("new_value")))


def _same_set(x: Column, y: Column) -> Column:
    return (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)


def _tokens_differ(name: str, description: str, old: Column, new: Column, pattern: str) -> Column:
    x, y = all_matches(old, pattern), all_matches(new, pattern)
    return _signal(name, description, ~_same_set(x, y), _listed(x), _listed(y))


def strip_section_number(text: Column) -> Column:
    return F.regexp_replace(lstrip(text), SECTION_NUMBER, "")


def numeric_signal(old: Column, new: Column) -> Column:
    return _tokens_differ("numeric_change", "Numeric values differ between versions", strip_section_number(old), strip_section_number(new), NUMERIC)


def date_signal(old: Column, new: Column) -> Column:
    return _tokens_differ("date_change", "Date references differ between versions", old, new, DATE)


def money_signal(old: Column, new: Column) -> Column:
    return _tokens_differ("monetary_change", "Monetary values differ between versions", old, new, MONEY)


def tokens(text: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(text), r"(?U)\b[a-z]+\b"))


def _words_signal(name: str, description: str, words: tuple[str, ...], old: Column, new: Column) -> Column:
    listed = F.array(*map(F.lit, words))
    x, y = F.array_intersect(listed, tokens(old)), F.array_intersect(listed, tokens(new))
    return _signal(name, description, ~_same_set(x, y), _listed(F.array_sort(F.array_except(x, y))), _listed(F.array_sort(F.array_except(y, x))))


def negation_signal(old: Column, new: Column) -> Column:
    return _words_signal("negation_change", "Negation words added or removed", NEGATIONS, old, new)


def modal_signal(old: Column, new: Column) -> Column:
    return _words_signal("modal_change", "Modal/obligation words changed", MODALS, old, new)


def _phrases(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, CONDITIONS)), lambda p: F.contains(text, p))


def condition_signal(old: Column, new: Column) -> Column:
    x, y = _phrases(F.lower(old)), _phrases(F.lower(new))
    return _signal("condition_change", "Conditional phrases added or removed", ~_same_set(x, y), _listed(x), _listed(y))


SIGNALS = (numeric_signal, date_signal, money_signal, negation_signal, modal_signal, condition_signal)


def signals(old: Column, new: Column) -> Column:
    """The signals in their fixed order. Null texts count as empty."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    # equal texts have none: their patterns are not run
    return F.when(a == b, F.array().cast("array<struct<signal_type: string, description: string, old_value: string, new_value: string>>")).otherwise(F.array_compact(F.array(*(s(a, b) for s in SIGNALS))))


def is_substantive(found: Column, config: Config = Config()) -> Column:
    weighty = SUBSTANTIVE + (("condition_change",) if config.conditions_are_substantive else ())
    return F.exists(found, lambda s: s["signal_type"].isin(*weighty))


def change_type(found: Column, ratio: Column, config: Config = Config()) -> Column:
    return (
        F.when(is_substantive(found, config), "substantive")
        .when(ratio >= UNCHANGED_AT, "unchanged")
        .when(ratio >= WORDING_AT, "wording_only")
        .when(ratio < UNCERTAIN_BELOW, "uncertain")
        .otherwise("wording_only")
    )


def settled_by(old: Column, new: Column, config: Config = Config()) -> Column:
    """What tells a clause pair's type: `equal`, `signals`, `bound` (the ratio must be under UNCERTAIN_BELOW) or `ratio`."""
    bound = ratio_bound(old, new) < UNCERTAIN_BELOW
    return F.when(old == new, "equal").when(is_substantive(signals(old, new), config), "signals").when(bound, "bound").otherwise("ratio")


def detect_changes(matches: DataFrame, config: Config = Config(), ratio: Callable[[str, str], float] = sequence_ratio) -> DataFrame:
    """matches(match_type, text_a, text_b, needs_review, review_reason, …) with signals, ratio, change_type, review and ratio_error.

    Added and removed clauses have no signals; a match without a second clause is uncertain. The ratio is only computed
    where the type, or its reason, depends on it: for pairs that differ without a substantive signal. Where it fails,
    ratio_error tells so, and the row's type counts for nothing.
    """
    kind = F.col("match_type")
    paired = ~kind.isin("added_candidate", "removed_candidate") & F.col("text_b").isNotNull()
    none = F.array().cast("array<struct<signal_type: string, description: string, old_value: string, new_value: string>>")
    found = matches.withColumn("signals", F.when(paired, signals(F.col("text_a"), F.col("text_b"))).otherwise(none))
    open_ = paired & ~is_substantive(F.col("signals"), config)
    asked = ratio_or_error(F.when(open_, F.col("text_a")), F.when(open_, F.col("text_b")), ratio)
    found = found.withColumn("_asked", asked).withColumns({"ratio": F.col("_asked.ratio"), "ratio_error": F.col("_asked.error")}).drop("_asked")
    by_text = change_type(F.col("signals"), F.coalesce("ratio", F.lit(0.5)), config)
    typed = found.withColumn("change_type", F.when(kind == "added_candidate", "added").when(kind == "removed_candidate", "removed").when(F.col("text_b").isNull(), "uncertain").otherwise(by_text))
    low = F.format_string("Low similarity (%.2f) with ambiguous signals — manual review required.", F.bround("ratio", 2))
    own = F.when(paired & (F.col("change_type") == "uncertain"), low).when(~paired & (F.col("change_type") == "uncertain"), "No clause_b.").otherwise("")
    match_review = paired & F.coalesce("needs_review", F.lit(False))
    reason = F.when(match_review, F.trim(F.concat_ws(" ", own, F.coalesce("review_reason", F.lit(""))))).otherwise(own)
    return typed.withColumn("review_reason", reason).withColumn("needs_review", (F.col("change_type") == "uncertain") | match_review)


def change_summary(changes: DataFrame, *keys: str) -> DataFrame:
    """Counts of each change type for each group; uncertain ones and those to be reviewed have their own columns."""
    count = lambda name: F.count_if(F.col("change_type") == name).alias(name)
    kinds = [count(k) for k in ("added", "removed", "substantive", "wording_only", "unchanged", "uncertain")]
    return changes.groupBy(*keys).agg(F.count("*").alias("total_changes"), *kinds, F.count_if("needs_review").alias("needs_review"))
