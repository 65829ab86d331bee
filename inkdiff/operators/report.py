"""Summaries, citations and report rows of changes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calls import WORKERS, call_each
from ..functions.text import strip
from ..schemas import CITATION

#: Fixed texts.
TEMPLATES = {
    "unchanged": "This clause is identical in both document versions. No changes detected.",
    "wording_only": "This clause has been reworded between versions but retains the same meaning. No substantive policy changes were detected.",
    "substantive": "This clause contains substantive changes that may affect policy obligations or rights.",
    "added": "This clause was added in the new document version and was not present previously.",
    "removed": "This clause was present in the original document but has been removed.",
    "uncertain": "The relationship between these clauses is ambiguous. Manual review is recommended.",
}
OTHER_TEMPLATE = "Change analysis result — see signals for details."
#: Fixed labels and colours: change type -> (label, label colour, row colour).
BADGES = {
    "unchanged": ("UNCHANGED", "#4caf50", "#fff"),
    "wording_only": ("WORDING ONLY", "#ff9800", "#fff9c4"),
    "substantive": ("SUBSTANTIVE", "#f44336", "#ffebee"),
    "added": ("ADDED", "#2196f3", "#e3f2fd"),
    "removed": ("REMOVED", "#e91e63", "#fce4ec"),
    "uncertain": ("NEEDS REVIEW", "#9c27b0", "#f3e5f5"),
}
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}
DETERMINISTIC_CONFIDENCE = 0.85
FAILED = "Summary generation failed."


def _lookup(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def summary_text(kind: Column, signals: Column) -> Column:
    told = lambda word, value: F.when((value != "") & (value != "(none)"), F.concat(F.lit(word), value))
    each = F.transform(signals, lambda s: F.concat_ws(" — ", s["description"], told("was: ", s["old_value"]), told("now: ", s["new_value"])))
    detected = F.when(F.size(signals) > 0, F.concat(F.lit(" Detected: "), F.array_join(each, "; "), F.lit("."))).otherwise("")
    return F.concat(_lookup(kind, TEMPLATES, OTHER_TEMPLATE), detected)


def deterministic_summary(kind: Column, signals: Column, fallback_reason: str = "") -> Column:
    return F.struct(
        summary_text(kind, signals).alias("summary"),
        kind.alias("classification_suggestion"),
        F.lit(DETERMINISTIC_CONFIDENCE).alias("confidence"),
        F.lit("deterministic").alias("provider_used"),
        F.lit(fallback_reason).alias("fallback_reason"),
    )


SUMMARY = "struct<summary: string, classification_suggestion: string, confidence: double, provider_used: string, fallback_reason: string>"


class Provider:
    """A source of summaries: `generate` gives a reply for each of some prompts, in their order; it may raise."""

    name = "provider"

    def is_available(self) -> bool:
        raise NotImplementedError

    def generate(self, prompts: list[str], timeout: int) -> list[str]:
        raise NotImplementedError


def generate_summaries(changes: DataFrame, providers: tuple[Provider, ...] = (), timeout: int = 10) -> DataFrame:
    """changes with `summary`. Providers are asked in their order; one that is unavailable or fails is passed over.

    Without providers all is native. With them, prompts go in batches to Python workers, and each prompt is a call of its
    own that may take `timeout` seconds (`call_each`), so one bad clause costs no other its summary. A provider that
    hangs is asked no more by that task. A clause that every provider fails on gets the deterministic text; each summary
    tells the last reason. A provider whose availability cannot be told leaves the text for a failed summary.
    """
    plain = deterministic_summary(F.col("change_type"), F.col("signals"))
    if not providers:
        return changes.withColumn("summary", plain)

    kind = pa.struct([("reply", pa.string()), ("name", pa.string()), ("reason", pa.string()), ("failed", pa.bool_())])

    dead: set[str] = set()

    def ask(prompts: pa.Array) -> pa.Array:
        return pa.array(ask_providers(prompts.to_pylist(), providers, timeout, dead, readable), kind)

    asked = changes.withColumn("_asked", F.arrow_udf(ask, "struct<reply: string, name: string, reason: string, failed: boolean>").asNondeterministic()(prompt(changes)))
    parsed = parse_reply(F.col("_asked.reply"))
    given = F.struct(parsed["summary"].alias("summary"), parsed["classification_suggestion"].alias("classification_suggestion"), parsed["confidence"].alias("confidence"), F.col("_asked.name").alias("provider_used"), F.col("_asked.reason").alias("fallback_reason"))
    other = plain.withField("fallback_reason", F.col("_asked.reason"))
    none = F.struct(F.lit(FAILED).alias("summary"), F.lit("").alias("classification_suggestion"), F.lit(0.0).alias("confidence"), F.lit("none").alias("provider_used"), F.col("_asked.reason").alias("fallback_reason"))
    return asked.withColumn("summary", F.when(F.col("_asked.failed"), none).when(F.col("_asked.reply").isNotNull(), given).otherwise(other)).drop("_asked")


def readable(reply: str) -> None:
    """Raises unless the reply is a JSON object, in a code fence or not."""
    text = reply.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```$", "", re.sub(r"^```[a-z]*\n?", "", text))
    if not isinstance(json.loads(text), dict):
        raise ValueError("the reply is no JSON object")


def ask_providers(
    prompts: list[str], providers: tuple[Provider, ...], timeout: float, dead: set[str] | None = None, check: Callable[[str], None] | None = None
) -> list[dict]:
    """For each prompt: reply (None if no provider gave one), name, the last reason to pass a provider over, and failed.

    dead: names of providers that gave no reply before; they are passed over, and those that hang now are added. check:
    raises on a reply that is of no use, which then counts as a failure of its provider.
    """
    out = [{"reply": None, "name": None, "reason": "", "failed": False} for _ in prompts]
    left, dead = list(range(len(prompts))), set() if dead is None else dead
    for p in providers:
        if p.name in dead:
            for k in left:
                out[k]["reason"] = f"{p.name} failed: it gave no reply before"
            continue
        (available,) = call_each(lambda _, p=p: bool(p.is_available()), [None], timeout, 1)
        if isinstance(available, TimeoutError):
            dead.add(p.name)
        elif isinstance(available, Exception):
            for k in left:
                out[k] |= {"reason": str(available), "failed": True}
            return out
        if available is not True:
            for k in left:
                out[k]["reason"] = f"{p.name} not available (no API key)" if available is False else f"{p.name} failed: {available}"
            continue
        replies = call_each(lambda prompt, p=p: _one_reply(p, prompt, timeout, check), [prompts[k] for k in left], timeout)
        for k, r in zip(left, replies, strict=True):
            if isinstance(r, Exception):
                out[k]["reason"] = f"{p.name} failed: {r}"
            else:
                out[k] |= {"reply": r, "name": p.name}
        if all(isinstance(r, TimeoutError) for r in replies) and len(replies) >= WORKERS:
            dead.add(p.name)
        left = [k for k in left if out[k]["reply"] is None]
        if not left:
            break
    return out


def _one_reply(provider: Provider, prompt: str, timeout: float, check: Callable[[str], None] | None) -> str:
    found = provider.generate([prompt], timeout)
    if len(found) != 1:
        raise ValueError(f"{len(found)} replies to 1 prompts")
    if check:
        check(found[0])
    return found[0]


def prompt(changes: DataFrame | None = None) -> Column:
    """The instruction for a language model; a missing second clause repeats the first one's place."""
    old = lambda c: F.coalesce(F.col(f"{c}_a"), F.col(f"{c}_b")).cast("string")
    new = lambda c: F.when(F.col("change_type").isin("added", "removed"), old(c)).otherwise(F.col(f"{c}_b").cast("string"))
    new_text = F.when(F.col("change_type").isin("added", "removed"), "(clause not present in new version)").otherwise(F.col("text_b"))
    told = F.array_join(F.transform("signals", lambda s: F.concat_ws(": ", s["signal_type"], s["description"])), "; ")
    head = lambda title, c: F.concat(F.lit(f"{title} CLAUSE ("), c("document_name"), F.lit(", Clause "), c("clause_id"), F.lit(", Page "), c("page_number"), F.lit("):\n"))
    return F.concat(
        head("OLD", old), old("text"), F.lit("\n\n"), head("NEW", new), new_text, F.lit("\n\nDETECTED SIGNALS: "), F.when(told == "", "none").otherwise(told),
        F.lit('\n\nRespond ONLY in JSON:\n{"summary": "...", "classification_suggestion": "wording_only|substantive|uncertain", "confidence": "high|medium|low"}\n\n'),
        F.lit("Do NOT invent citations, legal consequences, or information not in the text above."),
    )


def parse_reply(reply: Column) -> Column:
    """struct(summary, classification_suggestion, confidence) of a model's JSON reply, in a code fence or not."""
    plain = strip(reply)
    bare = F.when(F.startswith(plain, F.lit("```")), F.regexp_replace(F.regexp_replace(plain, r"\A```[a-z]*\n?", ""), r"\n?```\z", "")).otherwise(plain)
    fields = F.from_json(bare, "summary string, classification_suggestion string, confidence string")
    rated = _lookup(F.lower(F.coalesce(fields["confidence"], F.lit("medium"))), CONFIDENCE, 0.7)
    return F.struct(F.coalesce(fields["summary"], F.lit("")).alias("summary"), F.coalesce(fields["classification_suggestion"], F.lit("")).alias("classification_suggestion"), rated.alias("confidence"))


def citation(side: str) -> Column:
    fields = {"document_id": "document_id", "document_name": "document_name", "clause_id": "clause_id", "heading": "heading", "page_number": "page_number", "original_text": "exact_text"}
    return F.struct(*(F.col(f"{c}_{side}").alias(name) for c, name in fields.items()), F.lit(True).alias("citation_valid"), F.lit("").alias("warning"))


def attach_citations(changes: DataFrame) -> DataFrame:
    """changes with citations: of the new clause if it was added, of the old one if removed, else of both."""
    a, b = (F.when(F.col(f"clause_id_{s}").isNotNull(), citation(s)) for s in "ab")
    return changes.withColumn("citations", F.array_compact(F.array(a, b)).cast(f"array<{CITATION}>"))


def validate_citations(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """citations(document_id, clause_id, page_number, exact_text, …) with citation_valid and the first failing check."""
    truth = clauses.select("document_id", "clause_id", F.col("page_number").alias("_page"), F.col("original_text").alias("_text"), F.lit(True).alias("_known"))
    joined = citations.join(truth, ["document_id", "clause_id"], "left")
    page = F.concat(F.lit("Page number mismatch: citation says page "), F.col("page_number").cast("string"), F.lit(" but clause records page "), F.col("_page").cast("string"), F.lit("."))
    warning = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("clause_id '"), F.col("clause_id"), F.lit("' not found in the provided clause list.")))
        .when(~F.col("page_number").eqNullSafe(F.col("_page")), page)
        .when(~F.col("exact_text").eqNullSafe(F.col("_text")), F.concat(F.lit("Text mismatch: citation text does not match the clause's original_text (clause_id="), F.col("clause_id"), F.lit(").")))
        .otherwise("")
    )
    return joined.withColumn("warning", warning).withColumn("citation_valid", F.col("warning") == "").drop("_page", "_text", "_known")


def _citations_of(document: Column) -> Column:
    return F.transform(F.filter("citations", lambda c: c["document_id"] == document), lambda c: F.struct(c["page_number"].alias("page"), c["citation_valid"].alias("valid")))


def report_rows(changes: DataFrame) -> DataFrame:
    """The display fields of each change. An added clause fills the first slot, as readers of the report expect it."""
    added = F.col("change_type") == "added"
    first = lambda c: F.when(added, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    second = lambda c: F.when(~added, F.col(f"{c}_b"))
    badge = lambda n, other: _lookup(F.col("change_type"), {k: v[n] for k, v in BADGES.items()}, other)
    shown = F.transform("signals", lambda s: F.struct(F.initcap(F.replace(s["signal_type"], F.lit("_"), F.lit(" "))).alias("type"), s["description"].alias("desc"), s["old_value"].alias("old"), s["new_value"].alias("new")))
    heading = first("heading")
    return changes.select(
        "pair_id", "phase", "a_ordinal", "b_ordinal", "change_type",
        badge(0, "UNKNOWN").alias("badge_label"), badge(1, "#999").alias("badge_color"), badge(2, "#fff").alias("bg_color"),
        F.when(F.coalesce(heading, F.lit("")) == "", "(no heading)").otherwise(heading).alias("heading_a"),
        F.coalesce(second("heading"), F.lit("—")).alias("heading_b"),
        first("text").alias("text_a"), F.coalesce(second("text"), F.lit("")).alias("text_b"),
        first("page_number").alias("page_a"), second("page_number").alias("page_b"),
        first("document_name").alias("doc_a"), F.coalesce(second("document_name"), F.lit("")).alias("doc_b"),
        F.bround(F.coalesce("match_score", F.lit(0.0)) * 100, 1).alias("match_score"),
        shown.alias("signals"), F.col("summary.summary").alias("summary"), F.col("summary.provider_used").alias("provider"), "needs_review",
        _citations_of(first("document_id")).alias("citations_a"), _citations_of(second("document_id")).alias("citations_b"),
    )


def search_rows(rows: DataFrame, kind: str = "all", query: str = "") -> DataFrame:
    """Rows of one change type (or all) in whose headings and texts the query stands, regardless of case."""
    text = F.lower(F.concat_ws(" ", "heading_a", "heading_b", "text_a", "text_b"))
    return rows.where((F.lit(kind) == "all") | (F.col("change_type") == kind)).where(F.contains(text, F.lower(F.lit(query))))


def to_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)
