"""Queries over the derived two-version corpus: segmentation, features, alignment, changes, reports, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..corpus import clauses, duck
from ..operators import align, detect, evaluate, layout, report, segment

QUERIES: dict = {}
SQL: dict[str, str] = {}
CONFIG = Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- clauses aligned by their place ---------------------------------------------------------------------------------


def keyed_pairs(spark, sf_dir: str) -> DataFrame:
    """A and B clauses of one place side by side: a full outer join on the clause's key."""
    c = clauses(spark, sf_dir)
    a = c.where("side = 'a'").select("pair_id", "ordinal", "k", F.col("heading").alias("heading_a"), F.col("text").alias("text_a"))
    b = c.where("side = 'b'").select("pair_id", "ordinal", "k", F.col("heading").alias("heading_b"), F.col("text").alias("text_b"))
    kind = F.when(F.col("text_b").isNull(), "removed_candidate").when(F.col("text_a").isNull(), "added_candidate").otherwise("hybrid")
    return a.join(b, ["pair_id", "ordinal", "k"], "full_outer").withColumn("match_type", kind).withColumns({"needs_review": F.lit(False), "review_reason": F.lit("")})


def changes(spark, sf_dir: str) -> DataFrame:
    return detect.detect_changes(keyed_pairs(spark, sf_dir))


_KIND = "CASE WHEN k = 11 THEN 'added' WHEN k = 12 THEN 'removed' WHEN k BETWEEN 6 AND 10 THEN 'substantive' WHEN k IN (13, 14) THEN 'wording_only' WHEN k = 15 THEN 'uncertain' ELSE 'unchanged' END"
_PLACES = f"{duck()}, places AS (SELECT DISTINCT pair_id, ordinal, k, {_KIND} AS change_type FROM corpus)"
_PAIRED = f"{duck()}, paired AS (SELECT a.pair_id, a.ordinal, a.k, a.text AS old, b.text AS new FROM corpus a JOIN corpus b USING (pair_id, ordinal) WHERE a.side = 'a' AND b.side = 'b')"


@query(
    f"""{_PLACES} SELECT pair_id, count(*) AS total_changes, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed,
    count(*) FILTER (change_type = 'substantive') AS substantive, count(*) FILTER (change_type = 'wording_only') AS wording_only, count(*) FILTER (change_type = 'unchanged') AS unchanged,
    count(*) FILTER (change_type = 'uncertain') AS uncertain, count(*) FILTER (change_type = 'uncertain') AS needs_review FROM places GROUP BY pair_id"""
)
def change_summary(spark, sf_dir):
    return detect.change_summary(changes(spark, sf_dir), "pair_id")


@query(f"{_PLACES} SELECT pair_id, ordinal, change_type, change_type = 'uncertain' AS needs_review FROM places")
def change_rows(spark, sf_dir):
    return changes(spark, sf_dir).select("pair_id", "ordinal", "change_type", "needs_review")


def _signal(name: str, make, when: str, old: str, new: str, description: str):
    def run(spark, sf_dir):
        rows = keyed_pairs(spark, sf_dir).where("match_type = 'hybrid'")
        found = rows.withColumn("s", make(F.col("text_a"), F.col("text_b"))).where("s is not null")
        return found.select("pair_id", "ordinal", "s.signal_type", "s.description", "s.old_value", "s.new_value")

    QUERIES[f"signals_{name}"] = run
    kind = {"numeric": "numeric_change", "date": "date_change", "money": "monetary_change", "negation": "negation_change", "modal": "modal_change", "condition": "condition_change"}[name]
    SQL[f"signals_{name}"] = f"{_PAIRED} SELECT pair_id, ordinal, '{kind}' AS signal_type, '{description}' AS description, {old} AS old_value, {new} AS new_value FROM paired WHERE {when}"


_NUMBERS = "array_to_string(list_filter(regexp_extract_all({0}, '[A-Za-z]?[0-9]+(\\.[0-9]+)?'), lambda x: regexp_matches(x, '^[0-9]')), ', ')"
_signal("numeric", detect.numeric_signal, "k IN (6, 9, 10)", _NUMBERS.format("old"), _NUMBERS.format("new"), "Numeric values differ between versions")
_signal("date", detect.date_signal, "k = 9", "'5 March 2024'", "'6 April 2025'", "Date references differ between versions")
_signal("money", detect.money_signal, "k = 10", "regexp_extract(old, '\\$[0-9]+')", "regexp_extract(new, '\\$[0-9]+')", "Monetary values differ between versions")
_signal("negation", detect.negation_signal, "k = 7", "'(none)'", "'not'", "Negation words added or removed")
_signal("modal", detect.modal_signal, "k = 8", "'must'", "'may'", "Modal/obligation words changed")
_signal("condition", detect.condition_signal, "k = 14", "'(none)'", "'provided that'", "Conditional phrases added or removed")


@query()
def ratio_bands(spark, sf_dir):
    """How many pairs fall in each band of the ratio, which is computed for all of them here."""
    both = keyed_pairs(spark, sf_dir).where("match_type = 'hybrid'").withColumn("ratio", detect.similarity_ratio(F.col("text_a"), F.col("text_b")))
    r = F.col("ratio")
    band = F.when(r >= detect.UNCHANGED_AT, "unchanged").when(r >= detect.WORDING_AT, "wording").when(r < detect.UNCERTAIN_BELOW, "uncertain").otherwise("wording, low")
    return both.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


_LETTER = "least(length(old) - length(replace(old, c, '')), length(new) - length(replace(new, c, '')))"
_OTHERS = "least(length(regexp_replace(old, '[a-z 0-9]', '', 'g')), length(regexp_replace(new, '[a-z 0-9]', '', 'g')))"
_BOUND = f"2.0 * ({_OTHERS} + list_sum([{_LETTER} FOR c IN string_split('abcdefghijklmnopqrstuvwxyz 0123456789', '')])) / (length(old) + length(new))"


@query(
    f"""{_PAIRED}, told AS (SELECT CASE WHEN old = new THEN 'equal' WHEN k BETWEEN 6 AND 10 THEN 'signals' WHEN {_BOUND} < 0.6 THEN 'bound' ELSE 'ratio' END AS settled_by FROM paired)
    SELECT settled_by, count(*) AS n FROM told GROUP BY settled_by"""
)
def ratio_settled(spark, sf_dir):
    """What settles the type of each pair of texts: only those told by the ratio need Python for it."""
    both = keyed_pairs(spark, sf_dir).where("match_type = 'hybrid'")
    return both.groupBy(detect.settled_by(F.col("text_a"), F.col("text_b")).alias("settled_by")).agg(F.count("*").alias("n"))


@query(f"{_PLACES} SELECT change_type, count(*) AS n FROM places GROUP BY change_type")
def change_classification(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("change_type").agg(F.count("*").alias("n"))


@query(f"{_PLACES} SELECT 'pair' AS scope, kinds.change_type, (SELECT count(*) FROM places p WHERE p.change_type = kinds.change_type) AS n FROM (SELECT unnest(['added', 'removed', 'substantive', 'wording_only', 'unchanged']) AS change_type) kinds")
def stat_cards(spark, sf_dir):
    """The five shown change types in their order, 0 where there are none."""
    counts = changes(spark, sf_dir).groupBy("change_type").agg(F.count("*").alias("n"))
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("added", "removed", "substantive", "wording_only", "unchanged")))).alias("change_type"))
    return kinds.join(counts, "change_type", "left").select(F.lit("pair").alias("scope"), "change_type", F.coalesce("n", F.lit(0)).alias("n"))


# --- features and scores ------------------------------------------------------------------------------------------

_TERMS = rf"""{duck()}, words AS (SELECT pair_id, side, ordinal, regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+') AS w FROM corpus),
terms AS (SELECT pair_id, side, ordinal, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT pair_id, side, ordinal, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT pair_id, count(*) AS n FROM corpus GROUP BY pair_id),
df AS (SELECT pair_id, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY total DESC, term) AS rank FROM df),
raw AS (SELECT tf.pair_id, side, ordinal, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS raw FROM tf JOIN ranked USING (pair_id, term) JOIN sizes USING (pair_id) WHERE rank <= 5000),
weights AS (SELECT pair_id, side, ordinal, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY pair_id, side, ordinal)) AS weight FROM raw),
cosines AS (SELECT a.pair_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal, least(1.0::DOUBLE, sum(a.weight * b.weight)) AS s
            FROM weights a JOIN weights b USING (pair_id, term) WHERE a.side = 'a' AND b.side = 'b' GROUP BY ALL)"""


@query(f"{_TERMS} SELECT pair_id, side, ordinal, count(*) AS n_terms, round(sum(weight), 5) AS total, round(max(weight), 5) AS largest FROM weights GROUP BY ALL")
def tfidf_terms(spark, sf_dir):
    w = align.tfidf_terms(clauses(spark, sf_dir))
    return w.groupBy("pair_id", "side", "ordinal").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("largest"))


_CAP = 300


@query(f"{_TERMS.replace('rank <= 5000', f'rank <= {_CAP}')} SELECT pair_id, a_ordinal, b_ordinal, round(s, 5) AS tfidf_score FROM cosines")
def tfidf_capped(spark, sf_dir):
    """Scores by the most frequent terms of each pair alone, fewer than it has."""
    found = align.tfidf_cosine(clauses(spark, sf_dir), Config(max_terms=_CAP))
    return found.withColumn("tfidf_score", F.round("tfidf_score", 5))


@query(f"{_TERMS} SELECT pair_id, a_ordinal, b_ordinal, round(s, 5) AS tfidf_score FROM cosines")
def tfidf_cosine(spark, sf_dir):
    return align.tfidf_cosine(clauses(spark, sf_dir)).withColumn("tfidf_score", F.round("tfidf_score", 5))


@query(
    """SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def embedding_cosine(spark, sf_dir):
    """Each vector against the next one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = v.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(align.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


@query(
    f"""{duck()} SELECT pair_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal,
    CASE WHEN a.ordinal = b.ordinal THEN 1.0::DOUBLE WHEN starts_with(CAST(a.ordinal + 1 AS VARCHAR), CAST(b.ordinal + 1 AS VARCHAR)) OR starts_with(CAST(b.ordinal + 1 AS VARCHAR), CAST(a.ordinal + 1 AS VARCHAR)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS number_score
    FROM corpus a JOIN corpus b USING (pair_id) WHERE a.side = 'a' AND b.side = 'b'"""
)
def number_score(spark, sf_dir):
    c = clauses(spark, sf_dir)
    side = lambda s: c.where(F.col("side") == s).select("pair_id", F.col("ordinal").alias(f"{s}_ordinal"), align.clause_number(F.col("heading")).alias(f"n_{s}"))
    return side("a").join(side("b"), "pair_id").select("pair_id", "a_ordinal", "b_ordinal", F.coalesce(align.number_score(F.col("n_a"), F.col("n_b")), F.lit(0.0)).alias("number_score"))


#: The longest common subsequence of two headings, a bit for each place of the second one: zero bits of the last state.
_HEADED = f"""{_TERMS},
heads AS (SELECT pair_id, side, ordinal, h, length(h) AS n,
    map_from_entries(list_transform(list_distinct(string_split(h, '')), lambda c: struct_pack(key := c, value := list_sum(list_transform(range(0, length(h)), lambda i: CASE WHEN h[i + 1] = c THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT))) AS places
    FROM (SELECT pair_id, side, ordinal, array_to_string(list_sort(list_filter(string_split(heading, ' '), lambda w: w <> '')), ' ') AS h FROM corpus)),
headed AS (SELECT a.pair_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal,
    CASE WHEN a.ordinal = b.ordinal THEN 1.0::DOUBLE WHEN starts_with(CAST(a.ordinal + 1 AS VARCHAR), CAST(b.ordinal + 1 AS VARCHAR)) OR starts_with(CAST(b.ordinal + 1 AS VARCHAR), CAST(a.ordinal + 1 AS VARCHAR)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS number_score,
    CASE WHEN a.h = b.h THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (b.n - bit_count(list_reduce(list_prepend((1::HUGEINT << b.n::INT) - 1, list_transform(string_split(a.h, ''), lambda c: coalesce(b.places[c], 0::HUGEINT))),
        lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << b.n::INT) - 1)))) / (a.n + b.n) END AS heading_score
    FROM heads a JOIN heads b USING (pair_id) WHERE a.side = 'a' AND b.side = 'b'),
scored AS (SELECT pair_id, a_ordinal, b_ordinal, number_score, heading_score, coalesce(s, 0.0::DOUBLE) AS tfidf_score,
    0.2::DOUBLE * number_score + 0.3::DOUBLE * heading_score + 0.5::DOUBLE * coalesce(s, 0.0::DOUBLE) AS match_score FROM headed LEFT JOIN cosines USING (pair_id, a_ordinal, b_ordinal))"""


@query(f"{_HEADED} SELECT pair_id, a_ordinal, b_ordinal, number_score, heading_score, round(tfidf_score, 5) AS tfidf_score, round(match_score, 5) AS match_score FROM scored")
def hybrid_score(spark, sf_dir):
    """Scores of all clause pairs of each document pair."""
    s = align.score_pairs(clauses(spark, sf_dir))
    return s.select("pair_id", "a_ordinal", "b_ordinal", "number_score", "heading_score", F.round("tfidf_score", 5).alias("tfidf_score"), F.round("match_score", 5).alias("match_score"))


@query(f"{_HEADED} SELECT CAST(floor(heading_score * 10) AS BIGINT) AS tenth, count(*) AS n FROM scored GROUP BY ALL")
def heading_score(spark, sf_dir):
    """Similarity of the headings of all clause pairs, in tenths."""
    s = align.score_pairs(clauses(spark, sf_dir))
    return s.groupBy(F.floor(F.col("heading_score") * 10).alias("tenth")).agg(F.count("*").alias("n"))


@query(f"{_HEADED} SELECT CASE WHEN match_score >= 0.5 THEN 'hybrid' WHEN match_score >= 0.35 THEN 'needs_review' END AS match_type, count(*) AS n FROM scored GROUP BY ALL")
def match_bands(spark, sf_dir):
    """How many of all clause pairs fall in each band; null is below the review threshold."""
    s = align.score_pairs(clauses(spark, sf_dir))
    return s.groupBy(align.match_type(F.col("match_score"), CONFIG).alias("match_type")).agg(F.count("*").alias("n"))


@query(f"{_HEADED} SELECT pair_id, a_ordinal, count(*) FILTER (match_score >= 0.35) AS candidates FROM scored GROUP BY ALL")
def restructure_flags(spark, sf_dir):
    return align.restructure_counts(align.score_pairs(clauses(spark, sf_dir)), CONFIG)


_MATCHED = f"""{duck()}, a AS (SELECT * FROM corpus WHERE side = 'a'), b AS (SELECT * FROM corpus WHERE side = 'b'),
matched AS (SELECT pair_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal, CASE WHEN a.ordinal IS NULL THEN 'added_candidate' WHEN b.ordinal IS NULL THEN 'removed_candidate' ELSE 'hybrid' END AS match_type
            FROM a FULL JOIN b USING (pair_id, ordinal))"""


_MOVED = f"""{duck("base")}, corpus AS (SELECT pair_id, side, CASE WHEN side = 'b' THEN 39 - ordinal ELSE ordinal END AS ordinal, k, CASE WHEN side = 'b' AND k = 13 THEN '' ELSE heading END AS heading, text FROM base){_TERMS.removeprefix(duck())},
a AS (SELECT pair_id, ordinal AS place, ordinal, k FROM corpus WHERE side = 'a'), b AS (SELECT pair_id, 39 - ordinal AS place, ordinal, k FROM corpus WHERE side = 'b'),
placed AS (SELECT pair_id, a.ordinal AS a_ordinal, b.ordinal AS b_ordinal, coalesce(a.k, b.k) AS k FROM a FULL JOIN b USING (pair_id, place))"""


@query(
    f"""{_MOVED} SELECT pair_id, a_ordinal, b_ordinal, CASE WHEN a_ordinal IS NULL THEN 'added_candidate' WHEN b_ordinal IS NULL THEN 'removed_candidate' WHEN k = 13 AND 0.5 * s < 0.5 THEN 'needs_review' ELSE 'hybrid' END AS match_type,
    CASE WHEN k = 13 THEN round(0.5 * s, 5) END AS by_text_alone FROM placed LEFT JOIN cosines USING (pair_id, a_ordinal, b_ordinal)"""
)
def moved_match(spark, sf_dir):
    """Version B in reverse order, some of its headings lost: clauses are found at other places, and by their text alone."""
    c = clauses(spark, sf_dir)
    b = F.col("side") == "b"
    moved = c.withColumn("ordinal", F.when(b, 39 - F.col("ordinal")).otherwise(F.col("ordinal"))).withColumn("heading", F.when(b & (F.col("k") == 13), "").otherwise(F.col("heading")))
    lost = c.where("side = 'a' and k = 13").select("pair_id", F.col("ordinal").alias("a_ordinal"), F.lit(True).alias("lost"))
    found = align.hybrid_match(moved).join(lost, ["pair_id", "a_ordinal"], "left")
    return found.select("pair_id", "a_ordinal", "b_ordinal", "match_type", F.when(F.col("lost"), F.round("match_score", 5)).alias("by_text_alone"))


@query(f"{_MATCHED} SELECT * FROM matched")
def hybrid_match(spark, sf_dir):
    return align.hybrid_match(clauses(spark, sf_dir)).select("pair_id", "a_ordinal", "b_ordinal", "match_type")


@query()
def baseline_match(spark, sf_dir):
    return align.baseline_match(clauses(spark, sf_dir)).select("pair_id", "a_ordinal", "b_ordinal", "match_type", F.round("match_score", 5).alias("match_score"))


@query(f"{_MATCHED} SELECT pair_id, match_type, string_agg(CAST(coalesce(a_ordinal, b_ordinal) AS VARCHAR), ',' ORDER BY coalesce(a_ordinal, b_ordinal)) AS ordinals FROM matched WHERE match_type <> 'hybrid' GROUP BY ALL")
def added_removed(spark, sf_dir):
    m = align.hybrid_match(clauses(spark, sf_dir)).where(F.col("match_type").isin("added_candidate", "removed_candidate"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.coalesce("a_ordinal", "b_ordinal"))), lambda x: x.cast("string")), ",")
    return m.groupBy("pair_id", "match_type").agg(listed.alias("ordinals"))


# --- reports ------------------------------------------------------------------------------------------------------


def reported(spark, sf_dir) -> DataFrame:
    """Changes of the keyed pairs with the fields of both clauses."""
    c = changes(spark, sf_dir)
    side = lambda s: {f"document_id_{s}": F.concat("pair_id", F.lit(f"_{s}")), f"document_name_{s}": F.concat("pair_id", F.lit(f" {s}")), f"clause_id_{s}": F.when(F.col(f"text_{s}").isNotNull(), F.format_string(f"%s_{s}_clause_%04d", "pair_id", "ordinal")), f"page_number_{s}": (F.col("ordinal") / 10).cast("int") + 1, f"original_text_{s}": F.col(f"text_{s}")}
    return c.withColumns(side("a") | side("b") | {"phase": F.lit(0), "a_ordinal": F.col("ordinal"), "b_ordinal": F.col("ordinal"), "match_score": F.lit(1.0)})


_TEMPLATE = "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in report.TEMPLATES.items()) + " END"


#: The signals of two texts found by their words alone: type, description, and what was and is.
_MONEY = "regexp_extract({0}, '\\$[0-9]+')"
_DATE = "regexp_extract({0}, '[0-9]+ (March|April) [0-9]+')"
_HAS = "regexp_matches({0}, '{1}')"
_TOLD = f"""list_filter([
    CASE WHEN {_NUMBERS.format("old")} <> {_NUMBERS.format("new")} THEN ['numeric_change', 'Numeric values differ between versions', 'was: ' || {_NUMBERS.format("old")} || ' — now: ' || {_NUMBERS.format("new")}] END,
    CASE WHEN {_DATE.format("old")} <> {_DATE.format("new")} THEN ['date_change', 'Date references differ between versions', 'was: ' || {_DATE.format("old")} || ' — now: ' || {_DATE.format("new")}] END,
    CASE WHEN {_MONEY.format("old")} <> {_MONEY.format("new")} THEN ['monetary_change', 'Monetary values differ between versions', 'was: ' || {_MONEY.format("old")} || ' — now: ' || {_MONEY.format("new")}] END,
    CASE WHEN {_HAS.format("new", " not ")} AND NOT {_HAS.format("old", " not ")} THEN ['negation_change', 'Negation words added or removed', 'now: not'] END,
    CASE WHEN {_HAS.format("old", " must ")} AND {_HAS.format("new", " may ")} THEN ['modal_change', 'Modal/obligation words changed', 'was: must — now: may'] END,
    CASE WHEN {_HAS.format("new", "provided that")} AND NOT {_HAS.format("old", "provided that")} THEN ['condition_change', 'Conditional phrases added or removed', 'now: provided that'] END], lambda x: x IS NOT NULL)"""
_SIGNALLED = f"""{_PAIRED}, told AS (SELECT *, {_TOLD} AS told FROM paired), places AS (SELECT DISTINCT pair_id, ordinal, k, {_KIND} AS change_type FROM corpus)"""


@query(
    f"""{_SIGNALLED}, kinds AS (SELECT pair_id, ordinal, unnest(told)[1] AS signal_type, unnest(told)[3] AS told_values FROM told)
    SELECT pair_id, ordinal, signal_type, told_values FROM kinds"""
)
def signals_told(spark, sf_dir):
    """All signals of all pairs of texts; the statement reads them from the texts too."""
    both = keyed_pairs(spark, sf_dir).where("match_type = 'hybrid'")
    rows = both.select("pair_id", "ordinal", F.explode(detect.signals(F.col("text_a"), F.col("text_b"))).alias("s"))
    value = lambda name, word: F.when(F.col(f"s.{name}") != "(none)", F.concat(F.lit(f"{word}: "), F.col(f"s.{name}")))
    return rows.select("pair_id", "ordinal", "s.signal_type", F.concat_ws(" — ", value("old_value", "was"), value("new_value", "now")).alias("told_values"))


@query(
    f"""{_SIGNALLED} SELECT pair_id, ordinal, {_TEMPLATE} || CASE WHEN len(told) > 0 THEN ' Detected: ' || array_to_string(list_transform(told, lambda x: x[2] || ' — ' || x[3]), '; ') || '.' ELSE '' END AS summary,
    0.85::DOUBLE AS confidence, 'deterministic' AS provider_used FROM places LEFT JOIN told USING (pair_id, ordinal)"""
)
def summaries(spark, sf_dir):
    s = report.generate_summaries(changes(spark, sf_dir))
    return s.select("pair_id", "ordinal", "summary.summary", "summary.confidence", "summary.provider_used")


@query(
    f"""{_SIGNALLED} SELECT pair_id, ordinal, 'OLD CLAUSE (' || pair_id || ' a, Clause ' || pair_id || '_a_clause_' || lpad(CAST(ordinal AS VARCHAR), 4, '0') || ', Page ' || CAST(ordinal // 10 + 1 AS VARCHAR) || '):' || chr(10) || old || chr(10) || chr(10)
    || 'NEW CLAUSE (' || pair_id || ' b, Clause ' || pair_id || '_b_clause_' || lpad(CAST(ordinal AS VARCHAR), 4, '0') || ', Page ' || CAST(ordinal // 10 + 1 AS VARCHAR) || '):' || chr(10) || new || chr(10) || chr(10)
    || 'DETECTED SIGNALS: ' || CASE WHEN len(told) > 0 THEN array_to_string(list_transform(told, lambda x: x[1] || ': ' || x[2]), '; ') ELSE 'none' END || chr(10) || chr(10) || 'Respond ONLY in JSON:' || chr(10)
    || '{{"summary": "...", "classification_suggestion": "wording_only|substantive|uncertain", "confidence": "high|medium|low"}}' || chr(10) || chr(10)
    || 'Do NOT invent citations, legal consequences, or information not in the text above.' AS prompt FROM told"""
)
def prompts(spark, sf_dir):
    """The whole prompt of each pair, with its signals and instructions."""
    return reported(spark, sf_dir).where("match_type = 'hybrid'").select("pair_id", "ordinal", report.prompt().alias("prompt"))


@query(
    """SELECT conv_id, turn, 'turn ' || CAST(turn AS VARCHAR) AS summary, CASE WHEN turn % 2 = 0 THEN 'substantive' ELSE '' END AS classification_suggestion,
    CASE turn % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM conversations"""
)
def reply_parse(spark, sf_dir):
    """Model replies, half of them in a code fence, read back."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("turn").cast("string")
    rating = F.element_at(F.array(F.lit('"High"'), F.lit('"medium"'), F.lit('"low"'), F.lit('"none"')), (F.col("turn") % 4).cast("int") + 1)
    body = F.concat(F.lit('{"summary": "turn '), t, F.lit('", "confidence": '), rating, F.when(F.col("turn") % 2 == 0, ', "classification_suggestion": "substantive"').otherwise(""), F.lit("}"))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.select("conv_id", "turn", report.parse_reply(text).alias("r")).select("conv_id", "turn", "r.*")


@query(
    """SELECT conv_id, turn, coalesce(text, '') AS summary, CASE WHEN length(text) % 3 = 0 THEN 'uncertain' ELSE 'wording_only' END AS classification_suggestion,
    CASE length(text) % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM conversations"""
)
def reply_texts(spark, sf_dir):
    """Every turn's own text as the summary of a model's JSON reply, fenced or not, read back."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text") % 3
    told = F.struct(
        F.col("text").alias("summary"),
        F.when(n == 0, "uncertain").otherwise("wording_only").alias("classification_suggestion"),
        F.when(n == 0, "HIGH").when(n == 1, "low").alias("confidence"),
    )
    reply = F.when(n == 1, F.to_json(told)).otherwise(F.concat(F.lit("\n```json\n"), F.to_json(told), F.lit("\n```")))
    return c.select("conv_id", "turn", report.parse_reply(reply).alias("r")).select("conv_id", "turn", "r.*")


@query(
    f"""{duck()}, cited AS (SELECT pair_id || '_' || side AS document_id, pair_id || '_' || side || '_clause_' || lpad(CAST(ordinal AS VARCHAR), 4, '0') AS clause_id, ordinal, ordinal // 10 + 1 AS page FROM corpus)
    SELECT document_id, CASE WHEN ordinal % 10 = 1 THEN clause_id || 'x' ELSE clause_id END AS clause_id, ordinal % 10 > 3 OR ordinal % 10 = 0 AS citation_valid,
    CASE ordinal % 10 WHEN 1 THEN 'clause_id ''' || clause_id || 'x'' not found in the provided clause list.' WHEN 2 THEN 'Page number mismatch: citation says page ' || CAST(page + 1 AS VARCHAR) || ' but clause records page ' || CAST(page AS VARCHAR) || '.'
    WHEN 3 THEN 'Text mismatch: citation text does not match the clause''s original_text (clause_id=' || clause_id || ').' ELSE '' END AS warning FROM cited"""
)
def citations_valid(spark, sf_dir):
    """Citations of all clauses, some with a wrong clause, page or text."""
    c = clauses(spark, sf_dir)
    doc = F.concat("pair_id", F.lit("_"), "side")
    truth = c.select(doc.alias("document_id"), F.format_string("%s_clause_%04d", doc, "ordinal").alias("clause_id"), "ordinal", ((F.col("ordinal") / 10).cast("int") + 1).alias("page_number"), F.col("text").alias("original_text"))
    turn = F.col("ordinal") % 10
    cited = truth.select(
        "document_id",
        F.when(turn == 1, F.concat("clause_id", F.lit("x"))).otherwise(F.col("clause_id")).alias("clause_id"),
        (F.col("page_number") + F.when(turn == 2, 1).otherwise(0)).alias("page_number"),
        F.when(turn == 3, F.lower("original_text")).otherwise(F.col("original_text")).alias("exact_text"),
    )
    return report.validate_citations(cited, truth).select("document_id", "clause_id", "citation_valid", "warning")


_BADGE = lambda n: "CASE change_type " + " ".join(f"WHEN '{k}' THEN '{v[n]}'" for k, v in report.BADGES.items()) + " END"
_SHOWN = f"""{_PLACES}, shown AS (SELECT p.pair_id, p.ordinal, p.change_type, coalesce(a.heading, b.heading) AS heading_a, CASE WHEN p.change_type <> 'added' AND b.heading IS NOT NULL THEN b.heading ELSE '—' END AS heading_b,
    coalesce(a.text, b.text) AS text_a, CASE WHEN p.change_type <> 'added' THEN coalesce(b.text, '') ELSE '' END AS text_b
    FROM places p LEFT JOIN (SELECT * FROM corpus WHERE side = 'a') a USING (pair_id, ordinal) LEFT JOIN (SELECT * FROM corpus WHERE side = 'b') b USING (pair_id, ordinal))"""


def _rows(spark, sf_dir):
    return report.report_rows(report.attach_citations(report.generate_summaries(reported(spark, sf_dir))))


@query(f"{_SHOWN} SELECT pair_id, ordinal AS a_ordinal, change_type, {_BADGE(0)} AS badge_label, {_BADGE(2)} AS bg_color, heading_a, heading_b, text_a, text_b, 100.0::DOUBLE AS match_score, CASE WHEN change_type IN ('added', 'removed') THEN 1 ELSE 2 END AS n_citations FROM shown")
def result_rows(spark, sf_dir):
    r = _rows(spark, sf_dir)
    return r.select("pair_id", "a_ordinal", "change_type", "badge_label", "bg_color", "heading_a", "heading_b", "text_a", "text_b", "match_score", (F.size("citations_a") + F.coalesce(F.size("citations_b"), F.lit(0))).alias("n_citations"))


@query(f"{_SHOWN} SELECT upper(change_type) AS change_type, heading_a, pair_id, ordinal AS a_ordinal FROM shown ORDER BY pair_id, ordinal LIMIT 10")
def row_preview(spark, sf_dir):
    """The first ten rows of the report."""
    shown = _rows(spark, sf_dir).orderBy("pair_id", "a_ordinal").limit(10)
    return shown.select(F.upper("change_type").alias("change_type"), "heading_a", "pair_id", "a_ordinal")


@query(f"{_SHOWN} SELECT pair_id, ordinal AS a_ordinal FROM shown WHERE change_type = 'substantive' AND contains(lower(concat_ws(' ', heading_a, heading_b, text_a, text_b)), lower('MAY ship'))")
def row_search(spark, sf_dir):
    return report.search_rows(_rows(spark, sf_dir), "substantive", "MAY ship").select("pair_id", "a_ordinal")


@query(f"{_PLACES} SELECT '{{\"pair_id\":\"' || pair_id || '\",\"ordinal\":' || CAST(ordinal AS VARCHAR) || ',\"change_type\":\"' || change_type || '\"}}' AS value FROM places")
def result_json(spark, sf_dir):
    return report.to_json_lines(changes(spark, sf_dir).select("pair_id", "ordinal", "change_type"))


# --- segmentation -------------------------------------------------------------------------------------------------


def pages(spark, sf_dir) -> DataFrame:
    """Corpus clauses printed on pages of ten, with running text, blanks and soft hyphens to be cleaned."""
    c = clauses(spark, sf_dir)
    line = F.concat(F.lit("  "), "heading", F.lit("\n"), F.replace("text", F.lit(" of "), F.lit("  of\t ")), F.lit(" ­ \n"))
    page = (F.col("ordinal") / 10).cast("int") + 1
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "")
    grouped = c.groupBy(F.concat("pair_id", F.lit("_"), "side").alias("document_id"), page.alias("page_number")).agg(body.alias("b"))
    head = F.when(F.col("page_number") == 1, "Preamble of the document\n").otherwise("\f")
    return grouped.select("document_id", F.col("document_id").alias("document_name"), F.lit("v1").alias("version"), "page_number", F.concat(head, "b").alias("original_text"))


_PAGES = f"""{duck()}, pages_of AS (SELECT pair_id || '_' || side AS document_id, ordinal // 10 + 1 AS page_number, string_agg(heading || chr(10) || text, chr(10) ORDER BY ordinal) AS body FROM corpus GROUP BY ALL),
clean AS (SELECT document_id, page_number, CASE WHEN page_number = 1 THEN 'Preamble of the document' || chr(10) ELSE '' END || body AS normalized_text FROM pages_of)"""


def sections(spark, sf_dir) -> DataFrame:
    """Corpus clauses as sections of their documents, with the bodies of five places in a row as one long one."""
    c = clauses(spark, sf_dir)
    document = F.concat("pair_id", F.lit("_"), "side").alias("document_id")
    by = c.groupBy(document, F.floor(F.col("ordinal") / 5).cast("int").alias("n")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading", "text"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return by.select("document_id", F.col("document_id").alias("document_name"), F.lit("v1").alias("version"), F.lit("Terms of supply").alias("title"), F.col("document_id").alias("subtitle"), F.col("n").alias("ordinal"), F.element_at("s", 1)["heading"].alias("heading"), body.alias("body"))


_LAID = f"""{duck()}, sections AS (
    SELECT pair_id || '_' || side AS document_id, ordinal // 5 AS n, arg_min(heading, ordinal) AS heading, string_agg(text, ' ' ORDER BY ordinal) AS body FROM corpus GROUP BY ALL
), folded AS (
    SELECT document_id, n, heading, list_reduce([{{'lines': []::VARCHAR[], 'line': ''}}] || [{{'lines': []::VARCHAR[], 'line': w}} FOR w IN string_split(body, ' ') IF w <> ''], lambda s, w:
        CASE WHEN s.line = '' THEN {{'lines': s.lines, 'line': w.line}} WHEN length(s.line) + 1 + length(w.line) > 80 THEN {{'lines': s.lines || [s.line], 'line': w.line}}
        ELSE {{'lines': s.lines, 'line': s.line || ' ' || w.line}} END) AS f FROM sections
), wrapped AS (SELECT document_id, n, heading, f.lines || [f.line] AS lines FROM folded),
items AS (
    SELECT document_id, [{{'t': 'Terms of supply', 'step': 30}}, {{'t': document_id, 'step': 20}}, {{'t': repeat('_', 80), 'step': 20}}]
        || flatten(list([{{'t': heading, 'step': 16}}] || [{{'t': x, 'step': CASE WHEN k = len(lines) THEN 23 ELSE 13 END}} FOR x, k IN lines] ORDER BY n)) AS items FROM wrapped GROUP BY document_id
), placed AS (
    SELECT document_id, items, list_reduce([{{'page': 1, 'y': 60, 'pages': []::INT[]}}] || [{{'page': 0, 'y': i.step, 'pages': []::INT[]}} FOR i IN items], lambda s, i:
        {{'page': s.page + CASE WHEN s.y > 760 THEN 1 ELSE 0 END, 'y': CASE WHEN s.y > 760 THEN 60 ELSE s.y END + i.y, 'pages': s.pages || [s.page + CASE WHEN s.y > 760 THEN 1 ELSE 0 END]}}).pages AS pages FROM items
), lines AS (SELECT document_id, unnest(items).t AS t, unnest(pages) AS page_number, unnest(range(len(pages))) AS k FROM placed)"""


@query(f"{_LAID} SELECT document_id, page_number, string_agg(t, chr(10) ORDER BY k) AS original_text FROM lines GROUP BY ALL")
def laid_out_pages(spark, sf_dir):
    """Every document of the corpus wrapped and broken into pages."""
    return layout.lay_out(sections(spark, sf_dir)).select("document_id", "page_number", "original_text")


@query(
    rf"""{_LAID}, numbered AS (SELECT document_id, page_number, k, t, sum(CASE WHEN regexp_matches(t, '^([0-9]+[.]|[0-9]+[.][0-9]+|[0-9]+[.][0-9]+[.][0-9]+) ') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY k) AS section FROM lines),
    crossing AS (SELECT document_id, section, count(DISTINCT page_number) AS pages FROM numbered WHERE section > 0 GROUP BY ALL)
    SELECT document_id, count(*) AS sections, sum(pages - 1)::BIGINT AS crossing, sum(pages)::BIGINT AS clauses FROM crossing GROUP BY document_id"""
)
def crossing_clauses(spark, sf_dir):
    """Laid out pages cut into clauses: a section that goes on over a page is continued there by a clause without a heading.

    A wrapped line that begins with a number and a point begins a section, as it does for any reader of such pages.
    """
    found = segment.segment(segment.normalize_pages(layout.lay_out(sections(spark, sf_dir))))
    numbered = F.col("section_metadata.section_number").isNotNull()
    tail = (F.col("heading") == "") & (F.col("page_number") > 1)
    counts = found.groupBy("document_id").agg(F.count_if(numbered).alias("sections"), F.count_if(tail).alias("crossing"))
    return counts.withColumn("clauses", F.col("sections") + F.col("crossing"))


@query(f"{_PAGES} SELECT document_id, page_number, normalized_text FROM clean")
def normalize_pages(spark, sf_dir):
    return segment.normalize_pages(pages(spark, sf_dir)).select("document_id", "page_number", "normalized_text")


@query(
    """SELECT doc_id, length(t) >= 50 AS has_sufficient_text, CASE WHEN length(t) < 50 THEN 'Page 1: fewer than 50 characters extracted — possible scanned/image-only page.' END AS warning
    FROM (SELECT doc_id, trim(array_to_string(list_transform(string_split(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\x09-\\x0D\\x1C-\\x20]+|[\\x09-\\x0D\\x1C-\\x20]+$', '', 'g')), chr(10)), ' ' || chr(10)) AS t FROM documents)"""
)
def page_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("original_text"))
    return segment.normalize_pages(docs).select("doc_id", "has_sufficient_text", "warning")


@query(
    f"""{duck()}, first AS (SELECT DISTINCT pair_id, side FROM corpus WHERE ordinal < 10), listed AS (SELECT pair_id || '_' || side AS document_id, 0 AS page_number, -1 AS o, '' AS heading, 'Preamble of the document' AS text FROM first
    UNION ALL SELECT pair_id || '_' || side, ordinal // 10 + 1, ordinal, heading, heading || chr(10) || text FROM corpus)
    SELECT document_id, greatest(page_number, 1) AS page_number, document_id || '_clause_' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY o) - 1 AS VARCHAR), 4, '0') AS clause_id, heading, text AS original_text FROM listed"""
)
def segment_clauses(spark, sf_dir):
    return segment.segment(segment.normalize_pages(pages(spark, sf_dir))).select("document_id", "page_number", "clause_id", "heading", "original_text")


@query(f"{duck()} SELECT DISTINCT heading, CAST(ordinal + 1 AS VARCHAR) || '.' AS section_number, md5(CAST(CAST(substr(pair_id, 6) AS BIGINT) * 40 + ordinal AS VARCHAR)) AS section_title, 1 AS depth FROM corpus")
def section_metadata(spark, sf_dir):
    rows = clauses(spark, sf_dir).select("heading").distinct()
    return rows.select("heading", segment.section_metadata(F.col("heading")).alias("m")).select("heading", "m.*")


@query()
def clause_flags(spark, sf_dir):
    """Flags of every clause of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = segment.segment(segment.normalize_pages(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("d").alias("document_name"), F.lit("v1").alias("version"), F.lit(1).alias("page_number"), F.col("text").alias("original_text"))))
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "ordinal", "flagged_for_review", "review_reason")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def document_text(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return segment.document_text(c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("original_text"))).withColumnRenamed("document_id", "conv_id")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _labels(spark, sf_dir):
    """quality as the truth, toxic as the prediction."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_CONFUSION = "SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn, count(*) FILTER (toxic = quality) AS correct_count, count(*) AS total_count FROM labels"


@query(f"SELECT round_even(tp / (tp + fp), 4) AS precision, round_even(tp / (tp + fn), 4) AS recall, round_even(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) AS f1, correct_count, total_count FROM ({_CONFUSION})")
def alignment_metrics(spark, sf_dir):
    return evaluate.alignment_metrics(_labels(spark, sf_dir).select((F.col("toxic") == 1).alias("predicted"), (F.col("quality") == 1).alias("gold")))


_NAMED = "(SELECT CASE quality WHEN 1 THEN 'substantive' ELSE 'wording_only' END AS gold, CASE WHEN toxic = 1 THEN 'substantive' WHEN doc_id % 5 = 0 THEN 'uncertain' ELSE 'wording_only' END AS predicted FROM labels)"


def _named(spark, sf_dir):
    gold = F.when(F.col("quality") == 1, "substantive").otherwise("wording_only")
    predicted = F.when(F.col("toxic") == 1, "substantive").when(F.col("doc_id") % 5 == 0, "uncertain").otherwise("wording_only")
    return _labels(spark, sf_dir).select(gold.alias("gold"), predicted.alias("predicted"))


@query(f"WITH p AS {_NAMED}, l AS (SELECT gold AS x FROM p UNION SELECT predicted FROM p) SELECT g.x AS gold, q.x AS predicted, (SELECT count(*) FROM p WHERE p.gold = g.x AND p.predicted = q.x) AS n FROM l g, l q")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_named(spark, sf_dir))


@query(
    f"""WITH p AS {_NAMED}, l AS (SELECT gold AS label FROM p UNION SELECT predicted FROM p),
    c AS (SELECT label, (SELECT count(*) FROM p WHERE gold = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE predicted = label) AS called, (SELECT count(*) FROM p WHERE gold = label) AS support FROM l),
    r AS (SELECT label, support, CASE WHEN called > 0 THEN tp / called ELSE 0.0::DOUBLE END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS r FROM c),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM r)
    SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(f, 4) AS f1, support, round_even(avg(f) OVER (), 4) AS macro_f1 FROM f"""
)
def class_metrics(spark, sf_dir):
    return evaluate.class_metrics(_named(spark, sf_dir))


@query(f"SELECT count(*) FILTER (gold = 'wording_only') AS total, count(*) FILTER (gold = 'wording_only' AND predicted = 'wording_only') AS correct, count(*) FILTER (gold = 'wording_only' AND predicted = 'substantive') AS wrong_as_substantive, count(*) FILTER (gold = 'wording_only' AND predicted = 'substantive') = 0 AND count(*) FILTER (gold = 'wording_only') > 0 AS passed FROM {_NAMED}")
def wording_gate(spark, sf_dir):
    return evaluate.wording_gate(_named(spark, sf_dir))


@query(f"SELECT round_even(correct_count / total_count, 4) AS matching_accuracy, total_count AS dataset_size FROM ({_CONFUSION})")
def matching_accuracy(spark, sf_dir):
    return evaluate.matching_accuracy(_labels(spark, sf_dir).select((F.col("toxic") == 1).alias("predicted"), (F.col("quality") == 1).alias("gold")))


@query(
    f"""{_PLACES} SELECT count(*) FILTER (k NOT IN (11, 12) AND ordinal % 3 <> 0) AS false_matches, count(*) FILTER (k IN (11, 12) AND ordinal % 3 = 0) AS missed_matches, count(*) FILTER (k IN (11, 12)) AS unmatched_count,
    count(*) FILTER (k = 15) AS ambiguous_count, count(*) FILTER (k = 15) AS needs_review_count, 1.0::DOUBLE AS citation_integrity_rate FROM places"""
)
def diagnostics(spark, sf_dir):
    return evaluate.diagnostics(report.attach_citations(reported(spark, sf_dir)).withColumn("gold", F.col("ordinal") % 3 == 0))


def labelled_pairs(spark, sf_dir):
    """All clause pairs of the corpus with their expected types, as labelled data; pair and ordinal make the id."""
    p = keyed_pairs(spark, sf_dir)
    kind = F.expr(_KIND)
    return p.select(F.concat_ws("_", "pair_id", F.col("ordinal").cast("string")).alias("id"), kind.alias("category"), F.coalesce("text_a", F.lit("")).alias("clause_a_text"), F.coalesce("text_b", F.lit("")).alias("clause_b_text"), (~F.col("k").isin(11, 12)).alias("expected_match"), kind.alias("expected_change_type"), F.lit("").alias("notes"))


@query()
def evaluation_report(spark, sf_dir):
    """Both matchers over labelled pairs, each pair featurised alone."""
    rows = labelled_pairs(spark, sf_dir)
    types = evaluate.text_types(rows)
    out = evaluate.evaluation_report({name: evaluate.evaluate_pairs(rows, name, types=types) for name in ("baseline", "hybrid")})
    return out.withColumn("per_class_f1", F.to_json("per_class_f1")).withColumn("wording_test", F.to_json("wording_test")).drop("limitations", "timestamp")


@query("SELECT count(*) AS shared FROM (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) a SEMI JOIN (SELECT doc_id FROM labels WHERE doc_id % 2 = 1) b USING (doc_id)")
def dataset_overlap(spark, sf_dir):
    """Ids that two label sets share."""
    ids = _labels(spark, sf_dir).select("doc_id")
    return ids.where("doc_id % 2 = 0").join(ids.where("doc_id % 2 = 1"), "doc_id", "left_semi").agg(F.count("*").alias("shared"))


@query()
def compare_documents(spark, sf_dir):
    """The whole comparison of the printed pages: counts for each pair."""
    from ..compare import compare

    p = pages(spark, sf_dir)
    ids = clauses(spark, sf_dir).select("pair_id").distinct()
    pairs = ids.select("pair_id", F.concat("pair_id", F.lit("_a")).alias("document_id_a"), F.concat("pair_id", F.lit("_b")).alias("document_id_b"))
    return compare(p, pairs)["stats"]
