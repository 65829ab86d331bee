"""Finding an earlier version: document metadata, candidate sources, provenance and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import similarity_ratio
from ..functions.text import all_matches, contains_any, first_match, none_if_empty, split_lines, strip, words_of
from ..storage import kept

#: Fixed patterns and lists.
OFFICIAL = r"(?i)\.(edu|ac\.[a-z]{2}|gov|nic\.in|gov\.in)(/|$)"
THIRD_PARTY = r"(?i)(scribd|slideshare|academia\.edu|docplayer|studocu|coursehero|quora|reddit|facebook|twitter|instagram|youtube)"
SEARCH_THIRD_PARTY = r"(?i)(scribd|slideshare|academia\.edu|docplayer|studocu|coursehero|quora|reddit)"
YEAR = r"\b20\d{2}\b"
YEAR_RANGE = r"\b20\d{2}[–\-](?:20\d{2}|\d{2})\b"
VERSION = r"(?i)\b(v\d+(?:\.\d+)*|version\s*\d+[\d.]*|rev(?:ision)?\s*\d+)\b"
HEADINGS = (r"(?m)^(\d+\.\s+[A-Z][A-Z\s&/\-]{3,})", r"(?m)^([A-Z][A-Z\s&/\-]{5,})$")
AUTHORITIES = ("university", "college", "institute", "board", "registrar", "academic council", "senate", "examination", "department")
CATEGORIES = {
    "attendance": "Attendance Policy",
    "examination": "Examination Rules",
    "grading": "Grading Policy",
    "academic": "Academic Regulations",
    "placement": "Placement Policy",
    "library": "Library Policy",
    "hostel": "Hostel Rules",
    "scholarship": "Scholarship Policy",
    "fee": "Fee Structure",
    "disciplinary": "Disciplinary Policy",
    "admission": "Admission Policy",
    "syllabus": "Syllabus / Curriculum",
}
POLICY_WORDS = ("regulations", "policy", "rules", "guidelines", "ordinance", "statute")
TIERS = ("VERIFIED_PROVENANCE", "STRONG_PROVENANCE", "LIMITED_PROVENANCE", "UNVERIFIED")
UNREACHED = "Could not connect to the document server."
CIRCLE = "Links lead round in a circle."
LARGEST_FILE, LEAST_FILE = 32 * 1024 * 1024, 1024


def document_metadata(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with title, issuing_authority, academic_year, version, policy_category, years_mentioned and headings."""
    t = F.coalesce(F.col(text), F.lit(""))
    top = F.substring(t, 1, 500)
    years = F.slice(F.reverse(F.array_sort(F.array_distinct(all_matches(t, YEAR)))), 1, 6)
    titles = F.filter(F.transform(split_lines(strip(top)), strip), lambda x: F.char_length(x).between(6, 120) & ~F.startswith(x, F.lit("http")))
    near = F.lower(F.substring(t, 1, 800))

    def authority(word: str) -> Column:
        at = F.locate(word, near)
        before = F.substring(near, F.lit(1), at - 1)
        start = at - F.char_length(F.substring_index(before, "\n", -1))
        line = F.substring_index(F.substring(t, start, F.char_length(t)), "\n", 1)
        ends = F.locate("\n", F.substring(near, at, F.lit(800))) > 0
        return F.when(at > 0, none_if_empty(F.substring(strip(F.when(ends, line).otherwise(F.substring(t, start, F.lit(120)))), 1, 120)))

    category = F.lit("")
    for word, name in reversed(CATEGORIES.items()):
        category = F.when(F.contains(F.lower(t), F.lit(word)), name).otherwise(category)
    early = F.substring(t, 1, 3000)
    headings = F.concat(*(F.regexp_extract_all(early, F.lit(p), F.lit(1)) for p in HEADINGS))
    return documents.withColumns(
        {
            "title": F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")),
            "issuing_authority": F.coalesce(*map(authority, AUTHORITIES), F.lit("")),
            "academic_year": F.coalesce(first_match(t, YEAR_RANGE), F.try_element_at(years, F.lit(1)), F.lit("")),
            "version": F.coalesce(first_match(t, VERSION), F.lit("")),
            "policy_category": category,
            "years_mentioned": years,
            "headings": F.slice(F.array_distinct(F.transform(headings, strip)), 1, 15),
            "raw_first_500": strip(top),
        }
    )


def domain(url: Column) -> Column:
    """Host and port; empty where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def domain_priority(url: Column) -> Column:
    return F.when(F.regexp(url, F.lit(SEARCH_THIRD_PARTY)), 5).when(F.regexp(url, F.lit(OFFICIAL)), 1).when(F.regexp(url, F.lit(r"(?i)\.(org|net)(/|$)")), 3).otherwise(4)


def source_type(url: Column) -> Column:
    return F.when(F.regexp(url, F.lit(OFFICIAL)), "official_domain").when(F.regexp(url, F.lit(SEARCH_THIRD_PARTY)), "third_party").otherwise("web")


def enrich(candidates: DataFrame, retrieved_at: Column | None = None) -> DataFrame:
    """The first candidate(session_id, ordinal, source_url, …) of each url in its session, with domain, type, priority."""
    first = Window.partitionBy("session_id", "source_url").orderBy("ordinal")
    kept = candidates.where(F.coalesce("source_url", F.lit("")) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    url = F.col("source_url")
    return kept.withColumns({"source_domain": domain(url), "source_type": source_type(url), "domain_priority": domain_priority(url), "retrieval_ts": retrieved_at if retrieved_at is not None else F.current_timestamp()})


def top_candidates(enriched: DataFrame, k: int = 5) -> DataFrame:
    """Each session's k first candidates by domain priority, then order of arrival."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("domain_priority", "ordinal"))
    return enriched.withColumn("rank", rank).where(F.col("rank") <= k)


def first_source(results: DataFrame) -> DataFrame:
    """Rows of each session's first source (least source_rank) that found anything."""
    least = results.groupBy("session_id").agg(F.min("source_rank").alias("source_rank"))
    return results.join(least, ["session_id", "source_rank"])


def previous_year(academic_year: Column) -> Column:
    """The year before the first one named; empty if none is."""
    return F.coalesce((first_match(academic_year, r"20\d{2}").cast("int") - 1).cast("string"), F.lit(""))


def search_queries(context: DataFrame) -> DataFrame:
    """context(institution, university, policy_title, programme, academic_year) with the two search texts."""
    blank = lambda c: none_if_empty(F.coalesce(c, F.lit("")))
    inst = F.coalesce(blank(F.col("institution")), blank(F.col("university")), F.lit(""))
    uni = F.coalesce(blank(F.col("university")), blank(F.col("institution")), F.lit(""))
    programme = F.when(F.coalesce("programme", F.lit("")).isin("", "General"), "").otherwise(F.concat("programme", F.lit(" ")))
    first = strip(F.concat(inst, F.lit(" "), programme, "policy_title", F.lit(" pdf "), previous_year(F.col("academic_year"))))
    return context.withColumn("query_1", first).withColumn("query_2", strip(F.concat(uni, F.lit(" "), programme, "policy_title", F.lit(" regulations pdf"))))


def scrape_results(pages: DataFrame, page: str = "html", url: str = r"uddg=([^&\"'\s>]+)", title: str = r"(?s)class=\"result__a\"[^>]*>(.*?)</a>", snippet: str = r"(?s)class=\"result__snippet\"[^>]*>(.*?)</(?:a|span|div)>", most: int = 5) -> DataFrame:
    """pages with one row for each of the first `most` distinct http urls: ordinal, source_url, document_title, snippet."""
    found = lambda p: F.regexp_extract_all(F.coalesce(F.col(page), F.lit("")), F.lit(p), F.lit(1))
    plain = lambda x: F.replace(F.replace(strip(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", "")), F.lit("&amp;"), F.lit("&")), F.lit("&#x27;"), F.lit("'"))
    urls = F.transform(found(url), lambda u: F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u))
    zipped = F.arrays_zip(urls.alias("u"), found(title).alias("t"), found(snippet).alias("s"))
    # the first place of each url, in the page's own array: no shuffle
    seen = F.transform(zipped, lambda z, k: F.struct((k + 1).alias("ordinal"), z["u"].alias("source_url"), plain(z["t"]).alias("document_title"), plain(z["s"]).alias("snippet")))
    kept = F.filter(seen, lambda z: z["source_url"].isNotNull() & F.startswith(z["source_url"], F.lit("http")) & (F.array_position(urls, z["source_url"]) == z["ordinal"]))
    return pages.withColumn("_r", F.explode(F.slice(kept, 1, most))).select(*pages.columns, "_r.*")


def reply_candidates(replies: DataFrame, reply: str = "reply", query: str = "query_used", grounding: str = "grounding") -> DataFrame:
    """The http urls of the first JSON array of objects in each reply, with titles and snippets, as found by the row's query.

    A reply without such an array gives the pages that its column `grounding`, an array of structs (uri, title), cites,
    if it has that column.
    """
    text = F.coalesce(F.col(reply), F.lit(""))
    array = F.regexp_extract(text, r"(?s)\[\s*\{.*?\}\s*\]", 0)
    asked = F.coalesce(F.col(query), F.lit("")) if query in replies.columns else F.lit("")
    fields = lambda url, title, snippet, by: F.struct(url.alias("source_url"), F.coalesce(title, F.lit("")).alias("document_title"), F.coalesce(snippet, F.lit("")).alias("snippet"), by.alias("query_used"))
    listed = F.transform(F.from_json(array, "array<struct<url: string, title: string, snippet: string>>"), lambda c: fields(strip(c["url"]), c["title"], c["snippet"], asked))
    listed = F.filter(F.coalesce(listed, F.array().cast(listed_type := "array<struct<source_url: string, document_title: string, snippet: string, query_used: string>>")), lambda c: F.startswith(c["source_url"], F.lit("http")))
    if grounding in replies.columns:
        cited = F.transform(F.coalesce(F.col(grounding), F.array().cast("array<struct<uri: string, title: string>>")), lambda c: fields(c["uri"], c["title"], F.lit(""), F.lit("grounding")))
        listed = F.when(array == "", cited.cast(listed_type)).otherwise(listed)
    kept = [c for c in replies.columns if c not in (query, grounding)]
    return replies.select(*kept, F.posexplode(listed).alias("ordinal", "_c")).select(*kept, "ordinal", "_c.*")


def fetch_outcomes(fetched: DataFrame) -> DataFrame:
    """fetched(url, content_type, content) with `next_url` and `error`: what follows from each answer of a server.

    A document is kept (neither) or refused (error). A web page in its place leads on to its first PDF link (next_url);
    without one it is an error. A server's type counts only where the url itself does not end in .pdf.
    """
    kind, url = F.lower(F.coalesce("content_type", F.lit(""))), F.col("url")
    page = ~F.contains(kind, F.lit("pdf")) & ~F.endswith(F.lower(url), F.lit(".pdf")) & (F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text")))
    link = F.when(page, first_pdf_link(F.decode(F.coalesce("content", F.lit(b"")), "UTF-8"), url))
    refused = F.when(page, F.when(link.isNull(), "Server returned HTML webpage, not a direct PDF file.")).otherwise(file_error(url, F.col("content")))
    scheme = F.when(~F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)), "Only HTTP/HTTPS URLs are supported.")
    return fetched.withColumn("next_url", F.when(scheme.isNull(), link)).withColumn("error", F.coalesce(scheme, refused))


def follow_links(starts: DataFrame, fetched: DataFrame) -> DataFrame:
    """starts(url, …) with final_url, hops and error: where the links of answers (fetched, as for fetch_outcomes) lead in the end.

    final_url is a document (error null) or the answer that ends the way with its error. An address without an answer
    could not be reached; one that is asked twice gives a document if any of its answers is one. Links that lead round in
    a circle have no final_url. Every address jumps to where its target has got to, so ways double with each round and a
    chain of n links takes log2(n) of them; addresses that none of a round brings to an end are in circles.
    """
    outcomes = fetch_outcomes(fetched).select("url", "next_url", "error")
    answers = outcomes.groupBy("url").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), F.col("next_url").isNotNull().alias("open"), "next_url", "error")).alias("a"))
    leads = F.coalesce("a.next_url", "url").alias("target"), F.when(F.col("a.open"), 1).otherwise(0).cast("long").alias("hops")
    jumps = kept(answers.select("url", *leads, F.col("a.error").alias("error"), F.col("a.open").alias("open")))
    waiting = jumps.where("open").count()
    while waiting:
        on = jumps.select(F.col("url").alias("target"), *[F.col(c).alias(f"_{c}") for c in ("target", "hops", "error", "open")])
        met = jumps.where("open").join(on, "target", "left")
        unreached = F.col("_target").isNull()
        error = F.when(unreached, UNREACHED).otherwise(F.col("_error"))
        moved = met.select("url", F.coalesce("_target", "target").alias("target"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), error.alias("error"), (~unreached & F.col("_open")).alias("open"))
        following = kept(jumps.where("not open").union(moved))
        before, waiting = waiting, following.where("open").count()
        if waiting == before:
            break
        jumps = following
    ends = jumps.select("url", F.when(~F.col("open"), F.col("target")).alias("final_url"), F.when(~F.col("open"), F.col("hops")).alias("hops"), F.when(F.col("open"), CIRCLE).otherwise(F.col("error")).alias("error"), F.lit(True).alias("_known"))
    out = starts.join(ends, "url", "left").withColumn("final_url", F.coalesce("final_url", F.when(F.col("_known").isNull(), F.col("url"))))
    out = out.withColumn("hops", F.coalesce("hops", F.when(F.col("_known").isNull(), F.lit(0).cast("long"))))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("_known").isNull(), UNREACHED))).drop("_known")


def first_pdf_link(page: Column, base: Column) -> Column:
    """The first href to a .pdf, made absolute; null if there is none."""
    link = first_match(page, r"(?i)href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']", 1)
    root = F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*\z", ""), r"(?<=[^/:])/[^/]*\z", "")
    return (
        F.when(F.regexp(link, F.lit(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def safe_filename(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+\z", "")
    name = F.coalesce(none_if_empty(F.substring_index(path, "/", -1)), F.lit("previous_policy.pdf"))
    clean = F.regexp_replace(name, r"[^\w\-.]", "_")
    return F.substring(F.when(F.endswith(F.lower(clean), F.lit(".pdf")), clean).otherwise(F.concat(clean, F.lit(".pdf"))), 1, 120)


def file_error(url: Column, content: Column) -> Column:
    """Why a fetched file is no document; null if it is one. No local file ever stands in for a failed one."""
    size = F.octet_length(content)
    return (
        F.when(~F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False)), "Only HTTP/HTTPS URLs are supported.")
        .when(size > LARGEST_FILE, "Document exceeds the 32 MB size limit.")
        .when(size < LEAST_FILE, "Downloaded file is too small to be a valid PDF.")
        .when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "Downloaded file is not a valid PDF (bad magic bytes).")
    )


def verify_provenance(candidates: DataFrame) -> DataFrame:
    """candidates(source_url, source_domain, document_title, snippet, institution, university, policy_title, newer_year)
    with title_similarity, provenance_score, provenance_status, signals and warnings."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    url, both = text("source_url"), F.lower(F.concat_ws(" ", text("document_title"), text("snippet")))
    official = F.regexp(url, F.lit(OFFICIAL)) & ~F.regexp(url, F.lit(THIRD_PARTY))
    third = F.regexp(url, F.lit(THIRD_PARTY))
    title, other = F.lower(text("policy_title")), F.lower(text("document_title"))
    empty = (title == "") | (other == "")
    rated = candidates.withColumn("title_similarity", F.coalesce(similarity_ratio(F.when(~empty, title), F.when(~empty, other)), F.lit(0.0)))
    sim = F.col("title_similarity")
    has = lambda c: text(c) != ""
    inst, uni = has("institution") & contains_any(both, words_of(text("institution"))), has("university") & contains_any(both, words_of(text("university")))
    partly = (sim > 0.4) | contains_any(both, F.slice(words_of(text("policy_title")), 1, 3))
    newer = F.substring(text("newer_year"), 1, 4).try_cast("int")
    earlier = has("newer_year") & F.coalesce(F.exists(all_matches(both, r"20\d{2}"), lambda y: y.cast("int") < newer), F.lit(False))
    pdf, worded = F.endswith(F.lower(url), F.lit(".pdf")), contains_any(both, F.array(*map(F.lit, POLICY_WORDS)))
    points = [(official, 3), (third, -2), (inst, 2), (uni, 2), (sim > 0.7, 3), (~(sim > 0.7) & partly, 1), (earlier, 2), (pdf, 1), (worded, 1)]
    score = sum((F.when(when, n).otherwise(0) for when, n in points), F.lit(0))
    s = F.col("provenance_score")
    status = F.when((s >= 9) & official, TIERS[0]).when((s >= 6) & ~third, TIERS[1]).when(s >= 3, TIERS[2]).otherwise(TIERS[3])
    where = text("source_domain")
    say = lambda when, *parts: F.when(when, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    good = [
        say(official, "Document hosted on official domain (", where, ")"),
        say(inst, "Institution name '", text("institution"), "' found in candidate document"),
        say(uni, "Affiliating university '", text("university"), "' found in candidate document"),
        say(sim > 0.7, "Policy title closely matches (similarity ", F.format_string("%.0f%%", F.bround(sim * 100, 0)), ")"),
        say(~(sim > 0.7) & partly, "Policy title partially matches candidate"),
        say(earlier, "Candidate appears to be from a year before ", text("newer_year")),
        say(pdf, "Direct PDF link"),
        say(worded, "Policy-related keywords found in document snippet"),
    ]
    bad = [
        say(~official & third, "Third-party hosting site (", where, ") — not an authoritative source"),
        say(~official & ~third, "Domain authority unknown (", where, ")"),
        say(has("institution") & ~inst, "Institution name '", text("institution"), "' not found in candidate snippet"),
        say(has("university") & ~uni, "University name '", text("university"), "' not found in candidate snippet"),
        say(~(sim > 0.7) & ~partly, "Policy title does not closely match candidate document title"),
        say(has("newer_year") & ~earlier, "Could not confirm candidate is from a previous year"),
    ]
    return rated.withColumn("provenance_score", score).withColumn("provenance_status", status).withColumn("signals", F.array_compact(F.array(*good))).withColumn("warnings", F.array_compact(F.array(*bad)))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Verified candidates with their rank in the session: best tier, then best score, then order of arrival."""
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("provenance_status"))
    return verify_provenance(candidates).withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy(tier, F.desc("provenance_score"), "ordinal")))
