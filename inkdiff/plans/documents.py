"""Queries over documents and web pages: metadata, candidate sources, links, files, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import provenance as p

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source_domain,
    CASE WHEN regexp_matches(url, '(?i)\.(org|net)(/|$)') THEN 3 ELSE 4 END AS domain_priority, 'web' AS source_type FROM pages"""
)
def url_enrich(spark, sf_dir):
    rows = _pages(spark, sf_dir).select(F.col("page_id"), F.col("page_id").cast("string").alias("session_id"), F.lit(1).alias("ordinal"), F.col("url").alias("source_url"))
    return p.enrich(rows, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("page_id", "source_domain", "domain_priority", "source_type")


_VARIED = """(SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://registrar.state.edu/rules.pdf' WHEN 1 THEN 'https://www.scribd.com/doc/1' WHEN 2 THEN 'https://x.academia.edu/p' WHEN 3 THEN 'http://a.gov.in/x' WHEN 4 THEN 'https://law.ac.uk' WHEN 5 THEN 'https://y.org/z' ELSE 'https://z.com:8080/q.PDF' END AS url FROM pages)"""


def _varied(spark, sf_dir):
    urls = ["https://registrar.state.edu/rules.pdf", "https://www.scribd.com/doc/1", "https://x.academia.edu/p", "http://a.gov.in/x", "https://law.ac.uk", "https://y.org/z", "https://z.com:8080/q.PDF"]
    return _pages(spark, sf_dir).select("page_id", F.element_at(F.array(*map(F.lit, urls)), (F.col("page_id") % 7).cast("int") + 1).alias("url"))


@query(
    f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 3 ELSE 4 END AS domain_priority,
    CASE page_id % 7 WHEN 0 THEN 'official_domain' WHEN 1 THEN 'third_party' WHEN 2 THEN 'official_domain' WHEN 3 THEN 'official_domain' WHEN 4 THEN 'official_domain' ELSE 'web' END AS source_type,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, CASE page_id % 7 WHEN 0 THEN 'rules.pdf' WHEN 1 THEN '1.pdf' WHEN 2 THEN 'p.pdf' WHEN 3 THEN 'x.pdf' WHEN 4 THEN 'previous_policy.pdf' WHEN 5 THEN 'z.pdf' ELSE 'q.PDF' END AS filename FROM {_VARIED}"""
)
def url_classes(spark, sf_dir):
    u = F.col("url")
    return _varied(spark, sf_dir).select("page_id", p.domain_priority(u).alias("domain_priority"), p.source_type(u).alias("source_type"), p.domain(u).alias("domain"), p.safe_filename(u).alias("filename"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Pages as search results of twenty sessions."""
    rows = _pages(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.col("page_id") % 20).cast("string")).alias("session_id"),
        (F.col("page_id") / 20).cast("int").alias("ordinal"),
        F.col("url").alias("source_url"),
        F.concat(F.lit("Library Policy "), (2018 + F.col("page_id") % 9).cast("string")).alias("document_title"),
        F.concat(F.lit("rules of session"), (F.col("page_id") % 20).cast("string")).alias("snippet"),
    )
    return rows


_RAW = "(SELECT 's' || CAST(page_id % 20 AS VARCHAR) AS session_id, CAST(page_id // 20 AS INT) AS ordinal, page_id, url AS source_url, 2018 + page_id % 9 AS year FROM pages)"
_UNIQUE = rf"(SELECT *, CASE WHEN regexp_matches(source_url, '(?i)\.(org|net)(/|$)') THEN 3 ELSE 4 END AS priority FROM {_RAW} QUALIFY row_number() OVER (PARTITION BY session_id, source_url ORDER BY ordinal) = 1)"


@query(f"SELECT session_id, ordinal, source_url, row_number() OVER (PARTITION BY session_id ORDER BY priority, ordinal) AS rank FROM {_UNIQUE} QUALIFY rank <= 5")
def candidate_topk(spark, sf_dir):
    return p.top_candidates(p.enrich(_candidates(spark, sf_dir), F.lit(None).cast("timestamp"))).select("session_id", "ordinal", "source_url", "rank")


@query(
    rf"""SELECT session_id, ordinal, CAST(score AS INT) AS provenance_score, CASE WHEN score >= 6 THEN 'STRONG_PROVENANCE' WHEN score >= 3 THEN 'LIMITED_PROVENANCE' ELSE 'UNVERIFIED' END AS provenance_status,
    row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN score >= 6 THEN 2 WHEN score >= 3 THEN 3 ELSE 4 END, score DESC, ordinal) AS rank
    FROM (SELECT *, CASE WHEN starts_with(session_id, 's1') THEN 2 ELSE 0 END + 3 + CASE WHEN year < 2024 THEN 2 ELSE 0 END + 1 AS score FROM {_UNIQUE})"""
)
def provenance_rank(spark, sf_dir):
    """Titles are near the wanted one, sessions from 1 on name the institution, years before 2024 are earlier."""
    c = p.enrich(_candidates(spark, sf_dir), F.lit(None).cast("timestamp"))
    asked = c.withColumns({"institution": F.lit("session1"), "university": F.lit(""), "policy_title": F.lit("Library Policy 2024"), "newer_year": F.lit("2024-25")})
    return p.rank_candidates(asked).select("session_id", "ordinal", "provenance_score", "provenance_status", "rank")


@query("SELECT session_id, ordinal, source_rank FROM (SELECT 's' || CAST(page_id % 20 AS VARCHAR) AS session_id, CAST(page_id // 20 AS INT) AS ordinal, page_id % 3 + 1 AS source_rank FROM pages) QUALIFY source_rank = min(source_rank) OVER (PARTITION BY session_id)")
def search_fallback(spark, sf_dir):
    rows = _pages(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("page_id") % 20).cast("string")).alias("session_id"), (F.col("page_id") / 20).cast("int").alias("ordinal"), (F.col("page_id") % 3 + 1).alias("source_rank"))
    return p.first_source(rows).select("session_id", "ordinal", "source_rank")


@query(
    """SELECT page_id, 1 AS ordinal, url AS source_url, 'A & B ' || CAST(page_id AS VARCHAR) AS document_title, 'it''s ' || CAST(page_id AS VARCHAR) AS snippet FROM pages
    UNION ALL SELECT page_id, 3, 'http://second.example.org/', '', '' FROM pages"""
)
def link_scrape(spark, sf_dir):
    """Result pages made from the urls: an encoded link twice, a second one without title."""
    u = F.concat(F.lit("uddg="), F.url_encode("url"), F.lit("&rut=1"))
    page = F.concat(
        F.lit('<a class="result__a" href="?'), u, F.lit('">A <b>&amp;</b> B '), F.col("page_id").cast("string"), F.lit('</a><a class="result__snippet">it&#x27;s '), F.col("page_id").cast("string"),
        F.lit('</a><a href="?'), u, F.lit('"></a><a href="?uddg=http%3A%2F%2Fsecond.example.org%2F">'),
    )
    rows = _pages(spark, sf_dir).select("page_id", page.alias("html"))
    return p.scrape_results(rows).select("page_id", "ordinal", "source_url", "document_title", "snippet")


@query(
    """SELECT page_id, 0 AS ordinal, url AS source_url, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'T' || CAST(page_id AS VARCHAR) END AS document_title, '' AS snippet,
    CASE WHEN page_id % 3 = 0 THEN 'grounding' ELSE 'q' || CAST(page_id AS VARCHAR) END AS query_used FROM pages"""
)
def llm_candidates(spark, sf_dir):
    """Replies with talk around a JSON array, whose second object has no url, and replies that only cite their source."""
    reply = F.concat(F.lit('Here: [ {"url": "'), "url", F.lit('", "title": "T'), F.col("page_id").cast("string"), F.lit('"}, {"url": "none", "title": "x"} ] and [more]'))
    told = F.when(F.col("page_id") % 3 == 0, F.lit("no list")).otherwise(reply)
    cited = F.array(F.struct(F.col("url").alias("uri"), F.lit(None).cast("string").alias("title")))
    rows = _pages(spark, sf_dir).select("page_id", told.alias("reply"), F.concat(F.lit("q"), F.col("page_id").cast("string")).alias("query_used"), cited.alias("grounding"))
    return p.reply_candidates(rows).select("page_id", "ordinal", "source_url", "document_title", "snippet", "query_used")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.org/x/y/doc.pdf' WHEN 1 THEN 'https://a.org/doc.PDF?v=1' WHEN 2 THEN 'http://b.org/doc.pdf' END AS link FROM pages"""
)
def first_link(spark, sf_dir):
    bodies = ["<a href='doc.pdf'>", '<a href="z.html"><a HREF="/doc.PDF?v=1">', '<a href="http://b.org/doc.pdf"><a href="c.pdf">', "<a href=x.html>"]
    page = F.element_at(F.array(*map(F.lit, bodies)), (F.col("page_id") % 4).cast("int") + 1)
    return _pages(spark, sf_dir).select("page_id", p.first_pdf_link(page, F.lit("https://a.org/x/y/index.html?q=1")).alias("link"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Only HTTP/HTTPS URLs are supported.' WHEN octet_length(encode(text)) + CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 0 END < 1024 THEN 'Downloaded file is too small to be a valid PDF.'
    WHEN doc_id % 4 <> 0 THEN 'Downloaded file is not a valid PDF (bad magic bytes).' END AS error FROM documents"""
)
def file_checks(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    content = F.encode(F.concat(F.when(F.col("doc_id") % 4 == 0, "%PDF-").otherwise(""), "text"), "UTF-8")
    url = F.when(F.col("doc_id") % 4 == 3, "ftp://a.org/x.pdf").otherwise("https://a.org/x.pdf")
    return d.select("doc_id", p.file_error(url, content).alias("error"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'https://a.org/x/doc.pdf' END AS next_url, CASE WHEN doc_id % 4 = 0 AND octet_length(encode(text)) + 5 < 1024 THEN 'Downloaded file is too small to be a valid PDF.'
    WHEN doc_id % 4 = 2 THEN 'Server returned HTML webpage, not a direct PDF file.' WHEN doc_id % 4 = 3 THEN 'Only HTTP/HTTPS URLs are supported.' END AS error FROM documents"""
)
def fetch_outcomes(spark, sf_dir):
    """Documents as a server's answers: PDF files, web pages with and without a link to one, another scheme."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turn = F.col("doc_id") % 4
    body = F.concat(F.when(turn == 0, "%PDF-").when(turn == 1, "<a href='doc.pdf'>").otherwise(""), F.when(turn == 2, F.regexp_replace("text", "(?i)href", "")).otherwise(F.col("text")))
    url = F.when(turn == 3, "ftp://a.org/x.pdf").when(turn == 0, "https://a.org/x.pdf").otherwise("https://a.org/x/page")
    rows = d.select("doc_id", url.alias("url"), F.when(turn == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.encode(body, "UTF-8").alias("content"))
    return p.fetch_outcomes(rows).select("doc_id", "next_url", "error")


def _answers(spark, sf_dir) -> DataFrame:
    """Every page as an answer whose own links lead on: where to is told by the length of its html; some are files."""
    n = F.length("html")
    after = F.when(F.col("page_id") % 10 == 0, F.col("page_id") + n % 3).otherwise(F.col("page_id") - 1 - n % 7)
    leads = F.regexp_replace("html", F.lit('href="/[^"]*"'), F.concat(F.lit('href="/'), after.cast("string"), F.lit('.pdf?v=1"')))
    file = F.col("page_id") % 13 == 5
    body = F.when(file, F.concat(F.lit("%PDF-"), "html")).when(n % 11 == 0, F.col("html")).otherwise(leads)
    kind = F.when(file, "application/pdf").otherwise("text/html; charset=utf-8")
    url = F.concat(F.lit("https://pages.example.org/"), F.col("page_id").cast("string"), F.lit(".pdf?v=1"))
    return _pages(spark, sf_dir).select("page_id", url.alias("url"), kind.alias("content_type"), F.encode(body, "UTF-8").alias("content"))


@query(
    r"""WITH RECURSIVE bodies AS (
        SELECT page_id, page_id % 13 = 5 AS file, octet_length(encode(html)) + 5 AS size, CASE WHEN length(html) % 11 = 0 THEN html ELSE regexp_replace(html, 'href="/[^"]*"', 'href="/' ||
            CASE WHEN page_id % 10 = 0 THEN page_id + length(html) % 3 ELSE page_id - 1 - length(html) % 7 END || '.pdf?v=1"', 'g') END AS body FROM pages
    ), answers AS (
        SELECT page_id, CASE WHEN NOT file THEN CAST(nullif(regexp_extract(body, 'href="/(-?[0-9]+)[.]pdf[?]v=1"', 1), '') AS BIGINT) END AS target,
            CASE WHEN file AND size > 32 * 1024 * 1024 THEN 'Document exceeds the 32 MB size limit.' WHEN file AND size < 1024 THEN 'Downloaded file is too small to be a valid PDF.'
            WHEN NOT file AND NOT regexp_matches(body, 'href="/-?[0-9]+[.]pdf[?]v=1"') THEN 'Server returned HTML webpage, not a direct PDF file.' END AS error FROM bodies
    ), ways AS (
        SELECT page_id, page_id AS at, 0::BIGINT AS hops FROM pages
        UNION ALL SELECT w.page_id, a.target, hops + 1 FROM ways w JOIN answers a ON a.page_id = w.at WHERE a.target IS NOT NULL AND hops <= (SELECT count(*) FROM pages)
    ), ends AS (
        SELECT w.page_id, w.at, w.hops, CASE WHEN a.page_id IS NULL THEN 'Could not connect to the document server.' ELSE a.error END AS error FROM ways w LEFT JOIN answers a ON a.page_id = w.at WHERE a.page_id IS NULL OR a.target IS NULL
    )
    SELECT p.page_id, 'https://pages.example.org/' || e.at || '.pdf?v=1' AS final_url, e.hops, CASE WHEN e.page_id IS NULL THEN 'Links lead round in a circle.' ELSE e.error END AS error FROM pages p LEFT JOIN ends e USING (page_id)"""
)
def followed_links(spark, sf_dir):
    """From every page along its links to a file, an error, or round in a circle."""
    answers = _answers(spark, sf_dir)
    return p.follow_links(answers.select("page_id", "url"), answers.select("url", "content_type", "content")).select("page_id", "final_url", "hops", "error")


_ROOT = "regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)"


@query(
    rf"""SELECT page_id, CASE WHEN regexp_matches(html, 'href="/[^"]*"') THEN {_ROOT} || regexp_extract(html, 'href="(/[^"]*)"', 1) || '.pdf' END AS link,
    CASE WHEN regexp_matches(html, 'href="/[^"]*"') THEN length(html) - length(replace(html, 'href="/', 'href="')) ELSE 0 END AS links FROM pages"""
)
def page_links(spark, sf_dir):
    """The first link of every page's own html, as one to a file, made absolute by the page's own url; and their number."""
    made = F.regexp_replace("html", r'href="(/[^"]*)"', 'href="$1.pdf"')
    links = F.size(F.regexp_extract_all("html", F.lit(r'href="(/)[^"]*"'), F.lit(1)))
    return _pages(spark, sf_dir).select("page_id", p.first_pdf_link(made, F.col("url")).alias("link"), links.cast("long").alias("links"))


@query(
    r"""WITH paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
    named AS (SELECT page_id, regexp_replace(CASE WHEN regexp_extract(path, '[^/]*$') = '' THEN 'previous_policy.pdf' ELSE regexp_extract(path, '[^/]*$') END, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM paths)
    SELECT page_id, substr(CASE WHEN ends_with(lower(name), '.pdf') THEN name ELSE name || '.pdf' END, 1, 120) AS filename FROM named"""
)
def page_filenames(spark, sf_dir):
    """The name that each page's own address gives to what is fetched from it."""
    return _pages(spark, sf_dir).select("page_id", p.safe_filename(F.col("url")).alias("filename"))


@query(
    r"""SELECT doc_id, coalesce(CAST(CAST(nullif(regexp_extract(text, '20[0-9]{2}'), '') AS INT) - 1 AS VARCHAR), '') AS year_before,
    len(regexp_extract_all(coalesce(text, ''), '20[0-9]{2}')) AS years FROM documents"""
)
def text_years(spark, sf_dir):
    """The year before the first one that each document's own text names, and how many it names."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(20\d{2})"), F.lit(1)))
    return d.select("doc_id", p.previous_year(F.col("text")).alias("year_before"), found.cast("long").alias("years"))


_CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(t), '{k}') THEN '{v}'" for k, v in p.CATEGORIES.items()) + " ELSE '' END"
_TEXT = "'UNIVERSITY LIBRARY RULES ' || CAST(p_partkey AS VARCHAR) || chr(10) || 'Issued by the Academic Council of ' || p_name || chr(10) || 'version 2.' || CAST(p_size AS VARCHAR) || ' for ' || CASE WHEN p_partkey % 2 = 0 THEN '2023-24' ELSE 'the year 2022 and 2024' END || chr(10) || 'HOSTEL FEE RULES' || chr(10) || 'text'"


@query(
    f"""SELECT id, 'UNIVERSITY LIBRARY RULES ' || CAST(id AS VARCHAR) AS title, 'UNIVERSITY LIBRARY RULES ' || CAST(id AS VARCHAR) AS issuing_authority, CASE WHEN id % 2 = 0 THEN '2023-24' ELSE '2024' END AS academic_year,
    'version 2.' || CAST(p_size AS VARCHAR) AS version, {_CATEGORY} AS policy_category, CASE WHEN id % 2 = 0 THEN '2023' ELSE '2024,2022' END AS years, 'HOSTEL FEE RULES' AS headings
    FROM (SELECT p_partkey AS id, p_size, {_TEXT} AS t FROM part)"""
)
def doc_metadata(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(
        F.lit("UNIVERSITY LIBRARY RULES "), F.col("p_partkey").cast("string"), F.lit("\nIssued by the Academic Council of "), "p_name", F.lit("\nversion 2."), F.col("p_size").cast("string"), F.lit(" for "),
        F.when(F.col("p_partkey") % 2 == 0, "2023-24").otherwise("the year 2022 and 2024"), F.lit("\nHOSTEL FEE RULES\ntext"),
    )
    m = p.document_metadata(part.select(F.col("p_partkey").alias("id"), text.alias("text")))
    return m.select("id", "title", "issuing_authority", "academic_year", "version", "policy_category", F.array_join("years_mentioned", ",").alias("years"), F.array_join("headings", "|").alias("headings"))


@query(
    """SELECT p_partkey AS id, 'Inst ' || CASE WHEN p_partkey % 2 = 0 THEN 'Law ' ELSE '' END || 'Rules pdf' || CASE WHEN p_partkey % 3 = 0 THEN ' 2022' ELSE '' END AS query_1, 'Inst ' || CASE WHEN p_partkey % 2 = 0 THEN 'Law ' ELSE '' END || 'Rules regulations pdf' AS query_2 FROM part"""
)
def year_hint(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    even = F.col("p_partkey") % 2 == 0
    context = part.select(F.col("p_partkey").alias("id"), F.when(even, "Inst").otherwise("").alias("institution"), F.when(even, "").otherwise("Inst").alias("university"), F.lit("Rules").alias("policy_title"), F.when(even, "Law").otherwise("General").alias("programme"), F.when(F.col("p_partkey") % 3 == 0, "2023-24").otherwise("").alias("academic_year"))
    return p.search_queries(context).select("id", "query_1", "query_2")
