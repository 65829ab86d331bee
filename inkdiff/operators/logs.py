"""Users, sessions, the comparison log and the audit trail of investigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The states in order and what they say. Fixed values.
STATES = {
    "IDLE": "Waiting for user input.",
    "COLLECTING_CONTEXT": "Collecting institution and policy information.",
    "EXTRACTING_METADATA": "Analysing the uploaded policy document.",
    "SEARCHING_SOURCES": "Searching authoritative sources for the previous version.",
    "RANKING_CANDIDATES": "Ranking candidate documents by relevance.",
    "VERIFYING_PROVENANCE": "Evaluating source authority and provenance signals.",
    "AWAITING_CONFIRMATION": "Waiting for you to confirm the candidate document.",
    "DOWNLOADING_DOCUMENT": "Retrieving the confirmed candidate document.",
    "COMPARING_POLICIES": "Running the ML comparison pipeline.",
    "COMPLETED": "Investigation and comparison complete.",
    "FAILED": "Investigation could not be completed.",
}
LEAST_PASSWORD = 8


def admin_totals(users: DataFrame, log: DataFrame) -> DataFrame:
    """One row: total_users, total_comparisons, total_institutions (blank ones do not count)."""
    people = users.agg(F.count("*").alias("total_users"), F.count_distinct(F.when(F.col("institution") != "", F.col("institution"))).alias("total_institutions"))
    return people.join(F.broadcast(log.agg(F.count("*").alias("total_comparisons"))))  # one row each


def active_users(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Users with a session since the start of as_of's day."""
    return sessions.where(F.col("created_at") >= F.date_trunc("day", as_of)).agg(F.count_distinct("user_id").alias("active_today"))


def recent_comparisons(log: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The n newest log rows with user_name and institution; anonymous ones keep null names."""
    newest = log.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    named = users.select(F.col("id").alias("user_id"), F.concat("first_name", F.lit(" "), "last_name").alias("user_name"), "institution")
    return newest.join(named, "user_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def all_users(users: DataFrame) -> DataFrame:
    """Without secrets, newest first."""
    return users.select("id", "first_name", "last_name", "email", "institution", "role", "created_at", "last_login").orderBy(F.desc("created_at"), F.desc("id"))


def valid_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions whose expiry lies after as_of, compared as times."""
    return sessions.where(F.col("expires_at") > as_of)


def users_by_token(users: DataFrame, sessions: DataFrame, as_of: Column, token: str | None = None) -> DataFrame:
    """The users of valid sessions, or of one token; a null or empty token has none."""
    live = valid_sessions(sessions, as_of).where("token is not null and token <> ''")
    live = live if token is None else live.where(F.col("token") == token)
    return live.select("token", F.col("user_id").alias("id")).join(users, "id")


def new_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests(first_name, last_name, email, institution, password_length) with error, or id and normalised fields.

    An address counts once, regardless of case: the first request (by request_id) of a free one is taken.
    """
    mail = F.lower(F.trim("email"))
    rows = requests.withColumns({"email": mail, "first_name": F.trim("first_name"), "last_name": F.trim("last_name"), "institution": F.trim("institution")})
    taken = users.select(F.lower(F.trim("email")).alias("email"), F.lit(True).alias("_taken")).distinct()
    good = F.col("password_length") >= LEAST_PASSWORD
    turn = F.row_number().over(Window.partitionBy("email", good).orderBy("request_id"))
    joined = rows.withColumn("_turn", turn).join(taken, "email", "left")
    error = F.when(~good, f"Password must be at least {LEAST_PASSWORD} characters.").when(F.col("_taken") | (F.col("_turn") > 1), "An account with this email already exists.")
    return joined.withColumn("error", error).drop("_taken", "_turn")


def last_logins(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """users with last_login taken from their newest session."""
    newest = sessions.groupBy(F.col("user_id").alias("id")).agg(F.max("created_at").alias("_newest"))
    return users.join(newest, "id", "left").withColumn("last_login", F.coalesce("_newest", "last_login")).drop("_newest")


def delete_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select("token").distinct(), "token", "left_anti")


def delete_users(users: DataFrame, sessions: DataFrame, log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users without the gone(id) ones; their sessions go too, their log rows become anonymous."""
    ids = gone.select("id").distinct()
    marked = log.join(ids.withColumn("_gone", F.lit(True)), log["user_id"] == ids["id"], "left").drop(ids["id"])
    return (
        users.join(ids, "id", "left_anti"),
        sessions.join(ids, sessions["user_id"] == ids["id"], "left_anti"),
        marked.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone"),
    )


def log_rows(entries: DataFrame) -> DataFrame:
    """entries(user_id, doc_a_name, doc_b_name, counts…) as log rows, missing counts being 0."""
    return entries.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_changes", "substantive", "added", "removed", "wording_only")})


def append_log(entries: DataFrame, path: str) -> None:
    log_rows(entries).write.mode("append").parquet(path)


def transitions(audit: DataFrame) -> DataFrame:
    """audit(session_id, seq, state, …) with from_state (IDLE at first). A state out of the list raises."""
    known = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("Unknown state: "), F.coalesce("state", F.lit("null")))))
    before = F.lag("state", 1, "IDLE").over(Window.partitionBy("session_id").orderBy("seq"))
    return audit.withColumn("state", known).withColumn("from_state", before)


def current_states(audit: DataFrame) -> DataFrame:
    """Each session's last state, what it says, and the number of transitions."""
    last = audit.groupBy("session_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("transitions"))
    says = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return last.withColumn("description", F.coalesce(F.try_element_at(says, F.col("state")), F.col("state")))


def log_table(recent: DataFrame) -> DataFrame:
    """Display fields of log rows: the minute, initials, and the most telling count as badge."""
    initials = F.upper(F.concat_ws("", F.substring(F.substring_index("user_name", " ", 1), 1, 1), F.substring(F.substring_index("user_name", " ", -1), 1, 1)))
    badge = (
        F.when(F.col("substantive") > 0, F.concat(F.col("substantive").cast("string"), F.lit(" substantive")))
        .when(F.col("added") > 0, F.concat(F.col("added").cast("string"), F.lit(" added")))
        .otherwise(F.concat(F.col("total_changes").cast("string"), F.lit(" changes")))
    )
    return recent.withColumns({"shown_at": F.date_format("created_at", "yyyy-MM-dd HH:mm"), "initials": F.coalesce(initials, F.lit("")), "badge": badge})
