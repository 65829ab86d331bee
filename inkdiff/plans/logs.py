"""Queries over users, sessions, the comparison log and audit trails, derived from customer, orders, events, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-20 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def users(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("institution"),
        F.lit("user").alias("role"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 60).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_login"),
    )


def log(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    number = lambda n: (k % n).cast("int")
    return o.select(
        k.alias("id"), F.when(k % 7 != 0, F.col("o_custkey")).alias("user_id"), F.concat(F.lit("old"), k.cast("string")).alias("doc_a_name"), F.concat(F.lit("new"), k.cast("string")).alias("doc_b_name"),
        number(50).alias("total_changes"), number(5).alias("substantive"), number(3).alias("added"), number(4).alias("removed"), number(6).alias("wording_only"), F.col("o_orderdate").alias("created_at"),
    )


def sessions(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), "user_id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))


def audit(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    state = F.element_at(F.array(*map(F.lit, logs.STATES)), (F.col("turn") % 11).cast("int") + 1)
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), state.alias("state"))


_USERS = "(SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name, lower(c_name) || '@example.org' AS email, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS institution, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at FROM customer)"
_LOG = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS user_id, o_orderkey % 50 AS total_changes, o_orderkey % 5 AS substantive, o_orderkey % 3 AS added, o_orderdate AS created_at FROM orders)"
_SESSIONS = "(SELECT 't' || CAST(event_id AS VARCHAR) AS token, user_id, ts AS created_at, ts + INTERVAL 7 DAYS AS expires_at FROM events)"
_STATES = "[" + ", ".join(f"'{s}'" for s in logs.STATES) + "]"
_AUDIT = f"(SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, ({_STATES})[turn % 11 + 1] AS state FROM conversations)"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(f"SELECT (SELECT count(*) FROM {_USERS}) AS total_users, (SELECT count(DISTINCT institution) FROM {_USERS} WHERE institution <> '') AS total_institutions, (SELECT count(*) FROM {_LOG}) AS total_comparisons")
def admin_totals(spark, sf_dir):
    return logs.admin_totals(users(spark, sf_dir), log(spark, sf_dir))


@query(f"SELECT count(DISTINCT user_id) AS active_today FROM {_SESSIONS} WHERE created_at >= TIMESTAMP '2024-01-20'")
def active_users(spark, sf_dir):
    return logs.active_users(sessions(spark, sf_dir), _as_of())


_RECENT = f"(SELECT l.*, first_name || ' ' || last_name AS user_name, institution FROM {_LOG} l LEFT JOIN {_USERS} u ON u.id = l.user_id ORDER BY l.created_at DESC, l.id DESC LIMIT 10)"


@query(f"SELECT id, user_id, total_changes, user_name, institution FROM {_RECENT}")
def recent_log(spark, sf_dir):
    r = logs.recent_comparisons(log(spark, sf_dir), users(spark, sf_dir))
    return r.select("id", "user_id", F.col("total_changes").cast("long").alias("total_changes"), "user_name", "institution")


@query(f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS shown_at, coalesce(upper(substr(user_name, 1, 1) || substr(split_part(user_name, ' ', 2), 1, 1)), '') AS initials, CASE WHEN substantive > 0 THEN CAST(substantive AS VARCHAR) || ' substantive' WHEN added > 0 THEN CAST(added AS VARCHAR) || ' added' ELSE CAST(total_changes AS VARCHAR) || ' changes' END AS badge FROM {_RECENT}")
def admin_table(spark, sf_dir):
    return logs.log_table(logs.recent_comparisons(log(spark, sf_dir), users(spark, sf_dir))).select("id", "shown_at", "initials", "badge")


@query(f"SELECT id, first_name, last_name, email, institution, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM {_USERS}")
def all_users(spark, sf_dir):
    return logs.all_users(users(spark, sf_dir)).select("id", "first_name", "last_name", "email", "institution", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(f"SELECT token, id, email FROM {_SESSIONS} s JOIN {_USERS} u ON u.id = s.user_id WHERE expires_at > TIMESTAMP '{AS_OF}'")
def session_users(spark, sf_dir):
    return logs.users_by_token(users(spark, sf_dir), sessions(spark, sf_dir), _as_of()).select("token", "id", "email")


@query(f"SELECT id, email FROM {_SESSIONS} s JOIN {_USERS} u ON u.id = s.user_id WHERE expires_at > TIMESTAMP '{AS_OF}' AND token = 't6000'")
def user_by_token(spark, sf_dir):
    return logs.users_by_token(users(spark, sf_dir), sessions(spark, sf_dir), _as_of(), "t6000").select("id", "email")


@query(f"SELECT u.id, strftime(m, '%Y-%m-%d %H:%M:%S') AS last_login FROM {_USERS} u LEFT JOIN (SELECT user_id, max(created_at) AS m FROM {_SESSIONS} GROUP BY user_id) s ON s.user_id = u.id")
def login_view(spark, sf_dir):
    return logs.last_logins(users(spark, sf_dir), sessions(spark, sf_dir)).select("id", F.date_format("last_login", "yyyy-MM-dd HH:mm:ss").alias("last_login"))


@query(f"SELECT token FROM {_SESSIONS} WHERE CAST(substr(token, 2) AS BIGINT) % 3 <> 0")
def logout(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return logs.delete_sessions(s, s.where(F.substring("token", 2, 20).cast("long") % 3 == 0)).select("token")


@query(f"SELECT (SELECT count(*) FROM {_USERS} WHERE id % 4 <> 1) AS users, (SELECT count(*) FROM {_SESSIONS} WHERE user_id NOT IN (SELECT id FROM {_USERS} WHERE id % 4 = 1)) AS sessions, (SELECT count(*) FROM {_LOG} WHERE user_id IS NULL OR user_id % 4 = 1) AS anonymous")
def user_delete(spark, sf_dir):
    u = users(spark, sf_dir)
    left = logs.delete_users(u, sessions(spark, sf_dir), log(spark, sf_dir), u.where("id % 4 = 1"))
    one = [left[0].agg(F.count("*").alias("users")), left[1].agg(F.count("*").alias("sessions")), left[2].agg(F.count_if(F.col("user_id").isNull()).alias("anonymous"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # one row each


@query(
    f"""SELECT id AS request_id, CASE WHEN id % 6 = 0 THEN 'Password must be at least 8 characters.' WHEN id % 2 = 0 OR row_number() OVER (PARTITION BY mail, id % 6 = 0 ORDER BY id) > 1 THEN 'An account with this email already exists.' END AS error, mail AS email
    FROM (SELECT id, CASE WHEN id % 2 = 0 THEN email ELSE 'new' || CAST(id % 9 AS VARCHAR) || '@example.org' END AS mail FROM {_USERS})"""
)
def register_users(spark, sf_dir):
    """Requests: the even ones repeat a known address in capitals, the odd ones share nine new addresses."""
    u = users(spark, sf_dir)
    mail = F.when(F.col("id") % 2 == 0, F.upper("email")).otherwise(F.concat(F.lit(" New"), (F.col("id") % 9).cast("string"), F.lit("@example.org ")))
    asked = u.select(F.col("id").alias("request_id"), "first_name", "last_name", mail.alias("email"), "institution", F.when(F.col("id") % 6 == 0, 7).otherwise(8).alias("password_length"))
    return logs.new_users(asked, u).select("request_id", "error", "email")


@query(f"SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN substantive END, 0) AS substantive FROM {_LOG}")
def log_append(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("substantive", F.when(F.col("id") % 2 == 0, F.col("substantive")))
    return logs.log_rows(rows).select("id", F.col("substantive").cast("long").alias("substantive"))


@query(f"SELECT session_id, seq, lag(state, 1, 'IDLE') OVER (PARTITION BY session_id ORDER BY seq) AS from_state, state AS to_state FROM {_AUDIT}")
def state_transitions(spark, sf_dir):
    return logs.transitions(audit(spark, sf_dir)).select("session_id", "seq", "from_state", F.col("state").alias("to_state"))


@query(f"SELECT session_id, arg_max(state, seq) AS state, count(*) AS transitions, CASE arg_max(state, seq) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in logs.STATES.items())} END AS description FROM {_AUDIT} GROUP BY session_id")
def current_state(spark, sf_dir):
    return logs.current_states(audit(spark, sf_dir)).select("session_id", "state", "transitions", "description")
