"""Queries over winners, the history table, evidence, funnels, health and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.identity import base_source
from ..operators import evidence, funnel, health, merge, quality, resolve
from .registry import query, table
from .text_queries import COMPANY_SQL, IDENTITY_SQL, LOOSE_SQL
from .views import cte, view

AS_OF = "2024-02-01"
_TIES = ["source", "url", "seen_on", "l_linenumber", "url_direct"]
_ATS = "source IN ('greenhouse', 'lever')"
_RANK = "CASE gate WHEN 'QUALIFIED' THEN 1 WHEN 'VERIFY' THEN 0 END"
_DECISIVE = f"SELECT * FROM (SELECT *, max(CASE WHEN {_ATS} THEN 1 ELSE 0 END) OVER (PARTITION BY uid) AS any_ats FROM sightings) WHERE any_ats = 0 OR {_ATS}"
_SURFACED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_RANK} DESC, score DESC, CASE WHEN {_ATS} THEN 1 ELSE 0 END DESC,
  source DESC NULLS LAST, url DESC NULLS LAST, seen_on DESC NULLS LAST, l_linenumber DESC NULLS LAST, url_direct DESC NULLS LAST) AS n FROM ({_DECISIVE}) WHERE {_RANK} IS NOT NULL),
best AS (SELECT uid, coalesce(arg_min(url_direct, n) FILTER (WHERE url_direct <> ''), max(url_direct) FILTER (WHERE url_direct = '')) AS url_direct FROM ranked GROUP BY uid),
surfaced AS (SELECT r.uid, r.source, r.url, r.gate, r.score, b.url_direct FROM ranked r JOIN best b USING (uid) WHERE n = 1)"""


@query(cte("sightings") + f", {_SURFACED} SELECT * FROM surfaced")
def surfaced_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pick_surfaced(view(spark, sf_dir, "sightings"), _TIES).select("uid", "source", "url", "gate", "score", "url_direct")


@query(
    cte("sightings")
    + f""", {_SURFACED} SELECT uid, source, gate, score FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE gate WHEN 'SLOT-BLOCKED' THEN 1 ELSE 0 END DESC, score DESC, source, url, seen_on, l_linenumber, url_direct) AS n
  FROM ({_DECISIVE}) WHERE gate IN ('EXCLUDED', 'SLOT-BLOCKED') AND uid NOT IN (SELECT uid FROM surfaced)) WHERE n = 1"""
)
def demoted_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "sightings")
    return resolve.pick_demoted(s, resolve.pick_surfaced(s, _TIES), _TIES).select("uid", "source", "gate", "score")


@query(cte("sightings") + " SELECT uid, source, max_by(url, (seen_on, url)) AS url, max(seen_on) AS seen_on FROM sightings GROUP BY uid, source")
def sighting_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.sighting_ledger(view(spark, sf_dir, "sightings"))


@query(
    cte("postings")
    + f""", i AS ({IDENTITY_SQL}), k AS (SELECT doc_id, uid, source, CASE WHEN starts_with(source, 'freehire:') THEN split_part(source, ':', 2) ELSE split_part(source, ':', 1) END || '|' || ckey || '|https://jobs.example.com/' || CAST(doc_id % 101 AS VARCHAR) AS key FROM i),
n AS (SELECT key, min(uid) AS native_uid FROM k WHERE source IN ('greenhouse', 'lever', 'workday') GROUP BY key HAVING count(DISTINCT uid) = 1)
SELECT k.doc_id, n.native_uid FROM k JOIN n USING (key) WHERE k.source = 'freehire:greenhouse'"""
)
def exact_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.identity import opening_uid

    p = view(spark, sf_dir, "postings")
    uid = opening_uid(*[F.col(c) for c in ("company", "title", "source", "url", "external_id")])
    url = F.concat(F.lit("https://jobs.example.com/"), (F.col("doc_id") % 101).cast("string"))
    return resolve.exact_identities(p.select("doc_id", uid.alias("uid"), "company", "source", url.alias("url")))


@query(
    cte("postings")
    + f""", g AS (SELECT *, {COMPANY_SQL} || '|' || {LOOSE_SQL} AS group_key, CAST(doc_id % 101 AS INTEGER) AS score FROM postings)
SELECT doc_id, group_size FROM (SELECT doc_id, count(*) OVER (PARTITION BY group_key) AS group_size, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, CASE WHEN source IN ('greenhouse', 'lever', 'workday') THEN 1 ELSE 0 END DESC,
  CASE WHEN comp_max IS NOT NULL THEN 1 ELSE 0 END DESC, CASE WHEN location <> '' THEN 1 ELSE 0 END DESC, length(description) DESC, doc_id) AS n FROM g) WHERE n = 1"""
)
def representative_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postings")
    g = p.withColumn("group_key", F.concat(text.company_key(F.col("company")), F.lit("|"), text.title_key(F.col("title")))).withColumn("score", (F.col("doc_id") % 101).cast("int")).withColumn("uid", F.col("doc_id"))
    return resolve.representatives(g).select("doc_id", "group_size")


def snapshot_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored snapshot (documents not divisible by 5) and a batch (those not by 3), with edits."""
    p = view(spark, sf_dir, "postings").selectExpr("*", "doc_id AS uid", "department AS registry_lane", "CASE doc_id % 4 WHEN 0 THEN 'QUALIFIED' ELSE 'VERIFY' END AS gate", "CAST(doc_id % 97 AS INT) AS score", "'r' AS reasons", "department AS lane", "'2024-01-01' AS posted_at")
    stored = p.filter("doc_id % 5 <> 0").selectExpr(
        *[c for c in p.columns if c not in ("score", "comp_min", "comp_max", "comp_source", "remote_flag", "source")],
        "score - 1 AS score", "CASE WHEN doc_id % 2 = 0 THEN 50000 END AS comp_min", "CASE WHEN doc_id % 2 = 0 THEN 90000 END AS comp_max", "CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'unknown' END AS comp_source",
        "CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote_flag", "CASE WHEN doc_id % 7 = 0 THEN 'greenhouse' ELSE source END AS source",
        "CASE doc_id % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'ignored' ELSE 'new' END AS status", "DATE '2024-01-01' AS first_seen", "DATE '2024-01-20' AS last_seen", "3 AS seen_count",
        "1L AS first_seen_run", "2L AS last_seen_run", "CAST(NULL AS DATE) AS delisted_on", "CAST(doc_id % 2 AS INT) AS misses", "CASE WHEN doc_id % 2 = 1 THEN DATE '2024-01-25' END AS miss_on",
    )
    return stored, p.filter("doc_id % 3 <> 0")


_SNAP = """, p AS (SELECT *, doc_id AS uid, CASE doc_id % 4 WHEN 0 THEN 'QUALIFIED' ELSE 'VERIFY' END AS gate, CAST(doc_id % 97 AS INTEGER) AS score FROM postings),
s AS (SELECT uid, company, source AS src0, CASE WHEN doc_id % 7 = 0 THEN 'greenhouse' ELSE source END AS source, gate, score - 1 AS score, CASE WHEN doc_id % 2 = 0 THEN 50000 END AS comp_min, CASE WHEN doc_id % 2 = 0 THEN 90000 END AS comp_max,
  CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'unknown' END AS comp_source, CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote_flag, url_direct,
  CASE doc_id % 6 WHEN 0 THEN 'applied' WHEN 1 THEN 'ignored' ELSE 'new' END AS status, CAST(doc_id % 2 AS INTEGER) AS misses, CASE WHEN doc_id % 2 = 1 THEN DATE '2024-01-25' END AS miss_on, doc_id FROM p WHERE doc_id % 5 <> 0),
b AS (SELECT * FROM p WHERE doc_id % 3 <> 0)"""


@query(
    cte("postings")
    + _SNAP
    + """
SELECT coalesce(b.uid, s.uid) AS uid, coalesce(s.status, 'new') AS status,
 CASE WHEN b.uid IS NULL OR s.status IN ('applied', 'ignored') THEN s.score ELSE b.score END AS score,
 CASE WHEN b.uid IS NOT NULL AND (res OR s.uid IS NULL) THEN b.comp_min ELSE s.comp_min END AS comp_min,
 CASE WHEN b.uid IS NOT NULL AND (res OR s.uid IS NULL) THEN b.comp_max ELSE s.comp_max END AS comp_max,
 CASE WHEN b.uid IS NOT NULL AND (res OR s.uid IS NULL) THEN b.comp_source WHEN b.uid IS NOT NULL AND s.uid IS NOT NULL AND s.comp_min IS NULL AND s.comp_max IS NULL AND b.comp_source = 'absent' THEN 'absent' ELSE s.comp_source END AS comp_source,
 CASE WHEN b.remote_flag IS NULL THEN s.remote_flag WHEN b.remote_flag THEN TRUE WHEN (b.source IN ('greenhouse', 'lever', 'workday') AND b.board <> '') OR s.remote_flag IS NULL THEN FALSE ELSE s.remote_flag END AS remote_flag,
 CASE WHEN b.uid IS NOT NULL AND s.uid IS NOT NULL AND starts_with(b.source, 'freehire:') AND s.source IN ('greenhouse', 'lever', 'workday') THEN s.source WHEN b.uid IS NOT NULL THEN b.source ELSE s.source END AS source,
 CASE WHEN b.url_direct IS NULL THEN s.url_direct WHEN b.url_direct <> '' THEN b.url_direct WHEN s.url_direct IS NULL THEN '' ELSE s.url_direct END AS url_direct,
 CASE WHEN s.uid IS NULL THEN 1 WHEN b.uid IS NULL THEN 3 ELSE 4 END AS seen_count,
 CASE WHEN b.uid IS NOT NULL THEN DATE '2024-02-01' ELSE DATE '2024-01-20' END AS last_seen, CASE WHEN b.uid IS NOT NULL THEN 0 ELSE s.misses END AS misses
FROM s FULL JOIN (SELECT *, comp_source IN ('board', 'body', 'unknown') AND (comp_min IS NOT NULL OR comp_max IS NOT NULL) AS res FROM b) b ON s.uid = b.uid"""
)
def merged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = snapshot_inputs(spark, sf_dir)
    m = merge.merge_snapshot(stored, batch, F.lit(AS_OF).cast("date"), F.lit(3).cast("long"))
    return m.select("uid", "status", "score", "comp_min", "comp_max", "comp_source", "remote_flag", "source", "url_direct", "seen_count", "last_seen", "misses")


@query(
    cte("postings")
    + _SNAP
    + """, t AS (SELECT *, DATE '2024-01-20' < DATE '2024-02-01' AND source IN ('greenhouse', 'workday') AND status <> 'applied' AS miss FROM s)
SELECT uid, misses + CASE WHEN miss THEN 1 ELSE 0 END AS misses, CASE WHEN miss THEN DATE '2024-02-01' ELSE miss_on END AS miss_on,
  CASE WHEN status <> 'applied' AND misses + CASE WHEN miss THEN 1 ELSE 0 END >= 2 THEN DATE '2024-02-01' END AS delisted_on FROM t"""
)
def retired_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, _ = snapshot_inputs(spark, sf_dir)
    healthy = stored.filter(base_source(F.col("source")).isin("greenhouse", "workday")).select("source").distinct()
    return merge.retire(stored, healthy, F.lit(AS_OF).cast("date")).select("uid", "misses", "miss_on", "delisted_on")


@query(r"""
WITH d AS (SELECT user_id AS uid, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS seen FROM events GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY day) AS island FROM d)
SELECT uid, day, CAST(m AS BIGINT) AS misses, m >= 2 AS delisted FROM (SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY uid, island ORDER BY day) AS m FROM i)""")
def miss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid"), F.to_date("ts").alias("day")).agg((F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)) == 1).alias("seen"))
    return merge.miss_history(days)


@query(
    cte("openings")
    + """ SELECT o_custkey AS canonical_uid, arg_max(status, CASE status WHEN 'new' THEN 0 WHEN 'reviewed' THEN 1 WHEN 'ignored' THEN 2 WHEN 'applied' THEN 3 ELSE 4 END) AS status, min(first_seen) AS first_seen, max(first_seen) AS last_seen,
 CAST(sum(score) AS BIGINT) AS seen_count, array_to_string(list_sort(list_distinct(list(lane))), '; ') AS notes, arg_min(comp_min, uid) FILTER (WHERE comp_min IS NOT NULL) AS comp_min, arg_min(comp_max, uid) AS comp_max, count(*) AS merged FROM openings GROUP BY 1"""
)
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings").withColumns({"last_seen": F.col("first_seen"), "seen_count": F.col("score").cast("long"), "notes": F.col("lane")})
    return merge.merge_duplicates(o, "o_custkey")


@query(
    cte("openings")
    + """ SELECT uid, gate AS old_gate, CASE WHEN score < 40 THEN 'EXCLUDED' ELSE gate END AS new_gate, score AS old_score, CASE WHEN score < 40 THEN 0 ELSE score END AS new_score, gate IN ('QUALIFIED', 'VERIFY') AS dropped
FROM openings WHERE status IN ('new', 'reviewed') AND (CASE WHEN score < 40 THEN 'EXCLUDED' ELSE gate END <> gate OR CASE WHEN score < 40 THEN 0 ELSE score END <> score)"""
)
def rescore_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings")
    again = o.withColumns({"gate": F.when(F.col("score") < 40, "EXCLUDED").otherwise(F.col("gate")), "score": F.when(F.col("score") < 40, 0).otherwise(F.col("score"))})
    c = merge.rescored(o, again)
    return c.withColumn("dropped", F.col("dropped"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.TITLE_STOP) + ")))"


@query(f"""
WITH e AS (SELECT p_partkey AS line, p_brand AS key, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE {_WORDS.format("p_name")} END AS words FROM part WHERE p_size <= 10),
p AS (SELECT p_partkey AS uid, p_brand AS key, {_WORDS.format("p_name || ' ' || p_type")} AS words FROM part WHERE p_size > 10),
s AS (SELECT e.line, p.uid, e.words IS NULL AS untitled, CASE WHEN p.uid IS NULL THEN NULL WHEN e.words IS NULL THEN 0.0 ELSE CAST(len(list_intersect(e.words, p.words)) AS DOUBLE) / len(list_distinct(list_concat(e.words, p.words))) END AS score FROM e LEFT JOIN p USING (key)),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS runner_up, count(uid) OVER (PARTITION BY line) AS candidates FROM s WINDOW w AS (PARTITION BY line ORDER BY score DESC NULLS LAST, uid)),
v AS (SELECT *, CASE WHEN candidates = 0 THEN 'unmatched' WHEN untitled THEN CASE WHEN candidates = 1 THEN 'matched' ELSE 'ambiguous' END WHEN score >= 0.6 AND score - coalesce(runner_up, 0) >= 0.15 THEN 'matched' WHEN score >= 0.6 THEN 'ambiguous' ELSE 'unmatched' END AS verdict FROM r WHERE n = 1)
SELECT line, verdict, CASE WHEN verdict = 'matched' THEN uid END AS uid, score AS best, runner_up FROM v""")
def matched_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    e = part.filter("p_size <= 10").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("key"), F.when(F.col("p_partkey") % 5 != 0, text.title_tokens(F.col("p_name"))).alias("words"))
    p = part.filter("p_size > 10").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("key"), text.title_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"))
    return evidence.match_evidence(e, p)


@query(f"""
WITH t AS (SELECT p_partkey AS uid, p_brand AS key, {_WORDS.format("p_name || ' ' || p_type")} AS words, p_size FROM part),
x AS (SELECT l.uid, r.uid AS rejected_uid, l.words, r.words AS rw, row_number() OVER (PARTITION BY l.uid ORDER BY r.uid) AS n FROM t l JOIN t r USING (key) WHERE l.p_size > 25 AND r.p_size <= 5),
o AS (SELECT uid, rejected_uid, CAST(len(list_intersect(words, rw)) AS DOUBLE) / len(list_distinct(list_concat(words, rw))) AS overlap FROM x WHERE n = 1)
SELECT uid, rejected_uid, CASE WHEN overlap >= 0.6 THEN 'problem' ELSE 'note' END AS severity, overlap FROM o WHERE overlap > 0""")
def closed_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("key"), text.title_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("words"), "p_size")
    return evidence.closed_doors(t.filter("p_size > 25").drop("p_size"), t.filter("p_size <= 5").drop("p_size"))


@query(r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT page_id AS line, host, CASE WHEN page_id % 2 = 0 THEN path ELSE regexp_extract(path, '^/[^/]*') END AS path FROM u WHERE page_id % 3 = 0),
h AS (SELECT t.line, count(p.page_id) AS hits, min(p.page_id) AS uid FROM t LEFT JOIN (SELECT * FROM u WHERE page_id % 3 <> 0) p ON t.host = p.host AND (p.path = t.path OR starts_with(p.path, rtrim(t.path, '/') || '/')) GROUP BY t.line)
SELECT line, CASE WHEN hits = 0 THEN 'history' WHEN hits = 1 THEN 'drift' ELSE 'ambiguous' END AS verdict, hits, CASE WHEN hits = 1 THEN uid END AS uid FROM h""")
def tracker_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))
    t = u.filter("page_id % 3 = 0").select(F.col("page_id").alias("line"), "host", F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.regexp_extract("path", "^/[^/]*", 0)).alias("path"))
    return evidence.tracker_drift(t, u.filter("page_id % 3 <> 0").withColumnRenamed("page_id", "uid"))


_FOLD = f"""a AS (SELECT uid, arg_max(stage, (day, stage_no, event_id)) FILTER (WHERE stage IS NOT NULL) AS current_stage, max(day) AS last_activity, min(day) FILTER (WHERE stage = 'applied') AS applied_on,
  min(day) FILTER (WHERE stage IN ('interviewing', 'offer')) AS interview_on, min(day) FILTER (WHERE stage IN ('offer', 'rejected')) AS outcome_on, bool_or(coalesce(stage IN ('interviewing', 'offer'), FALSE)) AS interviewed, bool_or(coalesce(stage = 'offer', FALSE)) AS offered
  FROM app_events GROUP BY uid HAVING count(stage) > 0),
f AS (SELECT *, CASE WHEN last_activity <= DATE '{AS_OF}' THEN date_diff('day', last_activity, DATE '{AS_OF}') END AS days_silent, CASE WHEN interview_on >= applied_on THEN date_diff('day', applied_on, interview_on) END AS days_to_interview,
  CASE WHEN outcome_on >= applied_on THEN date_diff('day', applied_on, outcome_on) END AS days_to_outcome FROM a)"""


@query(cte("app_events") + f", {_FOLD} SELECT uid, current_stage, applied_on, last_activity, interviewed, offered, days_silent, current_stage IN ('applied', 'interviewing') AND coalesce(days_silent >= 5, FALSE) AS follow_up_due, days_to_interview, days_to_outcome FROM f")
def application_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.fold_applications(view(spark, sf_dir, "app_events"), F.lit(AS_OF).cast("date"), 5)


@query(
    cte("app_events")
    + f""", {_FOLD} SELECT count(*) AS submitted, CAST(sum(CASE WHEN current_stage IN ('applied', 'interviewing', 'offer') THEN 1 ELSE 0 END) AS BIGINT) AS active, CAST(sum(CASE WHEN interviewed THEN 1 ELSE 0 END) AS BIGINT) AS interviewed, CAST(sum(CASE WHEN offered THEN 1 ELSE 0 END) AS BIGINT) AS offers,
 CAST(sum(CASE WHEN current_stage = 'rejected' THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS withdrawn, round(100.0 * sum(CASE WHEN interviewed THEN 1 ELSE 0 END) / count(*), 1) AS interview_rate, round(100.0 * sum(CASE WHEN offered THEN 1 ELSE 0 END) / count(*), 1) AS offer_rate,
 median(days_to_interview) AS median_days_to_interview, median(days_to_outcome) AS median_days_to_outcome FROM f"""
)
def funnel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.summary(funnel.fold_applications(view(spark, sf_dir, "app_events"), F.lit(AS_OF).cast("date")))


@query(cte("app_events") + f", {_FOLD} SELECT 'lane' || CAST(uid % 6 AS VARCHAR) AS lane, count(*) AS submitted, CAST(sum(CASE WHEN interviewed THEN 1 ELSE 0 END) AS BIGINT) AS interviewed, round(100.0 * sum(CASE WHEN interviewed THEN 1 ELSE 0 END) / count(*), 1) AS interview_rate, CAST(sum(CASE WHEN offered THEN 1 ELSE 0 END) AS BIGINT) AS offers FROM f GROUP BY 1")
def funnel_by_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = funnel.fold_applications(view(spark, sf_dir, "app_events"), F.lit(AS_OF).cast("date"))
    return funnel.by_lane(apps.withColumn("lane", F.concat(F.lit("lane"), (F.col("uid") % 6).cast("string"))))


@query(cte("app_events") + f", {_FOLD}, w AS (SELECT CAST(date_trunc('week', DATE '{AS_OF}') AS DATE) - 7 * CAST(i AS INTEGER) AS week FROM range(8) t(i)) SELECT w.week, count(f.uid) AS applications FROM w LEFT JOIN f ON f.applied_on BETWEEN w.week AND w.week + 6 GROUP BY w.week")
def weekly_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.weekly(funnel.fold_applications(view(spark, sf_dir, "app_events"), F.lit(AS_OF).cast("date")), F.lit(AS_OF).cast("date"))


@query(cte("app_events") + " SELECT uid, list(CAST(day AS VARCHAR) || ':' || stage ORDER BY day, stage_no, event_id) AS timeline FROM app_events WHERE stage IS NOT NULL GROUP BY uid")
def application_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.timelines(view(spark, sf_dir, "app_events"))


_HEALTH = """m AS (SELECT *, last_value(CASE WHEN error IS NULL THEN count END IGNORE NULLS) OVER (PARTITION BY source ORDER BY "at", run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_count,
  sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY "at", run_id ROWS UNBOUNDED PRECEDING) AS island, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, run_id DESC) AS back FROM source_runs),
h AS (SELECT source, max(CASE WHEN error IS NULL THEN "at" END) OVER (PARTITION BY source) AS last_ok, count AS last_count, error AS last_error, CAST(sum(CASE WHEN error IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY source, island) AS BIGINT) AS consecutive_failures, prev_count, back FROM m),
health AS (SELECT source, last_ok, last_count, last_error, consecutive_failures, prev_count FROM h WHERE back = 1)"""


@query(cte("source_runs") + f", {_HEALTH} SELECT source, CAST(last_ok AS VARCHAR) AS last_ok, last_count, last_error, consecutive_failures, prev_count FROM health".replace("CAST(last_ok AS VARCHAR)", "strftime(last_ok, '%Y-%m-%d %H:%M:%S')"))
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.fold_health(view(spark, sf_dir, "source_runs")).withColumn("last_ok", F.date_format("last_ok", "yyyy-MM-dd HH:mm:ss"))


@query(
    cte("source_runs")
    + f", {_HEALTH} SELECT source, CASE WHEN last_error IS NOT NULL THEN 'failed' WHEN date_diff('day', CAST(last_ok AS DATE), DATE '{AS_OF}') >= 7 THEN 'stale' ELSE 'healthy' END AS state, last_error IS NULL AND NOT coalesce(prev_count >= 10 AND last_count < 0.5 * prev_count, FALSE) AS may_retire FROM health"
)
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = health.fold_health(view(spark, sf_dir, "source_runs"))
    ok = health.may_retire(h).select("source", F.lit(True).alias("ok"))
    return h.join(ok, "source", "left").select("source", health.health_state(F.to_date("last_ok"), F.col("last_error"), F.lit(AS_OF).cast("date")).alias("state"), F.coalesce("ok", F.lit(False)).alias("may_retire"))


@query(
    cte("openings")
    + """ SELECT uid, unnest(list_filter([CASE WHEN starts_with(reasons, 'comp:') AND comp_min IS NULL AND comp_max IS NULL THEN 'pay quoted but not stored' END, CASE WHEN comp_max < comp_min THEN 'pay ends out of order' END, CASE WHEN comp_max > 10 * comp_min THEN 'pay spread too wide' END,
 CASE WHEN comp_source IS NULL THEN 'pay without provenance' END], lambda x: x IS NOT NULL)) AS "check" FROM openings"""
)
def broken_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invariants(view(spark, sf_dir, "openings"))


@query(
    cte("openings")
    + """, a AS (SELECT uid, gate, CASE WHEN uid % 10 = 0 THEN score + 1 ELSE score END AS score FROM openings WHERE uid % 7 <> 0)
SELECT coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'missing' ELSE 'score' END AS field, CASE WHEN a.uid IS NOT NULL THEN CAST(a.score AS VARCHAR) END AS published, CASE WHEN a.uid IS NULL THEN CAST(b.uid AS VARCHAR) ELSE CAST(b.score AS VARCHAR) END AS stored
FROM a RIGHT JOIN openings b ON a.uid = b.uid WHERE a.uid IS NULL OR a.score <> b.score"""
)
def export_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = view(spark, sf_dir, "openings").select("uid", "gate", "score")
    published = stored.filter("uid % 7 <> 0").withColumn("score", F.when(F.col("uid") % 10 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return quality.differences(published, stored, "uid", ["gate", "score"])


_STATE = ("uid", "status", "gate", "score", "comp_min", "comp_source", "delisted_on")
_DIGEST = lambda extra="": "sha256(concat(" + ", ".join(f"coalesce('s' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in _STATE).replace("CAST(score AS VARCHAR)", f"CAST(score{extra} AS VARCHAR)") + "))"


def _tree(name: str, source: str) -> str:
    """Leaves of two digits, their parents and the root, by lane."""
    node = "sha256(string_agg({}, chr(10) ORDER BY {}))"
    return f"""{name}0 AS (SELECT lane, digest, count(*) AS n FROM ({source}) GROUP BY ALL), {name}2 AS (SELECT lane, substr(digest, 1, 2) AS prefix, sum(n) AS rows, {node.format("digest || ':' || n", "digest")} AS digest FROM {name}0 GROUP BY ALL),
{name}1 AS (SELECT lane, substr(prefix, 1, 1) AS p, sum(rows) AS rows, {node.format("digest", "prefix")} AS digest FROM {name}2 GROUP BY ALL), {name} AS (SELECT lane, prefix, rows, digest FROM {name}2 UNION ALL SELECT lane, p, rows, digest FROM {name}1 UNION ALL SELECT lane, '', sum(rows), {node.format("digest", "p")} FROM {name}1 GROUP BY lane)"""


@query(cte("openings") + f", {_tree('t', f'SELECT lane, {_DIGEST()} AS digest FROM openings')} SELECT lane, prefix, CAST(rows AS BIGINT) AS rows, digest FROM t")
def state_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of the stored openings' states by lane."""
    return quality.fingerprint(view(spark, sf_dir, "openings").select("lane", *_STATE), ["lane"])


@query(cte("openings") + f""", {_tree('t', f'SELECT lane, {_DIGEST()} AS digest FROM openings')}, {_tree('o', f"SELECT lane, {_DIGEST(" + CASE WHEN lane = '1-URGENT' AND uid % 1000 = 1 THEN 1 ELSE 0 END")} AS digest FROM openings")}
SELECT o.lane, o.lane IN ('1-URGENT', '5-LOW') AS stale, CASE WHEN o.lane = '5-LOW' THEN 'another day' WHEN o.digest <> t.digest THEN 'rows changed' END AS why FROM o JOIN t ON o.lane = t.lane AND o.prefix = '' AND t.prefix = ''""")
def stale_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by lane that were rendered before a few scores of one lane changed, or the day before."""
    openings = view(spark, sf_dir, "openings").select("lane", *_STATE)
    before = openings.withColumn("score", F.col("score") + F.when((F.col("lane") == "1-URGENT") & (F.col("uid") % 1000 == 1), 1).otherwise(0))
    day = F.when(F.col("lane") == "5-LOW", F.lit("2024-01-31")).otherwise(AS_OF).cast("date")
    published = quality.fingerprint(before, ["lane"]).filter("prefix = ''").select("lane", "digest", day.alias("day"))
    return quality.stale(published, quality.fingerprint(openings, ["lane"]), ["lane"], F.lit(AS_OF).cast("date"))


@query(cte("openings") + " SELECT gate, status, count(*) AS n, CAST(max(score) AS INTEGER) AS best FROM openings GROUP BY gate, status")
def counts_by_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "openings").groupBy("gate", "status").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query(cte("openings") + " SELECT uid, score, first_seen FROM openings WHERE gate IN ('QUALIFIED', 'VERIFY') AND score >= 55 AND status NOT IN ('applied', 'rejected', 'ignored') AND delisted_on IS NULL ORDER BY score DESC, first_seen DESC, uid LIMIT 200")
def queue_of_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "openings").filter(F.col("gate").isin("QUALIFIED", "VERIFY") & (F.col("score") >= 55) & ~F.col("status").isin(*merge.ACTED) & F.col("delisted_on").isNull())
    return o.orderBy(F.desc("score"), F.desc("first_seen"), "uid").limit(200).select("uid", "score", "first_seen")
