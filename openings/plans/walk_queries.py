"""Queries over page walks, detail pages and hydrated previews.  Their SQL reads the same pages, written a second time over the rows that both sides start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hydrate
from ..sources import payloads, walks
from .registry import query, table

PAGE, MOST = 20, 25

#: Items of boards: a supplier is a board, its line items are what its pages list; some pages repeat what an earlier one had.
_ITEMS = """SELECT 'walked' AS source, CAST(l_suppkey AS VARCHAR) AS board, CAST(floor(n / 20) AS INT) AS page_no, n % 20 AS pos,
 CASE WHEN l_suppkey % 19 = 0 AND n = 45 THEN NULL WHEN l_suppkey % 17 = 0 AND n >= 40 THEN concat('again', CAST(n % 20 AS VARCHAR)) WHEN l_suppkey % 5 = 4 THEN concat('o', CAST(l_orderkey AS VARCHAR)) ELSE concat('l', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) END AS external_id, l_suppkey
 FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS n FROM lineitem WHERE l_orderkey % 3 < 2 OR l_suppkey % 2 = 0)"""
#: What each page answered: totals that are said once, fall to 0, grow too large, aren't whole or never come; pages that fail or were never fetched.
_PAGES = """SELECT source, board, page_no, CASE WHEN l_suppkey % 11 = 0 AND page_no = 2 THEN 503 ELSE 200 END AS http_status, NOT (l_suppkey % 13 = 0 AND page_no = 1) AS parsed,
 CASE WHEN l_suppkey % 7 = 0 THEN '12.5' WHEN l_suppkey % 6 = 1 AND page_no > 0 THEN '0' WHEN l_suppkey % 8 = 3 THEN CAST(every_item + 7 AS VARCHAR) WHEN l_suppkey % 8 = 5 THEN CAST(every_item - 30 AS VARCHAR) WHEN l_suppkey % 16 = 6 THEN '0' ELSE CAST(every_item AS VARCHAR) END AS total
 FROM (SELECT source, board, page_no, l_suppkey, sum(count(*)) OVER (PARTITION BY board) AS every_item FROM items GROUP BY source, board, page_no, l_suppkey) WHERE NOT (l_suppkey % 10 = 9 AND page_no = 3)"""

_STEPS = f"""WITH items AS ({_ITEMS}), pages AS ({_PAGES}),
firsts AS (SELECT board, external_id, min(page_no) AS page_no FROM items WHERE external_id IS NOT NULL GROUP BY ALL),
a AS (SELECT p.*, (SELECT count(*) FROM items i WHERE i.board = p.board AND i.page_no = p.page_no) AS n_items, (SELECT count(external_id) FROM items i WHERE i.board = p.board AND i.page_no = p.page_no) AS named,
 (SELECT count(DISTINCT external_id) FROM items i WHERE i.board = p.board AND i.page_no = p.page_no) AS dist, (SELECT string_agg(external_id, ',' ORDER BY pos) FROM items i WHERE i.board = p.board AND i.page_no = p.page_no) AS ids,
 (SELECT count(*) FROM firsts f WHERE f.board = p.board AND f.page_no = p.page_no) AS fresh, CASE WHEN regexp_full_match(total, '[0-9]+') THEN CAST(total AS BIGINT) END AS said FROM pages p),
b AS (SELECT *, row_number() OVER w - 1 AS nth, CAST(sum(fresh) OVER w AS BIGINT) AS found, max(CASE WHEN said > 0 THEN said END) OVER w AS most, row_number() OVER (PARTITION BY board, ids ORDER BY page_no) > 1 AS again FROM a WINDOW w AS (PARTITION BY board ORDER BY page_no)),
c AS (SELECT *, CASE WHEN page_no <> nth THEN 'missing page' WHEN http_status <> 200 THEN 'http' WHEN NOT parsed THEN 'unusable' WHEN again THEN 'replayed page' WHEN fresh = 0 THEN 'no progress' WHEN found > most THEN 'above total' WHEN found = most THEN 'complete'
 WHEN n_items < {PAGE} AND found < most THEN 'short page' WHEN n_items < {PAGE} THEN 'end' END AS "end" FROM b WHERE nth < {MOST}),
steps AS (SELECT * FROM c WHERE nth <= coalesce((SELECT min(nth) FROM c x WHERE x.board = c.board AND x."end" IS NOT NULL), 1000000))"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(_ITEMS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    pages = spark.sql(_PAGES.replace("VARCHAR", "STRING").replace("FROM items", "FROM {items}"), items=items)
    return walks.walk_steps(pages, items.drop("l_suppkey"), PAGE, MOST)


@query(_STEPS + """ SELECT board, page_no, n_items AS items, fresh, n_items - named AS unlisted, named - dist AS repeats, dist - fresh AS earlier, found, most AS total, "end" FROM steps""")
def walk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("board", "page_no", "items", "fresh", "unlisted", "repeats", "earlier", "found", "total", "end")


@query(
    _STEPS
    + f""", g AS (SELECT board, count(*) AS pages, max("end") AS e, max(CASE WHEN u THEN found END) AS fetched, max(CASE WHEN u THEN most END) AS total, bool_or(u AND said IS NULL) AS bad, bool_or(u AND said = 0 AND most IS NULL) AS zero,
 sum(CASE WHEN u THEN n_items - named END) AS unlisted, sum(CASE WHEN u THEN named - dist END) AS repeats, sum(CASE WHEN u THEN dist - fresh END) AS earlier
 FROM (SELECT *, coalesce("end", '') NOT IN ('missing page', 'http', 'unusable', 'replayed page') AS u FROM steps) GROUP BY board),
h AS (SELECT *, coalesce(e, CASE WHEN pages >= {MOST} THEN 'page ceiling' ELSE 'pages stop' END) AS "end" FROM g),
n AS (SELECT *, concat_ws('; ', CASE WHEN bad THEN 'page without a total' END, CASE WHEN zero AND "end" <> 'page ceiling' THEN 'total 0 with items' END, CASE WHEN unlisted > 0 THEN 'items without an id' END, CASE WHEN repeats > 0 THEN 'ids repeated in a page' END, CASE WHEN earlier > 0 THEN 'ids of earlier pages' END) AS notes FROM h)
SELECT board, pages, coalesce(fetched, 0) AS fetched, total, "end", CASE WHEN "end" NOT IN ('complete', 'end', 'page ceiling') OR notes <> '' THEN 'partial' WHEN "end" = 'page ceiling' THEN 'capped' ELSE 'whole' END AS verdict, notes FROM n"""
)
def walk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.walk_verdicts(_steps(spark, sf_dir), MOST).drop("source")


#: Previews and details of a discovery feed, as both sides read them.
_SEEN = {
    "slug": "concat('s', CAST(c_custkey AS VARCHAR))", "source": "CASE WHEN c_custkey % 5 = 4 THEN 'Lever ' ELSE 'greenhouse' END",
    "url": "concat(CASE WHEN c_custkey % 14 = 13 THEN 'http' ELSE 'https' END, '://', CASE WHEN c_custkey % 5 = 4 THEN 'jobs.lever.co' WHEN c_custkey % 23 = 7 THEN 'lever.co' ELSE 'boards.greenhouse.io' END, '/', lower(c_mktsegment), '/', CAST(c_custkey AS VARCHAR))",
    "title": "concat(CASE WHEN c_nationkey % 4 = 0 THEN 'Buyer, ' ELSE 'Sales Lead, ' END, c_mktsegment)", "company": "c_name", "external_id": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END", "location": "'preview'", "description": "'short'", "posted_at": "'2024-01-01'",
    "closed_at": "CASE WHEN c_custkey % 29 = 3 THEN '2024-02-01' END",
}
_GOT = {
    "asked": _SEEN["slug"], "http_status": "CASE WHEN c_custkey % 12 = 7 THEN 404 ELSE 200 END", "fetched_at": "DATE '2024-01-02'", "slug": "concat('s', CAST(c_custkey + CASE WHEN c_custkey % 31 = 8 THEN 1 ELSE 0 END AS VARCHAR))",
    "source": "CASE WHEN c_custkey % 2 = 0 THEN '' WHEN c_custkey % 37 = 5 THEN 'workday' WHEN c_custkey % 5 = 4 THEN 'LEVER' ELSE 'greenhouse' END",
    "url": "CASE c_custkey % 8 WHEN 1 THEN concat('https://www.aggregator.example/', CAST(c_custkey AS VARCHAR)) WHEN 2 THEN '' ELSE concat('HTTPS://', CASE WHEN c_custkey % 5 = 4 THEN 'jobs.lever.co' ELSE 'boards.greenhouse.io:443' END, '/', lower(c_mktsegment), '/', CAST(c_custkey AS VARCHAR), '/') END",
    "title": "CASE WHEN c_custkey % 41 = 9 THEN 'Night Guard' WHEN c_custkey % 2 = 1 THEN concat(CASE WHEN c_nationkey % 4 = 0 THEN 'buyer - ' ELSE 'sales lead - ' END, c_mktsegment) ELSE '' END",
    "company": "CASE WHEN c_custkey % 43 = 11 THEN 'Another' ELSE upper(c_name) END", "external_id": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END", "location": "CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'detail' END",
    "description": "concat(CASE WHEN c_custkey % 3 = 1 THEN 'Requirements:\\n- x\\n' ELSE '' END, repeat(c_mktsegment, CAST(60 + c_custkey % 80 AS INT)))", "posted_at": "NULL", "closed_at": "CASE WHEN c_custkey % 47 = 1 THEN '2024-03-01' END",
}
_LIST = lambda columns: ", ".join(f"{e} AS {c}" for c, e in columns.items())
_KEY = "regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g')"
_ON = "(({key} = 'greenhouse' AND regexp_matches({url}, '(?i)^https://([^/?#@:]+\\.)?greenhouse\\.io(:\\d+)?/[^?#]')) OR ({key} = 'lever' AND regexp_matches({url}, '(?i)^https://jobs\\.lever\\.co(:\\d+)?/[^?#]')))"
_PLACE = "rtrim(replace(lower({}), ':443/', '/'), '/')"
_BARE = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH p AS (SELECT {_LIST(_SEEN)} FROM customer), d AS (SELECT {_LIST(_GOT).replace(chr(92) + 'n', "' || chr(10) || '")} FROM customer WHERE c_custkey % 10 <> 6),
j AS (SELECT p.*, {_KEY.format('p.source')} AS k, d.asked, d.http_status, d.slug AS said, d.source AS s2, d.url AS u2, d.title AS t2, d.company AS c2, d.external_id AS x2, d.location AS l2, d.description AS b2, d.closed_at AS z2 FROM p LEFT JOIN d ON p.slug = d.asked),
w AS (SELECT *, CASE WHEN trim(u2) <> '' THEN u2 ELSE url END AS mu, CASE WHEN trim(t2) <> '' THEN t2 ELSE title END AS mt FROM j),
s AS (SELECT *, CASE WHEN closed_at IS NOT NULL THEN 'closed preview' WHEN NOT regexp_matches(title, '(?i)\\bsales\\b.*\\blead\\b') THEN 'off topic' WHEN NOT {_ON.format(key='k', url='url')} THEN 'indirect' WHEN coalesce(http_status, 0) <> 200 THEN 'no detail' WHEN said <> slug THEN 'other slug'
 WHEN {_BARE.format('c2')} NOT IN ('', {_BARE.format('company')}) OR {_BARE.format('t2')} NOT IN ('', {_BARE.format('title')}) OR {_BARE.format('s2')} NOT IN ('', {_BARE.format('source')}) OR ((u2 <> '' OR x2 <> '') AND NOT ((u2 <> '' AND {_PLACE.format('u2')} = {_PLACE.format('url')}) OR (x2 <> '' AND x2 = coalesce(external_id, '')))) THEN 'other posting'
 WHEN NOT {_ON.format(key='k', url='mu')} THEN 'redirected' WHEN z2 IS NOT NULL THEN 'closed since' ELSE 'hydrated' END AS step FROM w),
t AS (SELECT *, step IN ('hydrated', 'closed since') AS taken, step IN ('no detail', 'other slug', 'other posting', 'redirected', 'hydrated') AS kept FROM s),
m AS (SELECT *, CASE WHEN taken THEN b2 ELSE description END AS text_ FROM t)
SELECT slug, step, kept, kept AND (length(text_) < 800 OR text_ NOT LIKE 'Requirements:%') AS degraded, CASE WHEN taken THEN mu ELSE url END AS url, CASE WHEN taken THEN mt ELSE title END AS title, CASE WHEN taken AND trim(l2) <> '' THEN l2 ELSE location END AS location, length(text_) AS n_chars FROM m"""
)
def hydrated_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    columns = lambda x: [f"CAST({e.replace('VARCHAR', 'STRING')} AS {'INT' if n == 'http_status' else 'DATE' if n == 'fetched_at' else 'STRING'}) AS {n}" for n, e in x.items()]
    hosts = spark.createDataFrame([("greenhouse", "greenhouse.io"), ("lever", "jobs.lever.co")], "source string, suffix string")
    out = hydrate.hydrate(c.selectExpr(*columns(_SEEN)), c.filter("c_custkey % 10 <> 6").selectExpr(*columns(_GOT)), hosts, ["sales lead"])
    return out.select("slug", "step", "kept", "degraded", "url", "title", "location", F.length("description").alias("n_chars"))


ID = "CAST(c_custkey AS STRING)"
_NL = "chr(10)"
#: Source -> (detail body, expected columns in DuckDB SQL).
DETAILS: dict[str, tuple[str, dict[str, str]]] = {
    "smartrecruiters": (
        "CASE WHEN c_custkey % 9 = 0 THEN '{\"error\":1}' ELSE to_json(named_struct('jobAd', named_struct('sections', named_struct('companyDescription', named_struct('text', CASE WHEN c_custkey % 2 = 0 THEN concat('<p>We are ', c_mktsegment, '</p>') END), 'jobDescription', named_struct('text', c_name), 'qualifications', CASE WHEN c_custkey % 3 = 0 THEN named_struct('text', '<li>CPQ</li>') END)))) END",
        {"description": f"CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'We are ' || c_mktsegment || {_NL} || ' ' || {_NL} ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' ' || {_NL} || ' - CPQ' ELSE '' END END", "location": "CAST(NULL AS VARCHAR)", "posted_at": "CAST(NULL AS VARCHAR)", "remote_flag": "CAST(NULL AS BOOLEAN)", "reject": "CASE WHEN c_custkey % 9 = 0 THEN 'envelope' END"},
    ),
    "workday": (
        "to_json(named_struct('jobPostingInfo', named_struct('jobDescription', CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END, 'remoteType', CASE c_custkey % 4 WHEN 1 THEN 'Fully Remote' WHEN 2 THEN 'Office - Flexible' WHEN 3 THEN '' END, 'location', c_mktsegment, 'additionalLocations', CASE WHEN c_custkey % 3 = 0 THEN array('Oslo', '', 'Bonn') END, 'startDate', '2024-05-06T00:00')))",
        {"description": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END", "location": "c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ', Oslo, Bonn' ELSE '' END", "posted_at": "'2024-05-06'", "remote_flag": "CASE c_custkey % 4 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END", "reject": "CASE WHEN c_custkey % 4 = 0 THEN 'body' END"},
    ),
    "oracle_orc": (
        "CASE WHEN c_custkey % 9 = 0 THEN '{}' ELSE to_json(named_struct('ExternalDescriptionStr', c_name, 'ExternalQualificationsStr', CASE WHEN c_custkey % 2 = 0 THEN '<b>CPQ</b>' ELSE '' END, 'PrimaryLocation', c_mktsegment, 'WorkplaceType', CASE c_custkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Remotely hybrid' END, 'ExternalPostedStartDate', '2024-07-08T09:00:00+00:00')) END",
        {"description": f"CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'Description' || {_NL} || c_name || CASE WHEN c_custkey % 2 = 0 THEN {_NL} || {_NL} || 'Qualifications' || {_NL} || ' CPQ' ELSE '' END END", "location": "CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END", "posted_at": "CASE WHEN c_custkey % 9 <> 0 THEN '2024-07-08' END", "remote_flag": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN TRUE WHEN c_custkey % 3 = 1 THEN FALSE END", "reject": "CASE WHEN c_custkey % 9 = 0 THEN 'envelope' END"},
    ),
}


def _register(source: str, body: str, expected: dict[str, str]) -> None:
    def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = table(spark, sf_dir, "customer").selectExpr(f"'{source}' AS source", "CAST(c_nationkey AS STRING) AS board", f"{ID} AS external_id", f"{body} AS body")
        return payloads.parse_details(raw, payloads.DETAILS[source]).select("external_id", *expected)

    query("SELECT CAST(c_custkey AS VARCHAR) AS external_id, " + ", ".join(f"{e} AS {c}" for c, e in expected.items()) + " FROM customer", f"details_{source}")(detailed)


for _name, (_body, _expected) in DETAILS.items():
    _register(_name, _body, _expected)


@query("""WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS board, CAST(c_custkey // 50 AS INT) AS page_no, c_nationkey AS k, count(*) AS n, count(*) FILTER (c_custkey % 9 > 0) AS ok, c_custkey // 50 AS pg FROM customer GROUP BY ALL),
q AS (SELECT *, CASE WHEN k % 4 = 0 THEN 1 WHEN k % 4 = 1 THEN 5 WHEN k % 4 = 2 THEN 1 END AS "first", CASE WHEN k % 4 = 0 THEN ok WHEN k % 4 = 1 THEN 2 WHEN k % 4 = 2 THEN n END AS "last", CASE WHEN k % 4 = 0 THEN ok WHEN k % 4 = 1 THEN 9 WHEN k % 4 = 2 THEN n + pg END AS total FROM p),
r AS (SELECT *, ok > 0 AND ok < coalesce(total, 0) AS capped, coalesce("first" < 1 OR "last" < "first" OR total < "last", FALSE) AS odd FROM q)
SELECT board, page_no, CAST(n AS BIGINT) AS candidates, CAST(ok AS BIGINT) AS openings, CAST(total AS BIGINT) AS total, capped,
 concat_ws('; ', CASE WHEN ok > 0 AND n > ok THEN 'read ' || ok || ' of ' || n || ' rows' END, CASE WHEN odd THEN 'range makes no sense' WHEN ok > 0 AND ok <> "last" - "first" + 1 THEN 'read ' || ok || ' of ' || ("last" - "first" + 1) || ' shown' END) AS notes,
 CASE WHEN ok = 0 THEN CASE WHEN k % 2 = 0 THEN 'empty' ELSE 'unproven' END WHEN capped THEN 'capped' WHEN n > ok OR odd OR ok <> "last" - "first" + 1 THEN 'partial' ELSE 'whole' END AS verdict FROM r""")
def card_page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose own counts agree, make no sense, name more than they show, or say nothing; every ninth link has no title."""
    item = "CASE WHEN c_custkey % 9 = 0 THEN concat('<a href=\"/acme/job/o', c_custkey, '\"><img></a>') ELSE concat('<a href=\"/acme/job/o', c_custkey, '\">', c_name, '</a>') END"
    page = F.expr("CAST(c_custkey div 50 AS INT)").alias("page_no")
    made = table(spark, sf_dir, "customer").groupBy("c_nationkey", page).agg(F.array_join(F.collect_list(F.expr(item)), " ").alias("links"), F.count(F.lit(1)).alias("n"), F.count(F.expr("CASE WHEN c_custkey % 9 > 0 THEN 1 END")).alias("ok"))  # at most 50 a page
    shown = F.expr("CASE c_nationkey % 4 WHEN 0 THEN concat('1 - ', ok, ' of ', ok) WHEN 1 THEN '5-2 of 9' WHEN 2 THEN concat('1-', n, ' of ', n + page_no) END")
    tail = F.expr("CASE WHEN c_nationkey % 2 = 0 THEN '<p class=\"jv-page-message\">No open positions</p>' ELSE '' END")
    body = F.concat("links", F.coalesce(F.concat(F.lit('<span class="jv-pagination-text">'), shown, F.lit("</span>")), F.lit("")), tail)
    raw = made.select(F.lit("jobvite").alias("source"), F.col("c_nationkey").cast("string").alias("board"), "page_no", body.alias("body"))
    return walks.card_pages(raw, "jobvite").select("board", "page_no", "candidates", "openings", "total", "capped", "notes", "verdict")
