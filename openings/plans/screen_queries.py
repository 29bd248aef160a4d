"""Queries over the screening rails, and the flagship decision queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import NEGATOR, REQUIREMENTS_HEADING
from ..functions.text import EDGE_AFTER, EDGE_BEFORE
from ..operators import rails
from ..operators.screen import (
    ABROAD, AMBIGUOUS_CODES, ATTENDANCE, BARE_COUNTRY, COUNTRY_LEVEL, FOREIGN_CODE, HOME, HOME_TOKEN, ONSITE_WORD, REMOTE_PHRASE, REMOTE_WORD, RESIDENCY, STATE_LOCK, TIME_ZONE, UNRESOLVED, VAGUE_REMOTE,
    RuleSet, certificates_demanded, location_verdict, rule_regression, screen,
)
from .registry import query
from .text_queries import COMPANY_SQL, LOOSE_SQL
from .views import cte, view

RULES = RuleSet(
    lanes=(("platform", 40, ("the", "le")), ("generic", 25, ("and", "en"))),
    title_block=("of", "que"),
    title_always_block=("license",),
    competing=("rivalforce",),
    products=("cpq",),
    quota=True,
    body_block=(("gambling", ("scum",)), ("credentials", ("password",))),
    certificates=("cta",),
    clearance=True,
    requirements={"years": ("15 years",)},
    signals=(("language", 5, ("with",)), ("licence", 7, ("license",))),
    metros=("austin",),
    comp_screen=70_000,
    comp_accept=100_000,
    floors={"umbrella": 40},
    excluded_companies=("hooli",),
)
AS_OF = "2024-01-01"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _has(column: str, *terms: str) -> str:
    return f"regexp_matches({column}, '{_q('(?i)' + EDGE_BEFORE + '(' + '|'.join(terms) + ')' + EDGE_AFTER)}')"


def _term(column: str, *terms: str) -> str:
    return f"regexp_extract({column}, '{_q('(?i)' + EDGE_BEFORE + '(' + '|'.join(terms) + ')' + EDGE_AFTER)}', 1)"


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{_q(pattern)}')"


# The same in SQL: places of a match are those where the pattern stands at the start of the rest and no word character before it.
def _at(t: str, pattern: str) -> str:
    return f"list_filter(CASE WHEN {_m(t, pattern)} THEN generate_series(1, length({t})) ELSE [] END, lambda i: {_m(f'substr({t}, i)', '^(?:' + pattern + ')')} AND (i = 1 OR NOT regexp_matches(substr({t}, i - 1, 1), '[\\p{{L}}\\p{{N}}_]')))"


def _whole(*terms: str) -> str:
    return "(?i)(?:" + "|".join(terms) + ")(?:[^\\p{L}\\p{N}_]|$)"


def _only(*terms: str) -> str:
    return "(?i)(?:" + "|".join(terms) + ")"


def undenied(t: str, pattern: str) -> str:
    """The first place that its sentence doesn't deny, null if none."""
    near = f"regexp_extract(substr({t}, greatest(1, i - 90), i - greatest(1, i - 90)), '[^.\\n]*\\z')"
    return f"list_min(list_filter({_at(t, pattern)}, lambda i: NOT {_m(near, NEGATOR)}))"


def quote(t: str, i: str, pattern: str) -> str:
    matched = f"regexp_extract(substr({t}, {i}), '{_q('^(?:' + pattern + ')')}')"
    head = f"regexp_extract(substr({t}, 1, {i} - 1), '[^.\\n!?]*\\z')"
    tail = f"regexp_extract(substr({t}, {i} + length({matched})), '^[^.\\n]*[.\\n]?')"
    return f"substr(trim(regexp_replace({head} || {matched} || {tail}, '\\s+', ' ', 'g')), 1, 180)"


def demanded(t: str, term: str) -> str:
    """Places of a product that the text demands."""
    before = f"substr({t}, 1, i - 1)"
    clause = f"trim(regexp_replace(regexp_extract({before}, '[^.\\n!?;]*\\z'), '\\s+', ' ', 'g'))"
    lines = f"list_filter(list_transform(string_split(regexp_replace({before}, '[^\\n]*\\z', ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    heading = f"coalesce(list_filter(({lines})[-8:], lambda x: ends_with(regexp_replace(x, '[*_#\\s]+$', ''), ':'))[-1], '')"
    optional = f"({_m(quote(t, 'i', _only(term)), rails.PREFERENCE)} OR {_m(heading, rails.PREFERENCE)})"
    inline = _m(clause, rails.REQUIREMENT)
    by_heading = f"(NOT {inline} AND ({_m(heading, rails.REQUIREMENT)} OR {_m(heading, rails.REQUIREMENT_HEADING)}) AND NOT {_m(clause, rails.SHALLOW)})"
    after = f"string_split_regex({clause}, '{_q(rails.REQUIREMENT)}')[-1]"
    return f"list_filter({_at(t, _whole(term))}, lambda i: NOT {optional} AND (({inline} AND NOT {_m(after, rails.ENUMERATION)}) OR {by_heading}) AND NOT {_m(f'right({clause}, 24)', rails.LIST_ITEM)})"


_SECTION = f"CASE WHEN {_m('description', REQUIREMENTS_HEADING)} THEN regexp_extract(description, '{_q(REQUIREMENTS_HEADING)}\\n((?s:.*?))(?:^[^\\n]{{1,80}}:[ \\t*_]*$|\\z)', 1) ELSE description END"


def _unmet(label: str, term: str) -> str:
    i = f"({_at('section', _whole(term))})[1]"
    head, tail = f"regexp_extract(substr(section, 1, {i} - 1), '[^.\\n]*\\z')", f"regexp_extract(substr(section, {i}), '^[^\\n]*')"
    sentence = f"substr(trim(regexp_replace({head} || {tail}, '\\s+', ' ', 'g')), 1, 180)"
    return f"CASE WHEN {i} IS NOT NULL AND NOT {_m(sentence, rails.OPTIONAL)} THEN '{label}: ' || {sentence} END"


_FORMATS = ", ".join(f"'{f}'" for f in ("%B %d %Y", "%b %d %Y", "%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%m/%d/%y"))
_CLOSED = f"list_min(list_transform(regexp_extract_all(description, '{_q(rails.DEADLINE)}', 1), lambda x: CAST(try_strptime(regexp_replace(regexp_replace(x, '(?i)(\\d)(st|nd|rd|th)\\b', '\\1'), '[,\\s]+', ' ', 'g'), [{_FORMATS}]) AS DATE)))"

_CODES = ", ".join(f"'{c}'" for c in AMBIGUOUS_CODES)
_ONSITE = f"({_at('body', ATTENDANCE)})[1]"
_PLACE = f"regexp_extract(substr(body, i), '{_q('^(?:' + RESIDENCY + ')')}', 1)"
_LIVING = f"list_filter({_at('body', RESIDENCY)}, lambda i: NOT {_m(_PLACE, COUNTRY_LEVEL)} AND NOT {_m(_PLACE, TIME_ZONE)} AND NOT {_has(_PLACE, 'austin')})[1]"
_TESTS = [  # (test, verdict, reason) in order
    ("abroad AND NOT home", "fail", "'non-US: ' || CASE WHEN location <> '' THEN location ELSE company END"), (f"coded AND code NOT IN ({_CODES})", "fail", "'non-US country code: ' || location"),
    (_has("blob", "austin"), "pass", "'target metro: ' || location"), ("remote AND abroad2 AND NOT here", "fail", "'remote but non-US: ' || location"), ("remote AND vague", "unknown", "'global remote, US payroll unconfirmed'"),
    ("remote AND here AND NOT says AND location <> '' AND home_loc", "unknown", "'named US office; remote appears only in body text'"), ("remote AND here AND lock", "unknown", "'remote but state-restricted; needs check'"),
    (f"remote AND here AND {_ONSITE} IS NOT NULL", "unknown", f"'called remote, but: ' || {quote('body', _ONSITE, ATTENDANCE)}"), (f"remote AND here AND {_LIVING} IS NOT NULL", "unknown", f"'called remote, but: ' || {quote('body', _LIVING, RESIDENCY)}"),
    ("remote AND here", "pass", "'remote-US: ' || CASE WHEN location <> '' THEN location ELSE 'flagged remote' END"), (f"remote AND location <> '' AND NOT {_m('location', r'(?i)^\s*(remote|anywhere)?\s*$')}", "unknown", "'remote but US eligibility unconfirmed'"),
    ("remote", "unknown", "'remote, no country stated'"), (_m("blob", ONSITE_WORD), "fail", "'onsite/hybrid outside target metros: ' || location"), ("location = ''", "unknown", "'no location given'"),
    (_m("location", UNRESOLVED), "unknown", "'board did not name the cities'"), (_m("location", BARE_COUNTRY), "unknown", "'bare US location, remote vs onsite unstated'"), ("here", "fail", "'US but onsite outside target metros: ' || location"), ("TRUE", "fail", "'located ' || location"),
]
#: postings with verdict and reason.
LOCATION_SQL = f"""SELECT *, CASE {' '.join(f"WHEN {t} THEN '{v}'" for t, v, _ in _TESTS)} END AS verdict, CASE {' '.join(f"WHEN {t} THEN {r}" for t, _, r in _TESTS)} END AS place
FROM (SELECT *, home OR (coded AND code IN ({_CODES})) AS here, says OR {_m('blob', REMOTE_PHRASE)} OR {_m('body', REMOTE_PHRASE)} AS remote FROM (
 SELECT *, {_m("blob || ' ' || company", ABROAD)} AS abroad, {_m("location || ' ' || company", ABROAD)} AS abroad2,
  {_m('blob', HOME)} OR {_m('blob', HOME_TOKEN)} OR {_m('early', HOME)} OR {_m('early', HOME_TOKEN)} AS home, {_m('location', HOME)} AS home_loc,
  regexp_extract(location, '{_q(FOREIGN_CODE)}', 1) AS code, regexp_extract(location, '{_q(FOREIGN_CODE)}', 1) <> '' AND NOT {_m('location', r'(?i),\s*us\b')} AS coded,
  {_m('location', REMOTE_WORD)} OR {_m('title', REMOTE_WORD)} OR coalesce(remote_flag, FALSE) AS says, {_m('blob', VAGUE_REMOTE)} AS vague, {_m('body', STATE_LOCK)} AS lock
 FROM (SELECT *, location || ' ' || title AS blob, substr(description, 1, 2500) AS body, substr(description, 1, 600) AS early FROM postings)))"""

_CKEY = COMPANY_SQL
_RAILS = [  # (null or what the reason ends with, gate, score, how it begins) in order
    ("CASE WHEN trim(title) = '' AND trim(description) = '' THEN '' END", "EXCLUDED", "0", "malformed: no title and no body"), (f"CASE WHEN {_CLOSED} < DATE '{AS_OF}' THEN CAST({_CLOSED} AS VARCHAR) END", "EXCLUDED", "0", "closed: "),
    ("CASE WHEN lane IS NULL THEN '' END", "EXCLUDED", "0", "no lane matched"),
    *[(f"CASE WHEN {_has('title', *terms)} THEN {_term('title', *terms)} END", "SLOT-BLOCKED", "weight", f"{label}: ") for label, terms in (("title always blocked", ("license",)), ("title blocked", ("of", "que")), ("competing platform", ("rivalforce",)), ("product in the title", ("cpq",)))],
    (f"CASE WHEN len({demanded('whole', 'cpq')}) > 0 THEN substr(whole, ({demanded('whole', 'cpq')})[1], 3) END", "SLOT-BLOCKED", "weight", "product demanded: "), ("CASE WHEN verdict = 'fail' THEN place END", "EXCLUDED", "weight", "location: "),
    *[(f"CASE WHEN {undenied('whole', p)} IS NOT NULL THEN {quote('whole', undenied('whole', p), q)} END", "EXCLUDED", "weight", f"{label}: ") for label, p, q in (
        ("quota", rails.QUOTA, rails.QUOTA), ("gambling", _whole("scum"), _only("scum")), ("credentials", _whole("password"), _only("password")), ("certificate refused", certificates_demanded(["cta"]), certificates_demanded(["cta"])), ("clearance", rails.CLEARANCE, rails.CLEARANCE))],
    (_unmet("years", "15 years"), "EXCLUDED", "weight", "requirement not met: "), ("CASE WHEN top < 70000 THEN CAST(top AS VARCHAR) END", "EXCLUDED", "weight", "pay below the screen: "),
]
_RAIL = "coalesce(" + ", ".join(f"CASE WHEN r{i} IS NOT NULL THEN struct_pack(gate := '{g}', score := {n}, reason := '{r}' || r{i}) END" for i, (_, g, n, r) in enumerate(_RAILS)) + ")"
_PAID = "coalesce(top >= 100000, FALSE)"
#: The steps of screening as common table expressions; the last is `screened`.
SCREEN_CTES = f""", placed AS MATERIALIZED ({LOCATION_SQL}),
laned AS MATERIALIZED (
 SELECT *, coalesce(comp_max, comp_min) AS top, {_CKEY} AS ckey, {LOOSE_SQL} AS loose, {_SECTION} AS section,
  CASE WHEN {_has('title', 'the', 'le')} THEN 'platform' WHEN {_has('title', 'and', 'en')} THEN 'generic' WHEN {_has('first', 'the', 'le')} THEN 'platform' WHEN {_has('first', 'and', 'en')} THEN 'generic' END AS lane,
  CASE WHEN {_has('title', 'the', 'le')} THEN 40 WHEN {_has('title', 'and', 'en')} THEN 25 WHEN {_has('first', 'the', 'le')} THEN 18 WHEN {_has('first', 'and', 'en')} THEN 10 END AS weight,
  NOT ({_has('title', 'the', 'le')} OR {_has('title', 'and', 'en')}) AS body_only
 FROM (SELECT *, substr(whole, 1, 1500) AS first FROM (SELECT *, title || chr(10) || location || chr(10) || department || chr(10) || description AS whole FROM placed))),
railed AS MATERIALIZED (SELECT *, {', '.join(f"{c} AS r{i}" for i, (c, *_) in enumerate(_RAILS))} FROM laned),
judged AS MATERIALIZED (
 SELECT *, {_RAIL} AS rail, list_filter([CASE WHEN length(trim(description)) < 200 THEN 'only ' || length(trim(description)) || ' characters of description' END, CASE WHEN verdict = 'unknown' THEN place END, CASE WHEN top IS NULL THEN 'pay not stated' END, CASE WHEN NOT {_PAID} AND top IS NOT NULL THEN 'pay below the accepted one' END, CASE WHEN body_only THEN 'lane in body only' END], lambda x: x IS NOT NULL) AS unknown,
  list_filter([CASE WHEN verdict = 'pass' THEN place END, CASE WHEN body_only THEN 'lane in body only' END,
   CASE WHEN top IS NULL THEN 'pay not stated' WHEN comp_min IS NULL THEN 'pay up to ' || top WHEN comp_max IS NULL THEN 'pay from ' || top ELSE 'pay ' || comp_min || ' to ' || comp_max END,
   CASE WHEN {_has('whole', 'with')} THEN 'language' END, CASE WHEN {_has('whole', 'license')} THEN 'licence' END], lambda x: x IS NOT NULL) AS notes,
  least(100, weight + CASE tier WHEN 'A' THEN 6 WHEN 'B' THEN 3 ELSE 0 END + CASE WHEN {_PAID} THEN 8 ELSE 0 END + CASE WHEN {_has('whole', 'with')} THEN 5 ELSE 0 END + CASE WHEN {_has('whole', 'license')} THEN 7 ELSE 0 END) AS points
 FROM railed),
screened AS MATERIALIZED (
SELECT doc_id, company, title, source, lane, CAST(coalesce(rail.score, points) AS INTEGER) AS score, ckey, loose,
 CASE WHEN rail IS NOT NULL THEN rail.gate WHEN ckey = 'hooli' OR (ckey = 'umbrella' AND points < 40) THEN 'SLOT-BLOCKED' WHEN starts_with(source, 'freehire:') OR len(unknown) > 0 THEN 'VERIFY' ELSE 'QUALIFIED' END AS gate,
 CASE WHEN rail IS NOT NULL THEN [rail.reason] ELSE
   list_concat(list_concat(CASE WHEN ckey = 'hooli' THEN ['employer excluded by profile: ' || company] WHEN ckey = 'umbrella' AND points < 40 THEN ['below the configured score floor'] ELSE [] END,
     CASE WHEN starts_with(source, 'freehire:') THEN ['source verification required'] ELSE [] END),
     list_concat(notes, CASE WHEN len(unknown) > 0 THEN ['NEEDS CHECK: ' || array_to_string(unknown, '; ')] ELSE [] END)) END AS reasons
FROM judged)"""


@query(cte("postings") + f" SELECT doc_id, verdict, place AS reason FROM ({LOCATION_SQL})")
def location_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "postings")
    v = location_verdict(*[F.col(c) for c in ("location", "title", "company", "description", "remote_flag")], RULES)
    return p.select("doc_id", v.alias("v")).select("doc_id", "v.verdict", "v.reason")


@query(cte("postings") + SCREEN_CTES + " SELECT doc_id, lane, gate, score, reasons FROM screened")
def screened_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(view(spark, sf_dir, "postings"), RULES, F.lit(AS_OF).cast("date")).select("doc_id", "lane", "gate", "score", "reasons")


@query(
    cte("postings")
    + SCREEN_CTES
    + """, s AS (SELECT *, ckey || '|' || loose AS role FROM screened WHERE gate IN ('QUALIFIED', 'VERIFY')),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY CASE gate WHEN 'QUALIFIED' THEN 1 ELSE 0 END DESC, score DESC, doc_id) AS n, count(*) OVER (PARTITION BY role) AS sightings FROM s)
SELECT doc_id, company, title, gate, score, sightings FROM r WHERE n = 1 ORDER BY score DESC, lower(company), doc_id LIMIT 100"""
)
def decision_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen all postings, keep one sighting of each role, rank: the top-100 report."""
    from pyspark.sql import Window

    from ..functions.text import company_key, title_key

    s = screen(view(spark, sf_dir, "postings"), RULES, F.lit(AS_OF).cast("date")).filter(F.col("gate").isin("QUALIFIED", "VERIFY"))
    s = s.withColumn("role", F.concat(company_key(F.col("company")), F.lit("|"), title_key(F.col("title"))))
    w = Window.partitionBy("role")
    best = w.orderBy(F.when(F.col("gate") == "QUALIFIED", 1).otherwise(0).desc(), F.desc("score"), "doc_id")
    one = s.select("doc_id", "company", "title", "gate", "score", F.row_number().over(best).alias("n"), F.count(F.lit(1)).over(w).alias("sightings"))
    return one.filter("n = 1").drop("n").orderBy(F.desc("score"), F.lower("company"), "doc_id").limit(100)


@query(
    cte("postings")
    + SCREEN_CTES
    + """ SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM (
  SELECT doc_id, trim(string_split(reasons[1], ':')[1]) AS reason FROM screened WHERE gate = 'EXCLUDED') GROUP BY reason ORDER BY n DESC, reason LIMIT 12"""
)
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why postings are excluded: the 12 commonest labels before a colon."""
    from ..functions.text import reason_label

    s = screen(view(spark, sf_dir, "postings"), RULES, F.lit(AS_OF).cast("date")).filter("gate = 'EXCLUDED'")
    label = reason_label(F.get("reasons", F.lit(0))).alias("reason")
    return s.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("n"), "reason").limit(12)


_NAMES = ", ".join(f"CASE WHEN r{i} IS NOT NULL THEN '{r.split(':')[0].strip()}' END" for i, (_, _, _, r) in enumerate(_RAILS))


@query(
    cte("postings")
    + SCREEN_CTES
    + f""", h AS (SELECT doc_id, ckey, lane, list_filter([{_NAMES}], lambda x: x IS NOT NULL) AS held FROM railed)
SELECT held[1] AS rail, count(*) AS postings, min(doc_id) AS example FROM h WHERE len(held) = 1 AND lane IS NOT NULL AND ckey <> 'hooli' AND held[1] <> 'malformed' GROUP BY 1"""
)
def rule_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rail alone keeps out: postings that would surface if the rule went."""
    return rule_regression(view(spark, sf_dir, "postings"), RULES, F.lit(AS_OF).cast("date"))
