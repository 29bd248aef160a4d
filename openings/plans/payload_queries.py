"""Queries over the payloads of the other boards and feeds: bodies as these sources send them are built from `customer`, malformed siblings included, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import payloads
from .registry import query, table
from .source_queries import PAGE, _landed

ID, TITLE = "CAST(c_custkey AS STRING)", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END"
REJECT = "CASE WHEN c_custkey % 9 = 0 THEN 'item' END"
COUNT = f"CAST(count(*) OVER (PARTITION BY c_nationkey, c_custkey // {PAGE}) AS BIGINT)"
PAY = "CAST(floor(c_acctbal) AS BIGINT)"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _list(key: str, **more: str) -> str:
    return "to_json(" + _struct(**{key: "items"}, **more) + ")"


#: Source -> (item, body, column -> DuckDB SQL).  Every one has external_id and title; a title is missing in every ninth item.
SOURCES: dict[str, tuple[str, str, dict[str, str]]] = {
    "smartrecruiters": (
        _struct(id=ID, name=TITLE, ref="CASE WHEN c_custkey % 2 = 0 THEN 'https://s/1' ELSE '' END", releasedDate="'2024-05-06T01:02:03Z'", location=_struct(city="c_mktsegment", region="''", country="'us'", remote="c_custkey % 3 = 0"), department=_struct(label="CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END"), function=_struct(label="'sales'")),
        _list("content", totalFound="size(items)"),
        {"url": "CASE WHEN c_custkey % 2 = 0 THEN 'https://s/1' ELSE 'https://jobs.smartrecruiters.com/' || c_nationkey || '/' || c_custkey END", "location": "c_mktsegment || ', us' || CASE WHEN c_custkey % 3 = 0 THEN ' (Remote)' ELSE '' END", "posted_at": "'2024-05-06'", "department": "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'sales' END", "remote_flag": "c_custkey % 3 = 0", "reported_total": COUNT},
    ),
    "workable": (
        _struct(shortcode=ID, title=TITLE, url="''", shortlink="concat('https://w/', c_custkey)", published_on="NULL", created_at="'2024-01-02 10:00'", city="' '", state="c_mktsegment", country="'US'", telecommuting="c_custkey % 2 = 0", department="'d'", description="'<p>a</p>b'"), _list("jobs", name="'Acme'"),
        {"url": "'https://w/' || c_custkey", "company": "'Acme'", "location": "c_mktsegment || ', US'", "posted_at": "'2024-01-02'", "remote_flag": "c_custkey % 2 = 0", "description": "'a' || chr(10) || 'b'"},
    ),
    "recruitee": (
        _struct(id="c_custkey", title=TITLE, careers_url="''", careers_apply_url="'https://r/a'", city="c_mktsegment", state_name="NULL", country="'NL'", description="'one'", requirements="'two'", remote="CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'false' ELSE 'maybe' END"), _list("offers"),
        {"url": "'https://r/a'", "location": "c_mktsegment || ', NL'", "description": "'one' || chr(10) || 'two'", "remote_flag": "CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"},
    ),
    "bamboohr": (
        _struct(id=ID, jobOpeningName=TITLE, departmentLabel="c_mktsegment", location=_struct(city="'Lindon'", state="'Utah'", country="NULL"), isRemote="c_custkey % 2 = 1", datePosted="'2024-02-03'"), _list("result", meta=_struct(totalCount="size(items)")),
        {"url": "'https://' || c_nationkey || '.bamboohr.com/careers/' || c_custkey", "location": "'Lindon, Utah'", "department": "c_mktsegment", "remote_flag": "c_custkey % 2 = 1", "reported_total": COUNT},
    ),
    "rippling": (
        _struct(uuid=ID, name=TITLE, url="'https://ats/1'", department="CASE WHEN c_custkey % 2 = 0 THEN to_json(named_struct('label', c_mktsegment)) ELSE c_mktsegment END", workLocation="CASE WHEN c_custkey % 3 = 0 THEN to_json(named_struct('label', 'Rome')) ELSE 'Oslo' END"), "to_json(items)",
        {"url": "'https://ats/1'", "department": "c_mktsegment", "location": "CASE WHEN c_custkey % 3 = 0 THEN 'Rome' ELSE 'Oslo' END"},
    ),
    # pages of three shapes: a feed, an object of the older list, that list alone
    "teamtailor": (
        "named_struct('id', CASE WHEN c_custkey % 5 > 0 THEN " + ID + " END, 'title', " + TITLE + r""", 'url', 'https://t/1', 'careersite-job-url', CASE WHEN c_custkey % 4 = 0 THEN concat('https://t/job/', c_custkey) END, 'location', CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END, 'date_published', CASE WHEN c_custkey % 2 = 0 THEN '2024-03-04T05:06:07+02:00' END, 'content_html', CASE WHEN c_custkey % 2 = 0 THEN '<p>x</p>' END,
        '_jobposting', named_struct('identifier', named_struct('value', CAST(c_custkey AS STRING)), 'datePosted', '2023-01-02', 'description', 'y', 'jobLocationType', CASE WHEN c_custkey % 6 = 0 THEN 'TELECOMMUTE' END, 'jobLocation', array(named_struct('address', named_struct('addressLocality', CASE WHEN c_custkey % 3 = 0 THEN 'Lund' ELSE 'Malm' END, 'addressCountry', 'SE')), named_struct('address', named_struct('addressLocality', 'Lund', 'addressCountry', 'SE')))))""",
        "CASE size(items) % 3 WHEN 0 THEN to_json(items) WHEN 1 THEN to_json(named_struct('jobs', items, 'next_url', ' ')) ELSE to_json(named_struct('jobs', array(), 'items', items, 'next_url', 'https://t/next')) END",
        {"url": "CASE WHEN c_custkey % 4 = 0 THEN 'https://t/job/' || c_custkey ELSE 'https://t/1' END", "posted_at": "CASE WHEN c_custkey % 2 = 0 THEN '2024-03-04' ELSE '2023-01-02' END", "remote_flag": "CASE WHEN c_custkey % 6 = 0 THEN TRUE END",
         "location": "CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'Lund, SE' ELSE 'Malm, SE; Lund, SE' END", "description": "CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END", "capped": f"{COUNT} % 3 = 2"},
    ),
    "pinpoint": (
        _struct(id=ID, title=TITLE, url="'https://p/1'", description="'a'", key_responsibilities="'b'", benefits="'c'", workplace_type="CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' END", compensation="'pay'", compensation_minimum="CAST(c_custkey AS DOUBLE)", compensation_maximum="CAST(c_custkey + 5 AS DOUBLE)", compensation_currency="CASE WHEN c_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END", compensation_frequency="CASE WHEN c_custkey % 5 = 0 THEN 'hour' ELSE 'Year' END", compensation_visible="c_custkey % 7 <> 0", location="'{\"name\":\"Bath\"}'", department="'ops'"),
        _list("data"),
        {"location": "'Bath'", "department": "'ops'", "description": "'a' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || 'c'", "remote_flag": "CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", "comp_min": "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN CAST(c_custkey AS BIGINT) END", "comp_max": "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN CAST(c_custkey + 5 AS BIGINT) END", "comp_text": "CASE WHEN c_custkey % 7 <> 0 THEN 'pay' END"},
    ),
    "workday": (
        _struct(title=TITLE, externalPath="concat('/job/', c_custkey)", locationsText="c_mktsegment", postedOn="'Posted Today'", bulletFields="CASE WHEN c_custkey % 2 = 0 THEN array(concat('R', c_custkey)) ELSE array('') END"), _list("jobPostings", total="size(items)"),
        {"external_id": "CASE WHEN c_custkey % 2 = 0 THEN 'R' || c_custkey ELSE '/job/' || c_custkey END", "url": "'https://' || c_nationkey || '/job/' || c_custkey", "location": "c_mktsegment", "reported_total": COUNT},
    ),
    "oracle_orc": (
        _struct(Id=ID, Title=TITLE, PostedDate="'2024-07-08'", PrimaryLocation="c_mktsegment", ShortDescriptionStr="'s'"), "to_json(named_struct('items', array(named_struct('TotalJobsCount', size(items), 'requisitionList', items))))",
        {"url": "'https://' || c_nationkey || '/job/' || c_custkey", "location": "c_mktsegment", "posted_at": "'2024-07-08'", "description": "'s'", "reported_total": COUNT},
    ),
    "eightfold": (
        _struct(id=ID, name=TITLE, canonicalPositionUrl="'https://e/1'", location="CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Bonn' END", locations="array('Bonn', c_mktsegment)", job_description="'d'", department="'x'"), _list("positions", count="size(items)", domain="'d'"),
        {"location": "CASE WHEN c_custkey % 2 = 0 THEN 'Bonn; ' || c_mktsegment ELSE 'Bonn' END", "description": "'d'", "reported_total": COUNT},
    ),
    "paylocity": (
        _struct(JobId=ID, JobTitle=TITLE, JobLocation=_struct(City="CASE WHEN c_custkey % 2 = 0 THEN 'Reno' END", State="CASE WHEN c_custkey % 2 = 0 THEN 'NV' END", Country="NULL"), LocationName="'Office'", Description="'a; b'", PublishedDate="'2024-09-10T00:00:00'", IsRemote="c_custkey % 3 = 0"),
        "concat('<html><script>window.pageData = ', to_json(named_struct('Jobs', items)), ';</script></html>')",
        {"url": "'https://recruiting.paylocity.com/Recruiting/Jobs/Details/' || c_custkey", "location": "CASE WHEN c_custkey % 2 = 0 THEN 'Reno, NV' ELSE 'Office' END", "description": "'a; b'", "posted_at": "'2024-09-10'", "remote_flag": "c_custkey % 3 = 0"},
    ),
    "jobvite": (
        f"concat('<tr><td><a class=\"jv\" href=\"/acme/job/o', c_custkey, '\">', coalesce({TITLE}, ''), '</a></td></tr>')", "concat('<table>', array_join(items, ''), '<a href=\"/acme/about\">About</a></table>')",
        {"external_id": "'o' || c_custkey", "url": "'https://jobs.jobvite.com/acme/job/o' || c_custkey"},
    ),
    "hrmdirect": (
        f"concat('<tr class=\"reqitem\" data-req-id=\"', c_custkey, '\"><td id=\"departments', c_custkey, '\"><b>', c_mktsegment, '</b></td><td id=\"posTitle\"> <a href=\"job-opening.php?req=', c_custkey, '&amp;x=1\"> ', coalesce({TITLE}, ''), ' </a></td><td class=\"city\"> ', c_mktsegment, ' </td><td class=\"reqitem\">', c_custkey % 12 + 1, '/', c_custkey % 28 + 1, '/2024</td></tr>')", "concat('<table>', array_join(items, ''), '</table>')",
        {"url": "'https://' || c_nationkey || '.hrmdirect.com/employment/job-opening.php?req=' || c_custkey || '&x=1'", "location": "c_mktsegment", "department": "c_mktsegment", "posted_at": "CAST(make_date(2024, CAST(c_custkey % 12 + 1 AS INT), CAST(c_custkey % 28 + 1 AS INT)) AS VARCHAR)"},
    ),
    "linkedin_guest": (
        f"concat('<div class=\"base-card\" data-entity-urn=\"urn:li:jobPosting:', c_custkey, '\"><a href=\"https://l/', c_custkey, '?trk=1\"></a><h3 class=\"base-search-card__title\"> ', coalesce({TITLE}, ''), ' </h3><h4 class=\"base-search-card__subtitle\"><a> ', c_mktsegment, ' </a></h4><span class=\"job-search-card__location\"> Here </span><time datetime=\"2024-02-0', c_custkey % 9 + 1, '\">x</time>')",
        "array_join(items, '</div>')",
        {"url": "'https://l/' || c_custkey", "company": "c_mktsegment", "location": "'Here'", "posted_at": "'2024-02-0' || (c_custkey % 9 + 1)"},
    ),
    "neogov": (
        f"concat('<item><title>', coalesce({TITLE}, ''), '</title><link>https://n/1</link><joblisting:jobId>', c_custkey, '</joblisting:jobId><joblisting:minimumSalary>', c_custkey * 10, '.50</joblisting:minimumSalary><joblisting:maximumSalary>', c_custkey * 20, '</joblisting:maximumSalary><joblisting:salaryCurrency>USD</joblisting:salaryCurrency><joblisting:salaryInterval>', CASE WHEN c_custkey % 2 = 0 THEN 'Year' ELSE 'Hour' END, '</joblisting:salaryInterval>', CASE WHEN c_custkey % 3 = 0 THEN '<joblisting:advertiseFromDate>Tue, 6 Feb 2024 05:00:00:0</joblisting:advertiseFromDate><joblisting:department>Parks &amp; Roads</joblisting:department><joblisting:qualifications>able</joblisting:qualifications>' ELSE '<joblisting:categories><joblisting:category>Law</joblisting:category><joblisting:category>Fire</joblisting:category></joblisting:categories>' END, '<pubDate>Mon, 5 Feb 2024 01:00:00 PST</pubDate><description>duties</description></item>')",
        "concat('<rss xmlns:joblisting=\"x\"><channel><title> City of ', size(items), ' &amp; Co </title><link>https://n</link>', array_join(items, ''), '</channel></rss>')",
        {"url": "'https://n/1'", "comp_min": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 10 AS BIGINT) END", "comp_max": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 20 AS BIGINT) END", "posted_at": "CASE WHEN c_custkey % 3 = 0 THEN '2024-02-06' ELSE '2024-02-05' END", "description": "CASE WHEN c_custkey % 3 = 0 THEN 'duties' || chr(10) || chr(10) || 'Qualifications' || chr(10) || 'able' ELSE 'duties' END",
         "company": f"'City of ' || {COUNT} || ' & Co'", "department": "CASE WHEN c_custkey % 3 = 0 THEN 'Parks & Roads' ELSE 'Law, Fire' END", "comp_text": "'USD ' || (c_custkey * 10) || '.50 - ' || (c_custkey * 20) || CASE WHEN c_custkey % 2 = 0 THEN ' / Year' ELSE ' / Hour' END"},
    ),
    "weworkremotely": (
        f"concat('<item><title>', CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN concat('Acme: ', c_name, ': lead') ELSE c_name END, '</title><link>https://w/', c_custkey, '</link><guid>', c_custkey, '</guid><region>Anywhere</region><category>', c_mktsegment, '</category><description>d</description></item>')",
        "concat('<rss><channel>', array_join(items, ''), '</channel></rss>')",
        {"title": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_name || ': lead' ELSE c_name END", "url": "'https://w/' || c_custkey", "location": "'Anywhere'", "department": "c_mktsegment", "remote_flag": "TRUE"},
    ),
    "remotive": (_struct(id="c_custkey", title=TITLE, url="'https://r/1'", company_name="c_mktsegment", candidate_required_location="'USA'", publication_date="'2024-01-01T00:00:00'", category="'dev'", salary="'$1'"), _list("jobs"), {"company": "c_mktsegment", "location": "'USA'", "posted_at": "'2024-01-01'", "comp_text": "'$1'", "remote_flag": "TRUE"}),
    "arbeitnow": (_struct(slug=ID, title=TITLE, url="'https://a/1'", company_name="c_mktsegment", location="'Berlin'", remote="c_custkey % 2 = 0", created_at="1704067200 + c_custkey * 86400"), _list("data"), {"company": "c_mktsegment", "remote_flag": "c_custkey % 2 = 0", "posted_at": "CAST(DATE '2024-01-01' + CAST(c_custkey AS INT) AS VARCHAR)"}),
    "himalayas": (_struct(guid=ID, title=TITLE, applicationLink="CASE WHEN c_custkey % 2 = 0 THEN 'https://h/1' END", companyName="c_mktsegment", locationRestrictions="array('US', 'Canada')", minSalary="floor(c_acctbal)", maxSalary="NULL"), _list("jobs", totalCount="size(items)"), {"url": "CASE WHEN c_custkey % 2 = 0 THEN 'https://h/1' ELSE CAST(c_custkey AS VARCHAR) END", "location": "'US, Canada'", "comp_min": PAY, "comp_max": "CAST(NULL AS BIGINT)", "reported_total": COUNT}),
    "jobicy": (_struct(id="c_custkey", jobTitle=TITLE, url="'https://j/1'", companyName="c_mktsegment", jobGeo="'Anywhere'", jobDescription="'<b>x</b>'", pubDate="'2024-04-05 06:07:08'", annualSalaryMin="floor(c_acctbal)"), _list("jobs"), {"location": "'Anywhere'", "description": "'x'", "posted_at": "'2024-04-05'", "comp_min": PAY}),
    "themuse": (_struct(id="c_custkey", name=TITLE, refs=_struct(landing_page="'https://m/1'"), company=_struct(name="c_mktsegment"), locations="array(named_struct('name', 'A'), named_struct('name', 'B'))", contents="'c'", publication_date="'2024-06-07'"), _list("results", total="size(items)"), {"url": "'https://m/1'", "company": "c_mktsegment", "location": "'A; B'", "reported_total": COUNT}),
    "workingnomads": (_struct(url="concat('https://n/', c_custkey)", title=TITLE, company_name="c_mktsegment", location="'x'", description="'d'", pub_date="'2024-08-09T01:00:00'", category_name="'c'"), "to_json(items)", {"external_id": "'https://n/' || c_custkey", "company": "c_mktsegment", "posted_at": "'2024-08-09'", "department": "'c'"}),
    "usajobs": (
        _struct(MatchedObjectId=ID, MatchedObjectDescriptor=_struct(PositionTitle=TITLE, PositionURI="'https://u/1'", OrganizationName="c_mktsegment", PositionLocationDisplay="'DC'", PublicationStartDate="'2024-10-11T00:00'", UserArea=_struct(Details=_struct(JobSummary="concat('<p>Sum ', c_mktsegment, '</p>')", MajorDuties="CASE WHEN c_custkey % 2 = 0 THEN array('one', ' ', c_mktsegment) ELSE array('two') END", Education="' '", OtherInformation="CASE WHEN c_custkey % 3 = 0 THEN c_name END")), PositionRemuneration="array(named_struct('MinimumRange', concat(CAST(c_custkey AS STRING), '.0'), 'MaximumRange', CAST(c_custkey + 1 AS STRING), 'RateIntervalCode', CASE WHEN c_custkey % 2 = 0 THEN 'PA' ELSE 'PH' END))")),
        "to_json(named_struct('SearchResult', named_struct('SearchResultCountAll', size(items), 'SearchResultItems', items)))",
        {"company": "c_mktsegment", "location": "'DC'", "comp_min": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS BIGINT) END", "comp_max": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 1 AS BIGINT) END", "reported_total": COUNT,
         "description": "'Summary' || chr(10) || ' Sum ' || c_mktsegment || chr(10) || chr(10) || 'Duties' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'one' || chr(10) || c_mktsegment ELSE 'two' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Other information' || chr(10) || c_name ELSE '' END"},
    ),
    "findwork": (_struct(id="c_custkey", role=TITLE, url="'https://f/1'", company_name="c_mktsegment", location="'y'", text="'t'", date_posted="'2024-11-12T13:14:15Z'", remote="c_custkey % 2 = 0"), _list("results", count="size(items)"), {"company": "c_mktsegment", "description": "'t'", "posted_at": "'2024-11-12'", "remote_flag": "c_custkey % 2 = 0", "reported_total": COUNT}),
    "careerjet": (_struct(url="concat('https://c/', c_custkey)", title=TITLE, company="c_mktsegment", locations="'z'", description="'d'", salary="'$2 a year'"), _list("jobs", hits="size(items)"), {"external_id": "'https://c/' || c_custkey", "company": "c_mktsegment", "comp_text": "'$2 a year'", "reported_total": COUNT}),
}


def _register(source: str, item: str, body: str, expected: dict[str, str]) -> None:
    columns = {"external_id": "CAST(c_custkey AS VARCHAR)", "title": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END", "reject": REJECT} | expected
    sql = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM customer"

    def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _landed(table(spark, sf_dir, "customer"), source, "CAST(c_nationkey AS STRING)", item, body, "c_custkey")
        rows = payloads.parse(raw, payloads.SPECS[source])
        return rows.selectExpr("external_id", "nullif(title, '') AS title", *[c for c in columns if c not in ("external_id", "title")])

    query(sql, f"parsed_{source}")(parsed)


for _name, (_item, _body, _expected) in SOURCES.items():
    _register(_name, _item, _body, _expected)


def _freehire(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _struct(
        public_slug=ID, source="CASE c_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'unheard' END", external_id=ID, url="concat('https://', CASE c_custkey % 4 WHEN 0 THEN 'boards.greenhouse.io' WHEN 1 THEN 'jobs.lever.co' WHEN 2 THEN 'lever.co.evil.example' ELSE 'boards.greenhouse.io' END, '/acme/', c_custkey)",
        title="c_name", company="c_mktsegment", work_mode="CASE c_custkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END", closed_at="CASE WHEN c_custkey % 5 = 0 THEN '2024-01-01' END",
    )
    raw = _landed(table(spark, sf_dir, "customer"), "freehire", "CAST(c_nationkey AS STRING)", item, _list("data", meta=_struct(total="size(items)")), "c_custkey")
    return payloads.parse(raw, payloads.SPECS["freehire"])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote_flag FROM customer WHERE c_custkey % 5 <> 0""")
def parsed_freehire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rows are gone (a page of only closed ones gives one row without an item)."""
    return _freehire(spark, sf_dir).filter("external_id IS NOT NULL").select("external_id", "title", "remote_flag")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS external_id, CASE WHEN c_custkey % 4 = 0 THEN 'detail ' || c_custkey WHEN c_custkey % 4 = 1 THEN 'short' ELSE 'short' END AS description, CASE WHEN c_custkey % 4 = 0 THEN 'Oslo' ELSE c_mktsegment END AS location FROM customer""")
def detailed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List rows joined with detail rows of the same opening; a blank detail leaves the list's value."""
    lists = table(spark, sf_dir, "customer").selectExpr("'bamboohr' AS source", "CAST(c_nationkey AS STRING) AS board", f"{ID} AS external_id", "'short' AS description", "c_mktsegment AS location", "CAST(NULL AS STRING) AS department")
    details = table(spark, sf_dir, "customer").filter("c_custkey % 4 < 2").selectExpr("'bamboohr' AS source", "CAST(c_nationkey AS STRING) AS board", f"{ID} AS external_id", "CASE WHEN c_custkey % 4 = 0 THEN concat('detail ', c_custkey) ELSE ' ' END AS description", "CASE WHEN c_custkey % 4 = 0 THEN 'Oslo' END AS location", "CAST(NULL AS STRING) AS department")
    return payloads.with_details(lists, details).select("external_id", "description", "location")
