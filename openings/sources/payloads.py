"""Board and feed payloads as postings.

raw_payloads(source, board, page_no, kind, external_id, fetched_at,
http_status, body) hold what was landed; a Spec says how one source's body
becomes rows: the body's schema, where its items are, and one SQL expression a
posting column over an item `i` (its place in the page is `pos`).  Parsing is
a projection and an explode; rows without a stable id, a title or a url are
rejected with a reason, never dropped silently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html

COLUMNS = {
    "external_id": "string", "title": "string", "url": "string", "company": "string", "location": "string", "description": "string", "posted_at": "string",
    "department": "string", "remote_flag": "boolean", "comp_min": "bigint", "comp_max": "bigint", "comp_text": "string", "reported_total": "bigint",
}
HTML_COLUMNS = ("description",)


@dataclass(frozen=True)
class Spec:
    """format: json (schema of the whole body), embedded (json that `pattern` finds in a page), cards (html pieces that `pattern` finds), xml (row schema under `items`; `b` is the body without its items).  A json body that is a list alone stands for an object with it as `bare_list`."""

    name: str
    schema: str
    items: str
    fields: dict[str, str]
    format: str = "json"
    pattern: str = ""
    skip_first: bool = False
    bare_list: str = ""
    extra: dict[str, str] = field(default_factory=dict)


def _place(*parts: str) -> str:
    return "nullif(concat_ws(', ', " + ", ".join(f"nullif(trim({p}), '')" for p in parts) + "), '')"


#: An item of a JSON Feed, or of the older list of the same board.
_FEED_ITEM = "id STRING, title STRING, url STRING, `careersite-job-url` STRING, location STRING, body STRING, date_published STRING, content_html STRING, _jobposting STRING"


def _feed_places(posting: str) -> str:
    """The places of a schema.org posting (one or a list), once each in order, semicolon-joined."""
    raw = f"get_json_object({posting}, '$.jobLocation')"
    listed = f"from_json(CASE WHEN {raw} LIKE '[%' THEN {raw} ELSE concat('[', {raw}, ']') END, 'array<struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>>')"
    place = _place("x.address.addressLocality", "x.address.addressRegion", "x.address.addressCountry")
    return f"array_join(array_distinct(transform({listed}, x -> {place})), '; ')"


# The sections of a federal feed's body, heading -> field.
BODY_SECTIONS = {
    "Summary": "JobSummary", "Duties": "MajorDuties", "Requirements": "Requirements", "Qualifications": "Qualifications", "Education": "Education", "Evaluation": "Evaluations",
    "Required documents": "RequiredDocuments", "Benefits": "Benefits", "Other information": "OtherInformation",
}


def _listed(e: str) -> str:
    """A field that is a text or a list of texts, as text: one line an item that isn't blank."""
    return f"CASE WHEN {e} LIKE '[%' THEN coalesce(array_join(filter(from_json({e}, 'array<string>'), x -> trim(x) <> ''), '\\n'), {e}) ELSE {e} END"


def _headed(parts: dict[str, str]) -> str:
    """Sections with their headings, those without text left out."""
    made = ", ".join(f"CASE WHEN trim(coalesce({_listed(e)}, '')) <> '' THEN concat('{h + chr(92) + 'n' if h else ''}', trim({_listed(e)})) END" for h, e in parts.items())
    return f"concat_ws('\\n\\n', {made})"


def _rss_date(e: str) -> str:
    """The day of a feed's date, whatever stands around it."""
    return f"CAST(to_date(try_to_timestamp(regexp_extract({e}, '(\\\\d{{1,2}} [A-Za-z]{{3}} \\\\d{{4}})', 1), 'd MMM yyyy')) AS STRING)"


def _annual(e: str) -> str:
    """A yearly pay in dollars as a whole number; others are null."""
    return f"CASE WHEN upper(trim(i.salaryCurrency)) = 'USD' AND lower(trim(i.salaryInterval)) IN ('year', 'annual', 'annually') THEN CAST(try_cast(replace({e}, ',', '') AS DOUBLE) AS BIGINT) END"


_SPECS = [
    Spec(
        "greenhouse",
        "jobs ARRAY<STRUCT<id STRING, title STRING, absolute_url STRING, content STRING, updated_at STRING, first_published STRING, location STRUCT<name STRING>, offices ARRAY<STRUCT<name STRING>>, departments ARRAY<STRUCT<name STRING>>>>, meta STRUCT<total BIGINT>",
        "b.jobs",
        {"external_id": "i.id", "title": "i.title", "url": "i.absolute_url", "location": "coalesce(nullif(i.location.name, ''), array_join(transform(i.offices, o -> o.name), '; '))", "description": "i.content",
         "posted_at": "substring(coalesce(i.first_published, i.updated_at), 1, 10)", "department": "i.departments[0].name", "reported_total": "b.meta.total"},
    ),
    Spec(
        "lever",
        "ARRAY<STRUCT<id STRING, text STRING, description STRING, categories STRUCT<commitment STRING, location STRING, team STRING, department STRING>, lists ARRAY<STRUCT<text STRING, content STRING>>, workplaceType STRING, hostedUrl STRING, applyUrl STRING>>",
        "b",
        {"external_id": "i.id", "title": "i.text", "url": "coalesce(nullif(i.hostedUrl, ''), i.applyUrl)", "location": "i.categories.location", "department": "coalesce(nullif(i.categories.department, ''), i.categories.team)",
         "description": "concat_ws('\\n', i.description, array_join(transform(i.lists, l -> concat_ws('\\n', l.text, l.content)), '\\n'))", "remote_flag": "CASE lower(i.workplaceType) WHEN 'remote' THEN true WHEN 'onsite' THEN false WHEN 'hybrid' THEN false END"},
    ),
    Spec(
        "ashby",
        "jobs ARRAY<STRUCT<id STRING, title STRING, department STRING, team STRING, location STRING, secondaryLocations ARRAY<STRUCT<location STRING>>, publishedAt STRING, isRemote BOOLEAN, jobUrl STRING, applyUrl STRING, descriptionHtml STRING, descriptionPlain STRING, compensation STRUCT<compensationTierSummary STRING, compensationTiers ARRAY<STRUCT<components ARRAY<STRUCT<compensationType STRING, minValue DOUBLE, maxValue DOUBLE>>>>>>>",
        "b.jobs",
        {"external_id": "i.id", "title": "i.title", "url": "coalesce(nullif(i.jobUrl, ''), i.applyUrl)", "location": "coalesce(nullif(i.location, ''), array_join(transform(i.secondaryLocations, s -> s.location), '; '))",
         "description": "coalesce(nullif(i.descriptionPlain, ''), i.descriptionHtml)", "posted_at": "substring(i.publishedAt, 1, 10)", "department": "coalesce(nullif(i.department, ''), i.team)", "remote_flag": "i.isRemote",
         "comp_min": "CAST(element_at(filter(transform(filter(flatten(transform(i.compensation.compensationTiers, t -> t.components)), c -> c.compensationType = 'Salary'), c -> c.minValue), v -> v IS NOT NULL), -1) AS BIGINT)",
         "comp_max": "CAST(element_at(filter(transform(filter(flatten(transform(i.compensation.compensationTiers, t -> t.components)), c -> c.compensationType = 'Salary'), c -> c.maxValue), v -> v IS NOT NULL), -1) AS BIGINT)",
         "comp_text": "i.compensation.compensationTierSummary"},
    ),
    Spec(
        "smartrecruiters",
        "totalFound BIGINT, content ARRAY<STRUCT<id STRING, name STRING, ref STRING, releasedDate STRING, location STRUCT<city STRING, region STRING, country STRING, remote BOOLEAN>, department STRUCT<label STRING>, function STRUCT<label STRING>>>",
        "b.content",
        {"external_id": "i.id", "title": "i.name", "url": "coalesce(nullif(i.ref, ''), concat('https://jobs.smartrecruiters.com/', board, '/', i.id))", "location": _place("i.location.city", "i.location.region", "i.location.country") + " || CASE WHEN i.location.remote THEN ' (Remote)' ELSE '' END",
         "posted_at": "substring(i.releasedDate, 1, 10)", "department": "coalesce(i.department.label, i.function.label)", "remote_flag": "i.location.remote", "reported_total": "b.totalFound"},
    ),
    Spec(
        "workable",
        "name STRING, jobs ARRAY<STRUCT<title STRING, shortcode STRING, telecommuting BOOLEAN, department STRING, url STRING, shortlink STRING, published_on STRING, created_at STRING, country STRING, city STRING, state STRING, description STRING>>",
        "b.jobs",
        {"external_id": "i.shortcode", "title": "i.title", "url": "coalesce(nullif(i.url, ''), i.shortlink)", "company": "b.name", "location": _place("i.city", "i.state", "i.country"), "posted_at": "substring(coalesce(i.published_on, i.created_at), 1, 10)",
         "department": "i.department", "remote_flag": "i.telecommuting", "description": "i.description"},
    ),
    Spec(
        "recruitee",
        "offers ARRAY<STRUCT<id STRING, title STRING, careers_url STRING, careers_apply_url STRING, city STRING, state_name STRING, country STRING, description STRING, requirements STRING, published_at STRING, department STRING, remote STRING>>",
        "b.offers",
        {"external_id": "i.id", "title": "i.title", "url": "coalesce(nullif(i.careers_url, ''), i.careers_apply_url)", "location": _place("i.city", "i.state_name", "i.country"), "description": "concat_ws('\\n', i.description, i.requirements)",
         "posted_at": "substring(i.published_at, 1, 10)", "department": "i.department", "remote_flag": "CASE WHEN lower(i.remote) IN ('true', 'yes', '1') THEN true WHEN lower(i.remote) IN ('false', 'no', '0') THEN false END"},
    ),
    Spec(
        "bamboohr",
        "meta STRUCT<totalCount BIGINT>, result ARRAY<STRUCT<id STRING, jobOpeningName STRING, departmentLabel STRING, location STRUCT<city STRING, state STRING, country STRING>, isRemote BOOLEAN, datePosted STRING>>",
        "b.result",
        {"external_id": "i.id", "title": "i.jobOpeningName", "url": "concat('https://', board, '.bamboohr.com/careers/', i.id)", "location": _place("i.location.city", "i.location.state", "i.location.country"), "posted_at": "i.datePosted",
         "department": "i.departmentLabel", "remote_flag": "i.isRemote", "reported_total": "b.meta.totalCount"},
    ),
    Spec(
        "rippling",
        "ARRAY<STRUCT<uuid STRING, name STRING, department STRING, url STRING, workLocation STRING, descriptionHtml STRING>>",
        "b",
        {"external_id": "i.uuid", "title": "i.name", "url": "i.url", "location": "coalesce(get_json_object(i.workLocation, '$.label'), i.workLocation)", "department": "coalesce(get_json_object(i.department, '$.label'), i.department)", "description": "i.descriptionHtml"},
    ),
    Spec(
        "teamtailor",
        f"jobs ARRAY<STRUCT<{_FEED_ITEM}>>, items ARRAY<STRUCT<{_FEED_ITEM}>>, next_url STRING",
        "CASE WHEN size(b.jobs) > 0 THEN b.jobs ELSE coalesce(b.items, b.jobs) END",
        {"external_id": "coalesce(nullif(i.id, ''), nullif(get_json_object(i._jobposting, '$.identifier.value'), ''), nullif(get_json_object(i._jobposting, '$.identifier.name'), ''), CASE WHEN get_json_object(i._jobposting, '$.identifier') NOT LIKE '{%' THEN get_json_object(i._jobposting, '$.identifier') END)",
         "title": "coalesce(nullif(i.title, ''), get_json_object(i._jobposting, '$.title'))", "url": "coalesce(nullif(i.`careersite-job-url`, ''), i.url)",
         "posted_at": "substring(coalesce(nullif(i.date_published, ''), get_json_object(i._jobposting, '$.datePosted')), 1, 10)",
         "description": "coalesce(nullif(i.body, ''), nullif(i.content_html, ''), get_json_object(i._jobposting, '$.description'))",
         "remote_flag": "CASE WHEN get_json_object(i._jobposting, '$.jobLocationType') = 'TELECOMMUTE' THEN true END",
         "location": f"coalesce(nullif(i.location, ''), {_feed_places('i._jobposting')})"},
        extra={"capped": "trim(coalesce(b.next_url, '')) <> ''"}, bare_list="jobs",
    ),
    Spec(
        "pinpoint",
        "data ARRAY<STRUCT<id STRING, title STRING, url STRING, description STRING, key_responsibilities STRING, skills_knowledge_expertise STRING, benefits STRING, workplace_type STRING, compensation STRING, compensation_minimum DOUBLE, compensation_maximum DOUBLE, compensation_currency STRING, compensation_frequency STRING, compensation_visible BOOLEAN, location STRING, department STRING>>",
        "b.data",
        {"external_id": "i.id", "title": "i.title", "url": "i.url", "location": "coalesce(get_json_object(i.location, '$.name'), i.location)", "department": "coalesce(get_json_object(i.department, '$.name'), i.department)",
         "description": "concat_ws('\\n\\n', i.description, i.key_responsibilities, i.skills_knowledge_expertise, i.benefits)", "remote_flag": "CASE WHEN i.workplace_type = 'remote' THEN true WHEN i.workplace_type IS NOT NULL THEN false END",
         "comp_min": "CASE WHEN i.compensation_visible AND i.compensation_currency = 'USD' AND lower(i.compensation_frequency) IN ('year', 'annual', 'yearly') THEN CAST(i.compensation_minimum AS BIGINT) END",
         "comp_max": "CASE WHEN i.compensation_visible AND i.compensation_currency = 'USD' AND lower(i.compensation_frequency) IN ('year', 'annual', 'yearly') THEN CAST(i.compensation_maximum AS BIGINT) END",
         "comp_text": "CASE WHEN i.compensation_visible THEN i.compensation END"},
    ),
    Spec(
        "workday",
        "total BIGINT, jobPostings ARRAY<STRUCT<title STRING, externalPath STRING, locationsText STRING, postedOn STRING, bulletFields ARRAY<STRING>>>",
        "b.jobPostings",
        {"external_id": "coalesce(nullif(i.bulletFields[0], ''), i.externalPath)", "title": "i.title", "url": "concat('https://', board, i.externalPath)", "location": "i.locationsText", "posted_at": "i.postedOn", "reported_total": "b.total"},
    ),
    Spec(
        "oracle_orc",
        "items ARRAY<STRUCT<TotalJobsCount BIGINT, requisitionList ARRAY<STRUCT<Id STRING, Title STRING, PostedDate STRING, PrimaryLocation STRING, ShortDescriptionStr STRING>>>>",
        "flatten(transform(b.items, w -> w.requisitionList))",
        {"external_id": "i.Id", "title": "i.Title", "url": "concat('https://', board, '/job/', i.Id)", "location": "i.PrimaryLocation", "posted_at": "substring(i.PostedDate, 1, 10)", "description": "i.ShortDescriptionStr", "reported_total": "array_max(transform(b.items, w -> w.TotalJobsCount))"},
    ),
    Spec(
        "eightfold",
        "domain STRING, positions ARRAY<STRUCT<id STRING, name STRING, canonicalPositionUrl STRING, location STRING, locations ARRAY<STRING>, job_description STRING, t_create BIGINT, department STRING>>, count BIGINT",
        "b.positions",
        {"external_id": "i.id", "title": "i.name", "url": "i.canonicalPositionUrl", "location": "coalesce(nullif(i.location, ''), array_join(i.locations, '; '))", "description": "i.job_description", "posted_at": "CAST(i.t_create AS STRING)", "department": "i.department", "reported_total": "b.count"},
    ),
    Spec(
        "phenom",
        "eagerLoadRefineSearch STRUCT<totalHits BIGINT, data STRUCT<jobs ARRAY<STRUCT<jobId STRING, jobSeqNo STRING, title STRING, applyUrl STRING, cityStateCountry STRING, location STRING, descriptionTeaser STRING, postedDate STRING, category STRING>>>>",
        "b.eagerLoadRefineSearch.data.jobs",
        {"external_id": "coalesce(i.jobId, i.jobSeqNo)", "title": "i.title", "url": "i.applyUrl", "location": "coalesce(nullif(i.cityStateCountry, ''), i.location)", "description": "i.descriptionTeaser", "posted_at": "substring(i.postedDate, 1, 10)", "department": "i.category",
         "reported_total": "b.eagerLoadRefineSearch.totalHits"},
        format="embedded", pattern=r"(?s)phApp\.ddo\s*=\s*(\{.*?\});?\s*(?:phApp\.|</script>|$)",
    ),
    Spec(
        "paylocity",
        "Jobs ARRAY<STRUCT<JobId STRING, JobTitle STRING, JobLocation STRUCT<City STRING, State STRING, Country STRING>, LocationName STRING, Description STRING, PublishedDate STRING, IsRemote BOOLEAN>>",
        "b.Jobs",
        {"external_id": "i.JobId", "title": "i.JobTitle", "url": "concat('https://recruiting.paylocity.com/Recruiting/Jobs/Details/', i.JobId)", "location": "coalesce(" + _place("i.JobLocation.City", "i.JobLocation.State", "i.JobLocation.Country") + ", i.LocationName)",
         "description": "i.Description", "posted_at": "substring(i.PublishedDate, 1, 10)", "remote_flag": "i.IsRemote"},
        format="embedded", pattern=r"(?s)window\.pageData\s*=\s*(\{.*?\})\s*;\s*(?:</script>|$)",
    ),
    Spec(
        "icims", "", "",
        {"external_id": r"regexp_extract(i, '/jobs/(\\d+)/', 1)", "title": r"trim(regexp_extract(i, '(?s)<h3[^>]*>(.*?)</h3>', 1))", "url": r"regexp_extract(i, 'href=\"([^\"]+)\"', 1)", "location": r"trim(regexp_extract(i, '(?s)class=\"[^\"]*location[^\"]*\"[^>]*>(.*?)<', 1))", "description": r"regexp_extract(i, '(?s)class=\"description\"[^>]*>(.*?)</div>', 1)"},
        format="cards", pattern=r"(?s)<li[^>]*iCIMS_JobCardItem[^>]*>.*?</li>",
    ),
    Spec(
        "jobvite", "", "",
        {"external_id": r"regexp_extract(i, '/job/([A-Za-z0-9]+)', 1)", "title": r"trim(regexp_extract(i, '(?s)>(.*?)</a>', 1))", "url": r"concat('https://jobs.jobvite.com', regexp_extract(i, 'href=\"([^\"]+)\"', 1))"},
        format="cards", pattern=r"(?s)<a[^>]*href=\"/[^\"]*/job/[A-Za-z0-9]+\"[^>]*>.*?</a>",
    ),
    Spec(
        "hrmdirect", "", "",
        {"external_id": r"regexp_extract(i, 'data-req-id=[\"\\x27]([^\"\\x27]+)', 1)",
         "title": r"regexp_replace(coalesce(nullif(trim(regexp_extract(i, '(?is)<td[^>]*\\bid=[\"\\x27]posTitle[^>]*>(.*?)</td>', 1)), ''), trim(regexp_extract(i, '(?s)<a[^>]*>(.*?)</a>', 1))), '^\\s*<a[^>]*>\\s*|\\s*</a>\\s*$', '')",
         "url": r"CASE WHEN regexp_extract(i, 'href=[\"\\x27]([^\"\\x27]+)', 1) RLIKE '(?i)^https?://' THEN replace(regexp_extract(i, 'href=[\"\\x27]([^\"\\x27]+)', 1), '&amp;', '&') WHEN regexp_extract(i, 'href=[\"\\x27]([^\"\\x27]+)', 1) <> '' THEN concat('https://', board, '.hrmdirect.com/employment/', replace(regexp_extract(i, 'href=[\"\\x27]([^\"\\x27]+)', 1), '&amp;', '&')) END",
         "department": r"nullif(trim(regexp_replace(regexp_extract(i, '(?is)<td[^>]*\\bid=[\"\\x27]departments[^>]*>(.*?)</td>', 1), '<[^>]+>', ' ')), '')",
         "location": r"trim(regexp_extract(i, '(?s)class=\"city\"[^>]*>(.*?)<', 1))",
         "posted_at": r"CAST(try_to_date(regexp_extract(i, '(\\d{1,2}/\\d{1,2}/\\d{4})', 1), 'M/d/yyyy') AS STRING)"},
        format="cards", pattern=r"(?is)<tr[^>]*\bdata-req-id=[^>]*>.*?</tr>",
    ),
    Spec(
        "linkedin_guest", "", "",
        {"external_id": r"regexp_extract(i, 'urn:li:jobPosting:(\\d+)', 1)", "title": r"trim(regexp_extract(i, '(?s)base-search-card__title\"[^>]*>(.*?)<', 1))", "url": r"regexp_extract(i, 'href=\"([^\"?]+)', 1)", "company": r"trim(regexp_extract(i, '(?s)subtitle\"[^>]*>\\s*(?:<a[^>]*>)?(.*?)<', 1))",
         "location": r"trim(regexp_extract(i, '(?s)job-search-card__location\"[^>]*>(.*?)<', 1))", "posted_at": r"regexp_extract(i, 'datetime=\"([^\"]+)\"', 1)"},
        format="cards", pattern=r"(?s)<div[^>]*base-card[^>]*>.*?</time>",
    ),
    Spec(
        "personio", "id STRING, name STRING, office STRING, department STRING, jobDescriptions STRUCT<jobDescription ARRAY<STRUCT<name STRING, value STRING>>>", "position",
        {"external_id": "i.id", "title": "i.name", "url": "concat('https://', board, '.jobs.personio.de/job/', i.id)", "location": "i.office", "department": "i.department", "description": "array_join(transform(i.jobDescriptions.jobDescription, d -> concat_ws('\\n', d.name, d.value)), '\\n\\n')"},
        format="xml",
    ),
    Spec(
        "neogov",
        "guid STRING, link STRING, title STRING, description STRING, pubDate STRING, jobId STRING, minimumSalary STRING, maximumSalary STRING, salaryCurrency STRING, salaryInterval STRING, department STRING, categories STRUCT<category ARRAY<STRING>>, location STRING, examplesofduties STRING, qualifications STRING, supplementalinformation STRING, advertiseFromDate STRING, advertiseFromDateUTC STRING, advertiseToDateTime STRING, advertiseToDateTimeUTC STRING",
        "item",
        {"external_id": r"coalesce(nullif(trim(i.jobId), ''), nullif(regexp_extract(coalesce(nullif(trim(i.link), ''), i.guid), '/jobs/(\\d+)', 1), ''))", "title": "i.title", "location": "i.location",
         "url": "coalesce(nullif(trim(i.link), ''), nullif(trim(i.guid), ''), concat('https://www.governmentjobs.com/careers/', board, '/jobs/', trim(i.jobId)))",
         "company": r"nullif(trim(from_xml(concat('<c>', regexp_extract(b, '(?s)<channel[^>]*>.*?(<title>.*?</title>)', 1), '</c>'), 'title STRING').title), '')",
         "department": "coalesce(nullif(trim(i.department), ''), nullif(array_join(filter(i.categories.category, c -> trim(c) <> ''), ', '), ''))",
         "description": _headed({"": "i.description", "Examples of duties": "i.examplesofduties", "Qualifications": "i.qualifications", "Supplemental information": "i.supplementalinformation", "Application deadline": _rss_date("coalesce(nullif(trim(i.advertiseToDateTimeUTC), ''), i.advertiseToDateTime)")}),
         "posted_at": f"coalesce({_rss_date('coalesce(nullif(trim(i.advertiseFromDateUTC), \'\'), i.advertiseFromDate)')}, {_rss_date('i.pubDate')})",
         "comp_min": _annual("i.minimumSalary"), "comp_max": _annual("i.maximumSalary"),
         "comp_text": "nullif(concat(concat_ws(' ', nullif(upper(trim(i.salaryCurrency)), ''), nullif(concat_ws(' - ', nullif(trim(i.minimumSalary), ''), nullif(trim(i.maximumSalary), '')), '')), CASE WHEN trim(i.salaryInterval) <> '' THEN concat(' / ', trim(i.salaryInterval)) ELSE '' END), '')"},
        format="xml",
    ),
    Spec(
        "weworkremotely", "title STRING, link STRING, guid STRING, region STRING, description STRING, pubDate STRING, category STRING", "item",
        {"external_id": "coalesce(i.guid, i.link)", "company": "trim(split(i.title, ':', 2)[0])", "title": "CASE WHEN instr(i.title, ':') > 0 THEN trim(split(i.title, ':', 2)[1]) ELSE i.title END", "url": "i.link", "location": "i.region", "department": "i.category", "description": "i.description", "remote_flag": "true", "posted_at": "substring(i.pubDate, 1, 16)"},
        format="xml",
    ),
]


def _feed(name: str, schema: str, items: str, **fields: str) -> Spec:
    return Spec(name, schema, items, fields)


_SPECS += [
    _feed("remotive", "jobs ARRAY<STRUCT<id STRING, title STRING, url STRING, company_name STRING, candidate_required_location STRING, description STRING, publication_date STRING, category STRING, salary STRING>>", "b.jobs",
          external_id="i.id", title="i.title", url="i.url", company="i.company_name", location="i.candidate_required_location", description="i.description", posted_at="substring(i.publication_date, 1, 10)", department="i.category", comp_text="i.salary", remote_flag="true"),
    Spec("remoteok", "ARRAY<STRUCT<id STRING, position STRING, url STRING, company STRING, location STRING, description STRING, date STRING, salary_min BIGINT, salary_max BIGINT>>", "b",
         {"external_id": "i.id", "title": "i.position", "url": "i.url", "company": "i.company", "location": "i.location", "description": "i.description", "posted_at": "substring(i.date, 1, 10)", "comp_min": "nullif(i.salary_min, 0)", "comp_max": "nullif(i.salary_max, 0)", "remote_flag": "true"}, skip_first=True),
    _feed("arbeitnow", "data ARRAY<STRUCT<slug STRING, title STRING, url STRING, company_name STRING, location STRING, description STRING, remote BOOLEAN, created_at BIGINT>>", "b.data",
          external_id="i.slug", title="i.title", url="i.url", company="i.company_name", location="i.location", description="i.description", remote_flag="i.remote", posted_at="CAST(to_date(timestamp_seconds(i.created_at)) AS STRING)"),
    _feed("himalayas", "jobs ARRAY<STRUCT<guid STRING, title STRING, applicationLink STRING, companyName STRING, locationRestrictions ARRAY<STRING>, description STRING, pubDate BIGINT, minSalary BIGINT, maxSalary BIGINT>>, totalCount BIGINT", "b.jobs",
          external_id="i.guid", title="i.title", url="coalesce(i.applicationLink, i.guid)", company="i.companyName", location="array_join(i.locationRestrictions, ', ')", description="i.description", comp_min="i.minSalary", comp_max="i.maxSalary", remote_flag="true", reported_total="b.totalCount"),
    _feed("jobicy", "jobs ARRAY<STRUCT<id STRING, jobTitle STRING, url STRING, companyName STRING, jobGeo STRING, jobDescription STRING, pubDate STRING, annualSalaryMin BIGINT, annualSalaryMax BIGINT>>", "b.jobs",
          external_id="i.id", title="i.jobTitle", url="i.url", company="i.companyName", location="i.jobGeo", description="i.jobDescription", posted_at="substring(i.pubDate, 1, 10)", comp_min="i.annualSalaryMin", comp_max="i.annualSalaryMax", remote_flag="true"),
    _feed("themuse", "results ARRAY<STRUCT<id STRING, name STRING, refs STRUCT<landing_page STRING>, company STRUCT<name STRING>, locations ARRAY<STRUCT<name STRING>>, contents STRING, publication_date STRING>>, total BIGINT", "b.results",
          external_id="i.id", title="i.name", url="i.refs.landing_page", company="i.company.name", location="array_join(transform(i.locations, l -> l.name), '; ')", description="i.contents", posted_at="substring(i.publication_date, 1, 10)", reported_total="b.total"),
    _feed("workingnomads", "ARRAY<STRUCT<url STRING, title STRING, company_name STRING, location STRING, description STRING, pub_date STRING, category_name STRING>>", "b",
          external_id="i.url", title="i.title", url="i.url", company="i.company_name", location="i.location", description="i.description", posted_at="substring(i.pub_date, 1, 10)", department="i.category_name", remote_flag="true"),
    _feed("freehire", "data ARRAY<STRUCT<public_slug STRING, source STRING, external_id STRING, url STRING, title STRING, company STRING, location STRING, description STRING, work_mode STRING, posted_at STRING, closed_at STRING>>, meta STRUCT<total BIGINT>", "filter(b.data, x -> x.closed_at IS NULL)",
          external_id="i.external_id", title="i.title", url="i.url", company="i.company", location="i.location", description="i.description", posted_at="substring(i.posted_at, 1, 10)", remote_flag="CASE i.work_mode WHEN 'remote' THEN true WHEN 'onsite' THEN false WHEN 'hybrid' THEN false END", reported_total="b.meta.total"),
    _feed("adzuna", "count BIGINT, results ARRAY<STRUCT<id STRING, title STRING, redirect_url STRING, company STRUCT<display_name STRING>, location STRUCT<display_name STRING>, description STRING, created STRING, salary_min DOUBLE, salary_max DOUBLE, salary_is_predicted STRING>>", "b.results",
          external_id="i.id", title="i.title", url="i.redirect_url", company="i.company.display_name", location="i.location.display_name", description="i.description", posted_at="substring(i.created, 1, 10)", reported_total="b.count",
          comp_min="CASE WHEN i.salary_is_predicted = '1' OR i.salary_min = i.salary_max THEN NULL ELSE CAST(i.salary_min AS BIGINT) END", comp_max="CASE WHEN i.salary_is_predicted = '1' OR i.salary_min = i.salary_max THEN NULL ELSE CAST(i.salary_max AS BIGINT) END",
          comp_text="CASE WHEN i.salary_is_predicted = '1' OR i.salary_min = i.salary_max THEN 'salary predicted by the feed, not stated' END"),
    _feed("usajobs", "SearchResult STRUCT<SearchResultCountAll BIGINT, SearchResultItems ARRAY<STRUCT<MatchedObjectId STRING, MatchedObjectDescriptor STRUCT<PositionTitle STRING, PositionURI STRING, OrganizationName STRING, PositionLocationDisplay STRING, PublicationStartDate STRING, PositionRemuneration ARRAY<STRUCT<MinimumRange STRING, MaximumRange STRING, RateIntervalCode STRING>>, UserArea STRUCT<Details STRUCT<" + ", ".join(f"{k} STRING" for k in BODY_SECTIONS.values()) + ">>>>>>", "b.SearchResult.SearchResultItems",
          external_id="i.MatchedObjectId", title="i.MatchedObjectDescriptor.PositionTitle", url="i.MatchedObjectDescriptor.PositionURI", company="i.MatchedObjectDescriptor.OrganizationName", location="i.MatchedObjectDescriptor.PositionLocationDisplay", description=_headed({h: f"i.MatchedObjectDescriptor.UserArea.Details.{k}" for h, k in BODY_SECTIONS.items()}),
          posted_at="substring(i.MatchedObjectDescriptor.PublicationStartDate, 1, 10)", reported_total="b.SearchResult.SearchResultCountAll",
          comp_min="CASE WHEN i.MatchedObjectDescriptor.PositionRemuneration[0].RateIntervalCode IN ('PA', 'Per Year') THEN CAST(try_cast(i.MatchedObjectDescriptor.PositionRemuneration[0].MinimumRange AS DOUBLE) AS BIGINT) END",
          comp_max="CASE WHEN i.MatchedObjectDescriptor.PositionRemuneration[0].RateIntervalCode IN ('PA', 'Per Year') THEN CAST(try_cast(i.MatchedObjectDescriptor.PositionRemuneration[0].MaximumRange AS DOUBLE) AS BIGINT) END"),
    _feed("findwork", "count BIGINT, results ARRAY<STRUCT<id STRING, role STRING, url STRING, company_name STRING, location STRING, text STRING, date_posted STRING, remote BOOLEAN>>", "b.results",
          external_id="i.id", title="i.role", url="i.url", company="i.company_name", location="i.location", description="i.text", posted_at="substring(i.date_posted, 1, 10)", remote_flag="i.remote", reported_total="b.count"),
    _feed("careerjet", "hits BIGINT, jobs ARRAY<STRUCT<url STRING, title STRING, company STRING, locations STRING, description STRING, date STRING, salary STRING>>", "b.jobs",
          external_id="i.url", title="i.title", url="i.url", company="i.company", location="i.locations", description="i.description", comp_text="i.salary", reported_total="b.hits"),
]

SPECS = {s.name: s for s in _SPECS}


def register(spec: Spec) -> Spec:
    """Add a source of one's own."""
    SPECS[spec.name] = spec
    return spec


def _body(spec: Spec) -> Column:
    if spec.format == "embedded":
        inside = F.regexp_extract("body", spec.pattern, 1)
        return F.from_json(F.when(F.ltrim("body").startswith("{"), F.col("body")).otherwise(inside), spec.schema)
    if spec.bare_list:
        alone = F.ltrim("body").startswith("[")
        return F.from_json(F.when(alone, F.concat(F.lit(f'{{"{spec.bare_list}":'), "body", F.lit("}"))).otherwise(F.col("body")), spec.schema)
    return F.from_json("body", spec.schema)


def parse(raw: DataFrame, spec: Spec) -> DataFrame:
    """Items of all list payloads of one source: source, board, page_no, pos, the posting columns, reject (null: usable).

    A body that isn't the source's shape, or lacks its list, gives one row with
    the reject reason "envelope"; an item without id, title or url one with
    "item".
    """
    mine = raw.filter(F.col("source") == spec.name)
    if spec.format == "cards":
        items = F.regexp_extract_all("body", F.lit(spec.pattern), F.lit(0))
        made = mine.select("*", F.lit(None).cast("string").alias("b"), F.when(F.size(items) > 0, items).alias("items"))
    elif spec.format == "xml":
        rows = F.regexp_extract_all("body", F.lit(rf"(?s)<{spec.items}[\s>].*?</{spec.items}>"), F.lit(0))
        clean = F.transform(rows, lambda r: F.regexp_replace(r, r"<(/?)[A-Za-z]+:", "<$1"))
        around = F.regexp_replace(F.regexp_replace("body", rf"(?s)<{spec.items}[\s>].*?</{spec.items}>", ""), r"<(/?)[A-Za-z]+:", "<$1")
        ids = mine.select("*", around.alias("b"), F.when(F.size(rows) > 0, clean).alias("texts"))
        made = ids.withColumnRenamed("texts", "items")
    else:
        with_body = mine.withColumn("b", _body(spec))
        made = with_body.withColumn("items", F.expr(spec.items))
    exploded = made.select("source", "board", "page_no", "b", F.posexplode_outer("items").alias("pos", "i"))
    if spec.skip_first:
        exploded = exploded.filter("pos IS NULL OR pos > 0")
    if spec.format == "xml":
        exploded = exploded.withColumn("i", F.from_xml("i", spec.schema))
    columns = [(F.expr(spec.fields[c]) if c in spec.fields else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    rows = exploded.select("source", "board", "page_no", "pos", F.col("i").isNull().alias("no_item"), *columns, *[F.expr(e).alias(n) for n, e in spec.extra.items()])
    text = {c: strip_html(F.col(c)) for c in (*HTML_COLUMNS, *(("title",) if spec.format == "cards" else ()))}
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reject = F.when(F.col("pos").isNull() & F.col("no_item"), "envelope").when(blank("external_id") | blank("title") | blank("url"), "item")
    return rows.withColumns(text).withColumn("reject", reject).drop("no_item")


def normalize(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of all sources at hand, in one table (see parse)."""
    parsed = [parse(raw, SPECS[n]) for n in names or SPECS]
    out = parsed[0]
    for p in parsed[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_locations(rows: DataFrame) -> DataFrame:
    """One row an opening (source, board, external_id): the first row's values, all places once each in order."""
    first = lambda c: F.min_by(c, F.struct("page_no", "pos")).alias(c)
    places = F.array_sort(F.collect_list(F.when(F.col("location") != "", F.struct("page_no", "pos", "location"))))
    others = [c for c in rows.columns if c not in ("source", "board", "external_id", "location")]
    return rows.groupBy("source", "board", "external_id").agg(F.array_join(F.array_distinct(F.transform(places, lambda p: p["location"])), "; ").alias("location"), *[first(c) for c in others])


#: Detail pages of boards whose lists lack the body: one opening a page, landed with kind "detail" and its external_id.
DETAILS = {
    s.name: s
    for s in (
        Spec(
            "smartrecruiters", "jobAd STRUCT<sections STRUCT<companyDescription STRUCT<text STRING>, jobDescription STRUCT<text STRING>, qualifications STRUCT<text STRING>, additionalInformation STRUCT<text STRING>>>", "b.jobAd.sections",
            {"description": "concat_ws(' \\n', i.companyDescription.text, i.jobDescription.text, i.qualifications.text, i.additionalInformation.text)"},
        ),
        Spec(
            "workday", "jobPostingInfo STRUCT<jobDescription STRING, remoteType STRING, location STRING, additionalLocations ARRAY<STRING>, startDate STRING>", "b.jobPostingInfo",
            {"description": "i.jobDescription", "location": "array_join(filter(concat(array(i.location), coalesce(i.additionalLocations, array())), x -> x <> ''), ', ')", "posted_at": "substring(i.startDate, 1, 10)", "remote_flag": "CASE WHEN i.remoteType <> '' THEN i.remoteType RLIKE '(?i)remote' END"},
        ),
        Spec(
            "oracle_orc", "ExternalDescriptionStr STRING, ExternalResponsibilitiesStr STRING, ExternalQualificationsStr STRING, PrimaryLocation STRING, WorkplaceType STRING, ExternalPostedStartDate STRING",
            "CASE WHEN coalesce(b.ExternalDescriptionStr, b.ExternalResponsibilitiesStr, b.ExternalQualificationsStr) IS NOT NULL THEN b END",
            {"description": _headed({"Description": "i.ExternalDescriptionStr", "Responsibilities": "i.ExternalResponsibilitiesStr", "Qualifications": "i.ExternalQualificationsStr"}), "location": "i.PrimaryLocation", "posted_at": "substring(i.ExternalPostedStartDate, 1, 10)", "remote_flag": "CASE WHEN trim(i.WorkplaceType) <> '' THEN i.WorkplaceType RLIKE '(?i)\\\\bremote\\\\b' END"},
        ),
    )
}
DETAIL_COLUMNS = ("description", "location", "posted_at", "remote_flag")


def parse_details(raw: DataFrame, spec: Spec) -> DataFrame:
    """Detail pages of one source: source, board, external_id, the columns that details override, reject ("envelope": not the source's shape; "body": no text).

    raw: source, board, external_id, body.  Of a page landed again, one counts:
    the one with the longest text.
    """
    read = raw.filter(F.col("source") == spec.name).withColumn("b", F.from_json("body", spec.schema)).withColumn("i", F.expr(spec.items))
    columns = [(F.expr(spec.fields[c]) if c in spec.fields else F.lit(None)).cast(COLUMNS[c]).alias(c) for c in DETAIL_COLUMNS]
    rows = read.select("source", "board", "external_id", F.col("i").isNull().alias("no_item"), *columns).withColumn("description", strip_html(F.col("description")))
    rows = rows.withColumn("reject", F.when(F.col("no_item"), "envelope").when(F.col("description") == "", "body")).drop("no_item")
    values = F.struct(*DETAIL_COLUMNS, "reject")
    best = rows.groupBy("source", "board", "external_id").agg(F.max_by(values, F.struct(F.length("description"), F.to_json(values))).alias("v"))
    return best.select("source", "board", "external_id", "v.*")


def with_details(lists: DataFrame, details: DataFrame, columns: tuple[str, ...] = ("description", "location", "department")) -> DataFrame:
    """List rows enriched by detail rows of the same opening: a detail's value wins unless blank."""
    d = details.select("source", "board", "external_id", *[F.col(c).alias(f"detail_{c}") for c in columns])
    joined = lists.join(d, ["source", "board", "external_id"], "left")
    return joined.select(*[F.coalesce(F.when(F.trim(F.col(f"detail_{c}").cast("string")) != "", F.col(f"detail_{c}")), F.col(c)).alias(c) if c in columns else F.col(c) for c in lists.columns])
