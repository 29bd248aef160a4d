import datetime
import re

import pytest
from pyspark.sql import functions as F

from openings.functions import identity, pay, spans, text
from openings.operators.screen import RuleSet, compile_terms, location_verdict


def one(spark, value, make):
    """make(column) for one string value."""
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "name, key",
    [("Acme, Inc.", "acme"), ("The Globex Group", "globex"), ("Labs Ltd", "labs ltd"), ("", ""), (None, ""), ("Georgia-Pacific LLC", "georgia pacific")],
)
def test_company_key(spark, name, key):
    assert one(spark, name, text.company_key) == key


def test_titles(spark):
    assert one(spark, "Senior PM (Remote, US) - Full Time", text.title_key) == "senior pm"
    assert one(spark, "Architect (Data Cloud)", lambda c: text.title_key(c, strict=True)) == "architect data cloud"
    assert one(spark, "Architect (Data Cloud)", text.title_key) == "architect"
    assert sorted(one(spark, "Senior Manager of the Data Team II", text.title_tokens)) == ["data", "manager", "team"]


def test_strip_html(spark):
    assert one(spark, "&lt;p&gt;One &amp;amp; two&lt;/p&gt;<ul><li>x</li></ul>&nbsp; y", text.strip_html) == "One & two\n - x\n y"
    assert one(spark, None, text.strip_html) == ""


def test_small_text_functions(spark):
    assert one(spark, "=1+1", text.formula_guard) == "'=1+1" and one(spark, " ok", text.formula_guard) == " ok"
    assert one(spark, "a​b\n*c*", text.sanitize) == "ab &#42;c&#42;"
    assert one(spark, "pay: low", text.reason_label) == "pay"
    assert one(spark, "Big Red Dog Labs", text.slug_candidates) == ["bigreddog", "big-red-dog", "brd"]
    assert one(spark, "# Head\n- First one here. Second one here! no", text.sentences) == ["First one here.", "Second one here! no"]
    assert one(spark, "x", lambda c: text.percent(F.lit(1), F.lit(0))) is None and one(spark, "x", lambda c: text.percent(F.lit(1), F.lit(3))) == 33.3


BODY = "We are hybrid. You will not carry a sales quota. Own a sales quota; fine\nRequirements:\n\n- 5 years of CPQ\n- more CPQ"


def test_spans_equal_finditer(spark):
    for pattern in ("quota", "(?i)cpq|own", "[a-z]+"):
        got = one(spark, BODY + " ünï 😀 quota", lambda c, p=pattern: spans.spans(c, p))
        assert [(s.start, s.end, s.match) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, BODY + " ünï 😀 quota")]
    assert one(spark, None, lambda c: spans.spans(c, "a")) == []


def test_context(spark):
    quota = lambda c, n: F.get(spans.spans(c, "sales quota"), F.lit(n))
    assert one(spark, BODY, lambda c: spans.negated(c, quota(c, 0))) and not one(spark, BODY, lambda c: spans.negated(c, quota(c, 1)))
    assert one(spark, BODY, lambda c: spans.rail_hit(c, "sales quota")["start"]) == BODY.rindex("sales quota")
    assert one(spark, BODY, lambda c: spans.clause_before(c, quota(c, 1))) == "Own a"
    cpq = lambda c: F.get(spans.spans(c, "CPQ"), F.lit(1))
    assert one(spark, BODY, lambda c: spans.governing_heading(c, cpq(c))) == "Requirements:"
    assert one(spark, BODY, lambda c: spans.sentence_around(c, cpq(c))) == "- more CPQ"
    assert one(spark, BODY, spans.requirements_section).strip() == "- 5 years of CPQ\n- more CPQ"
    assert one(spark, "no heading", spans.requirements_section) == "no heading"


@pytest.mark.parametrize(
    "url, same",
    [("HTTPS://Example.COM:443/a?b=1#c", "https://example.com/a?b=1"), ("http://x.org", "http://x.org/"), ("http://x.org:8080", "http://x.org:8080/"), ("mailto:a#b", "mailto:a"), (None, "")],
)
def test_identity_url(spark, url, same):
    assert one(spark, url, identity.identity_url) == same


def test_uids(spark):
    rows = [("Acme Inc", "PM (Core)", "greenhouse", "u1", "1"), ("ACME", "PM (Data)", "greenhouse", "u2", "2"), ("Acme", "PM (Core)", "remotive", "u3", "1"), ("", "PM", "remotive", "http://a/1", ""), ("", "PM", "remotive", "http://a/2", "")]
    key = [F.col(c) for c in ("company", "title", "source", "url", "external_id")]
    got = spark.createDataFrame(rows, "company string, title string, source string, url string, external_id string").select(identity.group_key(*key).alias("g"), identity.opening_uid(*key).alias("u")).collect()
    assert got[0].g == got[1].g == got[2].g and len({x.u for x in got}) == 5 and got[3].g != got[4].g
    assert all(len(x.u) == 20 for x in got)


@pytest.mark.parametrize(
    "body, band",
    [
        ("Base salary: $120,000 to $150,000", (120_000, 150_000, "body")), ("salary range $60 - $75 per hour", (124_800, 156_000, "body")), ("pay range: $120k-$140K plus a $500 stipend", (120_000, 140_000, "body")),
        ("target salary $90,000", (90_000, None, "body")), ("We pay well: $500 bonus", (None, None, "absent")), ("", (None, None, "absent")),
    ],
)
def test_pay_from_text(spark, body, band):
    null = F.lit(None).cast("long")
    assert tuple(one(spark, body, lambda c: pay.extract_band(null, null, F.lit(""), c, F.lit("")))) == band


@pytest.mark.parametrize("lo, hi, band", [(150_000, 120_000, (120_000, 150_000, "board")), (50, 60, (104_000, 124_800, "board")), (1, 250_000, (None, 250_000, "board"))])
def test_pay_from_board(spark, lo, hi, band):
    assert tuple(one(spark, "", lambda c: pay.extract_band(F.lit(lo).cast("long"), F.lit(hi).cast("long"), c, c, F.lit("")))) == band


def test_compiled_terms():
    p = re.compile(compile_terms(["C++", "/foo\\d/"]).replace(r"\p{L}\p{N}", r"\w"))
    assert p.search("use C++ now") and p.search("FOO7") and not p.search("xfoo7y")
    for bad in (["/.*/"], ["/a?/"], [""]):
        with pytest.raises(ValueError):
            compile_terms(bad)
    with pytest.raises(ValueError):
        compile_terms([], strict=True)


@pytest.mark.parametrize(
    "location, title, body, flag, verdict",
    [
        ("Berlin, Germany", "PM", "", None, "fail"), ("Austin, TX", "PM", "", None, "pass"), ("Remote (US)", "PM", "", None, "pass"), ("Remote", "PM", "", None, "unknown"), ("", "PM", "", None, "unknown"),
        ("Remote, in", "PM", "", None, "pass"), ("Remote, pl", "PM", "", None, "fail"), ("3 Locations", "PM", "", None, "unknown"), ("United States", "PM", "", None, "unknown"), ("Denver, CO", "PM", "", None, "fail"),
        ("Remote - US, Canada", "PM", "", None, "pass"), ("Remote, worldwide", "PM", "", None, "unknown"), ("Texas", "PM", "fully remote", None, "unknown"), ("Chicago", "Hybrid PM", "", False, "fail"),
    ],
)
def test_location(spark, location, title, body, flag, verdict):
    row = spark.createDataFrame([(location, title, body, flag)], "l string, t string, b string, f boolean")
    assert row.select(location_verdict(F.col("l"), F.col("t"), F.lit("Acme"), F.col("b"), F.col("f"), RuleSet(metros=("austin",))).alias("v")).first().v.verdict == verdict


def test_regular_expressions_stay_linear(spark):
    began = datetime.datetime.now()
    one(spark, "salary " * 30_000, spans.requirements_section)
    one(spark, "a " * 100_000, lambda c: spans.rail_hit(c, "sales quota"))
    assert (datetime.datetime.now() - began).total_seconds() < 30
