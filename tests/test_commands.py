import datetime
import time

import pytest
from pyspark.sql import functions as F

from openings.functions.identity import identity_url
from openings.operators import commands, listing, rails

D = datetime.date


def text(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "said, day",
    [
        ("Apply by March 3rd, 2024.", D(2024, 3, 3)), ("application deadline is 2024-05-06; position closes on 04/01/2024", D(2024, 4, 1)), ("Applications accepted until Sep 9 2024", D(2024, 9, 9)),
        ("posting closes 1/2/24", D(2024, 1, 2)), ("Benefits start 2024-01-01", None), ("Apply by Smarch 3 2024", None), (None, None),
    ],
)
def test_deadline(spark, said, day):
    assert text(spark, said, rails.deadline) == day


@pytest.mark.parametrize(
    "body, demanded",
    [
        ("3 years specializing in CPQ", True), ("CPQ is nice to have", False), ("5 years in clouds such as Sales, CPQ", False), ("Must have Sales Cloud, CPQ", False), ("Required Skills:\n\n* CPQ certification", True),
        ("Preferred Qualifications:\n* CPQ", False), ("Requirements:\n* familiarity with CPQ", False), ("We love dogs", False), ("Partner with the CPQ team; 5+ years of cloud required", False),
    ],
)
def test_required_product(spark, body, demanded):
    assert (text(spark, body, lambda c: rails.requires_product(c, "CPQ")) is not None) == demanded


def test_hard_requirements(spark):
    body = "About\nour architects\nRequirements:\n- must be a Certified Architect\n- Developer II preferred\nBenefits:\nlead"
    got = text(spark, body, lambda c: rails.hard_requirements(c, {"architect": "(?i)certified architect", "dev": "Developer II", "lead": "lead"}))
    assert [(x.label, x.sentence) for x in got] == [("architect", "- must be a Certified Architect")]


def test_statuses(spark):
    o = spark.createDataFrame([(1, "new", "n"), (2, "applied", "")], "uid int, status string, notes string")
    marks = spark.createDataFrame([(1, "applied", "", "t", 1), (1, "rejected", "sorry", "t", 2), (2, "applied", "", "t", 3), (2, "apllied", "", "t", 4), (9, "new", "", "t", 5)], "uid int, status string, notes string, at string, ord int")
    after, events, refused = commands.set_statuses(o, marks)
    assert sorted(map(tuple, after.collect())) == [(1, "rejected", "sorry"), (2, "applied", "")]
    assert sorted((x.uid, x.kind) for x in events.collect()) == [(1, "status:applied"), (1, "status:rejected")]
    assert sorted((x.uid, x.why) for x in refused.collect()) == [(2, "unknown status"), (9, "unknown opening")]


def test_a_late_stage_does_not_set_the_status_back(spark):
    c = spark.createDataFrame([(1, "rejected", "2024-02-01", "", 1), (1, "applied", "2024-01-01", "", 2), (1, "applied", "2024-01-01", "", 3), (1, "odd", "2024-03-01", "", 4)], "uid int, stage string, at string, detail string, ord int")
    events, statuses = commands.record_stages(c)
    assert events.count() == 2 and statuses.first().status == "rejected"


def test_append_once_and_adoption(spark):
    s = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    n = spark.createDataFrame([("a", None), ("c", None), ("c", None)], "k string, v string")
    assert sorted(map(str, commands.append_once(s, n, ["k", "v"]).collect())) == sorted(map(str, [*s.collect(), n.collect()[1]]))
    legacy = spark.createDataFrame([("o", "g", "u2")], "uid string, group_key string, url string")
    batch = spark.createDataFrame([("n1", "g", "u1", 1), ("n2", "g", "u2", 2)], "uid string, group_key string, url string, ord int")
    assert commands.adopt_legacy(legacy, batch).first().new_uid == "n2"


def test_legacy_adoption_does_not_pair_whole_groups(spark):
    n = 60_000  # 3.6e9 pairs if every legacy row met its group
    legacy = spark.range(n).selectExpr("id AS uid", "'g' AS group_key", "CASE WHEN id % 3 > 0 THEN concat('u', id % 3) END AS url")
    batch = spark.range(n).selectExpr("1000000 + id AS uid", "'g' AS group_key", "concat('u', id % 3) AS url", "id AS ord")
    began = time.monotonic()
    got = {(r.u, r.new_uid, r.n) for r in commands.adopt_legacy(legacy, batch).groupBy((F.col("old_uid") % 3).alias("u"), "new_uid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, 1000000, n // 3), (1, 1000001, n // 3), (2, 1000002, n // 3)} and time.monotonic() - began < 60


def test_rekeyed_openings(spark):
    stored = spark.createDataFrame([("o1", "remotive", "https://a/1"), ("o2", "Himalayas", "HTTPS://BÜCHER.example.com:443/x#y"), ("o3", "remotive", "https://a/3"), ("o4", "remotive", "https://a/4")], "uid string, source string, url string")
    sightings = [
        ("n1", "o1", "o1", "remotive", "https://a/1"), ("n2", None, "o2", "himalayas", "https://xn--bcher-kva.example.com/x"), ("n0", "o2", None, "himalayas", "https://xn--bcher-kva.example.com/x"),
        ("n3", None, "o3", "remotive", "https://a/other"), ("o4", "o4", "o4", "remotive", "https://a/4"), ("n5", None, None, "remotive", "https://a/4"),
    ]
    got = listing.rekey(stored, spark.createDataFrame(sightings, "uid string, blank_uid string, named_uid string, source string, url string"), identity_url).collect()
    assert sorted(tuple(r) for r in got) == [("o1", "n1", "blank-company"), ("o2", "n2", "named-aggregator")]


def test_detail_continuity(spark):
    s = "struct<company:string,title:string,source:string,url:string,external_id:string>"
    rows = [(("A", "T", "s", "u", "1"), ("a", "T", "", "u", "")), (("A", "T", "s", "u", "1"), ("B", "T", "", "u", "")), (("A", "T", "s", "u", "1"), ("", "", "", "v", "1")), (("A", "T", "s", "u", "1"), ("", "", "", "v", "2")), (("A", "T", "s", "u", "1"), ("", "", "", "", ""))]
    got = spark.createDataFrame(rows, f"p {s}, d {s}").select(commands.continuous_detail(F.col("p"), F.col("d")).alias("x")).collect()
    assert [x.x for x in got] == [True, False, True, False, True]


def test_profile(spark):
    r = spark.createDataFrame([(1, "lanes", "x", "5"), (2, "lane", "", None), (3, "lane", "x", "5.5"), (4, "lane", "x", "101")], "ord int, kind string, pattern string, weight string")
    assert sorted((x.ord, x.problem, x.hint) for x in commands.profile_violations(r, ["lane", "signal"]).collect()) == [(1, "unknown kind", "lane"), (2, "blank pattern", None), (3, "bad weight", None), (4, "bad weight", None)]


def test_queries_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"], cwd=here, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
