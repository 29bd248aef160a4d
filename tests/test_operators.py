import datetime

import pytest
from pyspark.sql import functions as F

from openings.operators import coverage, evidence, funnel, health, lint, merge, quality, resolve, sinks
from openings.operators.screen import RuleSet, screen
from openings.sources import integrity, payloads
from openings.streaming import jobs

D = datetime.date


def test_winners_do_not_depend_on_order(spark):
    rows = [("u", "remotive", "VERIFY", 99, None, 1), ("u", "greenhouse", "QUALIFIED", 82, "", 2), ("u", "lever", "QUALIFIED", 82, "http://a", 3), ("v", "greenhouse", "EXCLUDED", 0, None, 4), ("v", "remotive", "QUALIFIED", 90, None, 5), ("w", "remotive", "EXCLUDED", 5, None, 6), ("w", "remotive", "SLOT-BLOCKED", 1, None, 7)]
    for order in (rows, rows[::-1]):
        s = spark.createDataFrame(order, "uid string, source string, gate string, score int, url_direct string, n int").repartition(3)
        kept = resolve.pick_surfaced(s, ["source", "n"])
        assert [(x.uid, x.source, x.gate, x.url_direct) for x in kept.collect()] == [("u", "lever", "QUALIFIED", "http://a")]
        assert sorted((x.uid, x.gate) for x in resolve.pick_demoted(s, kept, ["n"]).collect()) == [("v", "EXCLUDED"), ("w", "SLOT-BLOCKED")]


def test_retiring_takes_two_days(spark):
    schema = "uid int, source string, status string, last_seen date, misses int, miss_on date, delisted_on date"
    o = spark.createDataFrame([(1, "a", "new", D(2024, 1, 1), 0, None, None), (2, "b", "new", D(2024, 1, 1), 0, None, None), (3, "a", "applied", D(2024, 1, 1), 1, None, None)], schema)
    healthy = spark.createDataFrame([("a",)], "source string")
    for day, expected in ((2, (1, None)), (2, (1, None)), (3, (2, D(2024, 1, 3)))):
        o = spark.createDataFrame(merge.retire(o, healthy, F.lit(D(2024, 1, day))).collect(), schema)
        got = {x.uid: (x.misses, x.delisted_on) for x in o.collect()}
        assert got == {1: expected, 2: (0, None), 3: (1, None)}


@pytest.mark.parametrize("stored, flag, source, board, out", [(True, False, "greenhouse", "b", False), (True, False, "remotive", "", True), (None, False, "remotive", "", False), (False, True, "x", "", True), (True, None, "x", "", True)])
def test_remote_flag(spark, stored, flag, source, board, out):
    row = spark.createDataFrame([(stored, flag, source, board)], "s boolean, f boolean, o string, b string")
    assert row.select(merge.merge_remote(*[F.col(c) for c in "sfob"]).alias("x")).first().x is out


def test_screening_a_stored_row_gives_the_same(spark):
    rules = RuleSet(lanes=(("data", 40, ("data engineer",)),), signals=(("spark", 5, ("spark",)),), metros=("austin",), comp_screen=50_000, excluded_companies=("hooli",), floors={"acme": 90})
    rows = [(i, c, t, "Austin, TX", "greenhouse", "b", None, pay, None, "A", "Spark " * 60) for i, (c, t, pay) in enumerate([("Globex", "Data Engineer", 120_000), ("Hooli", "Data Engineer", 120_000), ("Acme", "Data Engineer", None), ("Globex", "Cook", None), ("Globex", "Data Engineer", 10)])]
    p = spark.createDataFrame(rows, "doc_id int, company string, title string, location string, source string, board string, remote_flag boolean, comp_min long, comp_max long, tier string, description string")
    got = screen(p, rules).orderBy("doc_id")
    assert [x.gate for x in got.collect()] == ["QUALIFIED", "SLOT-BLOCKED", "SLOT-BLOCKED", "EXCLUDED", "EXCLUDED"]
    again = screen(spark.createDataFrame(p.collect(), p.schema).repartition(3), rules).orderBy("doc_id")
    assert got.collect() == again.collect()


def posting(spark, rows):
    """(doc_id, title, description, changes) as postings that pass every rail but those asked for."""
    plain = {"location": "Remote (US)", "company": "Globex", "source": "lever", "tier": "C", "remote_flag": True, "comp_min": 90_000, "comp_max": 150_000, "department": "", "registry_lane": "", "rails_exempt": False}
    schema = "doc_id int, title string, description string, location string, company string, source string, tier string, remote_flag boolean, comp_min int, comp_max int, department string, registry_lane string, rails_exempt boolean"
    return spark.createDataFrame([(i, t, d, *{**plain, **more}.values()) for i, t, d, more in rows], schema)


RULES = RuleSet(
    lanes=(("data", 40, ("data",)), ("ops", 30, ("operations",))), favoured_lanes=(("dream", 60, ("gardener",)),), favoured_companies=("Hooli Inc.",), lane_context={"plat": "Data"},
    title_block=("cook",), title_always_block=("surgeon",), competing=("rivalforce",), products=("cpq",), quota=True, body_block=(("travel", ("travel 80%",)),), certificates=("cta",), clearance=True,
    requirements={"years": ("15 years",)}, signals=(("spark", 5, ("spark",)), ("sql", 3, ("sql",))), metros=("austin",), comp_screen=80_000, comp_accept=100_000,
)
LONG = " We look for people who like their work." * 8
CASES = [
    ("", "", {}, "EXCLUDED", 0, "malformed"), ("Data", "Apply by June 1, 2024." + LONG, {}, "EXCLUDED", 0, "closed: 2024-06-01"), ("Data", "Apply by June 1, 2025." + LONG, {}, "QUALIFIED", 48, "remote-US"),
    ("Clerk", LONG, {}, "EXCLUDED", 0, "no lane"), ("Clerk", "Our data." + LONG, {}, "VERIFY", 26, "remote-US"), ("Clerk", LONG, {"registry_lane": "plat"}, "QUALIFIED", 48, "remote-US"), ("Data surgeon", LONG, {"rails_exempt": True}, "SLOT-BLOCKED", 40, "title always"),
    ("Data cook", LONG, {}, "SLOT-BLOCKED", 40, "title blocked: cook"), ("Data cook", LONG, {"rails_exempt": True}, "QUALIFIED", 48, "favoured"), ("Data cook gardener", LONG, {"company": "Hooli"}, "QUALIFIED", 68, "favoured"),
    ("Rivalforce data", LONG, {}, "SLOT-BLOCKED", 40, "competing"), ("Data CPQ", LONG, {}, "SLOT-BLOCKED", 40, "product in the title"), ("Data", "Must have deep knowledge of CPQ." + LONG, {}, "SLOT-BLOCKED", 40, "product demanded"),
    ("Data", "CPQ is a plus." + LONG, {}, "QUALIFIED", 48, "remote-US"), ("Data", LONG, {"location": "Berlin, Germany"}, "EXCLUDED", 40, "location: non-US"), ("Data", "You own a sales quota." + LONG, {}, "EXCLUDED", 40, "quota: You own a sales quota."),
    ("Data", "This is not a quota-carrying role." + LONG, {}, "QUALIFIED", 48, "remote-US"), ("Data", "You travel 80% of the time." + LONG, {}, "EXCLUDED", 40, "travel: You"), ("Data", "The CTA is required." + LONG, {}, "EXCLUDED", 40, "certificate refused"),
    ("Data", "You must hold a security clearance." + LONG, {"rails_exempt": True}, "EXCLUDED", 40, "clearance: You must"), ("Data", "No security clearance is required." + LONG, {}, "QUALIFIED", 48, "remote-US"),
    ("Data", "Requirements:\n- 15 years of it" + LONG, {}, "EXCLUDED", 40, "requirement not met: years: - 15 years"), ("Data", "Requirements:\n- 15 years preferred" + LONG, {}, "QUALIFIED", 48, "remote-US"),
    ("Data", LONG, {"comp_max": 70_000}, "EXCLUDED", 40, "pay below the screen: 70000"), ("Data", LONG, {"comp_max": 95_000}, "VERIFY", 40, "remote-US"), ("Data", "Spark and SQL." + LONG, {"tier": "A", "comp_min": None, "comp_max": None}, "VERIFY", 54, "remote-US"),
    ("Data", "Onsite 5x per week." + LONG, {}, "VERIFY", 48, "pay 90000"), ("Data", "You must be based in Denver Metro." + LONG, {}, "VERIFY", 48, "pay 90000"), ("Data", "You must be based in the United States." + LONG, {}, "QUALIFIED", 48, "remote-US"),
    ("Data", "You must reside in Austin." + LONG, {}, "VERIFY", 48, "pay 90000"), ("Data", "short", {}, "VERIFY", 48, "remote-US"), ("Data", LONG, {"source": "freehire:lever"}, "VERIFY", 48, "source verification"),
]


def test_every_rail(spark):
    p = posting(spark, [(i, t, d, more) for i, (t, d, more, *_) in enumerate(CASES)])
    got = screen(p, RULES, F.lit(D(2025, 1, 1))).orderBy("doc_id").collect()
    for x, (*_, gate, score, reason) in zip(got, CASES, strict=True):
        assert (x.gate, x.score) == (gate, score) and x.reasons[0].startswith(reason), x
    from openings.operators.screen import needs_check

    checks = {x.doc_id: x.c for x in screen(p, RULES, F.lit(D(2025, 1, 1))).select("doc_id", needs_check(F.col("reasons")).alias("c")).collect()}
    assert checks[26] == "called remote, but: Onsite 5x per week." and checks[25] == "pay not stated" and checks[13] == ""


def test_rules_that_contradict_themselves():
    for bad in ({"floors": {"Acme": True}}, {"floors": {"Acme": 101}}, {"floors": {"Acme Inc": 5, "acme": 6}}, {"certificates": (" ",)}):
        with pytest.raises(ValueError):
            RuleSet(**bad)


def test_evidence(spark):
    e = spark.createDataFrame([(1, "acme", ["data", "manager"]), (2, "acme", None), (3, "none", ["x"]), (4, "acme", ["cook"])], "line int, key string, words array<string>")
    p = spark.createDataFrame([("a", "acme", ["data", "manager"]), ("b", "acme", ["data", "manager", "emea", "west"])], "uid string, key string, words array<string>")
    assert [(x.line, x.verdict, x.uid) for x in evidence.match_evidence(e, p).orderBy("line").collect()] == [(1, "matched", "a"), (2, "ambiguous", None), (3, "unmatched", None), (4, "unmatched", None)]
    asked = spark.createDataFrame([("gp",), ("globex",), ("ab",)], "name string")
    employers = spark.createDataFrame([("Georgia", "georgia pacific"), ("Globex", "globex"), ("X", "a b"), ("Y", "acme b")], "employer string, key string")
    assert sorted((x.name, x.employer) for x in evidence.employer_aliases(asked, employers).collect()) == [("globex", "Globex"), ("gp", "Georgia")]


def test_funnel(spark):
    e = spark.createDataFrame([(1, D(2024, 1, 2), "applied", 1), (1, D(2024, 1, 9), "interviewing", 2), (1, D(2024, 1, 20), None, 3), (2, D(2024, 1, 3), None, 4), (3, D(2024, 3, 1), "applied", 5), (4, None, "rejected", 6)], "uid int, day date, stage string, event_id int")
    apps = funnel.fold_applications(e, F.lit(D(2024, 2, 1)), 10)
    got = {x.uid: x for x in apps.collect()}
    assert set(got) == {1, 3, 4} and got[1].current_stage == "interviewing" and got[1].days_silent == 12 and got[1].follow_up_due and got[1].days_to_interview == 7
    assert got[3].days_silent is None and not got[3].follow_up_due
    assert funnel.summary(apps.filter("uid < 0")).first().interview_rate is None
    assert [x.applications for x in funnel.weekly(apps, F.lit(D(2024, 1, 10)), 3).orderBy("week").collect()] == [0, 1, 0]


def test_health(spark):
    rows = [("a", 1, 100, None), ("a", 2, 10, "partial: x"), ("a", 3, 20, None), ("b", 1, 5, "HTTP 500"), ("b", 2, 5, "HTTP 500")]
    h = health.fold_health(spark.createDataFrame(rows, "source string, run_id int, count int, error string").withColumn("at", F.col("run_id")))
    got = {x.source: (x.last_count, x.consecutive_failures, x.prev_count) for x in h.collect()}
    assert got == {"a": (20, 0, 100), "b": (5, 2, None)}
    assert health.may_retire(h).count() == 0 and [x.source for x in health.broken(h, h).collect()] == ["b"]


def test_quality(spark):
    o = spark.createDataFrame([(1, 100, 50, "board", "x", "VERIFY"), (2, None, None, "body", "comp: ok", "ODD"), (3, 1, 90_000, "", "x", "VERIFY")], "uid int, comp_min long, comp_max long, comp_source string, reasons string, gate string")
    assert sorted((x.uid, x.check) for x in quality.invariants(o).collect()) == [(1, "pay ends out of order"), (2, "pay quoted but not stored"), (2, "provenance without pay"), (2, "unknown gate"), (3, "pay spread too wide"), (3, "pay without provenance")]
    assert [x.uid for x in quality.repaired_pay(o).filter("repaired").collect()] == [3]
    leaves = lambda d: sorted(map(tuple, quality.fingerprint(d).collect()))
    assert leaves(o) == leaves(o.repartition(3)) != leaves(o.filter("uid < 3"))


def raw(spark, source, body, board="b"):
    return spark.createDataFrame([(source, board, 1, body)], "source string, board string, page_no int, body string")


@pytest.mark.parametrize("source", ["greenhouse", "lever", "ashby", "workday", "adzuna", "remotive", "phenom", "icims", "personio"])
@pytest.mark.parametrize("body", ["[]", "{}", "null", "<html>", "", None, '{"jobs": null}', '{"jobs": [1, null]}'])
def test_malformed_payloads_are_rejected_not_raised(spark, source, body):
    got = payloads.parse(raw(spark, source, body), payloads.SPECS[source]).collect()
    assert all(x.reject is not None for x in got)


def test_every_source_parses(spark):
    assert len(payloads.SPECS) >= 34
    assert payloads.normalize(raw(spark, "none", "{}")).count() == 0


def test_pages_and_totals(spark):
    rows = [("s", "b", 1, 0, "a"), ("s", "b", 1, 1, "a"), ("s", "b", 1, 2, "c"), ("s", "b", 2, 0, "c"), ("s", "b", 2, 1, "d"), ("s", "b", 3, 0, "c"), ("s", "b", 3, 1, "d")]
    r = spark.createDataFrame(rows, "source string, board string, page_no int, pos int, external_id string")
    assert [x.repeat for x in integrity.dedupe_pages(r).orderBy("page_no", "pos").collect()] == [None, "page", None, "earlier", None, "replay", "replay"]
    t = r.withColumns({"reject": F.lit(None).cast("string"), "reported_total": F.lit(4)})
    assert integrity.reconcile_totals(t).first().verdict == "capped"
    reasons = spark.createDataFrame([("s", 1, "capped", "ceiling"), ("s", 2, "partial", "bad row"), ("s", 3, "partial", "bad row")], "source string, at int, kind string, reason string")
    assert integrity.source_verdict(reasons).first().verdict == "partial: bad row; ceiling"
    counts = spark.createDataFrame([("3",), ("-1",), ("0.5",), ("true",), (None,)], "v string").select(integrity.whole_count(F.col("v")).alias("n"))
    assert [x.n for x in counts.collect()] == [3, None, None, None, None]


def test_lint(spark):
    drafts = spark.createDataFrame([(1, "I raised revenue by 45% at Initech Global Systems over three long years."), (2, "I raised revenue by 45% at Initech Global Systems over four long years."), (3, "Something else was written by another person here today.")], "doc_id long, text string")
    register = spark.createDataFrame([("45% growth",)], "text string")
    assert sorted((x.doc_id, x.kind) for x in lint.claims(drafts, register).collect()) == [(1, "name"), (2, "name")]


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([("u", "g", 60, "=cmd"), ("v", "h", 40, None)], "uid string, group_key string, score int, title string")
    sinks.export_queue(q, str(tmp_path / "csv"), "csv")
    assert "'=cmd" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    sinks.export_queue(q, str(tmp_path / "json"))
    with pytest.raises(ValueError):
        sinks.export_queue(q, "x", "pdf")
    for run in (1, 2, 2):
        sinks.write_snapshot(q.withColumn("run", F.lit(run)), str(tmp_path / "s"), run)
    assert {x.run for x in sinks.read_latest(spark, str(tmp_path / "s")).collect()} == {2}
    tables = sinks.report_tables(q)
    assert tables["report_groups"].count() == 1 and tables["report_tail"].count() == 1
    boards = spark.createDataFrame([("A",), ("a",), ("b",)], "board string")
    assert [x.board for x in sinks.newly_discovered(boards, boards.filter("board = 'b'")).collect()] == ["A"]


def test_query_matrix_without_terms(spark):
    assert coverage.query_matrix(spark.createDataFrame([], "term string"), ["x"], ["y"]).count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    days = [(u, D(2024, 1, d), d % 4 == 0) for u in (1, 2) for d in range(1, 11)]
    for n, part in enumerate((days[:8], days[8:])):
        spark.createDataFrame(part, "uid long, day date, seen boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema("uid long, day date, seen boolean").parquet(str(tmp_path / "in/*"))
    jobs.liveness(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    batch = merge.miss_history(spark.createDataFrame(days, "uid long, day date, seen boolean"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_first_hits_of_one_ord_stand_first_in_the_table(spark, tmp_path):
    """Null ords come last, as in the SQL; hits of one ord are in the table's order, however its files are read."""
    from openings.plans.ledger_queries import query_yields

    schema = "l_returnflag string, l_partkey long, l_orderkey long, l_linenumber int"
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    few = [("R", u, 5, 1) for u in range(50)] + [("N", 60, None, 1), ("A", None, 1, 1)]
    many = [("A", u, 5, 1) for u in range(50)] + [("N", u, 9, 1) for u in range(50)] * 100 + [("A", 60, 70, 1)]
    for k, rows in enumerate((few, many)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / str(k)))
        next((tmp_path / str(k)).glob("part-*")).rename(folder / f"part-{k}.parquet")
    got = sorted(tuple(r) for r in query_yields(spark, str(tmp_path)).collect())
    assert got == [("A", 52, 51, 2), ("N", 5001, 51, 0), ("R", 50, 50, 50)]
