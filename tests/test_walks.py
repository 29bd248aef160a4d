"""Page walks, detail pages, hydrated previews and evidence by rare words."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from openings.operators import evidence, hydrate
from openings.sources import payloads, walks

PAGES = "source string, board string, page_no int, http_status int, parsed boolean, total string"
ITEMS = "source string, board string, page_no int, pos int, external_id string"


def plain_walk(pages, items, size, most):
    """The same walk, a page at a time."""
    seen, prints, total, zero, bad, notes, n = set(), set(), None, False, False, {"unlisted": 0, "repeats": 0, "earlier": 0}, 0
    for page_no in itertools.count():
        if n == most:
            end = None
            break
        if page_no not in pages:
            end = "missing page" if any(p > page_no for p in pages) else None
            n += end is not None
            break
        status, parsed, said = pages[page_no]
        n += 1
        if status != 200 or not parsed:
            end = "http" if status != 200 else "unusable"
            break
        said = int(said) if said is not None and said.isdigit() else None
        ids = items.get(page_no, [])
        named = [x for x in ids if x]
        if named and tuple(named) in prints:
            end = "replayed page"
            break
        prints.add(tuple(named))
        bad |= said is None
        if said:
            total = max(total or 0, said)
        elif said == 0 and total is None and ids:
            zero = True
        known = 0 if total is None and said == 0 and not ids else total
        fresh = set(named) - seen
        notes["unlisted"] += len(ids) - len(named)
        notes["repeats"] += len(named) - len(set(named))
        notes["earlier"] += len(set(named)) - len(fresh)
        seen |= fresh
        short = known is not None and len(seen) < known
        if not ids:
            end = "ended short" if short else "end"
        elif not fresh:
            end = "no progress"
        elif known is not None and len(seen) >= known:
            end = "complete" if len(seen) == known else "above total"
        elif len(ids) < size:
            end = "short page" if short else "end"
        else:
            continue
        break
    end = end or ("page ceiling" if n == most else "pages stop")
    wrong = bad or (zero and end != "page ceiling") or any(notes.values())
    return n, len(seen), end, "partial" if end not in ("complete", "end", "page ceiling") or wrong else "capped" if end == "page ceiling" else "whole"


def test_walks_equal_plain_walks(spark):
    rng = random.Random(7)
    boards, page_rows, item_rows = {}, [], []
    for b in range(150):
        pages, items, made = {}, {}, 0
        for page_no in range(rng.randint(1, 7)):
            if rng.random() < 0.05 and page_no:
                continue
            ids = [f"{made + i}" for i in range(3 if rng.random() < 0.75 else rng.randint(0, 3))]
            made += len(ids)
            if rng.random() < 0.12:
                ids = [rng.choice(["0", "1", "2", "", None]) for _ in range(3)]
            if rng.random() < 0.06 and page_no - 1 in items:
                ids = items[page_no - 1]
            pages[page_no] = (rng.choice([200] * 15 + [503]), rng.random() < 0.95, rng.choice(["6", "9", "12", "0", "0", None, "x"]) if rng.random() < 0.8 else str(made))
            items[page_no] = ids
        boards[str(b)] = plain_walk(pages, items, 3, 5)
        page_rows += [("s", str(b), p, *v) for p, v in pages.items()]
        item_rows += [("s", str(b), p, i, x) for p, ids in items.items() for i, x in enumerate(ids)]
    steps = walks.walk_steps(spark.createDataFrame(page_rows, PAGES), spark.createDataFrame(item_rows, ITEMS), 3, 5)
    got = {r.board: (r.pages, r.fetched, r.end, r.verdict) for r in walks.walk_verdicts(steps, 5).collect()}
    assert got == {b: v for b, v in boards.items() if b in got} and set(boards) - set(got) == {b for b, v in boards.items() if v[0] == 0}
    assert len({v[2] for v in got.values()}) >= 8


def test_later_zero_totals_and_html_counts(spark):
    pages = spark.createDataFrame([("s", "b", 0, 200, True, "40"), ("s", "b", 1, 200, True, "0"), ("s", "c", 0, 200, True, "40")], PAGES)
    items = spark.createDataFrame([("s", "b", i // 20, i % 20, str(i)) for i in range(40)] + [("s", "c", 0, i, str(i)) for i in range(20)], ITEMS)
    got = {r.board: r for r in walks.walk_verdicts(walks.walk_steps(pages, items)).collect()}
    assert (got["b"].end, got["b"].verdict, got["b"].total) == ("complete", "whole", 40)
    assert (got["c"].end, got["c"].verdict) == ("pages stop", "partial")
    assert walks.walk_verdicts(walks.walk_steps(pages.limit(0), items.limit(0))).count() == 0
    raw = spark.createDataFrame([("s", "b", 0, 200, "<p>1 - 50 of 1,234</p>"), ("s", "b", 1, 200, "<p>none</p>"), ("s", "b", 2, 200, None)], "source string, board string, page_no int, http_status int, body string")
    assert [(r.parsed, r.total) for r in walks.page_counts(raw, r"of ([\d,]+)").orderBy("page_no").collect()] == [(True, "1234"), (True, None), (False, None)]


def test_detail_pages(spark):
    bodies = [("workday", "a", '{"jobPostingInfo": {"jobDescription": "short"}}'), ("workday", "a", '{"jobPostingInfo": {"jobDescription": "the longer text", "location": "Oslo"}}'), ("workday", "b", "not json"), ("workday", "c", None), ("workday", "d", '{"jobPostingInfo": {"jobDescription": " "}}')]
    raw = spark.createDataFrame([(s, "x", i, b) for s, i, b in bodies], "source string, board string, external_id string, body string")
    got = {r.external_id: r for r in payloads.parse_details(raw, payloads.DETAILS["workday"]).collect()}
    assert got["a"].description == "the longer text" and got["a"].reject is None
    assert [got[i].reject for i in "bcd"] == ["envelope", "envelope", "body"]
    lists = raw.select("source", "board", "external_id", F.lit("stub").alias("description"), F.lit(True).alias("remote_flag")).distinct()
    joined = {r.external_id: r for r in payloads.with_details(lists, payloads.parse_details(raw, payloads.DETAILS["workday"]), ("description", "remote_flag")).collect()}
    assert joined["a"].description == "the longer text" and joined["b"].description == "stub" and joined["a"].remote_flag


@pytest.mark.parametrize(
    ("detail", "step"),
    [
        (dict(description="x" * 900), "hydrated"), (dict(http_status=404), "no detail"), (dict(slug="t"), "other slug"), (dict(company="B"), "other posting"), (dict(url="https://boards.greenhouse.io/a/2"), "other posting"),
        (dict(url="https://boards.greenhouse.io/a/2", external_id="7"), "hydrated"), (dict(url="https://evil.example/a/1", external_id="7"), "redirected"), (dict(url="https://boards.greenhouse.io.evil.example/a/1", external_id="7"), "redirected"),
        (dict(closed_at="2024-02-02"), "closed since"), (dict(title="Sales   lead!"), "hydrated"), (None, "no detail"),
    ],
)
def test_hydration_steps(spark, detail, step):
    names = ["slug", *hydrate.FIELDS]
    kind = ", ".join(f"{n} string" for n in names)
    preview = dict(slug="s", source="greenhouse", url="https://boards.greenhouse.io/a/1", title="Sales Lead", company="A", external_id="7", description="short")
    p = spark.createDataFrame([tuple(preview.get(n) for n in names)] * 2, kind)
    d = [] if detail is None else [("s", detail.get("http_status", 200), 1, *[({"slug": "s"} | detail).get(n) for n in names])]
    got = hydrate.hydrate(p, spark.createDataFrame(d, f"asked string, http_status int, fetched_at int, {kind}"), spark.createDataFrame([("greenhouse", "greenhouse.io")], "source string, suffix string"), ["sales lead"]).collect()
    assert [r.step for r in got] == [step] and got[0].kept == (step != "closed since")
    if step == "hydrated" and detail.get("description"):
        assert got[0].description == detail["description"]
    if step in ("redirected", "other posting"):
        assert got[0].url == preview["url"] and got[0].company == "A"


def test_hydrated_rows_meet_before_they_are_ranked(spark):
    kind = ", ".join(f"{c} string" for c in ("slug", *hydrate.FIELDS))
    p, d = spark.createDataFrame([], kind), spark.createDataFrame([], f"asked string, http_status int, fetched_at int, {kind}")
    out = hydrate.hydrate(p, d, spark.createDataFrame([("greenhouse", "greenhouse.io")], "source string, suffix string"), ["sales lead"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [slug") == 2


def test_evidence_by_rare_words_equals_all_pairs(spark):
    rng = random.Random(3)
    common, rare = ["sales", "engineer", "senior", "lead"], [f"w{i}" for i in range(120)]
    title = lambda: sorted({*rng.sample(common, rng.randint(1, 3)), *rng.sample(rare, rng.randint(0, 3))})
    postings = [(f"u{i:04}", "hot" if i % 3 else f"k{i % 7}", title()) for i in range(600)] + [("z1", "only", ["x"]), ("z2", None, ["x"])]
    asked = [(i, "hot" if i % 3 else f"k{i % 7}", title() if i % 9 else None) for i in range(400)] + [(900, "only", None), (901, "none", ["x"]), (902, "only", []), (903, None, ["x"])]

    def plain(line, key, words):
        near = [(u, w) for u, k, w in postings if k is not None and k == key]
        if not near:
            return (line, "unmatched", None)
        if words is None:
            return (line, "matched", near[0][0]) if len(near) == 1 else (line, "ambiguous", None)
        scores = sorted(((len({*words} & {*w}) / len({*words} | {*w}) if words and w else 0.0, u) for u, w in near), key=lambda x: (-x[0], x[1]))
        best, runner = scores[0][0], scores[1][0] if len(scores) > 1 else 0.0
        return (line, "matched", scores[0][1]) if best >= 0.6 and best - runner >= 0.15 else (line, "ambiguous" if best >= 0.6 else "unmatched", None)

    p, e = spark.createDataFrame(postings, "uid string, key string, words array<string>"), spark.createDataFrame(asked, "line int, key string, words array<string>")
    got = sorted((r.line, r.verdict, r.uid) for r in evidence.match_evidence(e, p).collect())
    assert got == sorted(plain(*a) for a in asked) and {v for _, v, _ in got} == {"matched", "ambiguous", "unmatched"}
    sets = e.filter("size(words) > 0").select("key", F.array_sort("words").alias("words")).distinct()
    candidates = evidence.title_candidates(sets, evidence._sets(p, "uid"), 0.45).count()
    product = sum(1 for _, k, w in asked if w for _, k2, _ in postings if k == k2 and k)
    assert candidates < product / 5


def test_evidence_gives_low_overlaps(spark):
    rng = random.Random(5)
    title = lambda: sorted(rng.sample([f"w{i}" for i in range(12)], rng.randint(1, 6)))
    postings = [(f"u{i:03}", f"k{i % 9}", title()) for i in range(60)] + [("z1", "one", ["w1", "x"]), ("z2", "blank", [])]
    asked = [(i, f"k{i % 9}", title() if i % 8 else None) for i in range(120)] + [(900, "one", ["w1"]), (901, "one", ["y"]), (902, "blank", ["y"]), (903, "none", ["y"]), (904, "k1", ["strange"])]

    def plain(line, key, words):
        scores = sorted((len({*words} & {*w}) / len({*words} | {*w}) if words and w else 0.0 for _, k, w in postings if k == key), reverse=True)
        return line, *(scores + [None, None])[:2]

    p, e = spark.createDataFrame(postings, "uid string, key string, words array<string>"), spark.createDataFrame(asked, "line int, key string, words array<string>")
    assert sorted((r.line, r.best, r.runner_up) for r in evidence.match_evidence(e, p).collect()) == sorted(plain(*a) for a in asked)


def test_title_overlaps_compare_distinct_sets(spark):
    rng = random.Random(7)
    rows = [(i, f"k{i % 3}" if i % 11 else None, rng.sample([f"w{j}" for j in range(7)], rng.randint(0, 5))) for i in range(200)]
    t = spark.createDataFrame(rows, "uid int, key string, words array<string>")
    near = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    got = sorted(tuple(r) for r in evidence.title_overlaps(t, "uid", 0.6).collect())
    assert got == sorted((i, j, near(a, b)) for i, k, a in rows for j, m, b in rows if k and k == m and i < j and near(a, b) >= 0.6) and got
    # 2.5e9 pairs of one company, few of them alike
    many = spark.range(50_000).selectExpr("id AS uid", "'k' AS key", "array('common', concat('a', id div 2), concat('b', id div 2)) AS words")
    began = time.monotonic()
    assert evidence.title_overlaps(many, "uid", 0.6).count() == 25_000 and time.monotonic() - began < 60


def test_pages_that_count_their_own_cards(spark):
    link = '<a href="/x/job/{0}">Job {0}</a>'
    text = '<span class="jv-pagination-text"> {} </span>'
    bodies = {
        0: link.format("a1") + link.format("a2") + text.format("1 - 2 of 2"), 1: link.format("a1") * 2 + text.format("1-2 of 7"), 2: link.format("a1") + '<a href="/x/job/a9"><i></i></a>', 3: link.format("a1") + text.format("3-2 of 1"),
        4: '<div class="jv-wrapper">No open positions</div>', 5: "<p>Sign in</p>", 6: None, 7: "",
    }
    raw = spark.createDataFrame([("jobvite", "x", n, b) for n, b in bodies.items()] + [("other", "x", 0, "")], "source string, board string, page_no int, body string")
    got = {r.page_no: (r.openings, r.total, r.notes, r.verdict) for r in walks.card_pages(raw, "jobvite").collect()}
    assert got == {
        0: (2, 2, "", "whole"), 1: (1, 7, "read 1 of 2 shown", "capped"), 2: (1, None, "read 1 of 2 rows", "partial"), 3: (1, 1, "range makes no sense", "partial"),
        4: (0, None, "", "empty"), 5: (0, None, "", "unproven"), 6: (0, None, "", "unproven"), 7: (0, None, "", "unproven"),
    }
    row = '<tr data-req-id="{0}"><td id="posTitle"><a href="job-opening.php?req={0}">R &amp; D {0}</a></td></tr>'
    raw = spark.createDataFrame([("hrmdirect", "y", 0, row.format(1) + row.format(2)), ("hrmdirect", "y", 1, row.format(3) + '<tr data-req-id="4"><td></td></tr>'), ("hrmdirect", "y", 2, "Current job opportunities are posted here as they become available. There are no openings.")], raw.schema)
    assert [(r.openings, r.notes, r.verdict) for r in walks.card_pages(raw, "hrmdirect").orderBy("page_no").collect()] == [(2, "", "whole"), (1, "read 1 of 2 rows", "partial"), (0, "", "empty")]
    assert walks.card_pages(raw.limit(0), "hrmdirect").count() == 0


def test_older_list_and_channel_titles(spark):
    schema = "source string, board string, page_no int, body string"
    old = '[{"id": "7", "title": "T", "careersite-job-url": "https://t/7", "url": "https://t/x", "location": "Oslo", "body": "<p>b</p>"}]'
    both = '{"jobs": [], "items": [{"title": "", "url": "u", "_jobposting": {"title": "P", "identifier": "i9", "jobLocation": {"address": {"addressLocality": "Lund", "addressCountry": "SE"}}}}], "next_url": "n"}'
    rows = payloads.parse(spark.createDataFrame([("teamtailor", "b", 0, old), ("teamtailor", "b", 1, both), ("teamtailor", "b", 2, '{"x": 1}'), ("teamtailor", "b", 3, None)], schema), payloads.SPECS["teamtailor"])
    got = [(r.external_id, r.title, r.url, r.location, r.description, r.capped, r.reject) for r in rows.orderBy("page_no").collect()]
    assert got[:2] == [("7", "T", "https://t/7", "Oslo", "b", False, None), ("i9", "P", "u", "Lund, SE", "", True, None)]
    assert [g[-1] for g in got[2:]] == ["envelope", "envelope"]
    rss = '﻿<rss xmlns:n="x"><channel><link>l</link><item><title>I</title><guid>https://n/jobs/55</guid></item><title>City &amp; Co</title></channel></rss>'
    bare = '<rss><channel><item><title>I</title><guid>g</guid></item></channel></rss>'
    rows = payloads.parse(spark.createDataFrame([("neogov", "b", 0, rss), ("neogov", "b", 1, bare)], schema), payloads.SPECS["neogov"]).orderBy("page_no").collect()
    assert [(r.external_id, r.url, r.company, r.reject) for r in rows] == [("55", "https://n/jobs/55", "City & Co", None), (None, "g", None, "item")]
