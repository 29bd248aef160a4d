"""Walks over a board's pages: where a walk ends, what it proves, and what it leaves open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import payloads
from .integrity import whole_count
from .landed import hrmdirect_empty, jobvite_empty

#: Ends after which nothing is missing, and ends whose own page doesn't count.
DONE, UNCOUNTED = ("complete", "end"), ("missing page", "http", "unusable", "replayed page")


def walk_steps(pages: DataFrame, items: DataFrame, page_size: int = 20, most_pages: int | None = None) -> DataFrame:
    """The pages that each board's walk takes, in order, with what is known after each.

    pages: source, board, page_no (from 0), http_status, parsed, total (text).
    items: source, board, page_no, pos, external_id (null or blank: no identity).

    Returns source, board, page_no, items, fresh (ids that no page before had),
    unlisted (items without an id), repeats (ids again within the page), found
    (ids so far), total (the largest positive total so far; 0 if an empty page
    says so), bad_total, zero_with_rows, end (why the walk stops here, else
    null).  Pages beyond the end or beyond `most_pages` aren't part of a walk.
    The first page's total holds where later pages say 0.  A page twice in
    `pages` counts once (its worst answer).
    """
    by = ["source", "board", "page_no"]
    id_ = F.when(F.trim("external_id") != "", F.trim("external_id"))
    rows = items.select(*by, "pos", id_.alias("id"))
    listed = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count("id").alias("named"), F.countDistinct("id").alias("distinct_"),
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("ids"),
    )
    listed = listed.withColumn("print_", F.when(F.size("ids") > 0, F.sha2(F.to_json(F.transform("ids", lambda x: x["id"])), 256))).drop("ids")
    fresh = rows.filter("id IS NOT NULL").groupBy("source", "board", "id").agg(F.min("page_no").alias("page_no")).groupBy(*by).agg(F.count(F.lit(1)).alias("fresh"))
    answers = pages.groupBy(*by).agg(F.max("http_status").alias("http_status"), F.bool_and("parsed").alias("parsed"), F.max(whole_count(F.col("total"))).alias("said"))
    p = answers.join(listed, by, "left").join(fresh, by, "left").fillna(0, ["items", "named", "distinct_", "fresh"])
    first = p.filter("print_ IS NOT NULL").groupBy("source", "board", "print_").agg(F.min("page_no").alias("first_"))
    p = p.join(first, ["source", "board", "print_"], "left")

    w = Window.partitionBy("source", "board").orderBy("page_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumns({"nth": F.row_number().over(w), "found": F.sum("fresh").over(so_far), "most": F.max(F.when(F.col("said") > 0, F.col("said"))).over(so_far)})
    if most_pages is not None:
        p = p.filter(F.col("nth") <= most_pages)
    none = F.col("items") == 0
    total = F.coalesce("most", F.when((F.col("said") == 0) & none, F.lit(0).cast("long")))
    short = F.coalesce(F.col("found") < total, F.lit(False))
    end = (
        F.when(F.col("page_no") != F.col("nth") - 1, "missing page")
        .when(~F.col("http_status").eqNullSafe(F.lit(200)), "http")
        .when(~F.coalesce("parsed", F.lit(False)), "unusable")
        .when(none & short, "ended short")
        .when(none, "end")
        .when(F.col("first_") < F.col("page_no"), "replayed page")
        .when(F.col("fresh") == 0, "no progress")
        .when(F.col("found") > total, "above total")
        .when(F.col("found") == total, "complete")
        .when((F.col("items") < page_size) & short, "short page")
        .when(F.col("items") < page_size, "end")
    )
    before = F.count("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("end", end).withColumn("ended_", before).filter("ended_ = 0").select(
        *by, "items", "fresh", (F.col("items") - F.col("named")).alias("unlisted"), (F.col("named") - F.col("distinct_")).alias("repeats"), (F.col("distinct_") - F.col("fresh")).alias("earlier"), "found", total.alias("total"),
        F.col("said").isNull().alias("bad_total"), ((F.col("said") == 0) & ~none & F.col("most").isNull()).alias("zero_with_rows"), "end",
    )


def walk_verdicts(steps: DataFrame, most_pages: int | None = None) -> DataFrame:
    """(source, board, pages, fetched, total, end, verdict, notes) of every walk (see walk_steps).

    verdict: partial where an end or a page shows that something is missing or
    wrong, capped where the page ceiling ended a walk below its total (or
    without one), else whole.  A walk whose pages stop without an end is
    partial ("pages stop").  notes: what pages showed, in a fixed order.
    """
    counted = ~F.coalesce(F.col("end").isin(*UNCOUNTED), F.lit(False))
    g = steps.groupBy("source", "board").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.max(F.when(counted, F.col("found"))), F.lit(0).cast("long")).alias("fetched"), F.max(F.when(counted, F.col("total"))).alias("total"), F.max("end").alias("end"),
        *[F.sum(F.when(counted, F.col(c))).alias(c) for c in ("unlisted", "repeats", "earlier")], F.bool_or(counted & F.col("bad_total")).alias("bad_total"), F.bool_or(counted & F.col("zero_with_rows")).alias("zero"),
    )
    ceiling = F.lit(False) if most_pages is None else (F.col("pages") >= most_pages) & F.col("end").isNull()
    end = F.coalesce("end", F.when(ceiling, "page ceiling"), F.lit("pages stop"))
    notes = F.array_compact(F.array(
        F.when(F.col("bad_total"), "page without a total"), F.when(F.col("zero") & (end != "page ceiling"), "total 0 with items"), F.when(F.col("unlisted") > 0, "items without an id"),
        F.when(F.col("repeats") > 0, "ids repeated in a page"), F.when(F.col("earlier") > 0, "ids of earlier pages"),
    ))
    verdict = F.when(~end.isin(*DONE, "page ceiling") | (F.size(notes) > 0), "partial").when(end == "page ceiling", "capped").otherwise("whole")
    return g.select("source", "board", "pages", "fetched", "total", end.alias("end"), verdict.alias("verdict"), F.array_join(notes, "; ").alias("notes"))


def page_counts(raw: DataFrame, pattern: str) -> DataFrame:
    """The totals that HTML pages state: source, board, page_no, http_status, parsed, total (the number behind `pattern`'s first group, commas out; null if none)."""
    said = F.regexp_replace(F.regexp_extract("body", pattern, 1), ",", "")
    return raw.select("source", "board", "page_no", "http_status", (F.trim(F.coalesce("body", F.lit(""))) != "").alias("parsed"), F.when(said != "", said).alias("total"))


# What can be an opening on the pages of two boards, and how one of them says which rows of how many a page shows.
CANDIDATES = {"jobvite": r"(?i)href=[\"']/[^\"'/]+/job/[A-Za-z0-9]+", "hrmdirect": r"(?i)<tr[^>]*\bdata-req-id="}
SHOWN = r"(?is)class=[\"'][^\"']*\bjv-pagination-text\b[^\"']*[\"'][^>]*>\s*(\d+)\s*-\s*(\d+)\s+of\s+(\d+)\b"


def card_pages(raw: DataFrame, source: str) -> DataFrame:
    """What an HTML page of a board without an interface proves about its own openings.

    raw: raw_payloads of jobvite or hrmdirect.  One row a page: source, board,
    page_no, candidates (places that look like an opening), openings (distinct
    ids of usable rows), first, last, total (as the page says, else null),
    capped (more are said to exist), notes, verdict: "whole", "partial" (a
    note), "capped", "empty" (no rows, and the board's own words for it) or
    "unproven" (no rows and no such words).  A page twice counts once for its
    ids; null bodies are unproven.
    """
    mine = raw.filter(F.col("source") == source)
    body = F.coalesce("body", F.lit(""))
    said = [F.when(body.rlike(SHOWN), F.regexp_extract(body, SHOWN, i).try_cast("bigint")) for i in (1, 2, 3)] if source == "jobvite" else [F.lit(None).cast("bigint")] * 3
    empty = {"jobvite": jobvite_empty, "hrmdirect": hrmdirect_empty}[source](body)
    pages = mine.select("source", "board", "page_no", F.regexp_count(body, F.lit(CANDIDATES[source])).cast("bigint").alias("candidates"), empty.alias("empty"), *[c.alias(n) for c, n in zip(said, ("first", "last", "total"), strict=True)])
    pages = pages.groupBy("source", "board", "page_no").agg(F.max("candidates").alias("candidates"), F.bool_and("empty").alias("empty"), *[F.max(c).alias(c) for c in ("first", "last", "total")])
    rows = payloads.parse(mine, payloads.SPECS[source]).filter("reject IS NULL")
    counts = rows.groupBy("source", "board", "page_no").agg(F.countDistinct("external_id").alias("openings"), F.count(F.lit(1)).alias("rows"))
    p = pages.join(counts, ["source", "board", "page_no"], "left").fillna(0, ["openings", "rows"])
    odd = (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("total") < F.col("last"))
    notes = F.array_compact(
        F.array(
            F.when((F.col("rows") > 0) & (F.col("candidates") > F.col("rows")), F.concat_ws(" ", F.lit("read"), "rows", F.lit("of"), "candidates", F.lit("rows"))),
            F.when(odd, "range makes no sense").when((F.col("rows") > 0) & (F.col("openings") != F.col("last") - F.col("first") + 1), F.concat_ws(" ", F.lit("read"), "openings", F.lit("of"), F.col("last") - F.col("first") + 1, F.lit("shown"))),
        )
    )
    capped = F.coalesce((F.col("rows") > 0) & (F.col("openings") < F.col("total")), F.lit(False))
    verdict = F.when(F.col("rows") == 0, F.when(F.col("empty"), "empty").otherwise("unproven")).when(capped, "capped").when(F.size(notes) > 0, "partial").otherwise("whole")
    return p.select("source", "board", "page_no", "candidates", "openings", "first", "last", "total", capped.alias("capped"), F.array_join(notes, "; ").alias("notes"), verdict.alias("verdict"))
