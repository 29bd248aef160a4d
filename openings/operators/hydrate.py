"""Previews of a discovery feed joined with their detail pages, every step of it stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_all_tokens
from .commands import continuous_detail
from .rails import fetch_needed

FIELDS = ("source", "url", "title", "company", "external_id", "location", "description", "posted_at", "closed_at")
# Fixed value: a shorter text is no whole description.
WHOLE_TEXT = 800
_HTTPS = r"(?i)^https://([^/?#@:]+)(?::\d+)?(/[^?#]+)"


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[^a-z0-9]+", "_")


def direct(url: Column, suffixes: Column) -> Column:
    """Whether a url is https, without credentials, with a path, on one of the hosts or below it (null suffixes: no)."""
    host = F.lower(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _HTTPS, 1))
    return F.coalesce((host != "") & F.exists(suffixes, lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s))), F.lit(False))


def hydrate(previews: DataFrame, details: DataFrame, hosts: DataFrame, terms: list[str]) -> DataFrame:
    """One row a preview: slug, step, kept, degraded, and FIELDS as they count after that step.

    previews: slug and FIELDS.  details: asked (the slug that was requested),
    http_status, fetched_at, slug (what the answer says) and FIELDS.  hosts:
    source, suffix: where a source's own postings stand.

    step is the first of these that holds; only `hydrated` takes the detail's
    values (those that aren't blank), the others keep the preview's:
    closed preview, off topic (no term has all its words in the title),
    indirect (the url isn't on a host of its source), no detail (none landed,
    or no 200), other slug, other posting (company, title, source, url or id
    don't continue the preview's, or the new title is off topic), redirected
    (the detail's url isn't direct), closed since, hydrated.

    kept: rows that go on as postings (no detail to hydrated, but for closed
    since).  degraded: kept, and too short or without requirements.  Of several
    answers for one slug the latest counts; a preview's slug that repeats is
    one opening, its row with the smallest url.  A null slug has no detail.
    """
    fields = F.struct(*FIELDS)
    # rows meet by slug before they are ranked: a task sorts its own shuffle partition, not all that one scan widens into texts and their JSON
    p = previews.repartition("slug").groupBy("slug").agg(F.min_by(fields, F.struct("url", F.to_json(fields))).alias("p"))
    answer = F.struct("http_status", "said", fields.alias("f"))
    d = details.withColumnRenamed("slug", "said").withColumnRenamed("asked", "slug").repartition("slug").groupBy("slug").agg(F.max_by(answer, F.struct("fetched_at", F.to_json(answer))).alias("d"))
    own = hosts.groupBy(source_key(F.col("source")).alias("key_")).agg(F.collect_set(F.lower("suffix")).alias("suffixes"))  # an allow-list's few hosts a source
    t = p.join(d, "slug", "left").withColumn("key_", source_key(F.col("p.source"))).join(own, "key_", "left")

    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    merged = F.struct(*[F.when(blank(F.col(f"d.f.{c}")), F.col(f"p.{c}")).otherwise(F.col(f"d.f.{c}")).alias(c) for c in FIELDS])
    t = t.withColumn("m", merged)
    matches = lambda title: F.coalesce(F.array_max(F.array(*[contains_all_tokens(title, F.lit(x)) for x in terms])), F.lit(False)) if terms else F.lit(True)
    step = (
        F.when(~blank(F.col("p.closed_at")), "closed preview")
        .when(~matches(F.coalesce("p.title", F.lit(""))), "off topic")
        .when(~direct(F.col("p.url"), F.col("suffixes")), "indirect")
        .when(~F.col("d.http_status").eqNullSafe(F.lit(200)), "no detail")
        .when(~F.col("d.said").eqNullSafe(F.col("slug")), "other slug")
        .when(~continuous_detail(F.col("p"), F.col("d.f")) | ~matches(F.col("m.title")), "other posting")
        .when(~direct(F.col("m.url"), F.col("suffixes")), "redirected")
        .when(~blank(F.col("m.closed_at")), "closed since")
        .otherwise("hydrated")
    )
    t = t.withColumn("step", step)
    taken = F.col("step").isin("hydrated", "closed since")
    out = t.select("slug", "step", *[F.when(taken, F.col(f"m.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in FIELDS])
    kept = F.col("step").isin("no detail", "other slug", "other posting", "redirected", "hydrated")
    text = F.coalesce("description", F.lit(""))
    poor = (F.length(text) < WHOLE_TEXT) | fetch_needed(text, most=2**31 - 1)
    return out.select("slug", "step", kept.alias("kept"), (kept & poor).alias("degraded"), *FIELDS)
