"""Landed lines and tables that aren't a board's payload, and pages that prove that a board is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html

# What pages of these boards say when they have no openings, and what they say when they only keep readers out.
ICIMS_NONE = r"(?i)\biCIMS_(?:JobSearchNoResults|NoResults|EmptyResults)\b"
NONE_TEXT = r"(?i)\b(?:no (?:jobs?|results|positions)|there are (?:currently )?no open positions|no open positions)\b"
KEPT_OUT = r"(?i)\b(?:sign in|log in|login|access denied|authentication required|captcha|verify (?:that )?you are human|just a moment|checking your browser|enable javascript|cloudflare)\b"


def evidence_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(line_no, columns of schema, problem) of lines (line_no, line): blank ones and comments are passed over, others that aren't JSON objects stay as problems."""
    text = F.trim(F.coalesce("line", F.lit("")))
    kept = lines.filter((text != "") & ~text.startswith("#")).select("line_no", text.alias("text"))
    made = kept.select("line_no", F.from_json("text", f"{schema}, corrupt_ STRING", {"columnNameOfCorruptRecord": "corrupt_"}).alias("r"), F.col("text").startswith("{").alias("object_"))
    good = F.col("object_") & F.col("r.corrupt_").isNull()
    names = [c.split()[0] for c in schema.split(", ")]
    return made.select("line_no", *[F.when(good, F.col(f"r.{n}")).alias(n) for n in names], F.when(~good, F.lit("not an object")).alias("problem"))


def tabular(rows: DataFrame) -> DataFrame:
    """Rows of a scraped table (site, min_amount, max_amount, job_url_direct, company_url as far as they are there) as posting columns; NaN is nothing."""
    has = lambda c: c in rows.columns
    amount = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.floor(F.col(c).cast("double"))).cast("long") if has(c) else F.lit(None).cast("long")
    said = lambda c: F.when(F.lower(F.trim(F.col(c).cast("string"))).isin("nan", "none", "nat"), "").otherwise(F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))) if has(c) else F.lit("")
    return rows.select("*", F.concat(F.lit("jobspy:"), F.lower(said("site"))).alias("source"), amount("min_amount").alias("comp_min"), amount("max_amount").alias("comp_max"), said("job_url_direct").alias("url_direct"), said("company_url").alias("company_site"))


def positive_whole(value: Column) -> Column:
    """The whole number above zero that a text is, thousands separated by commas or not; else null."""
    plain = F.regexp_replace(F.trim(value.cast("string")), ",", "")
    return F.when(plain.rlike(r"^\d{1,18}$") & (plain.try_cast("long") > 0), plain.try_cast("long"))


def icims_empty(page: Column) -> Column:
    """The page says by its own marks, or on one of its own pages in words, that there are no openings; a page that keeps readers out says nothing."""
    page = F.coalesce(page, F.lit(""))
    own = page.rlike(r"(?i)\biCIMS_")
    return page.rlike(ICIMS_NONE) | (own & strip_html(page).rlike(NONE_TEXT) & ~strip_html(page).rlike(KEPT_OUT))


def jobvite_empty(page: Column) -> Column:
    """The same for pages with the marks of the other board."""
    page = F.coalesce(page, F.lit(""))
    return page.rlike(r"(?i)\bjv-") & strip_html(page).rlike(NONE_TEXT)


# The words of a third board's own empty page.
HRM_TEMPLATE = r"(?i)current job opportunities are posted here as they become available"
HRM_NONE = r"(?i)\b(?:there are\s+)?(?:currently\s+)?no\s+(?:open\s+)?(?:jobs?|positions?|job openings?|openings?)(?:\s+(?:are\s+)?(?:currently\s+)?available(?:\s+at\s+this\s+time)?|(?=[.!?]|$))"


def hrmdirect_empty(page: Column) -> Column:
    """The third board's template with a sentence that says there are none."""
    plain = strip_html(F.coalesce(page, F.lit("")))
    return plain.rlike(HRM_TEMPLATE) & plain.rlike(HRM_NONE)
