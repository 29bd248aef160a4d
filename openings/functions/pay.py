"""Pay: bands from board fields and posting text, how they're shown, and listings that look made up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import spans

# Fixed values.
MONEY = r"\$\s?(\d{1,3})(?:,(\d{3}))?(?:\s?[kK])?(?:\.\d+)?"
RANGE_CONTEXT = (
    r"(?i)(base (salary|pay|compensation)|salary range|pay range|compensation range|"
    r"hiring range|target salary|annual (salary|base))"
)
HOURLY = r"(?i)\bper hour\b|/\s?h(?:ou)?r\b|\bhourly\b"
WEEKLY = r"(?i)\bper week\b|/\s?w(?:ee)?k\b|\bweekly\b"
MONTHLY = r"(?i)\bper month\b|/\s?mo(?:nth)?\b|\bmonthly\b"
THOUSANDS = r"\d\s?[kK]\b|\$\s?\d{2,3},\d{3}"
HOURS, WEEKS, MONTHS, LEAST, MOST, WINDOW = 2080, 52, 12, 40_000, 1_500_000, 320

BAND = "struct<lo:bigint,hi:bigint>"


def text_band(text: Column) -> Column:
    """The band (lo, hi) that a text states near a salary phrase; null if none.

    Each phrase opens a window; a window with two values decides, else the
    first single value is a lower end.  Rates are annualized; a bare figure
    counts as thousands only where the window writes thousands; values that
    state their own size outweigh others of the window.
    """
    windows = F.transform(spans(text, RANGE_CONTEXT), lambda s: F.substring(text, s["start"] + 1, F.lit(WINDOW)))

    def amounts(w: Column) -> Column:
        whole = F.regexp_extract_all(w, F.lit(MONEY), F.lit(0))
        a, b = F.regexp_extract_all(w, F.lit(MONEY), F.lit(1)), F.regexp_extract_all(w, F.lit(MONEY), F.lit(2))
        parts = F.arrays_zip(whole.alias("w"), a.alias("a"), b.alias("b"))
        hourly, weekly, monthly, thousands = (w.rlike(p) for p in (HOURLY, WEEKLY, MONTHLY, THOUSANDS))

        def value(x: Column) -> Column:
            has_b = F.coalesce(x["b"], F.lit("")) != ""
            raw = F.concat(x["a"], F.coalesce(x["b"], F.lit(""))).cast("long")
            v = (
                F.when(hourly & (raw < 500), raw * HOURS)
                .when(weekly & (raw < 20_000), raw * WEEKS)
                .when(monthly & (raw < 60_000), raw * MONTHS)
                .when(has_b, raw)
                .when(thousands, raw * 1000)
            )
            return F.struct(v.alias("v"), (has_b | x["w"].rlike(r"^\$\s?\d{1,3}\s?[kK]")).alias("own"))

        return F.filter(F.transform(parts, value), lambda x: x["v"].between(LEAST, MOST))

    def used(w: Column) -> Column:
        all_ = amounts(w)
        own = F.filter(all_, lambda x: x["own"])
        return F.transform(F.when(F.size(own) >= 2, own).otherwise(all_), lambda x: x["v"])

    found = F.filter(F.transform(windows, used), lambda v: F.size(v) > 0)
    pair, single = F.get(F.filter(found, lambda v: F.size(v) >= 2), F.lit(0)), F.get(found, F.lit(0))
    return (
        F.when(pair.isNotNull(), F.struct(F.array_min(pair).alias("lo"), F.array_max(pair).alias("hi")))
        .when(single.isNotNull(), F.struct(F.get(single, F.lit(0)).alias("lo"), F.lit(None).cast("long").alias("hi")))
        .cast(BAND)
    )


def board_band(lo: Column, hi: Column) -> tuple[Column, Column]:
    """(band, usable): a board's own figures, ends in order, hourly ones annualized; not usable where units are mixed (the ceiling is kept)."""
    swapped = lo.isNotNull() & hi.isNotNull() & (lo > hi)
    a, b = F.when(swapped, hi).otherwise(lo), F.when(swapped, lo).otherwise(hi)
    hourly = (a > 0) & (a < 1000) & (b.isNull() | (b < 1000))
    mixed = F.coalesce((a > 0) & (a < 1000) & (b >= LEAST), F.lit(False))
    given = (F.coalesce(lo, F.lit(0)) != 0) | (F.coalesce(hi, F.lit(0)) != 0)
    band = F.when(
        given,
        F.when(F.coalesce(hourly, F.lit(False)), F.struct((a * HOURS).alias("lo"), (b * HOURS).alias("hi")))
        .when(mixed, F.struct(F.lit(None).cast("long").alias("lo"), b.alias("hi")))
        .otherwise(F.struct(a.alias("lo"), b.alias("hi")))
        .cast(BAND),
    )
    return band, given & ~mixed


def extract_band(lo: Column, hi: Column, pay_text: Column, description: Column, provenance: Column) -> Column:
    """struct(lo, hi, source): the board's figures, else its pay text, else the posting's, else the ceiling of a mixed band, else absent."""
    band, usable = board_band(lo, hi)
    kept = F.when(provenance.isin("board", "body", "unknown"), provenance).otherwise("board")
    of = lambda b, s: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), s.alias("source"))
    by_text, by_body = text_band(F.coalesce(pay_text, F.lit(""))), text_band(F.coalesce(description, F.lit("")))
    none = F.struct(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit("absent").alias("source"))
    return (
        F.when(usable, of(band, kept))
        .when(by_text.isNotNull(), of(by_text, F.lit("board")))
        .when(by_body.isNotNull(), of(by_body, F.lit("body")))
        .when(band.isNotNull(), of(band, F.lit("board")))
        .otherwise(none)
    )


def show_band(lo: Column, hi: Column, source: Column) -> Column:
    """A band for people, with what it rests on."""
    k = lambda c: F.concat(F.lit("$"), F.floor(c / 1000).cast("string"), F.lit("k"))
    shown = (
        F.when(lo.isNotNull() & hi.isNotNull(), F.when(lo == hi, k(lo)).otherwise(F.concat(k(lo), F.lit("-"), k(hi))))
        .when(lo.isNotNull(), F.concat(k(lo), F.lit("+")))
        .when(hi.isNotNull(), F.concat(F.lit("up to "), k(hi)))
    )
    return F.coalesce(F.when(source == "body", F.concat(shown, F.lit(" (parsed from posting)"))).when(source == "unknown", F.concat(shown, F.lit(" (source unknown)"))).otherwise(shown), F.lit("not stated"))


def ghost_points(source_is_ats: Column, url_direct: Column, company_site: Column, lo: Column, hi: Column, title: Column) -> Column:
    """Points for looking made up (4 or more: flagged).  A null url means never looked and says nothing."""
    looked = url_direct.isNotNull() | company_site.isNotNull()
    feed = ~source_is_ats & looked
    annualized = (F.pmod(lo, F.lit(HOURS)) == 0) & (F.pmod(hi, F.lit(HOURS)) == 0) & (lo >= 100_000)
    pays = title.rlike(r"(?i)\$\s?\d|\bper (hour|week|month)\b|\bweekly pay\b")
    add = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return add(feed & (F.coalesce(url_direct, F.lit("")) == ""), 2) + add(feed & (F.coalesce(company_site, F.lit("")) == ""), 2) + add(annualized, 3) + add(pays, 2)
