"""Regular-expression matches with their places, and the clause, sentence and heading around them.

A span is struct(start, end, match): code points from 0, end exclusive.  The
matches of a pattern are zipped with the texts between them; no UDF is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that deny what follows in the same sentence.
NEGATOR = r"(?i)\b(?:not?|never|without|no longer|isn'?t|aren'?t|does not|do not|don'?t|will not|won'?t|is not|are not|free from|exempt from|nor)\b"
NEGATION_WINDOW = 90


def spans(text: Column, pattern: str) -> Column:
    """All matches, leftmost and without overlap; the pattern mustn't match nothing."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda x: x["match"].isNotNull())
    return F.when(text.isNull(), F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")).otherwise(F.aggregate(pairs, start, step, lambda a: a["out"]))


def before(text: Column, span: Column) -> Column:
    return F.substring(text, F.lit(1), span["start"])


def after_last(text: Column, ends: str) -> Column:
    """What follows the last of these characters (all, if none stands there), in one pass: a regular expression would start over at every place."""
    first, *others = ends
    return F.substring_index(F.translate(text, "".join(others), first * len(others)) if others else text, first, -1)


def clause_before(text: Column, span: Column) -> Column:
    """The part of the match's own clause before it, blanks squeezed."""
    part = after_last(before(text, span), ".\n!?;")
    return F.trim(F.regexp_replace(part, r"\s+", " "))


def sentence_around(text: Column, span: Column, limit: int = 180) -> Column:
    """The sentence (or line) a match stands in, blanks squeezed, cut to a length."""
    head = after_last(before(text, span), ".\n!?")
    tail = F.regexp_extract(F.substring(text, span["end"] + 1, F.length(text)), r"^[^.\n]*[.\n]?", 0)
    return F.substring(F.trim(F.regexp_replace(F.concat(head, span["match"], tail), r"\s+", " ")), 1, limit)


def negated(text: Column, span: Column, window: int = NEGATION_WINDOW) -> Column:
    """A negator stands between the sentence's start (or `window` characters back) and the match."""
    head = after_last(before(text, span), ".\n")
    near = F.when(F.length(head) > window, F.substring(head, F.length(head) - window + 1, F.lit(window))).otherwise(head)
    return near.rlike(NEGATOR)


def rail_hit(text: Column, pattern: str) -> Column:
    """The first match that isn't denied (null if none)."""
    hits = F.when(text.rlike(pattern), F.filter(spans(text, pattern), lambda s: ~negated(text, s)))
    return F.get(hits, F.lit(0))


# Headings that open and close the requirements section.
REQUIREMENTS_HEADING = r"(?im)^[ \t*#_-]*(?:minimum |basic |required |preferred )?(?:requirements|qualifications|what you(?:'ll)? (?:need|bring)|must[- ]haves?|who you are)[ \t:*_]*$"


def requirements_section(description: Column) -> Column:
    """What follows the first requirements heading, up to the next line that is a heading (ends with a colon); the whole text without one."""
    found = F.regexp_extract(description, REQUIREMENTS_HEADING + r"\n((?s:.*?))(?=^[^\n]{1,80}:[ \t*_]*$|\z)", 1)
    return F.when(description.rlike(REQUIREMENTS_HEADING), found).otherwise(description)


def governing_heading(text: Column, span: Column, lines: int = 8) -> Column:
    """The nearest of the last non-blank lines above the match's line that ends with a colon ("" if none)."""
    head = before(text, span)
    above = F.substring(head, F.lit(1), F.length(head) - F.length(after_last(head, "\n")))
    kept = F.filter(F.transform(F.split(above, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    near = F.slice(kept, F.greatest(F.size(kept) - lines + 1, F.lit(1)), F.lit(lines))
    headings = F.filter(near, lambda x: F.regexp_replace(x, r"[*_#\s]+$", "").endswith(":"))
    return F.coalesce(F.element_at(F.when(F.size(headings) > 0, headings), -1), F.lit(""))
