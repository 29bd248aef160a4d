"""Text functions: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands on either side of a whole word.  Unicode letters and digits, as a regular expression of Java and RE2 alike.
EDGE_BEFORE, EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"

# Company suffixes that identity ignores.
COMPANY_SUFFIXES = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "plc", "sa", "nv", "bv", "ag", "holding", "holdings", "group",
    "technologies", "technology", "labs", "the",
)
# Words that evidence matching ignores in company names.
EVIDENCE_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "corporation", "co", "company", "the", "group", "holdings", "international", "technologies", "technology",
    "solutions", "services",
)
# Words that title overlap ignores.
TITLE_STOP = ("the", "a", "an", "of", "and", "for", "in", "at", "to", "senior", "sr", "junior", "jr", "staff", "lead", "principal", "ii", "iii", "i")
# Decorations that title identity ignores.
TITLE_NOISE = ("remote", "us", "usa", "united states", "hybrid", "onsite", "full time", "fulltime", "ft")


def lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def squeeze(c: Column) -> Column:
    """Runs of blanks are one, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t ]+", " "))


def company_key(c: Column, suffixes: tuple[str, ...] = COMPANY_SUFFIXES) -> Column:
    """Identity of a company: lower case, words of a-z and 0-9, without suffixes; the plain words where nothing else is left."""
    plain = F.regexp_replace(lower(c), r"[^a-z0-9 ]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*suffixes))
    kept = F.array_join(words, " ")
    return F.when(kept != "", kept).otherwise(F.trim(plain))


def evidence_key(c: Column) -> Column:
    """A company as evidence names it: punctuation is blank, common suffixes go."""
    plain = F.regexp_replace(lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*EVIDENCE_SUFFIXES)), " ")


def title_key(c: Column, strict: bool = False) -> Column:
    """A normalized title: for identity (strict) bracketed words stay, for grouping they go."""
    t = lower(c)
    if not strict:
        t = F.regexp_replace(t, r"\(.*?\)", " ")
    t = F.regexp_replace(t, r"[^a-z0-9 ]", " ")
    t = F.regexp_replace(t, r"\b(" + "|".join(TITLE_NOISE) + r")\b", " ")
    return squeeze(t)


def title_tokens(c: Column) -> Column:
    """The set of a title's words but for filler."""
    return F.filter(F.array_distinct(F.regexp_extract_all(lower(c), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: ~w.isin(*TITLE_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members as a share of all; 0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def contains_all_tokens(title: Column, term: Column) -> Column:
    """All meaningful words of the term stand in the title (false for a term without any)."""
    words = title_tokens(term)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(title_tokens(title), w))


# The named character references that boards use.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&bull;", "•"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&amp;", "&"),
)


def unescape(c: Column) -> Column:
    """The usual character references; & last, so that one call decodes one level."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment: two levels of references, line ends for paragraphs and breaks, dashes for list items."""
    s = unescape(unescape(F.coalesce(c, F.lit(""))))
    for tag in ("</p>", "<br>", "<br/>", "<br />", "</li>"):
        s = F.replace(s, F.lit(tag), F.lit("\n"))
    s = F.replace(s, F.lit("<li>"), F.lit(" - "))
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.regexp_replace(F.replace(s, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sections(*parts: tuple[str, Column]) -> Column:
    """Headed sections, one blank line between; sections without text go."""
    made = [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{h}\n" if h else ""), F.trim(c))) for h, c in parts]
    return F.concat_ws("\n\n", *made)


def percent(n: Column, d: Column) -> Column:
    """100 n / d to one decimal (half up); null where d is 0."""
    return F.round(F.try_divide(F.lit(100).cast("double") * n, d), 1)


def sanitize(c: Column, limit: int = 500) -> Column:
    """Outside text in one safe line: no control or format characters, blanks squeezed, Markdown marks as references."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\p{Cc}\s]+", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\p{Cf}", ""), " +", " "))
    s = F.substring(s, 1, limit)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("`", "&#96;"), ("*", "&#42;"), ("_", "&#95;"), ("[", "&#91;"), ("]", "&#93;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


def formula_guard(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(c.rlike(r"^[\s\p{Cc}]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def reason_label(c: Column, limit: int = 60) -> Column:
    """What a reason says before its first colon, cut with an ellipsis."""
    head = F.trim(F.substring_index(c, ":", 1))
    return F.when(F.length(head) > limit, F.concat(F.substring(head, 1, limit), F.lit("…"))).otherwise(head)


def slug_candidates(name: Column) -> Column:
    """Board slugs that a company's name suggests: joined, hyphenated, initials of more than two words; in that order, once each."""
    words = F.filter(F.split(F.regexp_replace(lower(name), r"[^a-z0-9 ]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*COMPANY_SUFFIXES))
    initials = F.when(F.size(words) > 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    made = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.coalesce(initials, F.lit("")))
    return F.filter(F.array_distinct(made), lambda s: F.length(s) >= 2)


def sentences(c: Column, least_words: int = 3) -> Column:
    """Sentences of a draft, in order, of at least so many words: no Markdown furniture before a line, no fences.

    A sentence ends at . ! or ? before white space and a capital (A-Z), quote or bracket.
    """
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: bare(F.regexp_replace(bare(x), r"^[-*#>]+", "")))
    split = F.flatten(F.transform(F.filter(lines, lambda x: ~x.startswith("```")), lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z\"'(])")))
    return F.filter(F.transform(split, bare), lambda s: F.regexp_count(s, F.lit(r"\S+")) >= least_words)


def scorable_text(title: Column, location: Column, department: Column, description: Column) -> Column:
    """What the rails read: title, location, department and description, a line each."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title, location, department, description)])
