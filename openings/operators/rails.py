"""Rails that read a posting's words in context: denials, requirements, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.frames import settle

# Fixed values, all of what follows up to DEADLINE: phrases of the rails.
CLEARANCE = (
    r"(?i)\(cleared\)|\b(active|current)\s+(ts/?\s?sci|top secret|secret)\b|\b(secret|ts/?\s?sci|top.secret)\b.{0,15}\bclearance\b|"
    r"\bsecurity clearance\b.{0,40}\b(required|must)\b|\bmust\b.{0,50}\bsecurity clearance\b|\b(obtain|acquire|attain)\b.{0,60}\bclearance\b|\bdoes not hold dual citizenship\b"
)
QUOTA = (
    r"(?i)\b(sales quota|carry a quota|quota.?carrying|revenue (target|quota|number)|book of business|new logo|upsell target|cross.?sell target|"
    r"own(ing|s)? (the )?(renewal|expansion|revenue) (target|number|quota)|achieve (annual |quarterly )?(sales|revenue) target|commission plan|"
    r"pipeline generation|prospecting|net new business)\b"
)
REQUIREMENT = (
    r"(?i)\d\+? ?years?|require[sd]?|must have|deep (knowledge|expertise)|speciali[sz]|expert(ise)? in|proficien|"
    r"\b(led|delivered|implemented|owned|shipped)\b.{0,40}?\b(at least|a minimum of|minimum of|\d+\+?)\b|\bat least \d+\b|\ba minimum of \d+\b"
)
ENUMERATION = r"(?i)\b(including|include[sd]?|such as|like|e\.?g\.?|for example|ranging from)\b"
LIST_ITEM = r"(?i)(,|;|/|&|\band\b|\bor\b)\s*$"
REQUIREMENT_HEADING = r"(?i)\b(requirements?|required|qualifications?|must[- ]haves?|what (you'?ll |you )?(need|bring)|skills? (and|&) (experience|certifications?))\b"
SHALLOW = r"(?i)\b(familiar(ity)?|working knowledge|exposure to|awareness of|some experience|basic (understanding|knowledge)|comfortable with)\b"
PREFERENCE = r"(?i)\b(preferred|preferable|nice[ -]to[ -]have|a plus|bonus|desirable|not required|but not required|advantageous|ideally|would be great)\b"
OPTIONAL = r"(?i)\b(preferred|nice[ -]to[ -]have|a plus|bonus|not required|desirable|ideally)\b"
DEADLINE = (
    r"(?i)\b(?:apply(?:\s+no\s+later\s+than)?\s+by|application\s+deadline(?:\s+is)?|posting\s+closes?(?:\s+on)?|position\s+closes?(?:\s+on)?|"
    r"accept(?:ing)?\s+(?:applications|applicants)\s+until|applications?\s+(?:will\s+be\s+)?accepted\s+(?:until|through))\s*[:\-]?\s*"
    r"([A-Za-z]{3,9}\s+\d{1,2}(?:st|nd|rd|th)?(?:,\s*|\s+)\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
)
DATE_FORMATS = ("MMMM d yyyy", "MMM d yyyy", "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "M/d/yy")


def denied_rails(postings: DataFrame, rails: dict[str, str], text_col: str = "description") -> DataFrame:
    """postings with rail and quote of the first rail (in order) that has a match which its sentence doesn't deny; null where none has."""
    text = F.coalesce(text_col, F.lit(""))
    hits = {f"hit_{i}": spans.rail_hit(text, p) for i, p in enumerate(rails.values())}
    found = settle(postings, **hits)
    first = F.coalesce(*[F.when(F.col(h).isNotNull(), F.struct(F.lit(label).alias("rail"), spans.sentence_around(text, F.col(h)).alias("quote"))) for h, label in zip(hits, rails, strict=True)])
    return settle(found, first_=first).select(*postings.columns, F.col("first_.rail").alias("rail"), F.col("first_.quote").alias("quote"))


def requires_product(text: Column, product: str) -> Column:
    """The first span of `product` that the text demands (null if none).

    Demanded: a requirement stands before it in its clause, or its section's
    heading is one and the clause isn't shallow; and nothing makes it optional,
    one of an enumeration after the requirement, or one of a list.
    """

    def demanded(s: Column) -> Column:
        clause, heading = spans.clause_before(text, s), spans.governing_heading(text, s)
        optional = spans.sentence_around(text, s).rlike(PREFERENCE) | heading.rlike(PREFERENCE)
        inline = clause.rlike(REQUIREMENT)
        by_heading = ~inline & (heading.rlike(REQUIREMENT) | heading.rlike(REQUIREMENT_HEADING)) & ~clause.rlike(SHALLOW)
        after = F.element_at(F.split(clause, REQUIREMENT, -1), -1)
        listed = F.substring(clause, -24, 24).rlike(LIST_ITEM)
        return ~optional & ((inline & ~after.rlike(ENUMERATION)) | by_heading) & ~listed

    return F.get(F.when(text.rlike(product), F.filter(spans.spans(text, product), demanded)), F.lit(0))


def hard_requirements(description: Column, patterns: dict[str, str]) -> Column:
    """array of struct(label, sentence): gates named in the requirements section and not called optional there."""
    return gates(spans.requirements_section(F.coalesce(description, F.lit(""))), patterns)


def gates(section: Column, patterns: dict[str, str]) -> Column:
    """hard_requirements of a requirements section, best a column that was settled: it is read many times."""

    def gate(label: str, pattern: str) -> Column:
        s = F.get(spans.spans(section, pattern), F.lit(0))
        head = spans.after_last(spans.before(section, s), ".\n")
        tail = F.regexp_extract(F.substring(section, s["end"] + 1, F.length(section)), r"^[^\n]*", 0)
        sentence = F.substring(F.trim(F.regexp_replace(F.concat(head, s["match"], tail), r"\s+", " ")), 1, 180)
        return F.when(section.rlike(pattern) & ~sentence.rlike(OPTIONAL), F.struct(F.lit(label).alias("label"), sentence.alias("sentence")))

    return F.array_compact(F.array(*[gate(label, p) for label, p in patterns.items()]))


def deadline(text: Column) -> Column:
    """The earliest application deadline that a text states, as a date (null if none; other dates never count)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DEADLINE), F.lit(1))

    def day(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[,\s]+", " ")
        plain = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 100)))
        return F.coalesce(*[F.when(plain.rlike(_shape(f)), F.try_to_date(plain, f)) for f in DATE_FORMATS])

    return F.array_min(F.transform(raw, day))


def _shape(pattern: str) -> str:
    """What a date of a format looks like, so that no parser sees another's text."""
    return {
        "MMMM d yyyy": r"^(January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2} \d{4}$", "MMM d yyyy": r"^[A-Z][a-z]{2} \d{1,2} \d{4}$", "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
        "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    }[pattern]


def fetch_needed(description: Column, most: int = 6000) -> Column:
    """A stored text without a requirements section, and not so long that requirements are likely in its prose."""
    d = F.coalesce(description, F.lit(""))
    return ~d.rlike(spans.REQUIREMENTS_HEADING) & (F.length(d) <= most)


def jsonld_description(page: Column) -> Column:
    """The description of the first schema.org JobPosting that a page embeds ("" if none)."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    nodes = F.flatten(F.transform(found, lambda x: F.coalesce(F.when(F.trim(x).startswith("["), F.from_json(F.trim(x), "array<string>")), F.array(F.trim(x)))))
    jobs = F.filter(nodes, lambda n: F.get_json_object(n, "$['@type']").contains("JobPosting") & (F.coalesce(F.get_json_object(n, "$.description"), F.lit("")) != ""))
    raw = F.get_json_object(F.get(jobs, F.lit(0)), "$.description")
    from ..functions.text import unescape

    text = F.regexp_replace(raw, r"<(br|/p|/li|/div|/h\d)[^>]*>", "\n")
    text = unescape(F.regexp_replace(F.regexp_replace(text, r"<li[^>]*>", "  - "), r"<[^>]+>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))
