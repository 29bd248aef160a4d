"""Secret scans with corpus-wide ownership frequency.

Candidates are found with regular expressions; every candidate's hash is then
counted over the corpus by distinct repositories and owners.  A value that
several owners hold is a widely copied example; a value of one owner that
looks like a credential is live-looking.  DataFrame functions only.

Only texts with a candidate are taken beyond the scan; their matches are
placed by window sums of the text lengths between matches, so that a text with
many matches costs in proportion to them.  The candidates (no texts) are written
once, then counted and joined with their counts.  Counting is by (hash, owner,
repository) first, so a value in a third of all rows arrives as one row a task;
the join with one row a value is one that AQE splits where a value is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that is the secret value, and the shortest value or match."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: In this order for spans that start at one place.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27, base=False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 34, base=False),
    Kind("url", r"://[^\s:/@]{1,64}:([^\s:/@]{6,})@", 1, 6, base=False),
)

#: Values with these in them are placeholders whoever owns them.
PLACEHOLDER = r"(?i)example|changeme|placeholder|your_|dummy|xxxx|(.)\1{7,}|^(0123|1234|abcd)"


def _matches(text: Column, kind: Kind) -> Column:
    """All matches of one kind in order: (gap before, match, value)."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    made = F.transform(
        parts,
        lambda p, i: F.struct(
            F.lit(kind.name).alias("kind"), i.alias("i"), F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), p["value"].alias("value")
        ),
    )
    nothing = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(kind.pattern), F.filter(made, lambda p: p["size"].isNotNull())).otherwise(nothing)


def _key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """One row a candidate of each distinct (id, text): id, text_key, kind, base, start, end, owners, repositories, verdict.

    Places are code points, end exclusive.  Matches of a kind are leftmost and
    don't overlap; those that are too short are dropped.  verdict: "example"
    where `owners` > 1 or the value is a placeholder, "live" where one owner
    has it and it mixes letters and digits, else "weak".  Rows that repeat
    both id and text count once here (their owners all count).
    """
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in repository_cols])
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\x1e")).alias("owner"),
        repo.alias("repository"),
    )
    # a native filter first: only texts with a candidate go on
    rows = rows.filter(F.col("text").rlike("|".join(f"(?:{k.pattern})" for k in KINDS)))
    found = rows.select("id", "owner", "repository", _key(F.col("text")).alias("text_key"), F.flatten(F.array(*[_matches(F.col("text"), k) for k in KINDS])).alias("m"))
    exploded = found.select("id", "owner", "repository", "text_key", F.explode("m").alias("m")).select("id", "owner", "repository", "text_key", "m.*").distinct()
    before = Window.partitionBy("id", "text_key", "owner", "repository", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    least = F.coalesce(*[F.when(F.col("kind") == k.name, F.lit(k.least)) for k in KINDS])
    measured = F.when(F.col("kind").isin([k.name for k in KINDS if k.group]), F.length("value")).otherwise(F.col("size"))
    spans = (
        exploded.withColumn("end", end)
        .filter(measured >= least)
        .select(
            "id", "owner", "repository", "text_key", "kind", (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"),
            F.sha2("value", 256).alias("value_hash"),
            F.col("value").rlike(PLACEHOLDER).alias("placeholder"),
            (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).alias("mixed"),
        )
    )
    spans = durable(spans, "candidates")
    counts = (
        spans.select("value_hash", "owner", "repository").distinct()
        .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    )
    verdict = F.when((F.col("owners") > 1) | F.col("placeholder"), "example").when(F.col("mixed"), "live").otherwise("weak")
    return (
        spans.drop("owner", "repository").distinct()
        .join(counts, "value_hash")
        .select("id", "text_key", "kind", F.col("kind").isin([k.name for k in KINDS if k.base]).alias("base"), "start", "end", "owners", "repositories", verdict.alias("verdict"))
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """One row a row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    spans: kind:start:end of all candidates by start, then kind as in KINDS,
    comma-joined; base_sha256: lowercase hex SHA-256 of the base kinds' part of
    it.  found: the candidates with their counts and verdicts (null if none).
    Null and empty texts have no candidates; null ids, owners and repositories
    are values of their own; other columns aren't read; an empty table gives
    an empty result.
    """
    place = F.coalesce(*[F.when(F.col("kind") == k.name, F.lit(i)) for i, k in enumerate(KINDS)])
    each = secret_spans(docs, id_col, text_col, owner_col, repository_cols)
    joined = each.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end", "base", "owners", "repositories", "verdict"))).alias("found")
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).alias("row_id"), _key(text).alias("row_key"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    nothing = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint,base:boolean,owners:bigint,repositories:bigint,verdict:string>>")
    found = F.coalesce(F.col("found"), nothing)
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    return every.join(joined, every["row_id"].eqNullSafe(joined["id"]) & (every["row_key"] == joined["text_key"]), "left").select(
        F.col("row_id").cast("long").alias("doc_id"),
        count(lambda s: s["kind"] == "assign").alias("n_assign"),
        count(lambda s: s["kind"] == "access").alias("n_access"),
        count(lambda s: s["kind"] == "hex").alias("n_hex"),
        F.sha2(shown(F.filter(found, lambda s: s["base"])), 256).alias("base_sha256"),
        shown(found).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
        "found",
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs, with every candidate but widely copied examples replaced by `mark`; no row goes.

    Overlapping spans (one value found as two kinds) are replaced as one.
    Options are those of scan_secrets; all columns of docs stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    each = secret_spans(docs, **options).filter("verdict <> 'example'")
    cuts = each.groupBy("id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = lambda a, s: F.when(
        s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    ).otherwise(F.struct(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at")))
    done = F.aggregate("cuts", state, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    keyed = docs.withColumn("openings_key", _key(text))
    return (
        keyed.join(cuts, keyed[id_col].eqNullSafe(cuts["id"]) & (keyed["openings_key"] == cuts["text_key"]), "left")
        .select(*[F.when(F.col("cuts").isNull(), F.col(text_col)).otherwise(done).alias(c) if c == text_col else keyed[c] for c in docs.columns])
    )
