"""Source divergence, exact duplicates by content sort, vector codes: against plain versions on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from openings.llm.content_sort import exact_groups, keep_first
from openings.llm.divergence import BILLION, packed, radix_order, source_divergences
from openings.llm.vector_codes import Codebook, books_digest, compress, decode, encode, train_codebooks


# ---------------------------------------------------------------- content sort

SORTED = "doc_id long, text string, keep_id string, body int"


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def copies():
    rng = random.Random(5)
    rows = [(i, rng.choice(["a  b", "a\tb", "a b ", "a b", "", None, " ", "A b", "é x", "x" * 5]), None, 1) for i in range(300)]
    rows += [(1000 + i, "hot   copy \n of one text", None, 2) for i in range(400)]
    rows += [(None, "hot copy of one text", None, 2)] * 30 + [(None, "nobody's", None, 2)] * 3
    rows += [(7, "twice", None, 0)] * 2 + [(2000, "long " * 60000, "x", 1), (1999, "long  " * 60000, "y", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least_bytes", [1 << 20, 300])
def test_content_sort_equals_plain_groups(spark, least_bytes):
    rows = copies()
    df = spark.createDataFrame(rows, SORTED).repartition(5)
    got = [tuple(r) for r in exact_groups(df, least_bytes=least_bytes).collect()]
    assert sorted(got, key=str) == plain_groups(rows)
    assert exact_groups(df.limit(0), least_bytes=least_bytes).collect() == []


@pytest.mark.parametrize("least_bytes", [1 << 20, 300])
def test_keep_first_leaves_one_whole_row_a_text(spark, least_bytes):
    rows = copies()
    df = spark.createDataFrame(rows, SORTED).repartition(5)
    got = keep_first(df, least_bytes=least_bytes)
    assert got.columns == df.columns
    want = Counter(r[0] for r in plain_groups(rows) if r[3])
    assert Counter(r.doc_id for r in got.collect()) == want
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_content_sort_shuffles_texts_once_by_range(spark):
    df = spark.createDataFrame(copies(), SORTED)
    plan = exact_groups(df, least_bytes=1 << 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "SinglePartition" not in plan
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------- source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_divergences(rows, least_docs, top):
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (l, t), n in docs.items() if l == lang and n >= least_docs]
        totals = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        all_count = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        v = len(kept)
        p = {s: {t: 1 + BILLION * (count[lang, s, t] + 2) // (totals[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + BILLION * (all_count[t] + 2) // (sum(totals.values()) + 2 * v) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -value, i + 1) for i, (value, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s, t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -value, i + 1) for i, (value, t) in enumerate(terms[:top])]
    return sorted(out)


def audited(n=260):
    rng = random.Random(3)
    words = ["Alpha", "beta", "über", "exactly8", "ninechars", "sixteencharsword", "seventeencharword", "x" * 40, "y" * 300, "中文" * 9, "a", "é"]
    rows = []
    for i in range(n):
        text = " 1-2_".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", "hot", None, "é"]), i))
    rows += [("word " * 50000 + "exactly8", "en", "hot", 0), (None, "xx", "only", 0), ("few words", "yy", "p", 0), (None, "yy", "q", 0)]
    return rows + rows[:20]


@pytest.mark.parametrize("least_docs, top", [(1, 3), (10, 10)])
def test_divergences_equal_plain_ones(spark, least_docs, top):
    rows = audited()
    df = spark.createDataFrame(rows, "text string, lang string, source string, value int").repartition(6)
    got = sorted(tuple(r) for r in source_divergences(df, least_docs=least_docs, top=top).collect())
    assert got == plain_divergences([r[:3] for r in rows], least_docs, top)
    assert source_divergences(df.limit(0)).collect() == []


def test_divergences_of_many_sources_in_tiles_and_blocks(spark, monkeypatch):
    from openings.llm import divergence

    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "BLOCK", 32)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["k", "l", "m", "n", "o"]) * rng.randint(1, 20) for _ in range(9)), "en", f"s{rng.randint(0, 10)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in source_divergences(df, least_docs=2).collect()) == plain_divergences(rows, 2, 10)


def test_radix_order_and_packing():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 4000).astype(np.uint64), rng.integers(0, 1 << 63, 4000, dtype=np.uint64) >> np.uint64(50)
    assert (radix_order([a, b]) == np.lexsort((b, a))).all()
    terms = [b"a", b"ab", b"exactly8", b"ninebytes", b"sixteenbytesword"]
    data = np.frombuffer(b" ".join(terms), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in terms]) - 1
    starts = ends - [len(t) for t in terms]
    for words in (1, 2):
        own = [i for i, t in enumerate(terms) if len(t) <= 8 * words]
        made = packed(data, starts[own], ends[own], words)
        assert [b"".join(int(w[i]).to_bytes(8, "big") for w in made).rstrip(b"\0") for i in range(len(own))] == [terms[i] for i in own]


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label string, code int"


def plain_codes(rows, rounds=4, entries=256):
    rows = [r for r in rows if r[1] is not None and len(r[1]) == 8 and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows]
    books = [[w[2 * p : 2 * p + 2] for w in whole[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for w in whole:
                own[near(w[2 * p : 2 * p + 2], book)[1]].append(w[2 * p : 2 * p + 2])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(book)]
    out, by_label = [], Counter()
    for r, w in zip(rows, whole, strict=True):
        found = [near(w[2 * p : 2 * p + 2], books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        by_label[r[2]] += error
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*o[:3], by_label[o[3]], digest) for o in out), key=str)


def vectors(n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.25, -3.0]) for _ in range(8)], rng.choice(["a", "b", None]), 5) for i in range(n)]
    bad = [None, [], [1.0] * 7, [1.0] * 12, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] * 8, [-float("inf")] + [0.0] * 7, [1e30] + [0.0] * 7]
    rows += [(10**6 + i, b, "a", 1) for i, b in enumerate(bad)]
    return rows + [(None, [0.5] * 8, "b", 1)] * 2 + rows[:3]


@pytest.mark.parametrize("n", [5, 700])
def test_codes_equal_plain_ones(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted((tuple(r) for r in compress(df).collect()), key=str)
    assert got == plain_codes(rows)
    assert compress(df.limit(0)).collect() == [] and compress(df.filter("embedding IS NULL")).collect() == []


def test_codes_decode_to_their_error(spark):
    rows = [r for r in vectors(400) if r[1] is not None and len(r[1]) == 8 and r[0] is not None and r[0] < 400]
    df = spark.createDataFrame(rows, VECTORS).select("vec_id", "embedding", "label").withColumnRenamed("embedding", "vec")
    books = train_codebooks(df.select("vec_id", "vec"), 8, 1024)
    assert len(books_digest(books)) == 64
    for r in encode(df.selectExpr("vec_id", "vec", "vec AS other"), books, 1024).collect():
        whole = np.floor(1024 * np.array(r.other, np.float64)).astype(np.int64)
        assert int(((whole - decode(r.code, books)) ** 2).sum()) == r.error


def test_boxes_hold_the_nearest_entry_whatever_the_radius():
    rng = np.random.default_rng(2)
    for n, dims, spread in ((256, 16, 300), (256, 3, 40), (1, 5, 9), (70, 4, 2), (200, 2, 1 << 26)):
        book = Codebook(rng.integers(-spread, spread, (n, dims)))
        x = rng.integers(-2 * spread, 2 * spread, (500, dims))
        every = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
        for radius in (1, spread // 3, 100 * spread):
            entry, far = book.nearest(x, radius)
            assert (entry == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
        inside = book.members(book.box(x, np.full(len(x), spread // 3 + 1)))
        assert (inside == (np.abs(x[:, None, :] - book.entries[None]) <= spread // 3 + 1).all(axis=2)).all()
    # clustered entries: a box holds few of them
    book = Codebook(np.repeat(rng.integers(-10000, 10000, (16, 8)), 16, axis=0) + rng.integers(-20, 20, (256, 8)))
    x = book.entries + rng.integers(-5, 5, book.entries.shape)
    assert book.members(book.box(x, np.full(256, book.first_radius(x)))).mean() < 0.1
