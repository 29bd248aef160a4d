import random
import re

import numpy as np

from openings.llm import cover_tree
from openings.llm.bitmaps import bitmap, may_be, size_for
from openings.llm.cover_tree import LEAF, NONE, QUERY_LEAF, build_tree, dual_search, make_cell, top_k
from openings.llm.decontaminate import LEAST_TOKENS, MASKS, SHORT, SHORT_MASKS, _best_stretch, decontaminate, find_leaks


def brute_top(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    x = np.floor(256 * np.array([v for _, v in vectors], np.float64)).astype(np.int64)
    out = []
    for qi, qv in queries:
        s = x @ np.floor(256 * np.array(qv, np.float64)).astype(np.int64)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != qi][:k]
        out += [(qi, rank + 1, int(ids[j]), int(s[j])) for rank, j in enumerate(order)]
    return sorted(out)


def test_tree_covers_its_points():
    x = np.random.default_rng(1).standard_normal((700, 6))
    root, order = build_tree(x)
    assert sorted(order) == list(range(700))
    todo = [root]
    while todo:
        n = todo.pop()
        assert np.sqrt(((x[order[n.start : n.end]] - n.centre) ** 2).sum(axis=1)).max() <= n.radius + 1e-9
        assert not n.children or (n.children[0].start, n.children[-1].end) == (n.start, n.end)
        todo += n.children


def test_dual_search_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 8)) * 400
    d = np.round(centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 8)) * 4).astype(np.int64)
    q = d[::30]
    ids = np.arange(0, 3000, 30)
    full = q @ d.T
    full[np.arange(100), ids] = NONE
    for kind in (np.float64, np.int64):
        s, _, scored = dual_search(make_cell(q.astype(kind), ids, QUERY_LEAF), make_cell(d.astype(kind), np.arange(3000), LEAF), 5, np.full(100, NONE))
        assert (s == -np.sort(-full, axis=1)[:, :5]).all()
        assert scored < 0.6 * full.size


def test_dual_search_scores_leaves_in_blocks(monkeypatch):
    # nearly random vectors, which no bound excludes: products must be few and large; many ties, so that ids decide
    rng, calls = np.random.default_rng(6), []
    d = np.floor(rng.standard_normal((2048, 32)) * 2)
    q, ids, names = d[::8], np.arange(0, 2048, 8), rng.permutation(2048)
    full = q @ d.T
    full[np.arange(256), ids] = NONE
    order = np.array([np.lexsort((names, -row))[:5] for row in full])
    offer = cover_tree._offer
    monkeypatch.setattr(cover_tree, "_offer", lambda *a: (calls.append(a[3].size), offer(*a)))
    s, i, scored = dual_search(make_cell(q, names[ids], QUERY_LEAF), make_cell(d, names, LEAF), 5, np.full(256, NONE))
    assert (i == names[order]).all() and (s == np.take_along_axis(full, order, axis=1)).all()
    assert scored == sum(calls) and len(calls) * 400 < scored


def test_top_k(spark):
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    vectors += [(1000, vectors[0][1]), (1001, vectors[0][1])]  # ties
    rows = [(i, v, "x", 1) for i, v in vectors]
    extra = [(2000, None, "x", 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1), (2002, [float("nan")] * 6, "x", 1), (2003, [float("inf")] * 6, "x", 1), (None, [9.0] * 6, "x", 1), (5, vectors[5][1], "x", 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, score string, rank int")
    queries = df.filter("vec_id % 50 = 0")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, queries, region=64).collect())
    assert got == brute_top(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    odd = df.unionByName(spark.createDataFrame([(3000, [], "x", 1), (3050, [1.0, 2.0], "x", 1), (3100, [], "x", 1)], df.schema))
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(odd, odd.filter("vec_id % 50 = 0"), region=64).collect()) == got
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(150)], "vec_id long, embedding array<double>")
    assert {(x.query_id, x.vec_id) for x in top_k(same, same.filter("vec_id = 0"), region=20).collect()} == {(0, i) for i in range(1, 6)}
    large = spark.createDataFrame([(i, [(2.0**28 + i) * (-1) ** j for j in range(3)]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {x.score for x in top_k(large, large.filter("vec_id = 0"), k=1, scale=1).collect()} == {3 * 2**28 * (2**28 + 19)}
    # a vector whose scores needn't fit 64 bits takes no part, and leaves the others alone
    beyond = df.unionByName(spark.createDataFrame([(5000, [1e12] * 6, "x", 1)], df.schema))
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(beyond, queries, region=64).collect()) == got
    few = df.filter("vec_id IN (0, 1000)")
    assert [(x.query_id, x.vec_id) for x in top_k(few, few).orderBy("query_id").collect()] == [(0, 1000), (1000, 0)]
    assert top_k(df.filter("false"), queries).count() == 0 and top_k(df, df.filter("false")).count() == 0


def test_best_stretch():
    same = np.array([0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 1], bool)
    assert _best_stretch(same, [2], 0.8) == (1, 9, 8)
    assert _best_stretch(np.zeros(5, bool), [0], 0.8) is None


def plain_leaks(docs, items, least=13, identity=0.8):
    """The operator's definition in plain Python: all shifts, all stretches."""
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    best = {}
    for doc_id, text, *_ in docs:
        d = tokens(text)
        where = {}
        for i, w in enumerate(d):
            where.setdefault(w, []).append(i)
        for item_id, passage in items:
            t = tokens(passage)
            if len(t) < LEAST_TOKENS:
                continue
            masks = SHORT_MASKS if len(t) < SHORT else MASKS
            need = min(least, len(t) - (len(t) < least))
            for shift in {i - j for j, w in enumerate(t) for i in where.get(w, ())}:
                lo, hi = max(0, shift), min(len(d), shift + len(t))
                same = [d[i] == t[i - shift] for i in range(lo, hi)]
                seeds = {p for m in masks for p in range(len(same) - m[-1]) if all(same[p + q] for q in m)}
                found = [
                    (b - a + 1, -a, sum(same[a : b + 1])) for b in range(len(same)) if same[b] for a in range(b + 1)
                    if same[a] and any(a <= s <= b for s in seeds) and sum(same[a : b + 1]) + 1e-9 >= identity * (b - a + 1)
                ] if seeds else []
                if found and max(found)[0] >= need:
                    length, a, matched = max(found)
                    key, one = (doc_id, item_id), (matched, a - lo, length)
                    best[key] = max(best.get(key, one), one)
    return [(d, i, -a, length, matched, matched / len(tokens(dict(items)[i]))) for (d, i), (matched, a, length) in best.items()]


def test_leaks_of_long_items(spark):
    """Overlaps reach as far as the item does; a stretch of 300 tokens, cut in the middle, is found whole."""
    r = random.Random(8)
    text = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    long = text(300)
    spoilt = [f"x{i}" if 100 <= i < 150 or i % 11 == 3 else w for i, w in enumerate(long)]
    docs = [(1, " ".join([*text(40), *long, *text(70)])), (2, " ".join([*text(20), *spoilt, *text(9)])), (3, " ".join(long[250:] + text(90) + long[:60])), (4, " ".join(text(700)))]
    items = [(1, " ".join(long)), (2, " ".join(long[:12])), (3, " ".join(long[100:114]))]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_leaks(docs, items))
    assert (1, 1, 40, 300, 300, 1.0) in set(map(tuple, got))


def test_bitmaps(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000)
    made = bitmap(spark.createDataFrame([(int(k),) for k in keys[:5000]], "k long"), size_for(5000))
    hit = may_be(made, keys.view(np.uint64))
    assert hit[:5000].all() and hit[5000:].mean() < 0.005
    assert not may_be(bitmap(spark.createDataFrame([], "k long"), 20), keys.view(np.uint64)).any()


def test_leaks(spark):
    r = random.Random(5)
    vocabulary = ["v%d" % i for i in range(400)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(40)) for i in range(6)] + [(10, text(8)), (11, "too short"), (12, None), (13, "")]
    docs, planted = [], set()
    for i in range(60):
        words = text(150).split()
        if i % 4 == 0:
            item, passage = items[i // 4 % 7]
            passage = passage.split()
            if i % 8 == 0 and len(passage) > 20:  # every ninth word substituted
                passage = [f"other{j}" if j % 9 == 4 else w for j, w in enumerate(passage)]
            words[50:50] = [w.upper() + "," for w in passage]
            planted.add((i, item))
        docs.append((i, " ".join(words), 1, "z"))
    docs += [(100, None, 1, "z"), (101, "", 1, "z"), (None, items[0][1], 1, "z"), (102, text(60_000), 1, "z"), (4, docs[4][1], 1, "z")]
    schema = "doc_id long, text string, hash int, run string"
    df, bench = spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted | {(None, 0)}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_leaks(docs, items)))
    left = decontaminate(df, bench)
    assert left.columns == ["doc_id", "text", "hash", "run"]
    assert {x.doc_id for x in left.select("doc_id").collect()} == {i for i in range(60) if i % 4} | {100, 101, 102}
    assert find_leaks(df.filter("false"), bench).count() == 0 and find_leaks(df, bench.filter("false")).count() == 0
