import random

import numpy as np
import pyarrow as pa
import pytest

from openings.llm.components import components
from openings.llm.minhash import bands_for, keep_one, least_matches, near_duplicates
from openings.llm.words import NOT_ALNUM, cut_words, shingles

SCHEMA = "doc_id long, text string, component_id long, node string, sign string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA)


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (id_, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((id_, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_words_and_shingles():
    texts = pa.array(["The cat\tsat  on", "", None, "x", " lead the CAT ", "étre É\x0b\x85z", "x" * 9000 + " y"])
    got = []
    for w in cut_words(texts):
        got += [[bytes(w.data[a:b]) for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])] for lo, hi in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [(t or "").encode().lower().split() if "É" not in (t or "") else ["étre".encode(), "É".encode(), "\x85z".encode()] for t in texts.to_pylist()]
    w = next(cut_words(pa.array(["a b c", "a", "b c", ""])))
    s, bounds = shingles(w, 2)
    assert list(bounds) == [0, 2, 3, 4, 4]
    assert s[1] == s[3] and len(set(s.tolist())) == 3
    alnum = next(cut_words(pa.array(["It's 2-fold, ÉTÉ!"]), NOT_ALNUM))
    assert len(alnum.hashes) == 5


def test_parameters():
    assert (1 - 0.8**6) ** bands_for(0.8, 1e-4) <= 1e-4
    steps = least_matches(0.8, 1e-4, 192)
    assert [n for n, _ in steps] == [32, 64, 96, 128, 160, 192] and all(m < n * 0.8 for n, m in steps)


@pytest.mark.parametrize("k", [2, 5])
def test_same_as_brute_force(spark, k):
    r = random.Random(k)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = []
    for base in range(12):
        words = r.choices(vocabulary, k=r.randint(20, 120))
        for _ in range(r.randint(1, 6)):
            copy = list(words)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(3, None), (2, ""), (1, " \t "), (200, "one"), (201, "One"), (202, "one two"), (rows[0][0], rows[0][1]), (rows[0][0], "quite other words stand here now"), (None, rows[5][1]), (None, "nothing like it at all")]
    r.shuffle(rows)
    got = near_duplicates(frame(spark, rows), k=k).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute(rows, k, 80)
    assert all(x.kept == (x.doc_id is not None and x.doc_id == x.component_id) for x in got)


def test_a_large_group_that_its_first_member_does_not_link(spark):
    """A chain: neighbours link, the ends don't; all are one component."""
    words = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(40)]
    got = near_duplicates(frame(spark, rows), k=2).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute(rows, 2, 80)


@pytest.mark.parametrize("bridge", [None, 9])
def test_a_row_without_an_id_links_others(spark, bridge):
    words = ["w%d" % i for i in range(300)]
    part = lambda a, b: " ".join(words[a:b])
    rows = [(1, part(0, 100)), (bridge, part(8, 108)), (2, part(16, 116)), (None, part(150, 250)), (None, part(152, 252)), (None, None)]
    got = near_duplicates(frame(spark, rows), k=2).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute(rows, 2, 80)
    assert {x.component_id for x in got if x.doc_id in (1, 2)} == {1}


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = [f"v{r.randrange(10**6)}" for _ in range(400_000)]
    rows = [(3, " ".join(long)), (2, " ".join(long[:399_000])), (1, " ".join(reversed(long)))]
    got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows), k=2).collect()}
    assert got == {3: 2, 2: 2, 1: 1}


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_keep_one(spark):
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(5, long), (4, long), (4, long), (9, "alone here"), (None, "no id"), (8, None)]
    kept = keep_one(frame(spark, rows))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["4", "8", "9", "None"]
    assert kept.columns == ["doc_id", "text", "component_id", "node", "sign"]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (50, 51), (52, 51), (None, 3)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert np.all(True)
