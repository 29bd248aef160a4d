"""The pipeline's stages against plain versions of what they keep, and run() as their composition."""

import random

import corpus_pipeline
from openings.llm.cotraining import score_quality, train_quality

from test_minhash import brute
from test_search_and_leaks import plain_leaks


def test_stages_and_run(spark, tmp_path):
    r = random.Random(12)
    words = ["".join(r.choices("abcdeilnorst", k=r.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(r.choices(words, k=n)) + "."
    good = [(i, prose(r.randint(40, 90))) for i in range(150)]
    bad = [(200 + i, " ### ".join(r.choices(words, k=50))) for i in range(60)]
    items = [(i, prose(30)) for i in range(4)]
    copies = [(300 + i, good[i][1]) for i in range(6)] + [(310 + i, good[10 + i][1].replace(" ", " x ", 1)) for i in range(6)]
    leaks = [(330 + i, prose(30) + " " + items[i][1] + " " + prose(30)) for i in range(4)]
    leaks += [(340, prose(50) + " password = Zx9Zx8Zx7Zx6Q"), (341, prose(50) + " password = Zx9Zx8Zx7Zx6Q"), (342, prose(50) + " token: Qq1Ww2Ee3Rr4")]
    odd = [(350, "one two three"), (351, ""), (352, None)]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in good + bad + copies + leaks + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good[:110] + bad[:45]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "mixing"]
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert ids(kept) == sorted(x.doc_id for x in score_quality(docs, train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))).filter("keep").collect())
    clean = {i for i, _ in good}
    assert len(clean & set(ids(kept))) >= 0.97 * len(clean) and not set(ids(kept)) & {i for i, _ in bad[45:]}

    kept = kept.select(*docs.columns)
    own = [(x.doc_id, x.text) for x in kept.collect()]
    single = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert ids(single) == sorted(i for i, _, root in brute(own, 5, 80) if root == i)

    own = [(x.doc_id, x.text) for x in single.collect()]
    fresh = corpus_pipeline.benchmark(spark, single, sf)
    leaked = {d for d, *_ in plain_leaks(own, items)}
    assert ids(fresh) == sorted(i for i, _ in own if i not in leaked) and leaked == {330, 331, 332, 333} & {i for i, _ in own}

    before = {x.doc_id: x.text for x in fresh.collect()}
    masked = {x.doc_id: x for x in corpus_pipeline.secrets(spark, fresh, sf).collect()}
    assert set(masked) == set(before)
    for i, x in masked.items():
        # one value stands with two owners: an example; the other has one owner and goes
        expected = before[i].replace("token: Qq1Ww2Ee3Rr4", "[SECRET]") if before[i] else before[i]
        assert x.text == expected and x.n_chars == (None if x.text is None else len(x.text))

    mixed = corpus_pipeline.run(spark, sf).collect()
    sizes = {}
    for x in masked.values():
        sizes.setdefault(f"s{x.doc_id % 3}", []).append(len((x.text or "").split()))
    taken = {}
    for x in mixed:
        taken[x.source] = taken.get(x.source, 0) + x.words
        assert len(x.text.split()) == x.words and set(x.doc_ids) <= set(masked)
    assert abs(sum(taken.values()) - 1.5 * sum(map(sum, sizes.values()))) < 0.03 * sum(taken.values())
    assert all(taken[s] <= 2 * sum(own) for s, own in sizes.items())
