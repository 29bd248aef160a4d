"""What the operators must still see when the corpus grows or its mix changes."""

import itertools
import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from openings.llm import suffix_tree
from openings.llm.cotraining import features
from openings.llm.decontaminate import LEAST_TOKENS, MASKS, SHORT, SHORT_MASKS, find_leaks
from openings.llm.durable import BATCH, durable, shared_folder
from openings.llm.license_scan import scan_licenses
from openings.llm.suffix_tree import _bitmap, _may_be, language_model_scores
from openings.llm.words import cut_words, shingles


def test_suffix_tree_keeps_what_is_rare_in_a_large_corpus(spark):
    # 300,000 tokens of filler; "zeta" is followed by "omega" 9 times: a share of 3e-5, below the former p_context
    filler = spark.range(1, 3001).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 100), i -> concat('f', (id * 31 + i * i * 7) % 997))) AS text")
    rare = spark.createDataFrame([(10**6 + i, "zeta omega") for i in range(12)], "doc_id long, text string")
    got = [r for r in language_model_scores(filler.unionByName(rare)).filter("doc_id >= 1000000").collect()]
    trained = sum(not r.held_out for r in got)
    assert trained >= 8 and got[0].train_tokens * 4e-5 > trained
    # after "zeta" comes only "omega": the score is that of "zeta" and of what mu leaves, not of two rare words
    for r in got:
        assert r.score > r.base_score + 2


def test_licence_labels_do_not_depend_on_the_mix(spark):
    texts = ["Licensed under the MIT License", "Available under CC BY-NC"]
    common = ["mit freundlichen Gr\u00fcssen, licensed by nc", "released to the public"] * 20  # words of the templates in half of the documents
    for filler in ([], common):
        df = spark.createDataFrame(list(enumerate(texts + filler)), "doc_id long, text string")
        got = {r.doc_id: r.labels for r in scan_licenses(df).collect()}
        assert got[0] == "mit" and got[1] == "cc-by,cc-by-nc" and not any(got[i] for i in got if i > 1)


def test_masks_hit_every_allowed_overlap(spark):
    def missed(length, substituted, masks):
        gone = np.array(list(itertools.combinations(range(length), substituted)), int)
        same = np.ones((len(gone), length), bool)
        same[np.arange(len(gone))[:, None], gone] = False
        hit = np.zeros(len(gone), bool)
        for mask in masks:
            for start in range(length - mask[-1]):
                hit |= same[:, [start + p for p in mask]].all(axis=1)
        return same[~hit & same[:, 0] & same[:, -1]] if length < 13 else same[~hit]

    assert not any(len(missed(n, n // 5, MASKS)) for n in range(13, 27))
    short = [(n, length, k) for n in range(LEAST_TOKENS, 13) for length in (n - 1, n) for k in range(length // 5 + 1)]
    assert not any(len(missed(length, k, SHORT_MASKS if n < SHORT else MASKS)) for n, length, k in short)
    # one item of 13 tokens and all of its copies with two tokens substituted
    words = [f"w{i}" for i in range(13)]
    copies = [" ".join("other" if i in gone else w for i, w in enumerate(words)) for gone in itertools.combinations(range(1, 12), 2)]
    docs, items = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert find_leaks(docs, items).count() == len(copies)


def test_shingles_of_chunks_with_few_words():
    for n in range(9):
        for k in (1, 2, 3, 5, 7):
            (words,) = cut_words(pa.array([None, " ".join(f"w{i}" for i in range(n)), ""]))
            made, bounds = shingles(words, k)
            (longer,) = cut_words(pa.array([" ".join(f"w{i}" for i in range(n)), "a b c d e f g h i"]))
            assert list(np.diff(bounds)) == [0, n - k + 1 if n >= k else min(n, 1), 0]
            assert list(made) == list(shingles(longer, k)[0][: bounds[-1]])  # as beside other rows


def test_a_task_holds_few_temporary_bytes():
    # what the stages of the pipeline hold beside a batch, in every worker of an executor at once
    texts = pa.array(["some words of a text that goes on and on, " * 80] * 1200)
    names = pa.array(["web"] * 1200)
    tracemalloc.start()
    assert sum(len(text) for _, text, _ in features(texts, names, names)) == 1200
    assert sum(len(w.bounds) - 1 for w in cut_words(texts)) == 1200
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20


def test_a_written_table_leaves_no_shuffle_behind(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    durable(spark.range(1000).repartition(4, (F.col("id") % 7).alias("k")), "seven")
    deadline = time.time() + 10
    while files() > before and time.time() < deadline:
        time.sleep(0.1)
    assert files() <= before


def test_a_suffix_tree_leaves_only_its_tokens_tree_and_scores(spark):
    import os

    before = set(os.listdir(shared_folder(spark)))
    df = spark.createDataFrame([(i, "a b c d a b c e " * 9) for i in range(40)], "doc_id long, text string")
    assert language_model_scores(df).count() == 40
    assert sorted(n.split("-")[0] for n in set(os.listdir(shared_folder(spark))) - before) == ["scored", "tokens", "tree"]


def test_bitmap_of_grams_passes_few_others(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) * np.uint64(2)
    bits = _bitmap(spark.createDataFrame(pa.table({"key": keys.view(np.int64)})))
    assert _may_be(bits, keys).all()
    assert _may_be(bits, rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) * np.uint64(2)).mean() < 1e-3


def test_a_durable_write_gives_python_whole_texts_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    texts = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 4096) AS text")
    before = spark.conf.get(BATCH)
    got = durable(texts.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) < 8 << 20
    assert spark.conf.get(BATCH) == before


def test_suffix_tree_leaves_no_broadcast_behind(spark):
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    docs = spark.range(1, 200).selectExpr("id AS doc_id", "concat('a b c d ', id % 7) AS text")
    assert language_model_scores(docs).count() == 199
    assert not [f for f in set(os.listdir(folder)) - before if os.path.getsize(f"{folder}/{f}") > 1 << 20]


def test_frequent_grams_up_to_a_number_are_broadcast(spark, monkeypatch):
    values = spark.createDataFrame([(1,)] * 50 + [(2,)] * 30 + [(3,)] * 15 + [(9,)] * 5, "n long")
    for hot, most, least in ((100, 9, 1), (60, 9, 2), (20, 9, 3), (19, 9, 9), (4, 9, 9), (4, 3, 3), (1000, 3, 1)):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        assert suffix_tree._hot_count(values, most) == least
    docs = spark.range(1, 300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', (id * 31 + i * i) % 61))) AS text")
    scores = []
    for hot in (0, 1 << 20):  # all grams joined (but those of the least share), or all broadcast
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        tree, root = suffix_tree.learn(docs.select("text"))
        scores.append({r.doc_id: r for r in suffix_tree.score_texts(docs, tree, root, p_hot=1.0 if not hot else 2e-7).collect()})
    for a, b in ((scores[0][i], scores[1][i]) for i in range(1, 300)):
        assert (a.n_tokens, a.n_known) == (b.n_tokens, b.n_known) == (41, 41) and abs(a.score - b.score) < 1e-6 and abs(a.base_score - b.base_score) < 1e-6
