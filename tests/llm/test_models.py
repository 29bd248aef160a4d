import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from openings.llm import block_labeller
from openings.llm.block_labeller import label, main_texts, trained
from openings.llm.cotraining import CoTrainer, features, keep_good, pseudo_gradients, quality_scores, score_quality, train_quality
from openings.llm.html_blocks import blocks
from openings.llm.suffix_tree import END, SuffixTree, _contexts, _pair, language_model_scores, learn


def corpus(n=400, seed=1, order=1, kinds=50):
    r = random.Random(seed)
    after = {}
    out = []
    for i in range(n):
        past, words = [r.randrange(kinds) for _ in range(order)], []
        for _ in range(r.randint(5, 60)):
            words.append(f"W{past[-1]}")
            key = tuple(past[-order:])
            if key not in after:
                after[key] = random.Random(str((seed, key))).sample(range(kinds), 5)
            past.append(r.choice(after[key]))
        out.append((i, " ".join(words)))
    return out


def test_suffix_tree_scores(spark):
    rows = corpus() + [(1000, None), (1001, ""), (None, "w1 w2"), (5, "W1 w2")]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, token string")
    got = language_model_scores(df).collect()
    tokens = lambda t: [*(t or "").lower().split(), "<end>"]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
    expected = sorted((str(i), held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == expected
    out = [x for x in got if x.held_out and x.n_tokens > 3]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.2 * sum(x.n_tokens for x in out)
    assert language_model_scores(df.filter("false")).count() == 0


def test_suffix_tree_distributions_sum_to_one(spark):
    first, _ = learn(spark.createDataFrame([(t,) for _, t in corpus()], "text string"))
    assert len(first.depths[0][0]) and not len(first.depths[1][0])  # no word before the last tells more
    tree, root = learn(spark.createDataFrame([(t,) for _, t in corpus(n=1500, order=2, kinds=12)], "text string"))
    tokens, counts = root.frequent(0)
    p0 = (counts + 0.1) / root.denominator
    unknown = 0.1 / root.denominator
    assert abs(p0.sum() + unknown - 1) < 1e-9
    assert len(tree.depths) == 2 and len(tree.depths[1][0])
    for context in ([tokens[3]], [tokens[3], tokens[7]], [np.uint64(1), tokens[5]]):
        seen = [t for t in context]
        gains = []
        for t in [*tokens, np.uint64(12345)]:
            row = np.array([*seen, t], np.uint64)
            gains.append(tree.gain(row, np.array([0, len(row)]))[-1])
        assert abs((np.append(p0, unknown) * 10 ** np.array(gains)).sum() - 1) < 1e-6
    assert END and SuffixTree().bytes == 0
    at, key = _contexts(np.array([1, 2, 3, 4], np.uint64), np.array([0, 2, 4]), 1)
    assert list(at) == [1, 3] and list(key) == [1, 3] and _pair(key[:1], key[1:]) != _pair(key[1:], key[:1])


def documents(n=600, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeilnorst", k=r.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        good = r.random() < 0.7
        t = r.choices(words, k=r.randint(30, 120))
        text = " ".join(t) + "." if good else r.choice([" | ".join(t), " ".join(w + "###" for w in t), " ".join([t[0]] * len(t))])
        out.append((i, text, r.choice(["en", "de", None]), f"src{i % 7}", int(good)))
    return out


def test_quality(spark):
    rows = documents()
    df = spark.createDataFrame([(*x[:4], "c", 1.0) for x in rows] + [(9000, None, None, None, "c", 1.0), (9001, "", "en", "s", "c", 1.0), (None, rows[0][1], "en", "s", "c", 1.0)], "doc_id long, text string, lang string, source string, keep string, score double")
    labels = spark.createDataFrame([(x[0], x[4], 0) for x in rows[:300]] + [(0, rows[0][4], 1), (None, 1, 0), (7777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_scores(df, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 for x in got.values())
    held = rows[300:]
    assert sum(got[x[0]].keep == bool(x[4]) for x in held) >= 0.97 * len(held)
    kept = keep_good(df, train_quality(df, labels))
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.keep}
    assert train_quality(df, labels.filter("quality = 1")) is None
    assert quality_scores(df, labels.filter("false")).filter("keep").count() == len(rows) + 3
    assert quality_scores(df.filter("false"), labels).count() == 0


def test_co_training_gains_from_unlabelled_rows():
    """A weak view learns from what a strong one is sure of; no view gets worse."""
    r = np.random.default_rng(1)
    y = (r.random(6000) < 0.5).astype(int)
    view = lambda d, apart: np.concatenate([r.standard_normal((6000, d)) + apart * (y[:, None] - 0.5), np.ones((6000, 1))], axis=1).astype(np.float32)
    gains = []
    for _ in range(3):
        text, meta = view(20, 1.2), view(200, 0.15)
        trainer = CoTrainer(text[:300], meta[:300], y[:300])
        right = lambda: [((s >= 0.5) == y)[4000:].mean() for s in trainer.model().score(text, meta)]  # noqa: E731, B023
        before = right()
        while any(trainer.step(*pseudo_gradients(text[300:4000], meta[300:4000], trainer))) and len(gains) < 30:
            gains.append(0.0)
        gains.append(right()[1] - before[1])
        assert right()[0] >= before[0] - 0.01 and right()[2] > 0.95
    assert max(gains) > 0.01 and min(gains) > -0.01


def test_unlabelled_rows_teach_words_that_no_labelled_row_has(spark):
    """Sources tell quality; labelled rows use old words, unlabelled ones new words; new words are then known without their sources."""
    r = random.Random(12)
    old, new = (["mildew", "rusty"], ["lemon", "orchid"]), (["kvetch", "zizzag"], ["quaver", "jubily"])
    text = lambda words: " ".join(r.choice(words) if r.random() < 0.5 else r.choice(["stone", "river", "table", "window"]) for _ in range(30))
    rows = [(i, text((old if i < 300 else new)[i % 2]), "en", f"{'good' if i % 2 else 'bad'}{i % 3}") for i in range(2000)]
    asked = [(i, text(new[i % 2]), "en", "elsewhere") for i in range(5000, 5200)]
    schema = "doc_id long, text string, lang string, source string"
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    right = []
    for rounds in (0, 4):
        model = train_quality(docs, labels, rounds=rounds)
        got = score_quality(spark.createDataFrame(asked, schema), model).collect()
        right.append(sum((x.text_score >= 0.5) == (x.doc_id % 2 == 1) for x in got) / len(got))
    assert right[0] < 0.8 and right[1] > 0.95, right


def test_the_views_share_no_measure():
    """Another text changes the metadata view only by its length and lines; another source leaves the text view alone."""
    one = next(features(pa.array(["abc def ghi\njkl"]), pa.array(["s"]), pa.array(["en"])))
    two = next(features(pa.array(["### !!! %%%\n| |"]), pa.array(["s"]), pa.array(["en"])))
    three = next(features(pa.array(["abc def ghi\njkl"]), pa.array(["t"]), pa.array(["de"])))
    assert (one[2] == two[2]).all() and not (one[1] == two[1]).all()
    assert (one[1] == three[1]).all() and not (one[2] == three[2]).all()


def test_toxic_rows_are_bad(spark):
    rows = documents()
    toxic = {i for i, *_ in rows if i % 6 == 0}
    text = lambda x: x[1].replace(" ", " wretch ", 3) if x[0] in toxic else x[1]
    df = spark.createDataFrame([(x[0], text(x), x[2], x[3]) for x in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], x[4], int(x[0] in toxic)) for x in rows[:400]], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in keep_good(df, train_quality(df, labels)).select("doc_id").collect()}
    held = rows[400:]
    assert sum((x[0] in kept) == (bool(x[4]) and x[0] not in toxic) for x in held) >= 0.95 * len(held)


def test_features_of_odd_texts():
    rows = pa.array([None, "", "a", "ab", "x" * 100_000])
    found = list(features(rows, pa.array([None] * 5, pa.string()), pa.array(["en"] * 5)))
    assert sum(len(t) for _, t, _ in found) == 5 and all(np.isfinite(t).all() and np.isfinite(m).all() for _, t, m in found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies to improve your experience</p><button>Accept all</button></div>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li><li><a href="/c">Contact</a></li></ul></nav>
<article><h1>A &amp; B &lt;tag&gt;</h1><p>First   paragraph
goes on here.</p><p><b>Second one with <a href="/x">a link</a> in it.<br><p>Third one, which ends the story for good.</p></article>
<div class="comments"><h3>Comments</h3><div class="comment"><p>Great post, thanks for it</p></div></div>
<footer>&copy; 2024 Example &middot; All rights reserved.</footer></body></html>"""


def test_quotes_outside_values_are_characters():
    texts = lambda html: [b.text for b in blocks(html)]
    assert texts("<p><a title=O'Brien href=x>one</a> isn't two</p><p>three</p>") == ["one isn't two", "three"]
    assert texts("""<p title="a>b" rel = 'c>d'>one</p><p class=x"y>two "quoted"</p>""") == ["one", 'two "quoted"']


def test_blocks():
    texts = [b.text for b in blocks(PAGE)]
    assert texts[5:9] == ["Contact", "A & B <tag>", "First paragraph goes on here.", "Second one with a link in it."]
    assert blocks(None) == [] and blocks("") == [] and [b.text for b in blocks("just text &amp; more")] == ["just text & more"]
    assert [b.text for b in blocks('<p><a title="a > b" href="x">two</a> <b data-x=\'1 > 0 " \'>three</b></p><p title="open>four</p>')] == ["two three", "four"]
    assert [b.text for b in blocks("<p>" + '<a "' * 3000 + ">x")] and [b.text for b in blocks("<b a='" * 2000)] is not None
    assert [b.text for b in blocks("<p>a<p>b<div>c</p>d</div><script>x")] == ["a", "b", "c", "d"]


def test_main_texts(spark):
    rows = [(1, "u1", PAGE, "c"), (2, None, None, "c"), (3, "u3", "", "c"), (None, "u4", PAGE, "c"), (1, "u1", PAGE, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_texts(df).collect()
    expected = "A & B <tag>\nFirst paragraph goes on here.\nSecond one with a link in it.\nThird one, which ends the story for good."
    assert [(x.page_id, x.url, x.text, x.n_chars) for x in got] == [(1, "u1", expected, len(expected)), (2, None, "", 0), (3, "u3", "", 0), (None, "u4", expected, len(expected)), (1, "u1", expected, len(expected))]
    assert main_texts(df.filter("false")).count() == 0


def test_labeller_on_unseen_pages():
    from openings.llm.html_blocks import Block
    from openings.llm.html_pages import made_page

    pages = [blocks(made_page(50_000 + i)) for i in range(150)]
    truth = [np.array(["\x01" in b.text for b in p]) for p in pages]
    seen = label([[Block(b.path, b.text.replace("\x01", "") or ".", b.linked) for b in p] for p in pages], trained())
    wrong = sum(((p >= 0.3) != t).sum() for p, t in zip(seen, truth))
    assert wrong <= 0.015 * sum(map(len, truth))


#: Pages as they stand on the web, written and labelled by hand: lines that begin with + are main text.
BY_HAND = [
    """<html><head><title>Ferry times</title></head><body>
<div id="header"><a href="/"><img src="l.png" alt=""></a><span class="tagline">News from the harbour</span></div>
<div id="nav"><a href="/news">News</a> | <a href="/sport">Sport</a> | <a href="/weather">Weather</a></div>
<div id="content"><div class="post">
+<h1>Ferry service resumes after storm</h1>
+<p>The ferry between the two islands sailed again on Tuesday morning, three days after the storm had damaged the pier.</p>
+<p>Crews worked through the night to replace the ramp, the harbour master said, and the first boat left with 140 passengers.</p>
<div class="share"><a href="#">Tweet</a> <a href="#">Share</a></div>
+<h2>What comes next</h2>
+<p>A second vessel is expected to join the route in May. Tickets that were bought for the cancelled trips remain valid until the end of the year.</p>
</div></div>
<div id="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm in pictures</a></li><li><a href="/2">Road closures</a></li></ul></div>
<div id="footer">&copy; 2023 Harbour Post. All rights reserved. <a href="/imprint">Imprint</a></div></body></html>""",
    """<!doctype html><html><body class="single"><header class="site-header"><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div class="cookie-banner"><p>This website uses cookies. By continuing you agree to their use.</p><button>OK</button></div>
<main><article class="entry">
+<h1>Rye bread without kneading</h1>
+<p>Rye flour holds a lot of water, so the dough for this loaf is closer to a batter and needs a tin.</p>
+<ul>
+<li>500 g rye flour</li>
+<li>420 ml warm water</li>
+<li>2 teaspoons salt</li>
+</ul>
+<p>Stir everything together in the evening, cover the bowl and leave it at room temperature until the next morning.</p>
+<blockquote>A loaf is done when it sounds hollow.</blockquote>
</article>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>Worked well with half spelt, thanks for the recipe!</p></div><div class="comment"><p>How long does it keep?</p></div></section>
<form class="newsletter"><label>Your email</label><input type="email"><button>Subscribe</button></form></main>
<aside class="related"><h4>You may also like</h4><a href="/r/1">Sourdough starter</a></aside>
<footer><p>Powered by a static site generator</p></footer></body></html>""",
    """<html><body><table width="100%"><tr><td class="menu"><a href="a.html">Start</a><br><a href="b.html">Archive</a><br><a href="c.html">Links</a></td><td class="text">
+<h2>Notes on restoring an old radio</h2>
+<p>The set came with two dead valves and a transformer that hummed louder than any station did.
+<p>I began with the capacitors, since paper ones of that age leak almost without exception, and measured each before I took it out.
+<p>After a week the dial lit up and a faint voice read the shipping forecast.
</td></tr></table><div class="ad">Sponsored: cheap valves, buy now</div></body></html>""",
]


def test_labeller_on_pages_labelled_by_hand():
    right = total = 0
    for source in BY_HAND:
        lines = source.split("\n")
        page = blocks("\n".join(line.removeprefix("+") for line in lines))
        main = "\n".join(" ".join(b.text for b in blocks(line[1:])) for line in lines if line.startswith("+"))
        (p,) = label([page], trained())
        total += len(page)
        right += sum((q >= 0.3) == (b.text in main) for b, q in zip(page, p))
    assert right >= 0.94 * total


def test_a_long_page_is_read_in_windows(monkeypatch):
    page = blocks("<body><nav><a>x</a></nav><article>" + "".join(f"<p>Sentence number {i} of a page that goes on and on.</p>" for i in range(700)) + "</article><footer>end</footer>")
    (whole,) = label([page], trained())
    monkeypatch.setattr(block_labeller, "WINDOW", 64)
    (windows,) = label([page], trained())
    assert len(windows) == len(page) and np.abs(windows - whole).max() < 1e-4
