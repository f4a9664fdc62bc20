"""Language mixture, toxicity, quality and page text: held-out accuracy, planted cases and edges."""

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyloom.llm import common, op02_language_mixture as lang, op03_style_tree as style, op04_toxicity as tox, op08_quality_neighbours as qual, samples
from tallyloom.llm.common import importable

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_languages_held_out(docs):
    got = lang.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions) - 1) < 1e-6 for r in got if r.lang_pred != "und")


def test_mixture_of_two(docs):
    model = lang.train(docs)
    names, logp = model
    rows = docs.where("length(text) > 4000").select("lang", "text").limit(200).collect()
    text = {r.lang: r.text for r in rows}
    for a, b in (("en", "de"), ("fr", "es")):
        pi = lang.mixture(lang.grams(text[a][:4000] + "\n" + text[b][:2000]), logp)
        share = dict(zip(names, pi))
        assert abs(share[a] - 2 / 3) < 0.1 and abs(share[b] - 1 / 3) < 0.1


def test_language_edges(spark, docs):
    model = lang.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 +-"), (None, "the and of that"), (4, "é")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "en" and got[4][0] in model[0]
    nothing = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert lang.languages(nothing).first().lang_pred == "und"
    assert lang.languages(nothing.limit(0)).count() == 0


def test_toxicity_held_out(spark, docs):
    more = [spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels")]  # some hundred toxic rows
    got = tox.toxicity(*more).join(more[1], "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    hit = np.array([r.predicted for r in held])
    y = np.array([r.toxic for r in held])
    assert (hit == y).mean() > 0.96
    score = np.array([r.score for r in held])
    assert np.mean([a > b for a in score[y == 1] for b in score[y == 0]]) > 0.9


def test_misspellings_share_vectors():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioust"), 5)) for _ in range(200)]
    texts, y = [], []
    for k in range(400):
        t = list(rng.choice(words, 20))
        if k % 2:
            t[3] = "grumblor" + "".join(rng.choice(list("aeiou"), 2))
        texts.append(" ".join(t))
        y.append(k % 2)
    model = tox.fit(texts, np.array(y))
    scores = dict(zip(("grumblorzz", "grumblor", words[0]), model.word_scores(["grumblorzz", "grumblor", words[0]])))
    assert scores["grumblorzz"] > scores[words[0]] + 3 and scores["grumblor"] > scores[words[0]] + 3


def plain_score(model, text):
    """One text, word by word and window by window."""
    logits = []
    for w in text.lower().split():
        core = "<" + (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w) + ">"
        grams = [core[i:i + n] for n in tox.NGRAMS for i in range(len(core) - n + 1)]
        pulls = [model.pull[int(samples.gram_hashes(samples.code_points(g), len(g), tox.BUCKET_BITS)[0])] for g in grams]
        logits.append(sum(pulls) / max(len(pulls), 1))
    windows = [sum(logits[i:i + tox.WINDOW]) / tox.WINDOW for i in range(len(logits) - tox.WINDOW + 1)] or ([sum(logits) / len(logits)] if logits else [])
    if not windows:
        return 1 / (1 + np.exp(-min(0.0, model.offset)))
    e = [np.exp(tox.SHARPNESS * z) for z in windows]
    return 1 / (1 + np.exp(-(sum(a * z for a, z in zip(e, windows)) / sum(e) + model.offset)))


def test_toxicity_scores_equal_brute_force(spark, docs):
    rng = np.random.default_rng(2)
    model = tox.Model(rng.normal(0, 2, 1 << tox.BUCKET_BITS), -0.5)
    rows = [(k, t) for k, t in enumerate(["", None, "a", "!!!", "Idiot.", "two words", "ÄÖ éé (漢字) x-y"] + [r.text[:900] for r in docs.limit(20).collect()])]
    got = {r.doc_id: r.score for r in tox.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        assert abs(got[k] - plain_score(model, t or "")) < 1e-6, t


def test_toxicity_does_not_grow_with_length(spark):
    importable(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels)
    rows = tox.score(docs.join(labels.where("toxic = 0"), "doc_id"), model, keep=("text",)).where("score < 0.5").orderBy("doc_id").select("text").collect()
    clean = [r.text for r in rows if r.text]
    joined = " ".join(clean)
    long = (joined + " ") * (1 + (10 << 20) // len(joined))
    found = {r.doc_id: r.score for r in tox.score(spark.createDataFrame([
        (1, long[:1 << 20]), (2, long[:10 << 20]), (3, long[:1 << 20] + " you idiot " + joined[:5000]), (4, clean[0]), (5, " ".join([clean[0]] * 1000)),
        (6, " ".join(clean[:100])), (7, "idiot")], "doc_id long, text string"), model).collect()}
    assert all(found[k] < tox.CUTOFF for k in (1, 2, 4, 5, 6)) and found[3] >= tox.CUTOFF
    assert abs(found[4] - found[5]) < 0.02


def test_toxicity_edges(spark, docs, labels):
    model = tox.train(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "idiot " + "fine " * 50_000, "c"), (2, "idiot " + "fine " * 50_000, "d")], "doc_id long, text string, score string")
    got = tox.score(odd, model, keep=("text",)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and next(r.score for r in got if r.doc_id == 1) <= 0.5
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    whole = tox.toxicity(odd.withColumn("label", F.lit(1)).withColumn("predicted", F.lit("x")), labels.limit(0)).collect()
    assert len(whole) == 4 and {r.predicted for r in whole} == {0} and max(r.score for r in whole) < 1e-9
    only = tox.toxicity(docs, labels.where("toxic = 1"))  # one class: nothing can be told apart
    assert {r.predicted for r in only.collect()} == {0}
    assert tox.toxicity(docs.limit(0), labels).count() == 0


def test_long_labelled_texts_take_no_other_place(spark):
    """The first text of a class in the order of the sample is above the bound; a class of long texts only keeps the shortest."""
    importable(spark)
    keys = [r.k for r in spark.range(60).where(common.fold(F.col("id"), 3) != 1).orderBy(F.xxhash64("id")).select(F.col("id").alias("k")).collect()]
    labels = spark.createDataFrame([(k, n % 2) for n, k in enumerate(keys)], "doc_id long, toxic int")
    texts = {k: f"grumblor {k}" if n % 2 else f"fine words {k}" for n, k in enumerate(keys)}
    texts[keys[1]] = "grumblor " * 1000
    got = samples.labelled(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels, "toxic", 3, 1, 3, 2000)
    assert sorted(got["text"]) == sorted(texts[keys[n]] for n in (0, 2, 4, 3, 5, 7))
    for n in range(1, len(keys), 2):
        texts[keys[n]] = "grumblor " * (1000 - n)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert samples.labelled(docs, labels, "toxic", 3, 1, 40, 2000).query("label == 1")["text"].tolist() == [min((texts[k] for k in keys[1::2]), key=len)]


def test_quality_held_out(docs, labels):
    got = qual.quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_votes_equal_brute_force(docs, labels):
    model = qual.train(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()]
    z = model.latent(texts)
    for k, got in enumerate(model.vote(texts)):
        cos = model.vectors @ z[k]
        near = np.argsort(-cos)[:qual.NEIGHBOURS]
        w = np.exp(qual.SHARPNESS * (cos[near] - 1)) + 1e-9
        assert abs(got - (w * model.labels[near]).sum() / w.sum()) < 1e-6


def test_quality_edges(spark, docs, labels):
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 300_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in qual.quality(odd, labels).collect())
    assert {r.score for r in qual.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert qual.quality(docs.limit(0), labels).count() == 0


# --- pages --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("html, text", [
    ("<div><p>a&nbsp;&amp; b<p>c<br>d<ul><li>x<li>y</ul><div class='sidebar-left'>no</div>tail", "a & b\n\nc d\n\nx\n\ny\n\ntail"),
    ("<body><header>H</header><article><header><h1>T</h1></header><p>one <b>two</p><section class=comments>c</section></article><form>f<input>g</form>", "T\n\none two"),
    ("<script>var a='</p>'</script><p>hi<!-- no --></p><style>x", "hi"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("plain text &lt;b&gt; x", "plain text <b> x"),
    ("<article><p>one</p></article><aside>a</aside><article><p>two</article>", "one\n\ntwo"),
    ("<p>word<i>s</i> <b>in</b>\n a\trow", "words in a row"),
    ("<div role=navigation>n</div><p>t", "t"), ("", ""), ("<article></article>", ""),
])
def test_main_text(html, text):
    assert style.Page(html).text() == text


def test_repeated_branches_go(spark):
    importable(spark)
    rows = [(k, f"http://H.com/{k}", f"<body><div class=x>Same words here</div><div class=y><p>Own text {k}</p></div></body>") for k in range(30)]
    rows += [(k, f"http://two.org/{k}", "<article><p>All pages alike</p></article>") for k in range(100, 130)]
    rows += [(200, None, None), (201, "no host", "<p>q"), (None, "http://z.org", ""), (202, "http://few.net/1", "<div class=x>Same words here</div>")]
    got = {r.page_id: r.text for r in style.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert all(got[k] == f"Own text {k}" for k in range(30))
    assert all(got[k] == "All pages alike" for k in range(100, 130))
    assert (got[200], got[201], got[None], got[202]) == ("", "q", "", "Same words here")
    assert style.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_texts_of_a_low_branch_stay(spark):
    """Copies of one text on 90 of 100 pages make its branch low: the other ten texts stay, and so do the copies."""
    importable(spark)
    story, menu = "the same long story " * 20, "<div class=x>Home and more</div>"
    rows = [(k, f"http://h.com/{k}", f"<body>{menu}<div class=content><p>{story if k < 90 else f'Another story of page {k}'}</p></div><div class=ad>Buy {k}</div><div class=y>Seen {k}</div></body>") for k in range(100)]
    got = {r.page_id: r.text for r in style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{story.strip() if k < 90 else f'Another story of page {k}'}\n\nSeen {k}" for k in range(100)}


@pytest.mark.parametrize("html, text", [
    ("<article><h2 id='social-history'>Social history</h2><section id=header-notes class=part>one</section><p class='share-price'>two</p></article>", "Social history\n\none\n\ntwo"),
    ("<div><h2 id='social-history'>Social history</h2><section id=search-methods><p>one</section></div>", "Social history\n\none"),
    ("<article><p>one</p><div class='x share'>no</div><div class='ad-slot'>no</div><div class=commentList>no</div><section class=comments>no</section></article>", "one"),
    ("<div class='widget-x'>no</div><div id='cookie-box'>no</div><h2 class=banner>no</h2><p>one", "one"),
])
def test_names_of_headings_and_sections(html, text):
    assert style.Page(html).text() == text


def test_importance(spark):
    rows = [("h", 1, page, 5, 7) for page in range(10)] + [("h", 2, page, page, page) for page in range(10)] + [("h", 1, 0, 5, 7)]
    got = {r.path: (r.pages, round(r.importance, 9)) for r in style.importance(spark.createDataFrame(rows, "host string, path long, page long, look long, read long")).collect()}
    assert got == {1: (10, 0.0), 2: (10, 1.0)}
