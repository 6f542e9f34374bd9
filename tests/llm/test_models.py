"""Trained operators: held-out accuracy, and every defined edge case."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import langid, pagetext, quality, queries, toxicity
from tallyhouse.llm.common import id_bucket

SF = "/root/testdata/sf0.01"
LONG = "the quick brown fox jumps over it. " * 20000
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "1234 !!"), (5, "Plain words."), (5, "Plain words."), (6, LONG), (None, "Plain words.")]


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


def labels(spark, column):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column).collect() if r[1] is not None}


@pytest.mark.parametrize("query, column, fold, n", [("op3_quality_qda", "quality", 0, 5), ("op5_toxicity_weak_supervision", "toxic", 1, 3)])
def test_held_out_accuracy(spark, query, column, fold, n):
    rows = getattr(queries, query)(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = labels(spark, column)
    assert all(r.held_out == (bucket(r.doc_id, n) == fold) and 0 <= r.score <= 1 for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([y == p for y, p in held]) >= 0.9
    if column == "toxic":
        # a third of the texts marked toxic hold no word that sets them apart
        hits = [p for y, p in held if y]
        assert not any(p for y, p in held if not y) and np.mean(hits) >= 0.75


def test_correlated_voters_share_their_say():
    rng = np.random.default_rng(3)
    toxic = rng.random(4000) < 0.2
    own = [(toxic & (rng.random(4000) < 0.6)) for _ in range(2)]
    echo = own[0] ^ (rng.random(4000) < 0.002)
    votes = np.array([own[0], echo, own[1]], float).T
    model = toxicity.LabelModel(votes, toxic.astype(float), 0.2)
    assert model.share[0] < 0.6 and model.share[1] < 0.6 and model.share[2] > 0.9
    assert (model.accuracy > 0.9).all()


def test_language_replaces_columns_of_its_own_names(spark):
    learn = [(i, t, v) for v, t in (("en", "the house and the garden"), ("fr", "la maison et le jardin")) for i in range(40)]
    model = langid.train(spark.createDataFrame(learn, "x long, text string, lang string").withColumn("doc_id", F.monotonically_increasing_id()))
    df = spark.createDataFrame([(1, "the house", "xx", 7.0)], "doc_id long, text string, lang_pred string, lang_score double")
    out = langid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score", "lang_ambiguous"] and out.first().lang_pred == "en"


def test_language_held_out_accuracy(spark):
    rows = queries.op10_language_ecoc(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (bucket(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean(held) >= 0.95


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, lang_score int"
    learn = [(i, t, v, 0) for v, t in (("en", "the house and the garden were small"), ("fr", "la maison et le jardin étaient petits")) for i in range(40)]
    model = langid.train(spark.createDataFrame(learn, schema).withColumn("doc_id", F.monotonically_increasing_id()))
    df = spark.createDataFrame([(i, t, None) for i, t in EDGES], "doc_id long, text string, batch int")
    got = {(r.doc_id, r.text): r for r in langid.identify(df, model).collect()}
    assert [got[i, t].lang_pred for i, t in EDGES[:4]] == ["und"] * 4 and got[1, None].lang_score == 0.0
    assert got[6, LONG].lang_pred == "en"
    assert langid.identify(df.limit(0), model).collect() == []
    assert langid.train(spark.createDataFrame([], schema)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.train(spark.createDataFrame([(1, "abc", None, 0), (None, "abc", "en", 0), (2, None, "en", 0)], schema)) is None


def test_codewords_are_apart():
    for k in (2, 4, 5, 12, 60):
        m = langid.codewords(k)
        least = min((m[a] != m[b]).sum() for a in range(k) for b in range(a))
        assert len(m) == k and least >= max(1, m.shape[1] // 4)
    assert langid.codewords(1).shape == (1, 1)


def test_ngrams_of_a_long_text_do_not_depend_on_blocks(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 123, 5000, dtype=np.uint8))
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 700)
    assert (langid.ngram_counts(text) == whole).all() and whole.sum() == 4 * 5000 - 6


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(*r, 1) for r in EDGES], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(df, none, F.lit(True)).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (5, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(df, one, F.lit(True)).collect()} == {1.0}
    two = spark.createDataFrame([(5, 1), (4, 0), (3, 0), (6, 1)], "doc_id long, quality int")
    rows = quality.classify(df, two, ~id_bucket("doc_id", 5).isin(-1)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(df.limit(0), two, F.lit(True)).collect() == []


def test_quadratic_discriminant_matches_the_densities():
    rng = np.random.default_rng(3)
    x0, x1 = rng.normal(0, 1, (400, 4)), rng.normal(1, 2, (600, 4))
    model = quality.fit(*(quality.Moments(len(x), x.sum(0), x.T @ x) for x in (x0, x1)))
    got = model.score(np.vstack([x0, x1]))
    for x, s in zip(np.vstack([x0, x1])[:20], got):
        log = []
        for mean, inverse in zip(model.means, model.factors):
            cov = np.linalg.inv(inverse.T @ inverse)
            log.append(-0.5 * ((x - mean) @ np.linalg.inv(cov) @ (x - mean) + np.linalg.slogdet(cov)[1]))
        assert abs(s - 1 / (1 + np.exp(-(log[1] - log[0] + np.log(1.5))))) < 1e-6
    assert ((got > 0.5) == np.repeat([False, True], [400, 600])).mean() > 0.8


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(*r, 1) for r in EDGES], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    everyone = lambda c: F.lit(True)
    assert {round(r.score, 9) for r in toxicity.score(df, toxicity.train(df, none, everyone)).collect()} == {0.0}
    clean = spark.createDataFrame([(5, 0), (6, 0)], "doc_id long, toxic int")
    assert {round(r.score, 9) for r in toxicity.score(df, toxicity.train(df, clean, everyone)).collect()} == {0.0}
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 40)) + (" vilewordish" if i % 4 == 0 else "")) for i in range(240)]
    many = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(many, marks, everyone)
    got = {r.doc_id: r.score for r in toxicity.score(many, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(240))
    assert all(0 <= r.score < 0.7 for r in toxicity.score(df, model).collect())
    assert toxicity.score(df.limit(0), model).collect() == []


PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article>"
    "<h1>A &amp; B</h1><p>First   paragraph\nof <b>this</b> text&nbsp;here, with some more words.</p><script>var x = '<p>no</p>';</script><p>Second one, &eacute;t&#233;.</p>"
    "</article><footer>&copy; 2024 example</footer></body></html>": "A & B\nFirst paragraph of this text here, with some more words.\nSecond one, été.",
    "": "", None: "",
}


def test_page_text(spark):
    rows = [(i, f"u{i}", html, "x") for i, html in enumerate(PAGES)]
    rows += [(8, None, "<p", "x"), (9, "u", "<article><p>Cut off in the middle of a sentence that goes on", "x"), (9, "u", rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    field = pagetext.train()
    got = [(r.page_id, r.text) for r in pagetext.extract(df, field).collect()]
    assert len(got) == len(rows)
    for i, want in enumerate(PAGES.values()):
        assert (i, want) in got
    assert (9, "Cut off in the middle of a sentence that goes on") in got
    assert pagetext.extract(df.limit(0), field).collect() == []


def test_viterbi_finds_the_best_labelling():
    found = pagetext.blocks(next(iter(PAGES)))
    field = pagetext.train(60)
    feats = pagetext.features(found)

    def score(y):
        s = field.start[y[0]]
        for k, label in enumerate(y):
            s += sum(field.weights.get(f, 0.0) for f in feats[k]) * label
            s += field.between[y[k - 1]][label] if k else 0.0
        return s

    every = [[(n >> k) & 1 for k in range(len(found))] for n in range(1 << len(found))]
    assert abs(score(field.decode(found)) - max(map(score, every))) < 1e-9


def test_page_query_returns_every_page(spark):
    rows = queries.op6_html_crf(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text == r.text.strip() and "<script" not in r.text for r in rows)
