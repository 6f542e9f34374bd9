import hashlib
import random

import pytest

from tallyhouse.llm import fim

SCHEMA = "doc_id long, text string, form string, output string"


def brute(i, text):
    text = text or ""
    n, x = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return "plain", n, None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", n, a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", n, a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_against_brute_force_on_odd_texts(spark):
    rng = random.Random(5)
    odd = ["", None, "a", "\n\r\n", "<P>", "<P", "S>", "<", "<<<S", "P>M>", "é" * 7, "é\U0001f469‍\U0001f680", "\x00 ", "word " * 200_000]
    texts = odd + ["".join(rng.choices("<PSM> ab\nß\U0001f600", k=rng.randint(0, 30))) for _ in range(400)]
    rows = [(i, t, "own", "own") for i, t in enumerate(texts)] + [(None, "null id", "x", "y"), (20, texts[20], "", ""), (20, texts[20], "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.fill_in_middle(df).select("doc_id", "form", "n_units", "prefix_chars", "middle_chars", "output", "output_sha256", fim.restore().alias("back")).collect()
    want = sorted(((i, *brute(i, t), hashlib.sha256(brute(i, t)[-1].encode()).hexdigest(), t or "") for i, t, *_ in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [fim.CODE_POINTS, fim.WORDS, r"\X", r"\d"])
def test_units_tile_the_text(spark, unit):
    texts = ["", "one two  three\n", "  lead", "éa1b2c", "12", "abc"]
    rule = fim.Rule(unit=unit, transformed=100)
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    for r in fim.fill_in_middle(df, rule).withColumn("back", fim.restore()).collect():
        assert r["back"] == texts[r["doc_id"]]
    pattern = fim.regex.compile(unit)
    for t in texts:
        at = list(fim.ends(pattern, t))
        assert at == sorted(set(at)) and (at[-1] if at else 0) == len(t)


def test_empty_table_and_columns(spark):
    out = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "form"]
    assert len(out.columns) == len(set(out.columns))
