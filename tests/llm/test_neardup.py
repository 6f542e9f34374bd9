import random
import re

import numpy as np
import pytest

from tallyhouse.llm import neardup, queries

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    """(doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                i, j = root(i), root(j)
                up[max(i, j)] = min(i, j)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def run(df):
    return sorted(tuple(r) for r in neardup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def variants(seed=3):
    """Families of texts: copies, near copies at every distance, chains."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (1, 2, 5, 30):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    chain = rng.choices(words, k=200)
    for step in range(12):
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, rows[3][1].upper()), (n + 1, None), (n + 2, ""), (n + 3, " \n\t"), (n + 4, "one two"), (n + 5, "One\ttwo"), (n + 6, "two one")]
    rng.shuffle(rows)
    return rows


def test_components_against_brute_force(spark):
    rows = variants()
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (7, long), (9, long + " end")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", rep int, bands int, u int")
    assert run(df) == brute(rows)
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b"), (1, "a b")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1)}


def test_an_id_with_many_rows_and_texts(spark):
    base = [f"x{i}" for i in range(100)]
    near = " ".join([*base, "y"])
    rows = [(5, " ".join(base))] * 60 + [(9, near)] * 60 + [(5, "other words that stand alone here")] * 3 + [(11, "Other words that stand alone here")]
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = spark.createDataFrame([(5,), (9,)], "rep long")
    assert neardup.shingle_sets(df.withColumnRenamed("doc_id", "rep"), wanted).count() == 3
    assert {r[0]: r[2] for r in run(df)} == {5: 5, 9: 5, 11: 5}


def test_ties_between_leaders_in_a_large_family(spark):
    rng = random.Random(8)
    base = rng.choices([f"w{i}" for i in range(500)], k=120)
    rows = []
    for i in range(700):
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_signature_is_an_unbiased_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
    x, y = neardup.signatures([a, b], 512)
    assert abs((x == y).mean() - 800 / 1200) < 0.06
    one = neardup.signatures([a, a[:3]])
    assert (one[0] == neardup.signatures([a])[0]).all() and (one[1] == neardup.signatures([a[:3]])[0]).all()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op2_minhash_near_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows)
