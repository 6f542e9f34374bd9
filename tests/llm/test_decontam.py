import random
from collections import Counter

import pytest

from tallyhouse.llm import decontam, queries

SF = "/root/testdata/sf0.001"


def items(n=60, seed=2):
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(400)]
    out = []
    for i in range(n):
        said = " ".join(rng.choices(words, k=rng.randint(4, 120)))
        out.append((i, f"{said}? Answer: {rng.choice(words)} {rng.choice(words)}" if i % 2 else f"{said}. {rng.choice(words)}."))
    return out, words, rng


def full_scores(index, terms):
    """Every unit's score for a set of terms, without any bound."""
    score = Counter()
    for t in terms:
        for unit, x in index.postings.get(t, ()):
            score[unit] += x
    return score


def test_wand_returns_all_units_above_the_threshold():
    rows, words, rng = items()
    index = decontam.Index(rows)
    for _ in range(200):
        own = rng.choices(words, k=40) + rng.choice(rows)[1].split()[: rng.randint(1, 40)]
        terms = sorted({index.vocabulary[w] for x in own for w in decontam.words(x.encode()) if w in index.vocabulary})
        for threshold in (0.2, 0.4, 0.9):
            want = {u: s for u, s in full_scores(index, terms).items() if s >= threshold}
            got = dict(index.search(terms, threshold))
            assert set(want) <= set(got)
            assert all(s >= threshold - 2 * decontam.EPS for s in got.values())
            assert all(abs(got[u] - s) < 1e-9 for u, s in want.items())


def test_planted_items_are_found_and_clean_texts_are_not(spark):
    rows, words, rng = items()
    filler = [f"plain{i}" for i in range(500)]
    docs, planted = [], {}
    for i in range(120):
        own = rng.choices(filler, k=rng.randint(20, 600))
        if i % 3 == 0:
            item, text = rng.choice(rows)
            at = rng.randrange(len(own))
            own[at:at] = text.upper().split()
            planted[i] = item
        docs.append((i, " ".join(own)))
    docs += [(900, None), (901, ""), (902, " ".join(rng.choices(filler, k=30000)) + " " + rows[7][1])]
    planted[902] = rows[7][0]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, item_id int")
    bench = spark.createDataFrame([*rows, (77, None), (78, ""), rows[5]], "item_id long, text string")
    found = decontam.leaks(df, bench).where("contaminated").select("doc_id", "item_id").distinct().collect()
    got = {r.doc_id: r.item_id for r in found}
    assert set(got) == set(planted) and {(r.doc_id, r.item_id) for r in found} >= set(planted.items())


def test_index_in_parts_finds_the_same(spark, monkeypatch):
    rows, *_ = items()
    df = spark.createDataFrame([(i, t) for i, t in rows[:20]], "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    answers = lambda: {(r.doc_id, r.item_id): r[2:] for r in decontam.leaks(df, bench, threshold=0.05).collect()}
    whole = answers()
    for bound in (1, 500, 2000):
        monkeypatch.setattr(decontam, "MAX_INDEX_WORDS", bound)
        assert len(list(decontam.indexes(bench, "item_id", "text"))) > 1
        parts = answers()
        assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], abs=1e-12) for k in whole)
    assert {(i, i) for i, _ in rows[:20]} <= set(whole)


@pytest.mark.parametrize("docs, bench", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([], [])])
def test_empty_tables(spark, docs, bench):
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert decontam.leaks(df, b).collect() == []


def brute_force(docs, items):
    """Every pair of a text and an item found without an index: all units are
    scored for every window, and overlaps are counted for what is found."""
    weights = decontam.Weights(t for _, t in items)
    units = [(n, weights.impacts(u)) for n, (_, t) in enumerate(items) for u in decontam.cut_units(decontam.words((t or "").encode()))]
    holding = {}
    for u, (_, impact) in enumerate(units):
        for t, x in impact.items():
            holding.setdefault(t, []).append((u, x))
    half, out = decontam.PASSAGE_WORDS // 2, set()
    for doc, text in docs:
        t = decontam.words((text or "").encode())
        found = set()
        for i in range(0, max(1, len(t) - half), half):
            score = Counter()
            for w in set(t[i : i + 2 * half]):
                for u, x in holding.get(w, ()):
                    score[u] += x
            found |= {units[u][0] for u, x in score.items() if x >= decontam.THRESHOLD - decontam.EPS}
        for n in found:
            shares = []
            for part in decontam.parts(items[n][1]):
                want = decontam.grams(decontam.words(part.encode()))
                k = len(next(iter(want)))
                shares.append(len(want & set(zip(*[t[j:] for j in range(k)]))) / len(want))
            if shares[0] >= decontam.QUESTION_ALONE or min(shares) >= decontam.BOTH:
                out.add((doc, items[n][0]))
    return out


def test_query_against_brute_force(spark):
    items_ = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if decontam.words((r.text or "").encode())]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination_wand(spark, SF).collect()}
    assert got == brute_force(docs, items_) and got


def test_repeated_documents_and_null_ids(spark):
    rows, words, _ = items()
    docs = [(1, rows[3][1]), (1, rows[3][1]), (None, rows[3][1]), (2, rows[4][1] + " " + rows[3][1])]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id) for r in found.where("contaminated").collect())
    assert got[1, 3] == 2 and got[None, 3] == 1 and got[2, 3] == got[2, 4] == 1


def test_query_finds_every_whole_item_in_the_documents(spark):
    plain = lambda t: b" ".join(decontam.words((t or "").encode()))
    bench = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in bench if x and b" " + x + b" " in b" " + t + b" "}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination_wand(spark, SF).collect()}
    assert want and want <= got
