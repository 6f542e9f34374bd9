import hashlib
import random

import numpy as np
import pytest

from tallyhouse.llm import queries, repeats
from tallyhouse.llm.suffixarray import suffix_arrays

SCHEMA = "doc_id long, text string, ranges string, version string"


def brute(rows):
    """By every window's smallest id: (doc_id, n_bytes, n_removed, n_spans, hash)."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if i is not None else 0):
            w = raw[k : k + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49 if i is not None else 0):
            if least[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        kept = bytes(b for b, x in zip(raw, gone) if not x)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(df, **options):
    out = repeats.remove_repeats(df, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(150):
        strings = [[rng.randint(1, rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))] + [0] for _ in range(rng.randint(1, 12))]
        got = suffix_arrays(np.array(sum(strings, [])), np.array([len(x) for x in strings]))
        want, begin = [], 0
        for x in strings:
            want += [begin + i for i in sorted(range(len(x)), key=lambda i: x[i:])]
            begin += len(x)
        assert got.tolist() == want
    assert suffix_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def cases(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [text(rng.randint(0, 30)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts.insert(rng.randrange(len(parts)), s[a : a + rng.randint(30, 300)])
        rows.append((i * 3 % 161, "".join(parts)))
    near = text(80)
    for i in range(40):  # near copies, each with an edit of its own
        k = rng.randrange(len(near))
        rows.append((200 + i, near[:k] + rng.choice("xyz\u00e9\U0001f600") + near[k + 1 :]))
    odd = ["", None, "a", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "ab" * 200, "aab" * 100, "\u00e9" * 30, "\U0001f600" * 40, near, near[:50], near[1:51], "q" * 60 + near + "q" * 60]
    rows += [(300 + i, t) for i, t in enumerate(odd)] + [(400, near), (400, near), (None, near), (None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"together": 2, "bucket_bytes": 2000}, {"together": 5}])
def test_against_brute_force(spark, options):
    rows = cases()
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(5)
    assert run(df, **options) == brute(rows)


def test_one_id_with_different_texts(spark):
    a, b = "left " * 30 + "0123456789" * 12, "right " * 30 + "0123456789" * 12
    rows = [(5, a), (5, b), (6, a[100:] + "!"), (4, b[:90])]
    assert run(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)) == brute(rows)


def test_order_and_partitions_do_not_matter(spark):
    rows = cases(11)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert run(df.repartition(7)) == run(df.coalesce(1).orderBy("text"))


def test_very_long_text_and_a_passage_in_many(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghijklmnop ", k=1_300_000))
    passage = "".join(rng.choices("klmnopqrst ", k=120))
    rows = [(1, long)] + [(10 + i, "".join(rng.choices("uvwxyz", k=40)) + passage + "".join(rng.choices("uvwxyz", k=40))) for i in range(300)] + [(999, "#" + long[1000:2000])]
    got = {r[0]: r for r in run(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))}
    assert got[1][2] == 0 and got[999][2:4] == (1000, 1)
    assert all(got[10 + i][2] >= 120 for i in range(1, 300)) and got[10][2] == 0


def test_empty_table_and_kept_text(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    row = repeats.remove_repeats(spark.createDataFrame([(1, "x", "", "")], SCHEMA)).first()
    assert bytes(row["kept"]) == b"x"


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_suffix_array_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in docs])


def test_runs_of_a_hot_anchor_are_told_apart_by_what_is_beside_it(spark, monkeypatch):
    rows, staged = cases(), {}
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(repeats, "stage", lambda df, name, real=repeats.stage: staged.setdefault(name, real(df, name)))
    assert run(df, together=2) == brute(rows)
    assert staged["shared-runs"].where("hot").count() > 100 and staged["found"].where("window is not null").isEmpty()


@pytest.mark.parametrize("most", [1, 3])
def test_groups_beyond_one_portion_meet_by_their_windows(spark, most):
    rows = cases(5)
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).repartition(5)
    assert run(df, together=2, most=most) == brute(rows)
