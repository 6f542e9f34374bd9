import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyhouse.llm import packing, queries

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_slots(rows, capacity):
    """Every sequence is filled from 0 without gaps, within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_hold_the_tokenizers_ids(spark, tokenizer):
    texts = ["Hello, World! It's 3.14.", None, "", "été naïve Straße İstanbul 你好 😀", "a" * 200, "<|endoftext|> x", "x" * 30 + " \t\n y", "word " * 9000, "don't #tag a_b c--d"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = packing.pack(df).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(by[r.doc_id]) and r.length == len(r.ids) <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id] += r.ids
    assert {i: ids_of(tokenizer, t) for i, t in enumerate(texts)} == dict(by)
    check_slots(rows, 4096)


def test_small_capacity_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c")] * 7 + [(2, "one two three four five six seven eight nine ten")] * 3 + [(None, "z")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA + ", length int, piece int")
    got = packing.pack(df, capacity=8).collect()
    assert check_slots(got, 8) <= len(got)
    assert sum(r.length for r in got) == 7 * 4 + 3 * 11 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_is_best_fit_decreasing_over_counts():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 5000).tolist()
    histogram = {k: lengths.count(k) for k in set(lengths)}
    rows = packing.plan(histogram, 100)
    used = defaultdict(int)
    for length, _, n, per, first, start in rows:
        for i in range(n):
            used[first + i // per] += length
    assert max(used.values()) <= 100 and sum(used.values()) == sum(lengths)
    # one document at a time, the longest first, each into the fullest that fits
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(100 - x)
    assert len(used) <= len(rooms) * 1.01


def test_query_against_the_tokenizer(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = queries.op4_best_fit_packing(spark, sf).collect()
    count = check_slots(got, 4096)
    assert count <= -(-sum(r.length for r in got) // 4096) * 1.02 + 1
    by = {(r.doc_id, r.piece): r for r in got}
    pieces = 0
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(tokenizer, text)
        for p, at in enumerate(range(0, len(ids), 4096)):
            own, r = ids[at : at + 4096], by[doc_id, p]
            assert (r.start, r.length, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            pieces += 1
    assert pieces == len(got)


def test_case_is_kept_where_the_tokenizer_keeps_it(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    for normalizer, want in ((None, [2, 3]), (normalizers.Lowercase(), [3, 3])):
        own = Tokenizer(models.WordLevel({"[UNK]": 0, "end": 1, "House": 2, "house": 3}, unk_token="[UNK]"))
        own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if normalizer:
            own.normalizer = normalizer
        own.save(str(tmp_path / f"{want[0]}.json"))
        got = packing.Encoder(str(tmp_path / f"{want[0]}.json")).encode(pa.array(["House house", None]))
        assert [x.tolist() for x in got] == [[*want, packing.END_ID], [packing.END_ID]]
