"""Damaged JSON, products of a run, matching, conflicts and report checks."""

import json

from pyspark.sql import functions as F

from tallyhouse.operators import claims, report_lint, sampling, snapshots
from tallyhouse.sources import lenient_json, runs


def test_damaged_json_is_recovered_or_named(spark):
    whole = json.dumps({"products": [{"id": 1, "title": "A"}, {"id": 2, "title": "B"}]})
    rows = [
        ("ok", whole), ("prose", f"Here you are:\n```json\n{whole}\n```\n"), ("cut", whole[:-14]), ("page", "<!doctype html><html><body>no</body></html>"),
        ("empty", ""), ("missing", None),
    ]
    got = {r.file: r for r in lenient_json.states(spark.createDataFrame(rows, "file string, content string"), salvage_key="products").collect()}
    assert len(got) == len(rows)
    states = {k: r.state for k, r in got.items()}
    assert states["ok"] == "ok" and states["prose"] == "extracted" and states["cut"] == "salvaged" and states["missing"] == "missing"
    assert states["page"] != "ok" and states["empty"] != "ok"


def test_page_numbers(spark):
    df = spark.createDataFrame([("products-12.json",), ("products-x.json",), ("meta.json",)], "f string")
    assert [r.n for r in df.select(runs.numbered("f", "products-", "json").alias("n")).collect()] == [12, None, None]


def test_retention_keeps_the_ends(spark):
    snaps = spark.createDataFrame([("s", f"2024-01-0{i}") for i in range(1, 8)], "site string, snapshot_id string").withColumn("captured_at_utc", F.col("snapshot_id"))
    columns = sampling.retention(snaps, 2).columns
    assert "snapshot_id" in columns
    packed = {r.snapshot_id for r in sampling.retention(snaps, 2).collect()}
    assert "2024-01-01" not in packed and "2024-01-07" not in packed and packed


def test_unique_match_is_one_to_one(spark):
    a = spark.createDataFrame([("s", "a1", "x"), ("s", "a2", "y"), ("s", "a3", "y")], "site string, key_a string, t string")
    b = spark.createDataFrame([("s", "b1", "x"), ("s", "b2", "y")], "site string, key_a string, t string")
    got = snapshots.unique_match(a, b, ["t"], F.lit("title")).select("key_a", "key_b", "how").collect()
    assert [tuple(r) for r in got] == [("a1", "b1", "title")]


def test_claims_of_a_text(spark):
    texts = spark.createDataFrame([("s", "footer", "u", "Free shipping on orders over $50. We accept returns within 30 days.")], "site string, source string, url string, text string")
    topics = {r.topic for r in claims.extract(texts).collect()}
    assert "free_threshold" in topics


def test_fenced_lines_are_not_content(spark):
    reports = spark.createDataFrame([("r", "a\n```\ncode\n```\nb")], "report_id string, markdown string")
    lines = report_lint.content_lines(report_lint.report_lines(reports))
    assert {"a", "b"} <= {r.text for r in lines.collect()} and "code" not in {r.text for r in lines.collect()}
