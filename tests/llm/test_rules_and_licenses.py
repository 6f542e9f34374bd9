import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyhouse.llm import licenses, linerules, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "CC BY"), (4, "CC BY"), (5, "cc by cc\nBY cc by"), (6, "été cc-by naïve"), (None, "cc by"), (7, "accc by bycc by")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rule_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def license_base(text):
    words = PLAIN.findall(lower(text))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check_rules(rows, df):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())
    assert got == Counter((i, *rule_base(t)) for i, t in rows)


def check_licenses(rows, df):
    found = df.collect()
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found)
    assert got == Counter((i, *license_base(t)) for i, t in rows)
    for r in found:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_rules_on_edge_cases_and_clashing_columns(spark):
    rows = EDGES + [(20, "a b c a b c a b"), (21, "x y\nx y\n x y"), (22, "word " * 40000), (23, "café # * $     | <a>")]
    check_rules(rows, linerules.apply_rules(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", n_words int")))
    assert linerules.apply_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rules_remove_lines_and_reject_what_loses_too_much(spark):
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(16)) + "." for i in range(9))
    junk = "\n".join(["Home | About | Contact | News | Help | More | Shop | Jobs"] * 3 + ["Copyright (c) 2020 All rights reserved."])
    rows = {r.doc_id: r for r in linerules.apply_rules(spark.createDataFrame([(1, f"{good}\n{junk}"), (2, good), (3, junk * 4 + "\n" + good[:160])], SCHEMA)).collect()}
    assert rows[1].kept and rows[1].cleaned == good and rows[1].lost_navigation > 0 and rows[1].lost_boilerplate > 0
    assert rows[2].kept and rows[2].cleaned == good and rows[2].lost_words == 0
    assert not rows[3].kept


def test_rules_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_rules(rows, queries.op9_line_rules(spark, SF))


def test_licenses_on_edge_cases_and_clashing_columns(spark):
    rows = EDGES + [(30, "under the GNU General\n\nPublic License, all rights reserved cc by"), (31, "x " * 50000 + "cc by")]
    check_licenses(rows, licenses.scan(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA + ", labels string, word int")))
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def best_block(words, template):
    """The most distinct template words any block of a text holds, over the
    template's; every block is looked at."""
    own = licenses.template_words(template)
    width, want = max(1, math.ceil(licenses.SPREAD * len(own))), set(own)
    return max(len(want & set(words[i : i + width])) for i in range(max(1, len(words) - width + 1))) / len(want)


def test_template_join_against_all_blocks(spark):
    mit = dict((label, t) for label, t in licenses.TEMPLATES if "\n" in t)["mit"]
    wrapped = "Some words before.\n" + mit.replace(", ", ",\n") + "\nand some after"
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and documentation files", 2: "nothing here\nReleased under\nthe MIT License.\nmore", 3: "released the mit",
        4: "Licensed under the Apache License, Version 2.0 (the thing)", 5: "licensed under cc by sa 4 0", 6: "license " * 300, 7: "released under the bsd licence", 8: "released under the license", 9: wrapped,
        10: "released under " + "x " * 40 + "the mit license", 11: "x " * 20000 + wrapped + " y" * 500, 12: "", 13: "Licensed under CC BY-NC 4.0. " + "z " * 30 + "Released under the MIT license",
    }
    df = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("s", licenses.spaced(licenses.F.col("text")))
    rank = licenses.word_order(df, "s", {w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)})
    table = licenses.Templates(licenses.TEMPLATES, rank, licenses.CONTAINMENT)
    kept = df.withColumn("tokens", licenses.F.split(licenses._lower(licenses.F.col("s")), " "))
    got = {}
    for r in licenses.template_links(kept, ["doc_id"], table).collect():
        got[r.doc_id, r.template] = max(got.get((r.doc_id, r.template), 0), r.containment)
    want = {}
    for i, text in texts.items():
        words = PLAIN.findall(lower(text))
        for n, (_, template) in enumerate(licenses.TEMPLATES):
            c = best_block(words, template)
            if 10 * c >= 8 - 1e-9:
                want[i, n] = c
    assert got.keys() == want.keys() and len(want) >= 8 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    labels = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert labels[9] == labels[11] == "mit" and labels[2] == "mit" and labels[10] == "" and labels[13] == "cc-by,cc-by-nc,mit" and labels[5] == "cc-by,cc-by-sa"


def test_places_inside_one_another_all_count(spark):
    row = licenses.scan(spark.createDataFrame([(1, "la la la x")], SCHEMA), phrases={"la la": "song"}).first()
    assert (row.n_base, row.first_word, row.last_word) == (2, 0, 1)


def test_licenses_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_licenses(rows, queries.op8_license_set_join(spark, SF))


def test_ties_and_long_texts_do_not_depend_on_the_order_of_rows(spark):
    notice = licenses.TEMPLATES[0][1]
    twice = f"{notice} and so on {notice}"
    long = " ".join(f"w{i}" for i in range(5000)) + f" {notice} " + " ".join(f"x{i}" for i in range(3000))
    rows = [(1, twice), (2, long), (3, twice), (4, " ".join(notice.split()[3:]) + " " + " ".join(notice.split()[:-3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shown = [sorted(map(tuple, licenses.scan(d).collect())) for d in (df.coalesce(1), df.orderBy(F.desc("doc_id")).repartition(3), df.repartition(2))]
    assert shown[0] == shown[1] == shown[2]
    assert all(licenses.TEMPLATES[0][0] in r[6] for r in shown[0][:3])
