"""The filter audit against counting by hand."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from draftlens.llm import audit

DOCS = "doc_id long, text string, source string, part string, E boolean, id string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if x]
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}


def brute(docs, labels):
    rows = []
    for i, text, source, *_ in docs:
        f = fails(text or "")
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in docs)
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            whole, gone = list(alive), []
            for step, f in enumerate(order, 1):
                lost = [r for r in alive if r[1][f]]
                alive = [r for r in alive if not r[1][f]]
                out[part, "".join(order), step] = [len(alive), len(lost), sum(r[1][f] for r in gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in whole), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                gone += lost
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    got = audit.audited(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


@pytest.fixture(scope="module")
def docs():
    clean = " ".join(f"w{i}" for i in range(220))
    texts = [clean, clean + " x", "short", "", None, "a b " * 150, "AB CD $ ", clean + " #", "Ünïcode ÄÖ " * 80, clean, "long " * 40_000, "tab\tvt\x0bx " * 90]
    out = [(i, texts[i % len(texts)], ("s0", "s1", None, "")[i % 4] if i % 3 else "s0", "p", True, "x") for i in range(160)]
    return out + [(None, clean, "s1", "p", None, ""), (None, clean, None, "p", None, ""), (5, "short", "s1", "", None, ""), (5, "short", "s1", "", None, "")]


def test_equal_to_counting(spark, docs):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 1, 1), (3, None, 0), (None, 1, 1), (6, None, None)]
    want = brute(docs, labels)
    assert len(want) == 600 * 3
    assert audited(spark, docs, labels) == want


def test_empty_and_no_labels(spark, docs):
    assert audited(spark, [], []) == {}
    assert audited(spark, docs[:9], []) == brute(docs[:9], [])


def test_hot_key_is_looked_up_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    table = rows.filter("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("v"))
    got = audit.looked_up(rows, "k", table, 5000)
    assert got.count() == 5000
    want = {r.id: (0 if r.id % 3 == 0 else r.id if r.id % 3 == 1 else None) for r in rows.collect()}
    assert {r.id: r.v for r in got.collect()} == want
