"""Hard negatives against brute force, with hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, row string"


def brute(rows):
    """(anchor, positive, rank, negative, scores) of rows that take part, by all pairs."""
    own = []
    for n, (i, v, label, *_) in enumerate(rows):
        if i is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, i, v, label in own:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in own if m != n and len(w) == len(v)]
        alike = sorted(x[:3] for x in scored if x[3] == label)[:5]
        for ps, pi, _ in alike:
            inside = sorted(x[:2] for x in scored if x[3] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps)
            out += [(i, pi, r, j, -ps, -s) for r, (s, j) in enumerate(inside[:10], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mined(df, F.col("vec_id") % 100 == 0, label, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)) / 4
    x[100:400] = x[100]  # a third of all rows alike
    x[500:520] = x[0]
    out = [(i, [float(a) for a in np.float32(x[i])], int(rng.integers(4)), "q", "r") for i in range(900)]
    out += [out[100], out[100], (200, out[7][1], 1, None, None)]  # ids that repeat, anchors among them
    out += [(None, out[3][1], 1, "", ""), (1000, None, 1, "", ""), (1001, out[3][1], None, "", ""), (1002, [float("nan")] * 12, 1, "", ""), (1003, [None] * 12, 1, "", ""), (1004, [float("inf")] * 12, 1, "", "")]
    out += [(1100, [0.0] * 12, 1, "", ""), (1101, [], 1, "", ""), (1200, [0.5, 0.25], 2, "", ""), (1201, [0.5, 0.5], 2, "", ""), (1202, [0.25, 0.125], 3, "", "")]
    return out


def test_equal_to_all_pairs(spark, rows):
    want = brute(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want


def test_small_blocks_give_the_same(spark, rows):
    assert mined(spark, rows, block=100, anchors=3) == brute(rows)


def test_large_components_and_empty_tables(spark):
    big = [(100, [7e6, 6e6], 0, "", ""), (101, [6e6, 7e6], 0, "", ""), (102, [3e6, 3e6], 1, "", ""), (103, [5e6, 5e6], 1, "", "")]
    assert mined(spark, big) == brute(big) != []
    assert mined(spark, []) == []
    assert mined(spark, [(None, None, None, None, None)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(3000, 16)) * 32).astype(np.int64)
    q = negatives.Quantiser(x[:1000])
    tables = q.tables(x[0])
    norm = float(np.linalg.norm(x[0]))
    exact = x @ x[0]
    middle, width = 0, []
    for level, (codes, residual) in enumerate(q.encode(x)):
        middle = middle + tables[level][codes.astype(int) + np.arange(codes.shape[1]) * negatives.CENTROIDS].sum(axis=1)
        slack = norm * residual
        assert (np.abs(exact - middle) <= slack).all()
        width.append(slack.mean())
    assert width[1] < width[0] / 4  # the second level is much nearer
