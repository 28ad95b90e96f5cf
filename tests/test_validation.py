"""Parsers and rules against stated values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from draftlens.functions.amounts import figures, in_words, token_forms, verify_by_tokens
from draftlens.functions.dates import parse_date
from draftlens.functions.fields import normalised
from draftlens.functions.text import canonical_payee, payee_for_comparison, python_repr
from draftlens.operators import compare, geometry, reconcile, records, rules, store
from draftlens.streaming import ingest

TODAY = datetime.date(2026, 8, 17)


def column(spark, rows, make, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(make.alias("x")).collect()]


def test_figures(spark):
    got = column(spark, ["$\n125.50", "$ 300", "$1,247.05", "2 000,50", "$125.501", "", None, "none"], figures(F.col("a")))
    assert [(r.status, r.value) for r in got] == [
        ("OK", Decimal("125.50")), ("OK", Decimal("300.00")), ("OK", Decimal("1247.05")), ("OK", Decimal("2000.50")), ("UNPARSEABLE", None), ("ABSENT", None), ("ABSENT", None), ("UNPARSEABLE", None),
    ]


WORDS = [
    ("One Hundred and twenty five dollars and 50\n/100 DOLLARS", None, "125.50"),
    ("Two million and 99/100 dollars only", None, "2000000.99"),
    ("Ninty eigthy and xx/100", None, "170.00"),
    ("Three Hundred dollars and sixty cents", None, "300.60"),
    ("sixty cents only", None, "0.60"),
    ("One Hundrd and fifty", None, None),
    ("Sixtty and 00/100", None, None),
    ("One Hundred 25 dollars", None, None),
    ("one thousand nine hundred eighty one 4/kg 100 Dollars", 46, "1981.46"),
    ("nine hundred sixty five 460 100 DOLLARS", 47, "965.47"),
    ("twenty five and 50/xx", 10, None),
]


def test_words(spark):
    got = column(spark, [(a, b) for a, b, _ in WORDS], in_words(F.col("a"), F.col("b")), "a string, b int")
    assert [None if r.value is None else str(r.value) for r in got] == [w for *_, w in WORDS]
    assert [r.degraded for r in got][8:10] == [True, True] and not any(r.degraded for r in got[:8])


MATCHES = [
    (933, None, "Nine Hundred and thirty three dallas", "matched"),
    (933, None, "nine thousand three hundred thirty", "contradiction"),
    (650, None, "six thousand five hundred fifty", "contradiction"),
    (1688, None, "umble frotz", "tokens_missing"),
    (2218, 36, "Twenty- two hundred eighteen - 36", "matched"),
    (530, 42, "Five Hundred Thirty 42 DOLLARS", "matched"),
    (530, 17, "Five Hundred Thirty 42 DOLLARS", "tokens_missing"),
    (80, 0, "eight", "tokens_missing"),
    (30, 0, "thirtty dollars", "matched"),
    (5, 0, None, "tokens_missing"),
]


def test_token_match(spark):
    got = column(spark, [(t, d, c) for d, c, t, _ in MATCHES], verify_by_tokens(F.col("a"), F.col("b"), F.col("c")), "a string, b long, c int")
    assert [r.outcome for r in got] == [o for *_, o in MATCHES]


def test_token_forms(spark):
    got = column(spark, [(933,), (1150,), (2000,), (0,)], token_forms(F.col("a")), "a long")
    assert [len(x) for x in got] == [1, 2, 2, 1] and got[3] == [["zero"]] and " ".join(got[1][1]) == "eleven hundred fifty"


DATES = [
    ("17 08 2026", "OK", "2026-08-17"), ("15062025\nDDM MY YYY", "OK", "2025-06-15"), ("2026-03-12", "OK", "2026-03-12"), ("05 06 2026", "AMBIGUOUS", "2026-06-05"), ("blurred", "UNPARSEABLE", None),
    ("12th March, 2026", "OK", "2026-03-12"), ("Mar 12 2026", "OK", "2026-03-12"), ("26-08-30", "UNPARSEABLE", None), ("150815", "OK", "2015-08-15"), ("026-08-28", "UNPARSEABLE", None), (None, "ABSENT", None),
    ("20110102", "OK", "0102-11-20"),
]


def test_dates(spark):
    got = column(spark, [d for d, *_ in DATES], parse_date(F.col("a")))
    assert [(r.status, None if r.value is None else r.value.isoformat()) for r in got] == [(s, v) for _, s, v in DATES]


def test_six_digits_never_guess(spark):
    """All day-month-year strings: a resolved date is the only valid reading."""
    rows = [f"{d:02d}{m:02d}{y:02d}" for d in range(1, 29) for m in range(1, 13) for y in range(100)]
    got = column(spark, rows, parse_date(F.col("a"), "DMY", False))

    def readings(s):
        out = set()
        for y, m, d in ((s[4:], s[2:4], s[:2]), (s[4:], s[:2], s[2:4]), (s[:2], s[2:4], s[4:])):
            try:
                out.add(datetime.date((2000 if int(y) < 70 else 1900) + int(y), int(m), int(d)))
            except ValueError:
                pass
        return out

    for s, r in zip(rows, got, strict=True):
        valid = readings(s)
        assert (r.value is not None) == (len(valid) == 1) and (r.value is None or r.value in valid)


def test_texts(spark):
    assert column(spark, ["The Town of Whitby.", " PAY TO: x"], canonical_payee(F.col("a"))) == ["town of whitby", "pay to x"]
    assert column(spark, ["Pay to the order of: Town of Whitby", "", None], payee_for_comparison(F.col("a"))) == ["town of whitby", None, None]
    values = ["a'b", "x\ny", 'q"\'', None]
    assert column(spark, values, python_repr(F.col("a"))) == [repr(v) for v in values]


def document(**changed):
    row = {"payee_raw": "The Town of Whitby", "figures_raw": "$\n125.50", "words_raw": "One Hundred and twenty five dollars and 50\n/100 DOLLARS", "date_raw": "17 08 2026", "signed": True, "memo_raw": "April Rent Payment"}
    return row | changed


@pytest.mark.parametrize("cfg", [rules.Config()])
def test_verdicts(spark, cfg):
    cases = [
        (document(), "VALID"), (document(payee_raw="City of Oshawa"), "INVALID"), (document(memo_raw=None), "REVIEW"), (document(signed=None), "REVIEW"), (document(signed=False), "INVALID"),
        (document(date_raw="01 01 2020"), "INVALID"), (document(words_raw="nine hundred dollars only"), "INVALID"), (document(words_raw="frotz"), "REVIEW"), (document(figures_raw=None), "REVIEW"),
        (document(date_raw="30 09 2026"), "VALID"), (document(words_raw=None), "REVIEW"),
    ]
    schema = "payee_raw string, figures_raw string, words_raw string, date_raw string, signed boolean, memo_raw string, i int"
    df = spark.createDataFrame([(*c.values(), i) for i, (c, _) in enumerate(cases)], schema)
    got = {r.i: r for r in rules.validated(normalised(df), F.lit(TODAY), cfg).select("i", "verdict", "rules").collect()}
    assert [got[i].verdict for i in range(len(cases))] == [v for _, v in cases]
    assert [x.status for x in got[0].rules.values()] == ["PASS"] * 5 and "corroboration" in got[0].rules["amount_match"].evidence


def test_cents_alone_are_not_matched_by_zero(spark):
    """"zero dollars" says nothing about a figure of cents alone; where the figure is zero itself, or the cents agree, nothing changes."""
    cases = [("$\n0.93", "zero dollars only", "FAIL"), ("$0.93", "zero frotz dollars", "UNABLE"), ("$0.93", "zero and xx/100 dollars", "PASS"), ("$ 0", "zero dollars and ninety-three cents", "PASS"), ("$40.93", "forty dollars only", "PASS")]
    schema = "payee_raw string, figures_raw string, words_raw string, date_raw string, signed boolean, memo_raw string, i int"
    df = spark.createDataFrame([(*document(figures_raw=f, words_raw=w).values(), i) for i, (f, w, _) in enumerate(cases)], schema)
    got = {r.i: r.s for r in rules.validated(normalised(df), F.lit(TODAY), rules.Config()).select("i", F.col("rules")["amount_match"]["status"].alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [s for *_, s in cases]


@pytest.mark.parametrize("name", ["memo_rule", "override_integrity"])
def test_one_rule_needs_no_other(spark, name):
    """A query of one rule evaluates neither the other rules nor the customers."""
    from draftlens.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "c_name" not in plan
    df = spark.createDataFrame([tuple(document(memo_raw=m).values()) for m in ("x", None)], "payee_raw string, figures_raw string, words_raw string, date_raw string, signed boolean, memo_raw string")
    both = lambda d: sorted(r.s for r in d.select(F.col("rules")["memo"]["status"].alias("s")).collect())
    assert both(rules.judged(normalised(df.drop("payee_raw")), F.lit(TODAY), only=("memo",))) == both(rules.validated(normalised(df), F.lit(TODAY))) == ["PASS", "UNABLE"]


def test_reconciliation(spark):
    runs = [("a", 1, "$5.00", "five dollars only"), ("a", 2, "$5.00", "frotz"), ("b", 1, "$5.00", "five only"), ("b", 2, "$6.00", "six only"), ("c", 1, None, "x"), ("c", 2, None, "y")]
    df = spark.createDataFrame(runs, "source_id string, run int, figures_raw string, words_raw string")
    for c in ("payee_raw", "date_raw", "memo_raw"):
        df = df.withColumn(c, F.lit("1"))
    got = {r.source_id: r for r in reconcile.reconciled(normalised(df.withColumn("signed", F.lit(True)))).collect()}
    assert got["a"].amount_numeric.status == "OK" and got["a"].amount_words.value == Decimal("5.00")
    assert got["b"].amount_numeric.status == "AMBIGUOUS" and got["b"].amount_numeric.value is None and got["b"].amount_words.status == "AMBIGUOUS"
    assert got["c"].amount_words.status == "UNPARSEABLE" and "no run out of 2" in got["c"].amount_words.note and len(got["c"].memo_readings) == 2


def test_geometry(spark):
    schema = "regions array<struct<page:int,polygon:array<double>>>, w int, h int, pages array<struct<page:int,width:double,height:double,unit:string>>"
    box = [10.0, 20.0, 110.0, 20.0, 110.0, 70.0, 10.0, 70.0]
    page = [(1, 300.0, 600.0, "pixel")]
    rows = [([(1, box)], 300, 600, page), ([(1, box)], 600, 1200, page), ([(2, box)], 300, 600, page), ([], 300, 600, page), ([(1, box)], 0, 600, page), ([(1, box)], 300, 600, []), ([(1, box[:5])], 300, 600, page), ([(1, [5.0] * 8)], 300, 600, page), ([(1, box)], 300, 600, [(1, 3.0, 6.0, "cubit")])]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    c = geometry.to_pixels(F.col("regions"), F.col("w"), F.col("h"), F.col("pages"), F.lit(1))
    got = df.select(c.alias("c"), geometry.crop(c, F.col("w"), F.col("h"), geometry.CropConfig()).alias("crop")).collect()
    assert [r.c.status for r in got] == ["OK", "OK", "WRONG_PAGE", "NO_POLYGON", "INVALID_IMAGE_DIMENSIONS", "MISSING_PAGE_INFO", "MALFORMED_POLYGON", "ZERO_AREA", "UNSUPPORTED_UNIT"]
    assert got[0].c.bbox == [10, 20, 110, 70] and got[1].c.bbox == [20, 40, 220, 140] and got[0].crop.status == "adjusted" and got[2].crop.status == "not_run"


def test_comparison(spark):
    rows = [(True, "A", "a", "rejected", "not_run", None, None), (True, "A", "a", "not_run", "not_run", None, None), (False, None, None, "adjusted", "failed", None, None), (True, "A", "a", "not_run", "skipped", None, None), (False, None, None, "adjusted", "completed", " ", None), (False, None, None, "adjusted", "completed", "x", "x"), (True, "A ", "a", "adjusted", "completed", "A", "z"), (True, "A", "a", "accepted", "completed", "b", "a"), (True, "A", "a", "accepted", "completed", "b", "b")]
    c = [F.col(x) for x in "abcdefg"]
    got = column(spark, rows, compare.compared(*c), "a boolean, b string, c string, d string, e string, f string, g string")
    assert [r.status for r in got] == ["CROP_REJECTED", "TROCR_NOT_RUN", "TROCR_FAILED", "DI_ONLY", "BOTH_UNDETERMINED", "TROCR_ONLY", "AGREE_EXACT", "AGREE_NORMALIZED", "DISAGREE"]
    assert [r.manual_review for r in got] == [False, False, True, False, True, True, False, False, True]
    with pytest.raises(ValueError):
        compare.eligible(("payee", "signature"))


def test_store(spark):
    schema = "source_hash string, day string, path string"
    old = spark.createDataFrame([("h1", "20260101", "a", "CHQ-20260101-0007")], schema + ", record_id string")
    new = spark.createDataFrame([("h1", "20260101", "b"), ("h2", "20260101", "d"), ("h2", "20260101", "c"), (None, "20260101", "e"), (None, "20260101", "f"), ("", "20260102", "g")], schema)
    got = {r.path: r.record_id for r in store.appended(old, new, "day", ["path"]).collect()}
    assert got == {"a": "CHQ-20260101-0007", "c": "CHQ-20260101-0008", "e": "CHQ-20260101-0009", "f": "CHQ-20260101-0010", "g": "CHQ-20260102-0001"}


def test_ids_go_on_past_four_digits(spark):
    known = spark.createDataFrame([("CHQ-20260101-9999",), ("CHQ-20260101-10000",), ("CHQ-20260102-0003",), ("other",)], "record_id string")
    new = spark.createDataFrame([(1, "20260101"), (2, "20260101"), (3, "20260102"), (4, "20260103")], "k int, day string")
    got = {r.k: r.record_id for r in store.with_ids(new, known, "day", ["k"]).collect()}
    assert got == {1: "CHQ-20260101-10001", 2: "CHQ-20260101-10002", 3: "CHQ-20260102-0004", 4: "CHQ-20260103-0001"}


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    """Rows without hash too: the checkpoint's record of the last batch is taken away, and the batch comes again."""
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "store"), tmp_path / "checkpoint"
    rows = [(1, "a"), (2, None), (3, ""), (4, "a")]
    spark.createDataFrame(rows, "k int, source_hash string").coalesce(1).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("k int, source_hash string").parquet(str(source))
        ingest.ingest(stream, path, str(checkpoint), lambda df: df, ["k"]).awaitTermination()
        for f in (checkpoint / "commits").iterdir():
            f.unlink()
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_confidence_and_presence_reach_the_record(spark):
    fields = "struct<payee:double,amount_numeric:double,amount_words:double,cheque_date:double,signature:double,memo:double>"
    schema = f"payee_raw string, figures_raw string, words_raw string, date_raw string, signed boolean, memo_raw string, memo_present boolean, confidence {fields}"
    row = ("Town of Whitby", "$5.00", "five dollars", "2026-01-02", True, None, False, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4))
    df = normalised(spark.createDataFrame([row], schema), unicode=False)
    assert df.first().memo.note == "memo not returned by the extractor" and df.first().payee.confidence == 0.9
    checked = rules.validated(df.withColumn("source_file", F.lit("/a/b/c.jpg")), F.lit("2026-02-01").cast("date"))
    r = records.projected(checked, "1.0", "m").first()
    assert (r.source_file, r.ruleset_version, r.confidence.payee, r.confidence.date, r.raw_values.amount_words) == ("c.jpg", "1.0", 0.9, 0.6, "five dollars")
    assert r.confidence.amount_numeric == r.confidence.amount_words
    again = records.revalidated(records.projected(checked, "1.0").withColumn("record_id", F.lit("x")), spark.createDataFrame([("x", "memo", "seen")], "record_id string, rule string, evidence string"), "2.0", F.lit("2026-02-01").cast("date"), unicode=False)
    got = again.first()
    assert got.rules["memo"].status == "PASS" and got.overlaid and got.old_ruleset == "1.0" and got.payee_normalized == r.payee_normalized
    assert records.pending(again, "2.0").count() == 0 and records.revalidation_events(again, F.current_timestamp()).first().event == "ruleset_revalidation"


def test_token_match_without_evidence(spark):
    """Texts in the figure's order are not searched, nor are those that lack a word of each form without evidence; outcomes stay, and what was found and missing is given with evidence."""
    more = [(733, 0, "seven hundered thirty three dollars", "matched"), (40, 0, "forty thousand dollars", "contradiction"), (1200, 0, "twelve hundred dollars", "matched"), (2_000_000, 5, "two million and 05/100", "matched"), (2_000_000, 5, "two million and 06", "tokens_missing"), (0, 0, "zero dollars", "matched")]
    rows = [(t, d, c) for d, c, t, _ in [*MATCHES, *more]]
    schema = "a string, b long, c int"
    fast = column(spark, rows, verify_by_tokens(F.col("a"), F.col("b"), F.col("c"), False), schema)
    full = column(spark, rows, verify_by_tokens(F.col("a"), F.col("b"), F.col("c")), schema)
    assert [r.outcome for r in fast] == [r.outcome for r in full] == [o for *_, o in [*MATCHES, *more]]
    assert [r.claims for r in fast] == [r.claims for r in full]
    got = full[len(MATCHES)]
    assert [(x.expected, x.matched, x.distance) for x in got.found] == [("seven", "seven", 0), ("hundred", "hundered", 0), ("thirty", "thirty", 0), ("three", "three", 0)] and got.missing == []
    assert fast[3].found is None and fast[3].missing is None and full[3].missing and full[3].found == []


def test_boxes_round_half_to_even(spark):
    """Scaled corners and paddings that end in a half go to the even neighbour."""
    df = spark.range(1).select(F.expr("array(named_struct('page', 1, 'polygon', array(0.5D, 1.5D, 10.5D, 1.5D, 10.5D, 12.5D, 0.5D, 12.5D)))").alias("regions"), F.expr("array(named_struct('page', 1, 'width', 100.0D, 'height', 100.0D, 'unit', 'pixel'))").alias("pages"))
    c = geometry.to_pixels(F.col("regions"), F.lit(100), F.lit(100), F.col("pages"), F.lit(1))
    got = df.select(c.alias("c"), geometry.crop(c, F.lit(100), F.lit(100), geometry.CropConfig(least_area=1, padding=0.25)).alias("crop")).head()
    assert (got.c.status, got.c.bbox) == ("OK", [0, 2, 10, 12]) and (got.crop.status, got.crop.bbox, got.crop.reasons) == ("adjusted", [0, 0, 12, 14], [])
