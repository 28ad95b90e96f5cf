"""Stores, ranks, pages, medians, filters, indexes and dictionaries against plain Python."""

import random
import statistics
import threading

import pytest
from pyspark.sql import functions as F

from draftlens.operators import blooms, counters, dictionary, diagnostics, evaluate, paging, quantile, records, report, search, sequence, store
from draftlens.operators.versions import Conflict, Store
from draftlens.streaming import ingest

SCHEMA = "record_id string, amount long"


def rows_of(df):
    return sorted((r.record_id or "", r.amount) for r in df.select("record_id", "amount").collect())


def made(spark, path, n=40, buckets=8):
    at = Store.create(spark, str(path), "record_id", spark.createDataFrame([], SCHEMA).schema, buckets)
    at.append(spark.createDataFrame([(f"R{i}", i) for i in range(n)], SCHEMA))
    return at


# --- versions ---


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    at = made(spark, tmp_path / "s")
    before = at.manifest()
    version = at.merge(spark.createDataFrame([("R3", 300), ("new", 1)], SCHEMA))
    after = at.manifest(version)
    bucket = {r[0]: r[1] for r in at.read().select("record_id", at.bucket(after, at.read()).alias("b")).collect()}
    touched = {str(bucket["R3"]), str(bucket["new"])}
    assert {b for b in after.folders if after.folders[b] != before.folders.get(b)} == touched
    assert rows_of(at.read()) == sorted([(f"R{i}", 300 if i == 3 else i) for i in range(40)] + [("new", 1)])
    assert rows_of(at.read(1)) == sorted((f"R{i}", i) for i in range(40))  # the old snapshot
    assert at.merge(spark.createDataFrame([], SCHEMA)) == version


def test_new_columns_and_rows_without_key(spark, tmp_path):
    at = made(spark, tmp_path / "s", 4)
    at.append(spark.createDataFrame([(None, 7), (None, 7)], SCHEMA))
    at.merge(spark.createDataFrame([("R1", 1, "seen"), (None, 8, "x")], SCHEMA + ", note string"))
    got = sorted((r.record_id or "", r.amount, r.note or "") for r in at.read().collect())
    assert got == [("", 7, ""), ("", 7, ""), ("", 8, "x"), ("R0", 0, ""), ("R1", 1, "seen"), ("R2", 2, ""), ("R3", 3, "")]


def test_two_writers_lose_nothing(spark, tmp_path):
    at = made(spark, tmp_path / "s", 10, 2)
    failed = []

    def write(who):
        try:
            own = Store(spark, str(tmp_path / "s"))
            for i in range(3):
                own.append(spark.createDataFrame([(f"{who}{i}", i)], SCHEMA))
                own.merge(lambda old, i=i: old.filter(F.col("record_id") == "R0").withColumn("amount", F.col("amount") + 1))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = dict(rows_of(at.read()))
    assert got["R0"] == 6 and {k for k in got if k[0] in "ab"} == {f"{w}{i}" for w in "ab" for i in range(3)} and len(got) == 16
    assert at.versions() == list(range(14))


def test_a_conflict_is_seen_and_a_dead_writer_leaves_the_snapshot(spark, tmp_path):
    at = made(spark, tmp_path / "s", 10, 2)
    base = at.manifest()
    at.merge(spark.createDataFrame([("R1", 100)], SCHEMA))
    with pytest.raises(Conflict):
        at._replace(base, spark.createDataFrame([("R1", 5)], SCHEMA), "late")
    want, versions = rows_of(at.read()), at.versions()
    at._write(at.manifest(), spark.createDataFrame([("dead", 1)], SCHEMA))  # no manifest follows
    assert rows_of(at.read()) == want and at.versions() == versions


def test_backups_restore_and_vacuum(spark, tmp_path):
    at = made(spark, tmp_path / "s", 10, 2)
    first = rows_of(at.read())
    at.keep("monday")
    with pytest.raises(FileExistsError):
        at.keep("monday")
    for i in range(3):
        at.merge(spark.createDataFrame([("R1", 100 + i)], SCHEMA))
    latest = rows_of(at.read())
    assert at.vacuum(last=1, older_than=3600) == []  # a writer may still be at work
    assert at.vacuum(last=1, older_than=-60)
    assert rows_of(at.kept("monday")) == first and rows_of(at.read()) == latest
    at.restore("monday")
    assert rows_of(at.read()) == first


# --- filters and streams ---


def test_filters_find_every_batch_that_holds_a_key(spark, tmp_path):
    of = {str(b): spark.createDataFrame([(f"{b}-{i}",) for i in range(200)] + [(None,)], "h string") for b in range(5)}
    for b, df in of.items():
        blooms.build(df, "h", str(tmp_path / b))
    paths = {b: str(tmp_path / b) for b in of} | {"none": str(tmp_path / "none")}
    keys = spark.createDataFrame([("3-7",), ("0-199",), ("absent",), (None,)], "h string")
    got = blooms.may_hold(spark, keys, "h", paths)
    assert {"none", "0", "3"} <= set(got) and len(got) <= 4
    assert blooms.may_hold(spark, spark.createDataFrame([], "h string"), "h", {"1": paths["1"]}) == []


def test_batches_read_only_what_may_hold_their_hashes(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "store")
    for day in range(8):
        new = [(day * 10 + i, f"h{day}-{i}") for i in range(10)] + ([(900 + day, "h0-1"), (950 + day, None)] if day else [])
        batch = spark.createDataFrame(new, "id long, source_hash string")
        if day:  # the batches that a day's rows make it read
            held = ingest.seen_before(spark, at, batch, "source_hash")
            assert 1 <= len(held) <= 2
            assert any("h0-1" in [r.source_hash for r in spark.read.parquet(f).collect()] for f in held)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        ingest.ingest(stream, at, str(tmp_path / "checkpoint"), lambda df: df, ["id"]).awaitTermination()
    got = spark.read.parquet(at)
    assert got.filter("source_hash IS NOT NULL").count() == 80 and got.filter("source_hash IS NULL").count() == 7
    assert len(ingest.batches(spark, at)) == 8


# --- ranks, pages, medians ---


def test_ranks_of_a_hot_day(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "day string, v int, id int")
    order = [F.col("v"), F.col("id")]
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {}
    for day in {r[0] for r in rows}:
        ids = [r[2] for r in sorted((r for r in rows if r[0] == day), key=key)]
        want |= {i: (n + 1, ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None) for n, i in enumerate(ids)}
    got = sequence.ranked(df, ["day"], order, rows_in_range=50)
    assert {r.id: r["rank"] for r in got.collect()} == {i: w[0] for i, w in want.items()}
    assert got.select("day").join(df.select("day"), "day", "left_anti").filter("day IS NOT NULL").count() == 0
    beside = sequence.beside(df, ["day"], order, "id", rows_in_range=50)
    assert {r.id: (r["rank"], r.previous, r.next) for r in beside.collect()} == want
    assert [tuple(r) for r in report.neighbours(df.filter("id < 3").withColumnRenamed("id", "record_id"), [F.col("record_id")]).orderBy("place").collect()] == [(0, 1, None, 1), (1, 2, 0, 2), (2, 3, 1, None)]
    assert sequence.ranked(df.limit(0), ["day"], order).count() == 0
    # no range holds the hot day: its rows are dealt to many parts
    assert sequence._in_ranges(df.filter("day = 'hot'"), ["day"], order, 50).select("_part").distinct().count() >= 6


def test_ids_of_a_hot_day_stay_dense(spark):
    known = spark.createDataFrame([("CHQ-20260101-0007",), ("CHQ-20260102-12345",)], "record_id string")
    df = spark.createDataFrame([(i, "20260101" if i < 500 else "20260102") for i in range(510)], "id int, day string")
    got = {r.id: r.record_id for r in store.with_ids(df, known, "day", ["id"]).collect()}
    assert got == {i: f"CHQ-20260101-{8 + i:04d}" if i < 500 else f"CHQ-20260102-{12346 + i - 500}" for i in range(510)}


def test_a_page_opens_one_file(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 37) % 1000) for i in range(1000)], "id int, v int").repartition(5)
    at = str(tmp_path / "view")
    paging.write(df, at, [F.col("v"), F.col("id")], F.col("v"), rows=100)
    files = paging.directory(spark, at)
    assert files.count() >= 8 and files.agg(F.sum("n")).first()[0] == 1000
    first = files.orderBy("before").first()
    inside = paging.page(spark, at, 0, min(20, first.n))
    assert len(inside.inputFiles()) == 2  # the rows' file and the directory
    for number, size in ((0, 20), (3, 77), (49, 20), (50, 20), (0, 5000)):
        got = [(r.place, r.v) for r in paging.page(spark, at, number, size).orderBy("place").collect()]
        assert got == [(n + 1, n) for n in range(number * size, min(1000, (number + 1) * size))]
    assert sorted(r.v for r in paging.between(spark, at, 250, 260).collect()) == list(range(250, 261))


def test_page_tasks_are_fewer_than_files(spark, tmp_path, monkeypatch):
    """Small files don't make small tasks: the directory keeps the order of a task's files, and pages over their ends are whole."""
    monkeypatch.setattr(paging, "ROWS", 1000)
    at = str(tmp_path / "view")
    paging.write(spark.range(5000).select(F.xxhash64("id").alias("v"), "id"), at, [F.col("v"), F.col("id")], F.col("v"), rows=60)
    files = paging.directory(spark, at).orderBy("before").collect()
    assert len({f.part for f in files}) <= 5 and len(files) >= 5000 // 60 and all(a.last <= b.first for a, b in zip(files, files[1:], strict=False))
    want = [r.v for r in spark.range(5000).select(F.xxhash64("id").alias("v")).orderBy("v").collect()]
    for number in (0, 7, 24):
        assert [r.v for r in paging.page(spark, at, number, 200).orderBy("place").collect()] == want[200 * number : 200 * number + 200]



def test_medians(spark):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(501)] + [("b", float(i % 7)) for i in range(400)] + [("c", 3.5)] + [("d", None), ("d", float("nan"))] + [(None, x) for x in (1e300, -1e300, 1.0, 2.0)] + [("e", 10.0 ** (i - 150)) for i in range(301)]
    rows += [("a", None), ("f", 5.0), ("f", 5.0)]
    got = {r.g: (r.n, r["median"]) for r in quantile.medians(spark.createDataFrame(rows, "g string, v double"), F.col("v"), ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == (len(values), statistics.median(values) if values else None)
    whole = [v for _, v in rows if v is not None and v == v]
    assert [tuple(r) for r in quantile.medians(spark.createDataFrame(rows, "g string, v double"), F.col("v"), []).collect()] == [(len(whole), statistics.median(whole))]
    c = evaluate.calibration(spark.createDataFrame([(1.0, True), (4.0, True), (9.0, True), (0.5, False)], "v double, real boolean"), "v", "real", 0.7).first()
    assert (c.median_real, c.n_real, c.inside) == (4.0, 3, True)


# --- dictionary ---


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_near_words_are_all_found(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcé") for _ in range(n)) for n in (21, 22, 23, 24, 25, 26, 27, 60)]
    entries = ["a", "ab", "abc", "whitby", "whitty", "oshawa", "shaw", "éclair", *long]

    def edited(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice("abcxé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]])
        return w

    words = sorted({edited(rng.choice(entries)) for _ in range(400)} | {"", "x"})
    w, e = spark.createDataFrame([(x,) for x in words] + [(None,), ("whitby",)], "word string"), spark.createDataFrame([(x,) for x in entries] + [(None,), ("",)], "entry string")
    for k in (1, 2):
        got = dictionary.near(w, e, k)
        assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, levenshtein(a, b)) for a in words if a for b in entries if levenshtein(a, b) <= k)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matched_payees(spark):
    book = spark.createDataFrame([("Town of Whitby", "whitby", 1), ("Whitby Hydro", "hydro", 0), ("A Whitby", "whitby", 1)], "name string, distinctive string, tolerance int")
    df = spark.createDataFrame([(1, "The Town of WHITTY."), (2, "hydro co"), (3, "hydra"), (4, None), (5, "whitby"), (6, "whxxby")], "k int, payee string")
    got = {r.k: (r.matched_name, r.matched_distance) for r in dictionary.matched(df, "payee", book).collect()}
    assert got == {1: ("A Whitby", 1), 2: ("Whitby Hydro", 0), 3: (None, None), 4: (None, None), 5: ("A Whitby", 0), 6: (None, None)}


# --- search, counters, responses, overrides ---


def test_search_by_grams(spark, tmp_path):
    names = ["Café Noir", "cafe noir", "Whitby", None, "MACHINERY 12", "ab"]
    df = spark.createDataFrame([(f"R{i}", n, f"f{i % 2}.png", None) for i, n in enumerate(names)], "record_id string, payee string, source_file string, payee_normalized string")
    at = str(tmp_path / "index")
    search.build(df, at)
    for q in ("caf", "café", "é", "r", "F1", " mach ", "zebra", "noir f", "", "R3  f1", "a", "xyzzy"):
        want = sorted(r.record_id for r in report.filtered(df, query=q).collect()) if q.strip() else [f"R{i}" for i in range(6)]
        assert sorted(r.key for r in search.found(spark, at, q).collect()) == want, q
    assert search.candidates(spark, at, "zebra").count() == 0 and search.candidates(spark, at, "") is None


def test_search_has_postings_by_block(spark, tmp_path):
    """Records that share their texts add no postings of their own; one record is found among them, and records of a block that lack the query are not."""
    df = spark.range(0, 1000, 1, 2).select(F.format_string("R%04d", "id").alias("record_id"), F.when(F.col("id") == 777, "Zébra").otherwise("Town of Whitby").alias("payee"), F.lit("a.png").alias("source_file"), F.lit(None).cast("string").alias("payee_normalized"))
    at = str(tmp_path / "index")
    search.build(df, at)
    for q in ("zéb", "é", "r0777", "r077", "whitby a", "town zébra"):
        want = sorted(r.record_id for r in report.filtered(df, query=q).collect())
        assert sorted(r.key for r in search.found(spark, at, q).collect()) == want, q
    assert spark.read.parquet(f"{at}/postings").count() < 4 * 2500


def test_counters_by_differences(spark, tmp_path):
    outcome = "struct<status:string>"
    schema = f"record_id string, verdict string, cheque_date date, rules map<string,{outcome}>"
    rng = random.Random(2)
    make = lambda ids: spark.createDataFrame([(f"R{i}", rng.choice(["VALID", "INVALID"]), None, {"payee": (rng.choice(["PASS", "FAIL"]),)}) for i in ids], schema)
    at = Store.create(spark, str(tmp_path / "s"), "record_id", make([]).schema, 4)
    counts, seen = spark.createDataFrame([], counters.SCHEMA), 0
    for batch in range(3):
        at.append(make(range(batch * 10, batch * 10 + 10)))
        version = at.merge(make(range(batch * 5, batch * 5 + 3)))
        counts, seen = counters.refreshed(at, counts, seen, version), version
        key = lambda df: sorted(tuple(r) for r in df.select("name", "item", "n").collect())
        assert key(counts) == key(counters.counted(at.read()))
    assert counters.refreshed(at, counts, seen, seen) is counts


def test_diagnoses(spark):
    rows = [
        ("a", '{"documents":[{"fields":{"PayTo":{},"Amount":{}}}]}'), ("b", '{"documents":[{"fields":{}}]}'), ("c", "no json"), ("d", None), ("e", '{"documents":[]}'), ("f", '{"documents":[{"fields":{"PayerSignatures":null}}]}'),
        ("g", '{"documents":[{"fields":{"PayerSignatures":{"type":"signature","confidence":0.5,"boundingRegions":[{},{}],"valueArray":[1],"zeta":{"x":1},"alpha":null}}}]}'),
    ]
    got = {r.k: r for r in diagnostics.report(diagnostics.diagnosed(spark.createDataFrame(rows, "k string, response string"), "response", "PayerSignatures", "k")).collect()}
    assert got["a"].text == "PayerSignatures: KEY ABSENT from response\n  fields returned: Amount, PayTo"
    for k in "bcde":
        assert got[k].text == "PayerSignatures: KEY ABSENT from response\n  fields returned: (none)"
    assert got["f"].text.endswith("fields returned: PayerSignatures")
    assert (got["g"].regions, got["g"].entries, got["g"].others) == (2, 1, ["alpha", "zeta"])
    assert got["g"].text.splitlines() == ["PayerSignatures: key present", '  type = "signature"', "  valueArray = <1 entry(ies)>", "  confidence = 0.5", "  boundingRegions = <2 region(s)>", "  other keys: alpha, zeta"]


def test_standing_overrides(spark):
    rows = [("1", "payee", "PASS", "b", "2026-01-01"), ("1", "payee", "PASS", "a", "2026-01-01"), ("1", "payee", "FAIL", "later", "2026-01-02"), ("2", "memo", "PASS", None, None), ("2", None, "PASS", "x", None)]
    df = spark.createDataFrame(rows, "record_id string, rule string, status string, evidence string, timestamp string")
    got = sorted((r.record_id, r.rule, r.status, r.evidence) for r in store.standing(df, "status", "evidence").collect())
    assert got == [("1", "payee", "FAIL", "later"), ("2", "memo", "PASS", None)]
    got = sorted((r.record_id, r.rule, r.status, r.evidence) for r in store.standing(df.drop("timestamp"), "status", "evidence").collect())
    assert got == [("1", "payee", "FAIL", "later"), ("2", "memo", "PASS", None)]
    assert records.revalidated.__doc__


# --- from files to records ---


def test_files_become_records_once(spark, tmp_path):
    import datetime
    import hashlib

    from draftlens.operators import analyze, rules
    from draftlens.operators import records as projection

    calls = {"a.png": "Town of Whitby", "b.png": "Town of Whitty", "c.png": None}

    def make():
        seen = {}

        def call(path, content):
            if path.endswith("d.png"):
                raise OSError(path)
            n = seen[path] = seen.get(path, 0) + 1
            text = "Town of Oshawa" if path.endswith("e.png") and n == 2 else calls.get(path.rsplit("/", 1)[1], "Town of Whitby")
            return {"documents": [{"fields": {"PayTo": {"content": text}}}]} if text else {"documents": []}

        return call

    files = spark.createDataFrame([(f"/in/{n}.png", c.encode(), hashlib.sha256(c.encode()).hexdigest()) for n, c in (("a", "1"), ("b", "1"), ("c", "3"), ("d", "4"), ("e", "5"))], "path string, content binary, source_hash string")
    today, time = F.lit("2026-08-17").cast("date"), F.lit("2026-08-17 09:00:00").cast("timestamp")
    fields, captured = analyze.analyzed(files, make, 2)
    assert captured.count() == 10 and captured.filter("error IS NOT NULL").count() == 2
    got = {r.source_file: r for r in fields.collect()}
    assert set(got) == {"/in/a.png", "/in/b.png", "/in/e.png"} and got["/in/e.png"].payee.status == "AMBIGUOUS" and got["/in/a.png"].n_runs == 2
    empty = projection.projected(rules.validated(fields.withColumn("record_id", F.lit("")).withColumn("processed_time", time), today), "2", "m")
    at = Store.create(spark, str(tmp_path / "s"), "record_id", empty.schema, 4)
    for want in ([("cheque_processed", "CHQ-20260817-0001", "a.png"), ("cheque_processed", "CHQ-20260817-0002", "e.png"), ("duplicate_ingestion_skipped", "CHQ-20260817-0001", "b.png")], [("duplicate_ingestion_skipped", "CHQ-20260817-0001", "a.png"), ("duplicate_ingestion_skipped", "CHQ-20260817-0001", "b.png"), ("duplicate_ingestion_skipped", "CHQ-20260817-0002", "e.png")]):
        _, events = analyze.recorded(at, fields, today, "20260817", "2", "m", time)
        assert sorted((e.event, e.record_id, e.source_file) for e in events.collect()) == want
    stored = {r.record_id: r for r in at.read().collect()}
    assert set(stored) == {"CHQ-20260817-0001", "CHQ-20260817-0002"} and stored["CHQ-20260817-0001"].processed_time == datetime.datetime(2026, 8, 17, 9)


def test_patterns(spark, tmp_path):
    from draftlens.sources.responses import expanded

    for n in ("b.json", "a.json", "c.txt"):
        (tmp_path / n).write_text("{}")
    got = expanded(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/*.json", f"{tmp_path}/none-*.json"])
    assert [g.rsplit("/", 1)[1] for g in got] == ["c.txt", "a.json", "b.json", "none-*.json"]


def test_second_reading_from_the_environment():
    from draftlens.operators.second import RecogniserConfig, SecondConfig, from_environment

    assert from_environment({}) == (SecondConfig(), RecogniserConfig())
    env = {"X_ENABLED": "off", "X_TRIGGER_POLICY": "low_confidence_only", "X_MODEL": "m", "X_LOCAL_MODEL_PATH": "/models/m", "X_DEVICE": "cpu", "X_MAX_NEW_TOKENS": "8", "X_LOCAL_FILES_ONLY": " Yes "}
    first, second = from_environment(env, "X_")
    assert not first.enabled and first.policy == "low_confidence_only"
    assert second == RecogniserConfig("/models/m", None, "cpu", 8, True, False)
    for bad in ({"X_DEVICE": "tpu"}, {"X_TRIGGER_POLICY": "sometimes"}):
        with pytest.raises(ValueError):
            from_environment(bad, "X_")
