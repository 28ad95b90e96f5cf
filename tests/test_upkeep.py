"""Second readings, extractor calls and the store's upkeep on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.operators import compare, evaluate, report, second, upkeep
from draftlens.sources import extractor


def test_variants_and_width():
    rgb = np.zeros((4, 6, 3), np.uint8)
    rgb[:, 3:] = 200
    assert second.widened(rgb).shape == (4, 12, 3) and (second.widened(rgb)[:, :3] == 255).all()
    assert second.widened(np.zeros((2, 9, 3), np.uint8)).shape == (2, 9, 3)
    assert set(np.unique(second.variant(rgb, "adaptive_binarized"))) == {0, 255}
    assert np.unique(second.variant(np.where(rgb > 0, 120, 80).astype(np.uint8), "contrast_enhanced")).tolist() == [68, 132]
    assert (second.variant(rgb, "grayscale") == rgb).all()
    with pytest.raises(ValueError):
        second.variant(rgb, "sepia")
    with pytest.raises(ValueError):
        second.SecondConfig(fields=("payee", "micr"))
    assert "signature" in compare.NEVER


def test_turn(spark):
    rows = [(10, 20, "CW", None, None), (20, 10, None, None, "orientation unknown"), (10, 20, None, "CCW", "ok"), (10, 20, None, None, "orientation unknown"), (10, 20, None, None, None)]
    df = spark.createDataFrame(rows, "w int, h int, o string, d string, r string")
    got = df.select(second.turn_of(*map(F.col, "whodr"[:2]), F.col("o"), F.col("d"), F.col("r")).alias("t")).collect()
    assert [(r.t.direction, r.t.refused is None) for r in got] == [("CW", True), (None, True), ("CCW", True), (None, False), (None, True)]


def test_turned_crop(spark):
    """A crop is turned before it is read: the corner of the turned image is another one."""

    class Corner:
        """Reads the brightness of the top left corner; white beside it is padding."""

        def generate(self, image, field):
            row = image[0, :, 0]
            return str(int(row[row < 255][0])), None

    image = np.zeros((40, 20, 3), np.uint8)
    image[2, 16] = 77  # top right of the box; a counter-clockwise turn brings it to the top left
    f = "struct<value:string,raw_text:string,status:string,confidence:double>"
    region = "struct<payee:array<struct<page:int,polygon:array<double>>>>"
    box = [float(x) for x in (2, 2, 17, 2, 17, 37, 2, 37)]
    rows = [
        ("a", ("77", "77", "OK", 0.9), ([(1, box)],), [(1, 20.0, 40.0, "pixel")], 20, 40, bytearray(image.tobytes()), ("CCW", None)),
        ("b", ("77", "77", "OK", 0.9), ([(1, box)],), [(1, 20.0, 40.0, "pixel")], 20, 40, bytearray(image.tobytes()), (None, "seems turned")),
        ("c", ("77", "77", "OK", 0.9), (None,), [], 20, 40, bytearray(b"\x00"), (None, None)),
    ]
    df = spark.createDataFrame(rows, f"record_id string, payee {f}, regions {region}, pages array<struct<page:int,width:double,height:double,unit:string>>, width int, height int, pixels binary, turn struct<direction:string,refused:string>")
    cfg = second.SecondConfig(fields=("payee",), crops={"payee": second.CropConfig(padding=0.0, most_share=1.0, least_area=1)})
    got = {r.record_id: r for r in second.long(second.verified(df, cfg, Corner, unicode=False)).collect()}
    assert (got["a"].status, got["a"].second) == ("AGREE_EXACT", "77")
    assert (got["b"].run, got["b"].status, got["c"].status) == ("not_run", "TROCR_NOT_RUN", "TROCR_NOT_RUN")
    off = second.verified(df, second.SecondConfig(enabled=False), Corner)
    assert "pixels" not in off.columns and off.filter("ocr_verifications IS NOT NULL").isEmpty()


def test_stem_and_old_verdict(spark):
    df = spark.createDataFrame([("/a/b.c/x.y.png",), ("plain",), (".env",)], "p string").coalesce(1)
    assert [r[0] for r in df.select(upkeep.stem(F.col("p"))).collect()] == ["x.y", "plain", ".env"]
    rules = spark.createDataFrame([({"a": ("UNABLE",)},), ({"a": ("FAIL",), "b": ("PASS",)},)], "r map<string,struct<status:string>>").coalesce(1)
    assert [r[0] for r in rules.select(upkeep.old_verdict(F.col("r"))).collect()] == ["VALID", "INVALID"]


def test_rotations_are_applied_once(spark):
    records = spark.createDataFrame([("r1", None, None, None), ("r2", None, None, None)], "record_id string, rotation struct<direction:string,confident:boolean>, rotation_direction string, rotation_confident boolean")
    turns = spark.createDataFrame([("r1", "CW", "unsure"), ("r1", "CW", "unsure"), ("r2", "north", "?"), ("r9", "CW", "?")], "record_id string, direction string, detector_note string")
    reviews = spark.createDataFrame([], "record_id string, status string")
    done = upkeep.rotated(records, turns, reviews)
    assert [(r.record_id, r.rotation.direction, r.rotation_confident) for r in done.collect()] == [("r1", "CW", True)]
    written = upkeep.rotation_reviews(done, "someone", F.lit("2026-01-01").cast("timestamp"))
    assert upkeep.rotated(records, turns, written).isEmpty()


def test_source_prefers_the_name(spark):
    records = spark.createDataFrame([("a", "x.png", "h"), ("b", "other.png", "h"), ("c", "x.png", None), ("d", "x.png", "gone")], "record_id string, source_file string, source_hash string")
    files = spark.createDataFrame([("/in/x.png", "h"), ("/in/copy.png", "h")], "path string, source_hash string")
    assert {r.record_id: r.source_path for r in upkeep.with_source(records, files).collect()} == {"a": "/in/x.png", "b": "/in/copy.png", "c": None, "d": None}


def test_extractor(spark, tmp_path):
    def make():
        def client(path, content):
            if path.endswith("bad"):
                raise OSError("secret path")
            return {"documents": []}

        return client

    files = spark.createDataFrame([("/good", bytearray(b"1"), "h1"), ("/bad", bytearray(b"2"), "h2")], "path string, content binary, source_hash string")
    got = extractor.extracted(files, make, 3)
    assert sorted((r.source_file, r.run, r.error) for r in got.collect()) == [("/bad", i, "OSError") for i in (1, 2, 3)] + [("/good", i, None) for i in (1, 2, 3)]
    assert extractor.batch_summary(files, files, got).first().asDict() == {"found": 2, "skipped": 0, "processed": 1, "errors": 1}
    extractor.capture(got, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 3


def test_scores_and_names(spark):
    df = spark.createDataFrame([("raw_generation_evidence", 0.98765), ("other", 0.5), (None, None)], "e string, s double").coalesce(1)
    assert [r[0] for r in df.select(report.score_text(F.col("e"), F.col("s"))).collect()] == ["0.988 (raw, not calibrated)", "Not calibrated", "Not calibrated"]
    assert report.script_json([{"a": "</script>"}]) == '[{"a": "<\\/script>"}]'
    truth = spark.createDataFrame([("a",), ("b",)], "record_id string")
    assert [r[0] for r in evaluate.missing(truth, truth.filter("record_id = 'a'")).collect()] == ["b"]
