"""The second reading of doubtful fields end to end: trigger, quarter turn, box, crop, recogniser, comparison.

Everything but the recogniser is a Column expression over one row a record; its rows go through one Arrow function, so nothing is
exploded, regrouped or joined. The recogniser is injected: ``make()`` is called once for each task and gives an object with
``generate(image, field) -> (text, score)``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import in_words
from ..functions.fields import ok
from ..functions.text import let, memo_for_comparison, payee_for_comparison
from ..sources.responses import switch
from .compare import POLICIES, compared, eligible, triggered
from .geometry import CropConfig, crop, to_pixels
from .images import luma, otsu

# fixed values: what a crop may be turned into before it is read, its least width for its height, and the contrast factor
VARIANTS, LEAST_ASPECT, CONTRAST = ("rgb_normalized", "grayscale", "contrast_enhanced", "adaptive_binarized"), 3.0, 1.6
#: States of a crop that is read.
READ = ("accepted", "adjusted")
_READING = T.StructType().add("run", "string").add("raw", "string").add("score", "double").add("error", "string").add("milliseconds", "double")


class Recogniser(Protocol):
    def generate(self, image: np.ndarray, field: str) -> tuple[str | None, float | None]: ...


@dataclass(frozen=True)
class SecondConfig:
    """Which fields are read again, when, and how they are cut out."""

    enabled: bool = True
    fields: tuple[str, ...] = ("payee", "amount_words", "memo")
    policy: str = "always_on_eligible_fields"
    thresholds: dict[str, float] = field(default_factory=dict)
    crops: dict[str, CropConfig] = field(default_factory=lambda: {"amount_words": CropConfig(least_aspect=0.3, most_aspect=30.0)})
    variant: str = VARIANTS[0]
    #: The word that settles differences of payees, and its edit distance.
    expected: str = "whitby"
    tolerance: int = 2

    def __post_init__(self) -> None:
        eligible(self.fields)
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.variant not in VARIANTS:
            raise ValueError(f"unknown variant {self.variant!r}")


@dataclass(frozen=True)
class RecogniserConfig:
    """What a recogniser's maker is told; nothing here loads a model."""

    model: str = ""
    revision: str | None = None
    device: str = "auto"
    max_new_tokens: int = 32
    local_files_only: bool = False
    keep_crops: bool = False


#: Ways to choose a device.
DEVICES = ("auto", "cpu", "cuda")


def from_environment(env: Mapping[str, str], prefix: str = "SECOND_READING_", base: SecondConfig | None = None, recogniser: RecogniserConfig | None = None) -> tuple[SecondConfig, RecogniserConfig]:
    """The configurations with what variables say in place of ``base`` and ``recogniser``; variables that are not set change nothing.

    ENABLED, TRIGGER_POLICY; MODEL (LOCAL_MODEL_PATH goes before it), MODEL_REVISION, DEVICE, MAX_NEW_TOKENS, LOCAL_FILES_ONLY, DEBUG_RETAIN_CROPS.
    """
    base, recogniser = base or SecondConfig(), recogniser or RecogniserConfig()
    said = lambda name, default: env.get(prefix + name, default)
    if said("DEVICE", recogniser.device) not in DEVICES:
        raise ValueError(f"unknown device {said('DEVICE', '')!r}")
    first = replace(base, enabled=switch(env.get(prefix + "ENABLED"), base.enabled), policy=said("TRIGGER_POLICY", base.policy))
    second = replace(
        recogniser, model=said("LOCAL_MODEL_PATH", "") or said("MODEL", recogniser.model), revision=said("MODEL_REVISION", recogniser.revision), device=said("DEVICE", recogniser.device),
        max_new_tokens=int(said("MAX_NEW_TOKENS", recogniser.max_new_tokens)), local_files_only=switch(env.get(prefix + "LOCAL_FILES_ONLY"), recogniser.local_files_only),
        keep_crops=switch(env.get(prefix + "DEBUG_RETAIN_CROPS"), recogniser.keep_crops),
    )
    return first, second


def variant(rgb: np.ndarray, name: str) -> np.ndarray:
    """A crop as it is, gray, with more contrast around its mean brightness, or in black and white."""
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name!r}")
    if name == VARIANTS[0]:
        return rgb
    gray = luma(rgb).astype(np.float64)
    if name == VARIANTS[2]:
        mean = np.floor(gray.mean() + 0.5)
        gray = (mean + CONTRAST * (gray - mean)).clip(0, 255)
    elif name == VARIANTS[3]:
        gray = np.where(gray < otsu(gray.astype(np.uint8)), 0, 255)
    return np.repeat(gray.astype(np.uint8)[..., None], 3, axis=2)


def widened(rgb: np.ndarray, least: float = LEAST_ASPECT) -> np.ndarray:
    """White on both sides until the image is wide enough for its height."""
    missing = round(rgb.shape[0] * least) - rgb.shape[1]
    if missing <= 0:
        return rgb
    return np.pad(rgb, ((0, 0), (missing // 2, missing - missing // 2), (0, 0)), constant_values=255)


def turn_of(width: Column, height: Column, override: Column, detected: Column, refused: Column) -> Column:
    """struct<direction, refused>: an operator's word, nothing for a landscape image, else what the detector found or why it refused.

    detected and refused are ``direction`` and ``status`` of ``images.examined``; both null means that it was not asked.
    """
    given, flat = override.isin("CW", "CCW"), F.coalesce(width >= height, F.lit(True))
    direction = F.when(given, override).when(~flat & detected.isin("CW", "CCW"), detected)
    why = F.when(F.coalesce(given, F.lit(False)) | flat | detected.isNotNull() | refused.isNull(), None).otherwise(F.concat(F.lit("the image seems turned: "), refused))
    return F.struct(direction.alias("direction"), why.cast("string").alias("refused"))


def _comparable(name: str, raw: Column, unicode: bool) -> Column:
    if name == "amount_words":
        return let(in_words(raw, F.lit(None).cast("int"), unicode), lambda w: F.when(w["status"] == "OK", w["value"].cast("string")))
    return (payee_for_comparison if name == "payee" else memo_for_comparison)(raw, unicode)


def read(df: DataFrame, make: Callable[[], Recogniser], name: str, fields: tuple[str, ...]) -> DataFrame:
    """df (pixels, width, height, _turn, _crops struct by field) without pixels, with _readings struct by field; an error is its type's name."""
    kept = [c for c in df.columns if c != "pixels"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("_readings", T.StructType([T.StructField(f, _READING) for f in fields]))])

    def one(recogniser: Recogniser, image: Callable[[], np.ndarray], box: list[int], turn: str | None, f: str) -> tuple:
        """(run, raw, score, error, milliseconds)."""
        start = time.perf_counter()
        try:
            x0, y0, x1, y1 = box
            part = image()[y0:y1, x0:x1]
            part = np.rot90(part, 1 if turn == "CCW" else -1) if turn else part
            text, score = recogniser.generate(widened(variant(part, name)), f)
        except Exception as e:  # whatever a model raises; messages may hold the document's text
            return "failed", None, None, type(e).__name__, 1000 * (time.perf_counter() - start)
        return "completed" if text and text.strip() else "undetermined", text, score, None, 1000 * (time.perf_counter() - start)

    types = {"run": pa.string(), "raw": pa.string(), "score": pa.float64(), "error": pa.string(), "milliseconds": pa.float64()}

    def read_one(recogniser: Recogniser, pixels: pa.Array, sizes: tuple[list, list], turns: list, crops: pa.Array, f: str) -> pa.Array:
        """The readings of one field of a batch; values of rows that are not read stay in Arrow."""
        boxes, skipped = crops.field("bbox"), crops.field("skipped").to_pylist()
        states, rows = crops.field("status").to_pylist(), []
        for i, state in enumerate(states):  # an image at a time
            if state not in READ:
                rows.append(("skipped" if skipped[i] else "not_run", None, None, None, None))
                continue
            image = lambda i=i: np.frombuffer(pixels[i].as_buffer(), np.uint8).reshape(sizes[1][i], sizes[0][i], 3)
            rows.append(one(recogniser, image, boxes[i].as_py(), turns[i], f))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types.values(), strict=True)], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = None
        for batch in batches:
            crops = batch.column("_crops")
            if recogniser is None and any(s in READ for f in fields for s in crops.field(f).field("status").to_pylist()):
                recogniser = make()
            sizes, turns = (batch.column("width").to_pylist(), batch.column("height").to_pylist()), batch.column("_turn").field("direction").to_pylist()
            got = [read_one(recogniser, batch.column("pixels"), sizes, turns, crops.field(f), f) for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.StructArray.from_arrays(got, names=list(fields))], names=[*kept, "_readings"])

    return df.mapInArrow(run, schema)


def _entry(cfg: SecondConfig, f: str, unicode: bool) -> Column:
    first, second, cut = F.col(f), F.col("_readings")[f], F.col("_crops")[f]
    texts = F.struct(_comparable(f, first["raw_text"], unicode).alias("a"), _comparable(f, second["raw"], unicode).alias("b"))

    def entry(t: Column) -> Column:
        verdict = compared(ok(first), first["raw_text"], t["a"], cut["status"], second["run"], second["raw"], t["b"], F.lit(cfg.expected) if f == "payee" else None, cfg.tolerance)
        primary = F.struct(first["raw_text"].alias("raw"), t["a"].alias("normalized"), first["confidence"].alias("confidence"))
        return F.struct(primary.alias("primary"), cut.dropFields("skipped").alias("crop"), second.withField("normalized", t["b"]).alias("secondary"), verdict.alias("comparison"))

    return let(texts, entry)


def verified(df: DataFrame, cfg: SecondConfig, make: Callable[[], Recogniser], unicode: bool = True) -> DataFrame:
    """df without pixels, with ocr_verifications: map<field, struct<primary, crop, secondary, comparison>>, null if nothing is to be read again.

    df: a field struct for each of cfg.fields, ``regions`` (struct by field of array<struct<page, polygon>>), ``pages``, ``width``, ``height``,
    ``pixels`` (RGB bytes) and ``turn`` (``turn_of``). No value of df changes.
    """
    if not cfg.enabled or cfg.policy == "disabled":
        return df.drop("pixels").withColumn("ocr_verifications", F.lit(None).cast("map<string,string>"))
    broken = F.coalesce(F.length("pixels") != 3 * F.col("width") * F.col("height"), F.lit(True))
    turned = F.coalesce(F.col("turn")["direction"].isNotNull(), F.lit(False))
    none = lambda why: F.struct(F.lit("not_run").alias("status"), F.lit(None).cast("array<int>").alias("bbox"), F.array(why).alias("reasons"))

    def cut_out(f: str) -> Column:
        wanted = triggered(cfg.policy, F.lit(f), F.col(f)["confidence"], cfg.thresholds)
        box = to_pixels(F.col("regions")[f], F.col("width"), F.col("height"), F.col("pages"), F.lit(1))
        cut = let(box, lambda b: crop(b, F.col("width"), F.col("height"), cfg.crops.get(f, CropConfig()), turned))
        state = F.when(~wanted, none(F.lit("not selected by the policy"))).when(F.col("turn")["refused"].isNotNull(), none(F.col("turn")["refused"])).when(broken, none(F.lit("the image can't be read"))).otherwise(cut)
        return let(state, lambda s: F.struct(s["status"].alias("status"), s["bbox"].alias("bbox"), s["reasons"].alias("reasons"), (~wanted).alias("skipped"))).alias(f)

    crops = [cut_out(f) for f in cfg.fields]
    # crops are computed once: the recogniser is between them and their use
    cut = df.withColumn("_crops", F.struct(*crops)).withColumn("_turn", F.col("turn"))
    # pixels go to Python only for rows of which a crop is read
    some = [F.col("_crops")[f]["status"].isin("accepted", "adjusted") for f in cfg.fields]
    got = read(cut.withColumn("pixels", F.when(F.array_contains(F.array(*some), True), F.col("pixels"))), make, cfg.variant, cfg.fields)
    entries = [c for f in cfg.fields for c in (F.lit(f), _entry(cfg, f, unicode))]
    return got.withColumn("ocr_verifications", F.create_map(*entries)).drop("_crops", "_turn", "_readings")


def long(df: DataFrame, key: str = "record_id") -> DataFrame:
    """A row for each field that was to be read again, as ``evaluate`` and the reports take them."""
    # an outer generator has no filter inferred below it, into which the whole comparison would be copied
    one = df.select(key, F.explode_outer("ocr_verifications").alias("field", "v")).filter("field IS NOT NULL")
    return one.select(
        key, "field", F.col("v.crop.status").alias("crop"), F.col("v.secondary.run").alias("run"), F.col("v.comparison.status").alias("status"), F.col("v.comparison.manual_review").alias("manual_review"),
        F.col("v.primary.raw").alias("primary"), F.col("v.secondary.raw").alias("second"), F.col("v.comparison.selected").alias("selected"), F.col("v.secondary.score").alias("score"),
    )


def verification_events(df: DataFrame, at: Column) -> DataFrame:
    """Audit events of records that were read again."""
    done = df.filter(F.size("ocr_verifications") > 0)
    return done.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit("trocr_verification_backfill").alias("event"), "record_id", F.map_keys("ocr_verifications").alias("fields"))
