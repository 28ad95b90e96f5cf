"""Sources: extractor responses (JSON), the record store, images with their resolution, configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.fields import SIGNED

_REGION = "array<struct<pageNumber:int,page_number:int,polygon:array<double>>>"
FIELD = f"struct<type:string,valueString:string,value_string:string,content:string,valueDate:string,value_date:string,value:string,valueSignature:string,value_signature:string,valueSelectionMark:string,valueBoolean:boolean,value_boolean:boolean,valueArray:array<string>,value_array:array<string>,confidence:double,boundingRegions:{_REGION},bounding_regions:{_REGION}>"
RESPONSE = f"struct<documents:array<struct<fields:map<string,{FIELD}>>>,pages:array<struct<pageNumber:int,width:double,height:double,unit:string>>>"
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".heif")


def expanded(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The paths that patterns match, sorted within each pattern, patterns in the given order; one that matches nothing stays as it is.

    The driver lists names, as any read of files does.
    """
    jvm = spark._jvm
    out: list[str] = []
    for pattern in patterns:
        p = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        out += sorted(h.getPath().toString() for h in hits) if hits else [pattern]
    return out


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses, one file each, with their path."""
    schema = T._parse_datatype_string(RESPONSE)
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())


def files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (*IMAGES, ".json")) -> DataFrame:
    """Files of a folder by suffix, whatever its case, with their SHA-256."""
    found = spark.read.format("binaryFile").load(folder)
    return found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)).select("path", "length", "content", F.sha2("content", 256).alias("source_hash"))


def text_of(f: Column) -> Column:
    """The first text that is not blank, untrimmed."""
    keys = ("valueString", "value_string", "content", "valueDate", "value_date", "value")
    return F.coalesce(*[F.when(F.trim(F.regexp_replace(f[k], r"(?U)\s+", " ")) != "", f[k]) for k in keys])


def regions_of(f: Column) -> Column:
    """array<struct<page, polygon>>; an empty list falls through to the other spelling."""
    regions = F.coalesce(F.when(F.size(f["boundingRegions"]) > 0, f["boundingRegions"]), f["bounding_regions"])
    return F.transform(regions, lambda r: F.struct(F.coalesce(r["pageNumber"], r["page_number"]).alias("page"), r["polygon"].alias("polygon")))


def signed_of(f: Column) -> Column:
    """The signature verdict: strings, then booleans, then entries, then a region; null if the field says nothing."""
    signed = None
    for k in ("valueSignature", "value_signature", "valueSelectionMark"):
        one = F.when(f[k].isNotNull(), F.lower(F.trim(f[k])).isin(*SIGNED))
        signed = one if signed is None else F.coalesce(signed, one)
    flag = F.when(F.lower(f["value"]).isin("true", "false"), F.lower(f["value"]) == "true")
    entries = F.when(F.size(f["valueArray"]) > 0, True).when(F.size(f["value_array"]) >= 0, F.size(f["value_array"]) > 0)
    region = F.when(F.size(regions_of(f)) > 0, True)
    return F.coalesce(signed, flag, f["valueBoolean"], f["value_boolean"], entries, region)


def raw_fields(df: DataFrame) -> DataFrame:
    """df of responses with the raw inputs of the six fields and their confidence; without a document all are null and error says so."""
    fields = F.try_element_at(F.col("documents"), F.lit(1))["fields"]
    one = {v: F.try_element_at(fields, F.lit(k)) for k, v in V.FIELD_NAMES.items()}
    raw = {"payee_raw": "payee", "figures_raw": "amount_numeric", "words_raw": "amount_words", "date_raw": "cheque_date", "memo_raw": "memo"}
    out = df.withColumn("error", F.when(fields.isNull(), "no document detected"))
    for name, field in raw.items():
        out = out.withColumn(name, text_of(one[field]))
    out = out.withColumn("confidence", F.struct(*[one[v]["confidence"].cast("double").alias(v) for v in V.FIELD_NAMES.values()]))
    return out.withColumn("signed", signed_of(one["signature"])).withColumn("memo_present", one["memo"].isNotNull())


def unexpected_fields(df: DataFrame) -> DataFrame:
    """Names of returned fields that nothing reads, sorted."""
    fields = F.try_element_at(F.col("documents"), F.lit(1))["fields"]
    return df.select("source_file", F.array_sort(F.array_except(F.map_keys(fields), F.array(*map(F.lit, V.FIELD_NAMES)))).alias("unexpected"))


def store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A record store; a missing one is empty, a broken one fails."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def resolution(content: Column) -> Column:
    """struct<dpi, source> from a JFIF density or a PNG pHYs chunk; 300 if there is none."""
    h = F.hex(content)
    at = F.locate("4A46494600", h)  # JFIF marker
    number = lambda pos, n: F.conv(F.substring(h, pos, F.lit(n)), 16, 10).try_cast("double")
    unit, x = number(at + 14, 2), number(at + 16, 4)
    jfif = F.when((at > 0) & (unit == 1) & (x > 0), x).when((at > 0) & (unit == 2) & (x > 0), x * 2.54)
    phys = F.locate("70485973", h)
    png = F.when((phys > 0) & (number(phys + 24, 2) == 1), F.round(number(phys + 8, 8) * 0.0254, 0))
    dpi = F.coalesce(jfif, png)
    return F.struct(F.coalesce(dpi, F.lit(300.0)).alias("dpi"), F.when(dpi.isNull(), "fallback").otherwise("jfif").alias("source"))


def switch(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def dotenv(text: str, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; what the environment has already wins."""
    env = os.environ if env is None else env
    out = {}
    for line in text.lstrip("﻿").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#") and key.strip() not in env:
            out[key.strip()] = value.strip().strip("'\"")
    return out
