"""What an extractor returned for a field, from the response as a VARIANT.

``parse_json`` keeps every key and type of a response, known or not; paths are read with ``variant_get``, and keys and sizes of objects and lists from
``map<string, variant>`` and ``array<variant>``. A response that is no JSON has no document; one without the field names what came instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

# fixed values: the keys of a signature field that are known
KNOWN = ("type", "valueSignature", "value_signature", "valueSelectionMark", "value", "valueBoolean", "valueArray", "content", "confidence", "boundingRegions", "bounding_regions")
REGIONS = ("boundingRegions", "bounding_regions")
LIST = "valueArray"


def _entries(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string, variant>"), F.expr("map()").cast("map<string, variant>"))


def _shown(key: Column, value: Column) -> Column:
    """A value as text: lists of regions and entries by their size, everything else as JSON."""
    size = F.size(F.try_variant_get(value, "$", "array<variant>"))
    is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    counted = F.when(key.isin(*REGIONS), F.concat(F.lit("<"), size.cast("string"), F.lit(" region(s)>"))).when(key == LIST, F.concat(F.lit("<"), size.cast("string"), F.lit(" entry(ies)>")))
    return F.when(is_list & key.isin(*REGIONS, LIST), counted).otherwise(F.to_json(value))


def diagnosed(df: DataFrame, response: str = "response", field: str = "PayerSignatures", *keep: str) -> DataFrame:
    """(keep..., present, returned, known, others, regions, entries): one row for each response.

    returned: names of the first document's fields, sorted, if the field is absent. known: map of known keys to their values as text.
    others: unknown keys, sorted. regions, entries: sizes of the lists of regions and values, null without one.
    """
    doc = F.try_variant_get(F.try_parse_json(F.col(response)), "$.documents[0].fields", "variant")
    at = df.select(*keep, _entries(doc).alias("_fields"))
    at = at.select(*keep, "_fields", F.try_element_at("_fields", F.lit(field)).alias("_field"))
    # JSON's null is as good as no field
    at = at.withColumn("_field", F.when(~F.is_variant_null("_field"), F.col("_field"))).withColumn("_keys", _entries(F.col("_field")))
    size = lambda names: F.coalesce(*[F.size(F.try_variant_get(F.try_element_at("_keys", F.lit(n)), "$", "array<variant>")) for n in names])
    present = F.col("_field").isNotNull()
    known = let(F.map_filter("_keys", lambda k, v: k.isin(*KNOWN)), lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["key"], _shown(e["key"], e["value"])))))
    return at.select(
        *keep, present.alias("present"), F.when(~present, F.array_sort(F.map_keys("_fields"))).alias("returned"), known.alias("known"),
        F.array_sort(F.filter(F.map_keys("_keys"), lambda k: ~k.isin(*KNOWN))).alias("others"), size(REGIONS).alias("regions"), size((LIST,)).alias("entries"),
    )


def report(diagnosed_rows: DataFrame, field: str = "PayerSignatures") -> DataFrame:
    """With ``text``: the diagnosis as lines."""
    absent = F.concat(F.lit(f"{field}: KEY ABSENT from response\n  fields returned: "), F.when(F.size("returned") > 0, F.array_join("returned", ", ")).otherwise("(none)"))
    lines = F.transform(F.array(*map(F.lit, KNOWN)), lambda k: F.when(F.map_contains_key("known", k), F.concat(F.lit("  "), k, F.lit(" = "), F.try_element_at("known", k))))
    others = F.when(F.size("others") > 0, F.concat(F.lit("  other keys: "), F.array_join("others", ", ")))
    here = F.array_join(F.concat(F.array(F.lit(f"{field}: key present")), F.array_compact(lines), F.array_compact(F.array(others))), "\n")
    return diagnosed_rows.withColumn("text", F.when(F.col("present"), here).otherwise(absent))
