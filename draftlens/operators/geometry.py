"""From polygons on a page to pixel boxes on an image, and whether a box is fit to be read alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

# fixed values: outcomes of a conversion, in order of priority
CONVERSIONS = ("INVALID_IMAGE_DIMENSIONS", "NO_POLYGON", "WRONG_PAGE", "MISSING_PAGE_INFO", "UNSUPPORTED_UNIT", "MALFORMED_POLYGON", "ZERO_AREA", "OK")
UNITS = ("pixel", "inch")


def to_pixels(regions: Column, width: Column, height: Column, pages: Column, page: Column) -> Column:
    """struct<status, bbox array<int>> of the expected page's first region.

    regions: array<struct<page, polygon>>; pages: array<struct<page, width, height, unit>>.
    Coordinates scale by image over page, round half to even and are clamped to the image.
    """
    sized = (width > 0) & (height > 0)
    some = F.filter(F.coalesce(regions, F.array().cast(_REGIONS)), lambda r: F.size(F.coalesce(r["polygon"], F.array().cast("array<double>"))) > 0)

    def judge(x: Column) -> Column:
        polygon, info = x["region"]["polygon"], x["info"]
        most, least = F.array_max(polygon), F.array_min(polygon)  # NaN is the largest of all
        odd = (F.size(polygon) < 6) | (F.size(polygon) % 2 == 1) | (F.size(F.array_compact(polygon)) < F.size(polygon)) | F.isnan(most) | (most == float("inf")) | (least == float("-inf"))
        # scaling keeps the order, so only the extremes are scaled
        halves = F.struct(F.filter(polygon, lambda v, i: i % 2 == 0).alias("x"), F.filter(polygon, lambda v, i: i % 2 == 1).alias("y"))
        ends = lambda h, n, of: [_at(f(h[n]), of / info[{"x": "width", "y": "height"}[n]], of) for f in (F.array_min, F.array_max)]
        box = let(halves, lambda h: F.array(*[c for two in zip(ends(h, "x", width), ends(h, "y", height), strict=True) for c in two]))
        no_info = info.isNull() | info["width"].isNull() | info["height"].isNull() | ~(info["width"] > 0) | ~(info["height"] > 0)
        early = (
            F.when(~F.coalesce(sized, F.lit(False)), CONVERSIONS[0]).when(x["n"] == 0, CONVERSIONS[1]).when(x["region"].isNull(), CONVERSIONS[2]).when(no_info, CONVERSIONS[3]).when(~F.coalesce(info["unit"].isin(*UNITS), F.lit(False)), CONVERSIONS[4]).when(odd, CONVERSIONS[5])
        )
        return let(F.when(early.isNull(), box), lambda b: _conversion(F.coalesce(early, F.when((F.get(b, F.lit(2)) <= F.get(b, F.lit(0))) | (F.get(b, F.lit(3)) <= F.get(b, F.lit(1))), CONVERSIONS[6]).otherwise(CONVERSIONS[7])), b))

    def parts(some: Column) -> Column:
        region = F.get(F.filter(some, lambda r: r["page"] == page), F.lit(0))
        info = F.get(F.filter(pages, lambda p: p["page"] == page), F.lit(0))
        return F.struct(F.size(some).alias("n"), region.alias("region"), info.alias("info"))

    return let(some, lambda s: let(parts(s), judge))


_REGIONS = "array<struct<page:int,polygon:array<double>>>"


def _at(v: Column, scale: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.rint(v * scale).cast("int"), (limit - 1).cast("int")))


def _conversion(status: Column, box: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "OK", box).alias("bbox"))


@dataclass(frozen=True)
class CropConfig:
    """What a crop must be like; roi: x0, y0, x1, y1 as shares of the image."""

    padding: float = 0.15
    least_area: int = 400
    most_share: float = 0.35
    least_aspect: float = 0.15
    most_aspect: float = 25.0
    roi: tuple[float, float, float, float] | None = None
    least_overlap: float = 0.3


def overlap(box: Column, roi: tuple[float, float, float, float], width: Column, height: Column) -> Column:
    """Share of the box that lies in the region of interest."""
    g = lambda i: F.get(box, F.lit(i))
    w = F.greatest(F.lit(0.0), F.least(g(2), F.lit(roi[2]) * width) - F.greatest(g(0), F.lit(roi[0]) * width))
    h = F.greatest(F.lit(0.0), F.least(g(3), F.lit(roi[3]) * height) - F.greatest(g(1), F.lit(roi[1]) * height))
    return F.try_divide(w * h, (g(2) - g(0)) * (g(3) - g(1)))


def crop(conversion: Column, width: Column, height: Column, cfg: CropConfig, turned: Column | None = None) -> Column:
    """struct<status, bbox, reasons>: not_run, rejected with all reasons, or the padded box (adjusted if it changed)."""
    box = conversion["bbox"]
    g = lambda i: F.get(box, F.lit(i))
    w, h = g(2) - g(0), g(3) - g(1)
    area = w * h
    turned = F.lit(False) if turned is None else turned
    aspect = F.try_divide(F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h))
    reasons = [F.when(area < cfg.least_area, "area too small"), F.when(area / (width * height) > cfg.most_share, "area too large"), F.when(~aspect.between(cfg.least_aspect, cfg.most_aspect), "aspect out of range")]
    if cfg.roi is not None:
        reasons.append(F.when(overlap(box, cfg.roi, width, height) < cfg.least_overlap, "outside the region of interest"))
    dx, dy = F.rint(w * cfg.padding).cast("int"), F.rint(h * cfg.padding).cast("int")
    room = F.struct(dx.alias("dx"), dy.alias("dy"))
    padded = let(room, lambda d: F.array(F.greatest(F.lit(0), g(0) - d["dx"]), F.greatest(F.lit(0), g(1) - d["dy"]), F.least(width.cast("int"), g(2) + d["dx"]), F.least(height.cast("int"), g(3) + d["dy"])))
    none = F.array().cast("array<string>")

    def result(x: Column) -> Column:
        status = F.when((conversion["status"] != "OK") | ~F.coalesce((width > 0) & (height > 0), F.lit(False)), "not_run").when(F.size(x["why"]) > 0, "rejected").when(x["padded"] == box, "accepted").otherwise("adjusted")
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s.isin("accepted", "adjusted"), x["padded"]).alias("bbox"), F.when(s == "rejected", x["why"]).otherwise(none).alias("reasons")))

    return let(F.struct(F.array_compact(F.array(*reasons)).alias("why"), padded.alias("padded")), result)
