"""Secrets in texts: three patterns, and character Markov models of random strings against ordinary identifiers.

The base finds assignments to names such as ``password``, access keys and hexadecimal strings by patterns. Places come
from lengths alone: ``split`` gives the text between matches and ``regexp_extract_all`` the matches, and their running sum is where
each ends. The method adds spans of a fourth kind, ``markov``: runs of ``CANDIDATE`` that touch no base span and whose characters are
likelier under a model of random strings than under one of ordinary identifiers, by more than the odds against.

Labelled samples: the base's matches are samples of random strings, one model a kind; all other runs of eight or more characters are samples of
identifiers. A model gives a character after another

    P(b | a) = (n(ab) + S * P(b)) / (n(a) + S),   P(b) = (n(b) + S * u(b)) / (n + S)

with counts over different samples, less ``RARE`` a pair (so neither a secret that no pattern finds nor its copies make themselves ordinary),
and u even over the kind's own characters, but for a hundredth that all characters share. A kind without samples is even then.
Log-likelihood ratios of all pairs of characters are whole thousandths, so sums are exact in any order; a run's
ratio is the largest of the kinds', and must exceed ln(identifiers of 16 or more / samples of random strings) + ln ``ODDS``; a run must have ``VARIED`` different characters. All is in DataFrame functions;
the driver sees the table of pairs alone, which the alphabet bounds.

Texts: null is empty; no span has the hash of the empty string. Every row is scanned whole. The models are fitted on documents of about
``SAMPLE_BYTES`` in all, drawn by a hash of the id; rows without id are drawn together. Places are code points, ends exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlens.functions.text import let

from .common import spread_of

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group of the value, least length of the value, its characters). A maximal run is long enough if and only if so many characters
#: in a row match, so the bound stands in the pattern where a shorter match hides nothing; an assignment that is too short does hide what it covers.
BASE = (
    ("assign", ASSIGN, 2, 12, "A-Za-z0-9+/_.=-"),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "A-Z0-9"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, "0-9a-f"),
)
#: Texts without any of these in lower case have no match; looking for bytes is cheaper than matching.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
KINDS = (*(k for k, *_ in BASE), "markov")
RUN = "[A-Za-z0-9+/_=-]"
LEAST = 16
#: Runs begin where none is before, so a run that is too short is not tried again from each of its characters.
CANDIDATE = rf"(?<!{RUN}){RUN}{{{LEAST},}}"
IDENTIFIER = rf"(?<!{RUN}){RUN}{{8,}}"
#: Characters of the models, by code: printable ASCII; the space stands before the first character of a string.
FIRST, WIDTH = 32, 95
SYMBOLS = 68
STRENGTH = 32
#: Pairs count as seen beyond so many times, so a secret among the identifiers doesn't teach its own characters.
RARE = 3
SHARED = 0.01
#: Bytes of text that the models are fitted on, about.
SAMPLE_BYTES = 64 << 20
#: How much likelier than not a span must be a secret.
ODDS = 100
#: Runs of fewer different characters are rulers and fillers.
VARIED = 6
#: Elements that running sums add up at a time.
CHUNK = 256


def running_sums(x: Column) -> Column:
    """Sums of the first one, two, ... elements of an array; chunk by chunk, so arrays are not copied for each element."""

    def along(part: Column, base: Column) -> Column:
        zero = F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(part, zero, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["all"], F.array(a["sum"] + v)).alias("all")), lambda a: a["all"])

    def chunked(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(CHUNK))
        parts = F.transform(starts, lambda s: F.slice(v, s + 1, CHUNK))
        total = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return let(parts, lambda p: let(along(F.transform(p, total), F.lit(0).cast("bigint")), lambda sums: F.flatten(F.transform(p, lambda part, i: along(part, F.coalesce(F.get(sums, i - 1), F.lit(0).cast("bigint")))))))

    return let(F.transform(x, lambda v: v.cast("bigint")), chunked)


def hinted(text: Column, kind: str) -> Column:
    """Whether a text may have a match of the kind."""
    out = F.lit(kind not in HINTS)
    for part in HINTS.get(kind, ()):
        out = out | F.contains(F.lower(text), F.lit(part))
    return out


def located(text: Column, pattern: str, group: int = 0, least: int = 0, may: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, leftmost and not overlapping, whose value is long enough."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))

    def spans(m: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(m)), m, lambda gap, x: F.length(gap) + F.length(x))
        pairs = F.zip_with(running_sums(steps), m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end")))
        return F.zip_with(pairs, F.regexp_extract_all(text, p, F.lit(group)) if group else m, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    all_ = F.when(text.rlike(pattern) if may is None else may & text.rlike(pattern), let(found, spans)).otherwise(none)
    return F.filter(all_, lambda s: F.length(s["value"]) >= least) if least else all_


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array of spans for each kind of ``BASE``, named by the kind."""
    return docs.withColumns({kind: located(F.col(text), pattern, group, least, hinted(F.col(text), kind)) for kind, pattern, group, least, _ in BASE})


# --- models ------------------------------------------------------------------------------------


def _pairs(value: Column) -> Column:
    """Numbers of the pairs of adjacent characters, the first of them after a space."""
    code = lambda c: F.ascii(c) - FIRST
    return let(F.split(value, ""), lambda cs: F.transform(F.filter(cs, lambda c: c != ""), lambda c, i: F.when(i == 0, F.lit(0)).otherwise(code(F.get(cs, i - 1))) * WIDTH + code(c)))


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value): the base's matches by kind, and identifiers (kind ``ordinary``)."""
    clean = F.col(text)
    for _, pattern, *_ in BASE:
        clean = F.regexp_replace(clean, pattern, " ")
    found = with_base(docs, text)
    clean = F.when(sum((F.size(kind) for kind, *_ in BASE), F.lit(0)) > 0, clean).otherwise(F.col(text))
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    base = [named(kind, F.col(kind)["value"]) for kind, *_ in BASE]
    return found.select(F.inline(F.concat(*base, named("ordinary", F.regexp_extract_all(clean, F.lit(IDENTIFIER), F.lit(0))))))


def ratios(labelled: DataFrame) -> tuple[dict[str, list[int]], int]:
    """For each kind of random string the log-likelihood ratios of all pairs, in thousandths; and the ratio that a string must exceed."""
    spark = labelled.sparkSession
    labelled = labelled.distinct()
    counted = labelled.select("kind", F.explode(_pairs(F.col("value"))).alias("i")).groupBy("kind", "i").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("n", F.greatest(F.col("n") - RARE, F.lit(0)))
    kinds = [*(k for k, *_ in BASE), "ordinary"]
    grid = spark.range(WIDTH * WIDTH).select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.col("id").cast("int").alias("i"))
    n = grid.join(counted, ["kind", "i"], "left").fillna(0, ["n"]).withColumns({"a": F.floor(F.col("i") / WIDTH), "b": F.col("i") % WIDTH})
    own = F.lit(False)
    for kind, *_, chars in BASE:
        own = own | ((F.col("kind") == kind) & F.char(F.col("b") + FIRST).rlike(f"[{chars}]"))
    size = F.element_at(F.create_map(*[F.lit(x) for k, *_, c in BASE for x in (k, _count(c))]), F.col("kind"))
    even = F.when(F.col("kind") == "ordinary", F.lit(1.0 / SYMBOLS)).otherwise(F.when(own, (1 - SHARED) / size).otherwise(F.lit(0.0)) + SHARED / SYMBOLS)
    over = lambda *c: F.sum("n").over(Window.partitionBy("kind", *c))
    single = (over("b") + STRENGTH * even) / (over() + STRENGTH)
    p = n.withColumn("p", (F.col("n") + STRENGTH * single) / (over("a") + STRENGTH))
    wide = p.groupBy("i").agg(*[F.max(F.when(F.col("kind") == k, F.col("p"))).alias(k) for k in kinds])
    table = wide.select("i", *[F.floor(1000 * (F.ln(k) - F.ln("ordinary")) + 0.5).cast("int").alias(k) for k in kinds[:-1]]).orderBy("i").collect()
    seen = labelled.agg(F.count_if((F.col("kind") == "ordinary") & (F.length("value") >= LEAST)).alias("ordinary"), F.count_if(F.col("kind") != "ordinary").alias("random")).first()
    least = max(0.0, log((seen["ordinary"] + 1) / (seen["random"] + 1))) + log(ODDS)
    return {k: [r[k] for r in table] for k in kinds[:-1]}, int(1000 * least)


def _count(chars: str) -> int:
    """How many characters a bracket's content stands for."""
    import re

    return sum(bool(re.match(f"[{chars}]", chr(c))) for c in range(FIRST, FIRST + WIDTH))


def ratio(value: Column, tables: dict[str, list[int]]) -> Column:
    """The largest log-likelihood ratio of a string, in thousandths."""
    known = {k: F.split(F.lit(",".join(map(str, t))), ",").cast("array<bigint>") for k, t in tables.items()}
    zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in known])
    return F.aggregate(_pairs(value), zero, lambda a, i: F.struct(*[(a[k] + F.get(t, i)).alias(k) for k, t in known.items()]), lambda a: F.greatest(*[a[k] for k in known]))


# --- scan --------------------------------------------------------------------------------------


def sampled(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents of about ``SAMPLE_BYTES`` in all."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return docs if size <= SAMPLE_BYTES else docs.filter(spread_of(id_col) < SAMPLE_BYTES / size)


def _joined(spans: Column) -> Column:
    """kind:start:end of (start, kind's number, end), by start and kind, with commas between."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, the number of spans of each base kind, ``base``, ``spans``): both arrays of (start, kind's number, end) in order."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tables, least = ratios(samples(sampled(plain, "id", "text")))
    found = with_base(plain).withColumn("run", located(F.col("text"), CANDIDATE)).drop("text")
    mark = lambda spans, no: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind"), s["end"].alias("end")))
    base = F.concat(*[mark(F.col(kind), no) for no, (kind, *_) in enumerate(BASE)])
    found = found.withColumn("base", base)
    varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= VARIED
    clear = F.filter("run", lambda r: varied(r["value"]) & ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    likely = F.filter(clear, lambda r: ratio(r["value"], tables) > least)
    return found.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE], "base", F.concat("base", mark(likely, len(BASE))).alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: spans of secrets in every document."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
