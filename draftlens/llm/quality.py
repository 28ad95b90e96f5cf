"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` states what is counted in a text, ``RULES`` which of it, or which ratio of two
of it, must lie between which bounds. ``kept`` compiles the table into one Boolean column.
Everything is built from Spark's own functions; no user function runs.

Repeated five-word windows are found per text: windows are hashed, and only where some
hash comes twice the (hash, place) pairs are sorted; a word is counted if one of
the windows that cover it comes twice. All of it is linear or n log n in the text's length.

Rows: a null or empty text has no words and fails. Nothing depends on other rows, so ties,
repeated rows and skew do not matter. Names of existing columns are kept; the measures
are computed in a struct beside them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: Common words of running text in the languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "de", "la", "le", "les", "et", "des", "un", "en", "que", "el", "los", "y", "der", "die", "und", "das", "den", "von", "zu", "mit")


class Rule(NamedTuple):
    """Passes if least * whole - slack <= part <= most * whole (whole None: 1); a bound of None does not bind.

    The slack keeps ratios from binding in texts of a few words.
    """

    name: str
    part: str
    whole: str | None
    least: float | None
    most: float | None
    slack: float = 0.0


#: The first two are the base; the others are this operator's own.
BASE = (Rule("enough words", "n_words", None, 10, None), Rule("few repeated words", "n_repeat_words", "n_words", None, 0.2))
RULES = (
    *BASE,
    Rule("not endless", "n_words", None, None, 100_000),
    Rule("word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("few symbols", "n_symbols", "n_words", None, 0.3),
    Rule("some stop words", "n_stop_words", "n_words", 0.03, None, 2.0),
    Rule("few repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _hashes(words: Column) -> Column:
    """Hashes of the windows of WINDOW words."""
    n = F.size(words) - WINDOW
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))


def _covered(pairs: Column) -> Column:
    """Words covered by windows whose hash comes twice or more; pairs: sorted (hash, place)."""
    twice = F.filter(pairs, lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]))
    places = F.sort_array(F.transform(twice, lambda p: p["i"]))
    return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"])


def measured(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """docs with a struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words (long)."""
    names_all = docs.columns
    docs, names = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [c for c in docs.columns if c != out]
    kept = [f"c{i}" for i, c in enumerate(names_all) if c != out]
    body = F.coalesce(F.col(f"c{names_all.index(text)}").cast("string"), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    staged = docs.withColumn("_words", words).withColumn("_lines", lines)
    staged = staged.withColumn("_hashes", _hashes(F.col("_words")))
    w, h = F.col("_words"), F.col("_hashes")
    # a column of its own, as a lambda would sort anew for each element
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    staged = staged.withColumn("_pairs", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_pairs").isNull(), F.lit(0)).otherwise(_covered(F.col("_pairs"))),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
    }
    return staged.select(*kept, F.struct(*[c.cast("long").alias(n) for n, c in found.items()])).toDF(*names, out)


def passes(rules: tuple[Rule, ...], measure: str = "measures") -> Column:
    """The rules as one condition; products instead of ratios, so nothing is divided by zero."""
    out = F.lit(True)
    for r in rules:
        part = F.col(f"{measure}.{r.part}").cast("double")
        whole = F.col(f"{measure}.{r.whole}").cast("double") if r.whole else F.lit(1.0)
        if r.least is not None:
            out = out & (part >= whole * r.least - r.slack)
        if r.most is not None:
            out = out & (part <= whole * r.most)
    return out


def base_failed(measure: str = "measures") -> Column:
    n, again = F.col(f"{measure}.n_words"), F.col(f"{measure}.n_repeat_words")
    return (n < 10) | (100 * again > 20 * n)


def filtered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = measured(plain, f"c{docs.columns.index(text)}", "q")
    return found.filter(~base_failed("q") & passes(rules, "q")).select(*plain.columns).toDF(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: measures and verdict of every document."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    m = lambda n: F.col(f"measures.{n}").alias(n)
    return docs.select("doc_id", *map(m, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed().alias("base_failed"), (~base_failed() & passes(RULES)).alias("kept"))


def _sql_rule(r: Rule) -> str:
    whole = r.whole or "1"
    return " AND ".join([*([f"{r.part} >= {whole} * {r.least}::DOUBLE - {r.slack}::DOUBLE"] if r.least is not None else []), *([f"{r.part} <= {whole} * {r.most}::DOUBLE"] if r.most is not None else [])])


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times
  FROM (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win WHERE times > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d) LEFT JOIN rep USING (doc_id)
), v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"({_sql_rule(r)})" for r in RULES)} AS kept
FROM v
"""
