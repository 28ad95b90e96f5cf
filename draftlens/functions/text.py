"""Text normalisation as Column expressions. Patterns are Unicode-aware ((?U))."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC, which Spark has no function for; only rows with other than ASCII characters reach Python's tables."""
    other = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfkc(other), c)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once for each row; a plain expression would be evaluated wherever it stands."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


_BUILT: dict[tuple, Column] = {}


def remembered(key: tuple, make: Callable[[], Column]) -> Column:
    """make(), built once for each key in a session: a parser is thousands of calls to the JVM, and an unresolved column fits any frame.

    The key must hold all that make depends on.
    """
    now = SparkContext._active_spark_context
    full = (now.applicationId if now else None, *key)
    if full not in _BUILT:
        if _BUILT and next(iter(_BUILT))[0] != full[0]:
            _BUILT.clear()  # of a session that has ended
        _BUILT[full] = make()
    return _BUILT[full]


def _sql(x) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, or null. The table is one literal, parsed at once."""
    text = "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")"
    return F.try_element_at(remembered(("lookup", text), lambda: F.expr(text)), key)


def one_of(c: Column, words) -> Column:
    return F.array_contains(F.expr("array(" + ", ".join(map(_sql, words)) + ")"), c)


def clean(c: Column, unicode: bool = True) -> Column:
    """NFKC, white space collapsed and trimmed; null becomes ''."""
    c = F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(nfkc(c) if unicode else c, r"(?U)\s+", " "))


def canonical_payee(c: Column, unicode: bool = True) -> Column:
    """Lower case without punctuation or a leading 'the'."""
    t = F.regexp_replace(F.lower(clean(c, unicode)), r"(?U)[^\w\s]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), "^the ", "")


def tokens(c: Column) -> Column:
    """Parts between single spaces, without empty ones."""
    return F.array_remove(F.split(c, " "), "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def within_distance(words: Column, target: str, tolerance: int) -> Column:
    """Whether some word is within the edit distance of target."""
    return F.exists(words, lambda t: F.levenshtein(t, F.lit(target)) <= tolerance)


def memo_for_comparison(c: Column, unicode: bool = True) -> Column:
    return let(F.upper(clean(c, unicode)), lambda t: F.when(t != "", t))


# fixed values: printed labels that precede a payee
PAYEE_LABELS = ("pay to the order of", "payable to the order of", "pay to the order", "pay to", "payable to")


def without_payee_label(c: Column) -> Column:
    """Without the longest printed label in front."""
    out = F.trim(c)
    cut = F.lit(0)
    for label in sorted(PAYEE_LABELS, key=len):
        cut = F.when(F.lower(out).startswith(label), len(label)).otherwise(cut)
    return F.btrim(F.substring(out, cut + 1, F.length(out)), F.lit(" :-—"))


def payee_for_comparison(c: Column, unicode: bool = True) -> Column:
    return let(canonical_payee(let(clean(c, unicode), without_payee_label), False), lambda t: F.when(t != "", t))


def python_repr(c: Column) -> Column:
    """A text in quotes as Python shows it; null shows as None."""
    body = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single = c.contains("'")
    plain = F.when(single & ~c.contains('"'), F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(plain, F.lit("None"))
