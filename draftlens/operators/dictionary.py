"""Names against a dictionary within an edit distance, by keys that close words share.

Two words within k edits become equal after at most k letters are deleted from each, so each word gets the keys that remain when
up to k of its letters are deleted; words that share a key meet in an equi-join and their distance is then computed. No word is compared with words that
share no key, and only distinct words meet: a word of a third of all rows is one row. Words of over ``LONG`` letters have as many keys as pairs of their letters, so
they are cut into k + 1 pieces instead: k edits leave one piece whole, at most k places away. Words whose lengths allow both meet by both kinds of keys.

A null or empty name has no word and matches nothing. Distances are Levenshtein's, by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_payee, let, tokens

#: Words up to this length have deletion keys; from this length less the distance on they have pieces as well.
LONG = 24


def deletions(word: Column, k: int) -> Column:
    """The word and all that is left of it when up to k letters are deleted, each once."""
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    out = F.array(word)
    last = out
    for _ in range(k):
        step = lambda ws: F.array_distinct(F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: without(w, i))).otherwise(F.array().cast("array<string>")))))
        last = let(last, step)
        out = F.concat(out, last)
    return F.array_distinct(out)


def pieces(word: Column, k: int, reach: int) -> Column:
    """Keys of a word's k + 1 pieces; with ``reach`` of what may stand for a piece of a word up to so many letters longer or shorter, up to k places away."""
    n = F.length(word)

    def of(size: Column, shift: int) -> list[Column]:
        out = []
        for i in range(k + 1):
            start = F.floor(size * i / (k + 1)) + 1
            length = F.floor(size * (i + 1) / (k + 1)) + 1 - start
            at = start + shift
            text = F.substring(word, at.cast("int"), length.cast("int"))
            out.append(F.when((at >= 1) & (at + length - 1 <= n), F.concat_ws(":", F.lit(f"p{i}"), size.cast("string"), text)))
        return out

    keys = [c for d in range(-reach, reach + 1) for s in (range(-k, k + 1) if reach else (0,)) for c in of(n + d, s)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _keyed(words: DataFrame, word: str, k: int, reach: int) -> DataFrame:
    w = F.col(word)
    short = F.when(F.length(w) <= LONG, F.transform(deletions(w, k), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array().cast("array<string>"))
    long = F.when(F.length(w) > LONG - k, pieces(w, k, reach)).otherwise(F.array().cast("array<string>"))
    return words.select(word, F.explode(F.concat(short, long)).alias("_key"))


def near(words: DataFrame, entries: DataFrame, k: int = 2, word: str = "word", entry: str = "entry") -> DataFrame:
    """(word, entry, distance) of all distinct words and entries within k edits."""
    mine = _keyed(words.select(word).filter(F.length(word) > 0).distinct(), word, k, k)
    theirs = _keyed(entries.select(entry).filter(F.length(entry) > 0).distinct(), entry, k, 0)
    met = mine.join(theirs, "_key").filter(F.abs(F.length(word) - F.length(entry)) <= k).select(word, entry).distinct()
    return met.withColumn("distance", F.levenshtein(F.col(word), F.col(entry), k)).filter("distance >= 0")


def matched(df: DataFrame, payee: str, dictionary: DataFrame, k: int = 2, name: str = "name", distinctive: str = "distinctive", tolerance: str = "tolerance", unicode: bool = True) -> DataFrame:
    """df with ``matched_name`` and ``matched_distance``: the dictionary's entry whose distinctive word is nearest to a word of the payee.

    dictionary: (name, distinctive word in canonical form, tolerance of at most k edits). Of equally near entries the least name; null where no
    word is within an entry's tolerance. One row a payee goes through the join, so payees that repeat are matched once.
    """
    book = dictionary.select(F.col(name).alias("_name"), F.col(distinctive).alias("_entry"), F.col(tolerance).alias("_most"))
    said = df.select(F.col(payee).alias("_payee")).filter("_payee IS NOT NULL").distinct()
    said = said.withColumn("_words", F.array_distinct(tokens(canonical_payee(F.col("_payee"), unicode))))
    words = said.select("_payee", F.explode("_words").alias("_word"))
    pairs = near(words.select("_word"), book.select("_entry"), k, "_word", "_entry")
    hits = pairs.join(book, "_entry").filter(F.col("distance") <= F.col("_most"))
    best = hits.groupBy("_word").agg(F.min(F.struct("distance", "_name")).alias("_best"))
    of = words.join(best, "_word").groupBy("_payee").agg(F.min("_best").alias("_best"))
    joined = df.join(of, F.col(payee) == F.col("_payee"), "left")
    return joined.withColumn("matched_name", F.col("_best._name")).withColumn("matched_distance", F.col("_best.distance")).drop("_payee", "_best")
