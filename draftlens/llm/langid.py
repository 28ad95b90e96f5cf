"""Language identification by interpolated Kneser-Ney character models, one per language.

A word, lower-cased and between two marks, is scored character by character with up to
``order - 1`` preceding characters of the same word. Every model interpolates
absolutely discounted counts with continuation counts of the shorter context, down to
a uniform distribution, so unseen characters have a probability too. All languages
share one sorted array of 64-bit n-gram hashes; beside each n-gram stand its final
probabilities, and beside each context its back-off weights, for every language.
The language with the lowest cross-entropy per character wins.

Training reads a bounded sample: documents of up to ``train_chars`` characters are taken by a hash of the text at a rate at
which a language gives about ``train_chars`` characters; copies count once, and twice ``train_chars`` is the limit. The driver fits the models on it
and sends them to the workers; their size is bounded by the sample's, whatever the table's.

The score is a calibrated probability of the choice: a logistic curve over the margin
between the two best cross-entropies, fitted on a part of the sample that the models
did not see. A text whose cross-entropy lies far beyond all that this part shows is
rejected by ``rejected`` (see ``identify``); ``op7`` only returns `und` for texts
without a letter.

Rows: a null text, or one without a letter, gives `und` and score 0. Null ids are
predicted too. Null languages teach nothing. With nothing to learn from, all is `und`. A column that has
the name of an output gives way to it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trim

ORDER = 5
TRAIN_CHARS = 1_500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
#: Words that a worker remembers.
MEMO = 150_000


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each code."""
    k = max(0, len(codes) - n + 1)
    h = np.full(k, n, np.uint64) * _M
    for i in range(n):
        h = (h ^ codes[i : i + k]) * _P
        h ^= h >> np.uint64(29)
    return h


def _marked(word: str) -> str:
    return f"\x02{word}\x03"


class Models:
    """Sorted hash arrays: n-gram hash -> log2 probability by language, context hash -> log2 back-off by language."""

    def __init__(self, words: dict[str, Counter], order: int = ORDER) -> None:
        self.order, self.langs = order, sorted(words)
        count = [self._counts(words[x]) for x in self.langs]
        width = len(self.langs)
        alphabet = {c for x in self.langs for w in words[x] for c in w} | {"\x03"}
        self.uniform = 1.0 / (len(alphabet) + 1)
        keys, probs, weights = [], [], []  # by n-gram length
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(1, order + 1):
            grams = np.unique(np.concatenate([c[n][0] for c in count])) if width else np.empty(0, np.uint64)
            prob = np.zeros((len(grams), width))
            contexts = np.unique(np.concatenate([c[n][2] for c in count])) if width else np.empty(0, np.uint64)
            gamma = np.ones((len(contexts), width))
            suffix = np.zeros(len(grams), np.uint64)
            context = np.zeros(len(grams), np.uint64)
            for i, c in enumerate(count):
                h, number, head, tail = c[n]
                at = np.searchsorted(grams, h)
                suffix[at], context[at] = tail, head
                once, twice = (number == 1).sum(), (number == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                where = np.searchsorted(contexts, head)
                total = np.bincount(where, number, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                seen = total > 0
                gamma[seen, i] = discount * kinds[seen] / total[seen]
                prob[at, i] = (number - discount) / total[where]
            below = np.full((len(grams), width), self.uniform)
            if lower is not None:  # every suffix of an n-gram is an n-gram too
                below = lower[1][np.searchsorted(lower[0], suffix)] if len(grams) else below
            prob += gamma[np.searchsorted(contexts, context)] * below
            keys.append(grams)
            probs.append(prob)
            weights.append((contexts, gamma))
            lower = (grams, prob)
        self.grams = [(k, np.log2(p).astype(np.float32)) for k, p in zip(keys, probs, strict=True)]
        self.contexts = [(c, np.log2(g).astype(np.float32)) for c, g in weights]

    def _counts(self, words: Counter) -> dict[int, tuple]:
        """By length: hashes, counts (below the longest: of different preceding characters), context hashes, suffix hashes."""
        order = self.order
        text = list(words.items())
        codes = np.concatenate([np.frombuffer(_marked(w).encode("utf-32-le"), np.uint32) for w, _ in text]).astype(np.uint64) if text else np.empty(0, np.uint64)
        sizes = np.array([len(w) + 2 for w, _ in text], np.int64)
        number = np.repeat(np.array([n for _, n in text], np.int64), sizes)
        offset = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if text else np.empty(0, np.int64)
        out: dict[int, tuple] = {}
        longer = None
        for n in range(order, 0, -1):
            last = np.flatnonzero(offset >= max(1, n - 1))  # the n-gram ends here; the opening mark is never predicted
            h = _hashes(codes, n)[last - n + 1]
            head = _hashes(codes, n - 1)[last - n + 1] if n > 1 else np.zeros(len(last), np.uint64)
            tail = _hashes(codes, n - 1)[last - n + 2] if n > 1 else np.zeros(len(last), np.uint64)
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            value = np.bincount(back, number[last], len(keys)).astype(np.int64)
            if longer is not None:
                # different characters before it; those at a word's start have none and keep their count
                start = np.zeros(len(keys), bool)
                start[back] = offset[last] == n - 1
                kinds = np.bincount(np.searchsorted(keys, longer), minlength=len(keys))
                value = np.where(start & (n > 1), value, kinds)
            longer = tail[first]
            out[n] = (keys, value, head[first], tail[first])
        return out

    def bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its code length in bits by language, and its number of predicted characters."""
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        codes = np.frombuffer("".join(map(_marked, words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(sizes) - sizes
        offset = np.arange(len(codes)) - np.repeat(begin, sizes)
        width = len(self.langs)
        cost = np.zeros((len(codes), width), np.float32)
        todo = np.arange(len(codes))[offset > 0]
        for n in range(self.order, 0, -1):
            if not len(todo):
                break
            can = offset[todo] >= max(1, n - 1)
            at = todo[can]
            keys, prob = self.grams[n - 1]
            h = _hashes(codes, n)[at - n + 1]
            where = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[where] == h if len(keys) else np.zeros(len(h), bool)
            cost[at[hit]] -= prob[where[hit]]
            miss = at[~hit]
            if len(miss):
                contexts, gamma = self.contexts[n - 1]
                c = _hashes(codes, n - 1)[miss - n + 1] if n > 1 else np.zeros(len(miss), np.uint64)
                w = np.minimum(np.searchsorted(contexts, c), max(0, len(contexts) - 1))
                known = contexts[w] == c if len(contexts) else np.zeros(len(c), bool)
                cost[miss[known]] -= gamma[w[known]]
            if n == 1:
                cost[miss] -= np.float32(np.log2(self.uniform))
            todo = np.sort(np.r_[todo[~can], miss])
        return np.add.reduceat(cost, begin, axis=0), sizes - 1


class Identifier:
    """Models with their calibration; what the workers get."""

    def __init__(self, sample: dict[str, list[str]], order: int = ORDER) -> None:
        words: dict[str, Counter] = {}
        held: list[tuple[str, str]] = []
        for lang, texts in sample.items():
            words[lang] = Counter()
            for i, x in enumerate(texts):
                if i % 5 == 4:
                    held.append((lang, x))
                else:
                    words[lang].update(split(x))
            if not words[lang]:
                for x in texts:
                    words[lang].update(split(x))
        words = {k: v for k, v in words.items() if v}
        self.models = Models(words, order)
        self.langs = self.models.langs
        self.forget()
        self.a, self.b, self.limit = 4.0, 0.0, float("inf")
        if self.langs and held:
            best, margin, entropy, letters = self.measure([x for _, x in held])
            good = np.array([self.langs[i] == lang for i, (lang, _) in zip(best, held, strict=True)])
            use = letters
            self._fit(margin[use], good[use])
            if use.any():
                # far outside of all that known languages show
                self.limit = float(max(entropy[use].max() * 1.5, np.median(entropy[use]) * 2.0))
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words: a word's row in the table of code lengths, whose last column is its characters."""
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, len(self.langs) + 1), np.float32)

    def _fit(self, margin: np.ndarray, good: np.ndarray) -> None:
        """Logistic regression of being right on the margin, with a prior count of one for each outcome."""
        if len(self.langs) < 2 or not len(margin):
            return
        x = np.r_[margin, margin.mean(), 0.0]
        y = np.r_[good.astype(float), 1.0, 0.0]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
            w = np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.a, self.b = max(0.0, float(a)), float(b)

    def _learned(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.forget()
            new = list(words)
        rows = [self.table]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            bits, n = self.models.bits(part)
            rows.append(np.column_stack([bits, n.astype(np.float32)]))
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        self.table = np.concatenate(rows)

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Best language, margin and cross-entropy in bits per character, and whether there is a letter."""
        split_texts = [split(x) if x else [] for x in texts]
        total = np.zeros((len(texts), len(self.langs)))
        chars = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):  # the words of some texts at a time
            seen: set[str] = set()
            to = at
            while to < len(texts) and (to == at or len(seen) < MEMO // 4):
                seen.update(split_texts[to])
                to += 1
            self._learned(seen)
            for i in range(at, to):
                if words := split_texts[i]:
                    got = self.table[np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                    total[i], chars[i] = got[:-1], got[-1]
            at = to
        entropy = total / np.maximum(chars, 1)[:, None]
        order = np.argsort(entropy, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = order[:, 0]
        first = entropy[rows, best]
        second = entropy[rows, order[:, 1]] if len(self.langs) > 1 else first + 1
        return best, second - first, first, chars > 0

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
        best, margin, entropy, letters = self.measure(texts)
        score = 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))
        langs = [self.langs[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
        return langs, np.where(letters, score, 0.0).tolist(), [float(e) if ok else None for e, ok in zip(entropy, letters, strict=True)], (~letters | (entropy > self.limit)).tolist()


class _Table(dict):
    """Letters and marks in lower case; all other characters part words."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c.lower() if unicodedata.category(c)[0] in "LM" else " "
        return self[code]


_LETTERS = _Table()


def split(text: str) -> list[str]:
    """Words of letters, lower-cased; a mark alone is no word."""
    return [w for w in text.translate(_LETTERS).split() if len(w) > 1 or unicodedata.category(w)[0] == "L"]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, train_chars: int = TRAIN_CHARS) -> Identifier:
    """Fit on a sample of train with about ``train_chars`` characters for each language."""
    known = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.filter(F.length("text") <= train_chars)
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return Identifier({}, order)
    # a document's own hash decides, so reruns take the same sample
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rate: Column = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, train_chars / max(1, n)))).otherwise(rate)
    # a text that was drawn counts once, whatever its copies; should the distinct texts still be too many, the least hashes stay
    drawn = known.filter(draw < rate).distinct().withColumn("place", draw)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, 0))
    sample: dict[str, list[str]] = {name: [] for name in sizes}
    for r in drawn.withColumn("chars", before).filter(F.col("chars") <= 2 * train_chars).collect():
        sample[r.lang].append(r.text)
    return Identifier({k: sorted(v) for k, v in sample.items()}, order)


def identify(docs: DataFrame, model: Identifier, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, entropy (bits per character) and rejected (no letter, or beyond the calibrated limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "entropy", "rejected")]

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for i in range(0, len(texts), 250):
                for c, x in zip(cols, m.identify([t if isinstance(t, str) else None for t in texts.iloc[i : i + 250]]), strict=True):
                    c.extend(x)
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "entropy", "rejected"), cols, strict=True)))
        m.forget()
        trim()

    keep = [i for i, c in enumerate(docs.columns) if c not in names]
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    got = rows.withColumn("found", run(F.col(f"c{docs.columns.index(text)}").cast("string")))
    return got.select(*(f"c{i}" for i in keep), *(f"found.{x}" for x in ("lang_pred", "score", "entropy", "rejected"))).toDF(*(docs.columns[i] for i in keep), *names)


def accepted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are."""
    model = fit(docs.filter(~held_out(id_col)), text, lang, **options)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = identify(rows, model, f"c{docs.columns.index(text)}")
    return found.filter(~F.col("rejected")).select(*rows.columns).toDF(*docs.columns)


def held_out(id_col: str, modulus: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy")
