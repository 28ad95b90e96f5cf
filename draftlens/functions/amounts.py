"""Amounts in figures and in words, as Column expressions over token arrays.

Nothing is guessed: an unknown word, a stray digit or a malformed figure refuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import clean, let, lookup, one_of

#: Exact money. Longer figures become null.
MONEY = "decimal(38,2)"


def corrected(token: Column) -> Column:
    """The token after the fixed table of misspellings."""
    return F.coalesce(lookup(V.MISSPELLINGS, token), token)


def _small(token: Column) -> Column:
    """Value of a ones or tens word."""
    return lookup(V.ONES | V.TENS, token)


# a word's class: the number that it stands for, or one of these
NOISE, UNKNOWN, CENT = -1, -2, -3
_CLASSES = {w: NOISE for w in V.NOISE} | V.ONES | V.TENS | V.SCALES | {"hundred": 100, "cent": CENT, "cents": CENT}
_CLASSES |= {wrong: _CLASSES[right] for wrong, right in V.MISSPELLINGS.items()}


def word_class(token: Column) -> Column:
    """Number of a number word however it is spelt, else ``NOISE``, ``CENT`` or ``UNKNOWN``: one look into one table."""
    return F.coalesce(lookup(_CLASSES, token), F.lit(UNKNOWN)).cast("bigint")


def is_number_word(token: Column) -> Column:
    return word_class(token) >= 0


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


# --- figures ------------------------------------------------------------------------------------


def figures(raw: Column, unicode: bool = True) -> Column:
    """struct<value, raw_text, status, note> of an amount in figures."""
    return let(clean(raw, unicode), lambda text: let(F.regexp_extract(F.replace(text, F.lit("$"), F.lit(" ")), r"(\d[\d,.\s]*\d|\d)", 1), lambda found: _figures(raw, text, found)))


def _figures(raw: Column, text: Column, found: Column) -> Column:
    cents = F.regexp_extract(found, r"[.,](\d{1,2})$", 1)
    digits = F.regexp_replace(F.regexp_replace(found, r"[.,]\d{1,2}$", ""), r"[,\s]", "")
    value = F.concat(digits, F.lit("."), F.rpad(F.when(cents != "", cents).otherwise(F.lit("0")), 2, "0")).try_cast(MONEY)
    shaped = found.rlike(r"^(?:\d{1,3}(?:[,\s]\d{3})+|\d+)(?:[.,]\d{1,2})?$")
    status = F.when(text == "", V.ABSENT).when(~shaped, V.UNPARSEABLE).otherwise(V.OK)
    note = F.when(text == "", None).when(found == "", "no digits found").when(~shaped, F.concat(F.lit("malformed amount "), found))
    return _struct(value=F.when(status == V.OK, value), raw_text=F.when(text == "", raw).otherwise(text), status=status, note=note)


def cents_of(value: Column) -> Column:
    return ((value * 100) % 100).cast("int")


# --- words --------------------------------------------------------------------------------------

_FOLD = "struct<total:bigint,current:bigint,seen:boolean,bad:boolean>"


def _step(acc: Column, c: Column) -> Column:
    """The automaton's transition: what is read so far, and a word's class."""
    run = F.when(acc["current"] == 0, F.lit(1).cast("bigint")).otherwise(acc["current"])
    return _struct(
        total=F.when(c >= 1000, acc["total"] + run * c).otherwise(acc["total"]),
        current=F.when(c < 0, acc["current"]).when(c < 100, acc["current"] + c).when(c == 100, run * 100).otherwise(F.lit(0).cast("bigint")),
        seen=acc["seen"] | (c >= 0),
        bad=acc["bad"] | (c <= UNKNOWN),
    )


def total_of(classes: Column) -> Column:
    """Sum of number words, given by their classes; null with an unknown word or without any."""
    zero = _struct(total=F.lit(0), current=F.lit(0), seen=F.lit(False), bad=F.lit(False)).cast(_FOLD)
    return F.aggregate(classes, zero, _step, lambda a: F.when(a["seen"] & ~a["bad"], a["total"] + a["current"]))


def words_to_int(tokens: Column) -> Column:
    """Sum of number words; null with an unknown word or without any."""
    return total_of(F.transform(tokens, word_class))


def _last(array: Column, test: Callable[[Column], Column]) -> Column:
    """Position (from 1) of the last element that passes; 0 for none."""
    return F.coalesce(F.array_max(F.transform(array, lambda x, i: F.when(test(x), i + 1).otherwise(0))), F.lit(0))


def _first(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_min(F.array_compact(F.transform(array, lambda x, i: F.when(test(x), i + 1)))), F.lit(0))


def _head(array: Column, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def _tail(array: Column, after: Column) -> Column:
    """The elements after a position."""
    return F.slice(array, after + 1, F.greatest(F.size(array) - after, F.lit(0)))


def _printed_noise(token: Column) -> Column:
    """Digits or slashes that are no dollar words: what is left of a printed numerator."""
    letters = F.regexp_extract_all(token, F.lit("[a-z]+"), F.lit(0))
    dollars = (F.size(letters) > 0) & F.forall(letters, lambda p: word_class(p) >= NOISE)
    return token.rlike(r"[\d/\\]") & ~dollars


def without_cents_suffix(lowered: Column) -> Column:
    """struct<text, found>: without the printed '.../100' and the numerator noise before it."""

    def cut(parts: Column, anchor: Column) -> Column:
        keep = _last(_head(parts, anchor - 1), lambda t: ~_printed_noise(t))
        rest = F.array_join(F.concat(_head(parts, keep), _tail(parts, anchor)), " ")
        return _struct(text=F.when(anchor > 0, rest).otherwise(lowered), found=anchor > 0)

    is_anchor = lambda t: t.rlike(r"^(?:\d{0,3}|xx|no|none|zero)?[/\\.\-]*100$")
    return let(F.array_remove(F.split(lowered, r"(?U)\s+"), ""), lambda parts: let(_last(parts, is_anchor), lambda anchor: cut(parts, anchor)))


def spelled_cents(classes: Column) -> Column:
    """struct<classes, cents>: number words before the first 'cent(s)' taken out; null if there are none."""

    def cut(at: Column, keep: Column, cents: Column) -> Column:
        good = F.coalesce((at > 0) & (keep < at - 1) & cents.between(0, 99), F.lit(False))
        rest = F.when(good, F.concat(_head(classes, keep), _tail(classes, at))).when((at > 0) & (keep >= at - 1), F.concat(_head(classes, at - 1), _tail(classes, at))).otherwise(classes)
        return _struct(classes=rest, cents=F.when(good, cents.cast("int")))

    number = lambda at, keep: total_of(F.slice(classes, keep + 1, F.greatest(at - 1 - keep, F.lit(0))))
    split = lambda at: let(_last(_head(classes, at - 1), lambda c: c < 0), lambda keep: let(number(at, keep), lambda cents: cut(at, keep, cents)))
    at = F.array_position(classes, F.lit(CENT).cast("bigint")).cast("int")
    return F.when(at > 0, let(at, split)).otherwise(_struct(classes=classes, cents=F.lit(None).cast("int")))


def _letters(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("[a-z]+"), F.lit(0))


#: The printed denominator with a slash, or a bare 100 whose slash was lost.
_SLASH = r"(\d{1,2}|none|no|xx|zero)?\s*/\s*(100|00|xx)"
_BARE = r"(\d{1,2})?[^\w]{0,4}\b100\b"


def _read_suffix(lowered: Column) -> Column:
    """struct<text, cents>: the numerator of the printed cents read and cut out."""

    def cut(whole: Column, numerator: Column) -> Column:
        at = F.call_function("locate", whole, lowered)
        rest = F.concat(F.substring(lowered, F.lit(1), at - 1), F.lit(" "), F.substring(lowered, at + F.length(whole), F.length(lowered)))
        return _struct(text=rest, cents=F.coalesce(numerator.try_cast("int"), F.lit(0)))

    take = lambda p: cut(F.regexp_extract(lowered, p, 0), F.regexp_extract(lowered, p, 1))
    return F.when(lowered.rlike(_SLASH), take(_SLASH)).when(lowered.rlike(_BARE), take(_BARE)).otherwise(_struct(text=lowered, cents=F.lit(None).cast("int")))


def in_words(raw: Column, numeric_cents: Column, unicode: bool = True) -> Column:
    """struct<value, raw_text, status, note, degraded> of an amount in words.

    With numeric_cents the printed cents suffix is dropped unread and the figure's cents
    stand in for it (degraded); without, its numerator is read.
    """
    given = numeric_cents.isNotNull()

    def stripped(lowered: Column) -> Column:
        none = F.lit(None).cast("int")
        dropped = let(without_cents_suffix(lowered), lambda s: _struct(text=s["text"], cents=none, found=s["found"]))
        read = let(_read_suffix(lowered), lambda s: _struct(text=s["text"], cents=s["cents"], found=F.lit(False)))
        return F.when(given, dropped).otherwise(read)

    def parse(text: Column, body: Column) -> Column:
        stray = F.array_join(F.regexp_extract_all(body["text"], F.lit(r"\d+"), F.lit(0)), "")
        classes = F.transform(_letters(body["text"]), word_class)
        split = let(classes, lambda c: F.when(body["cents"].isNull(), spelled_cents(c)).otherwise(_struct(classes=c, cents=body["cents"])))
        return let(split, lambda s: finish(text, stray, body["found"], s["classes"], s["cents"]))

    def finish(text: Column, stray: Column, found: Column, classes: Column, spelled: Column) -> Column:
        borrowed = spelled.isNull() & found
        cents = F.coalesce(spelled, F.when(borrowed, numeric_cents), F.lit(0))
        meaning = F.exists(classes, lambda c: c != NOISE)
        dollars = F.when(meaning, total_of(classes)).when(cents > 0, F.lit(0).cast("long"))
        return let(_struct(dollars=dollars, cents=cents, stray=stray), lambda x: result(text, x["dollars"], x["cents"], x["stray"], borrowed))

    def result(text: Column, dollars: Column, cents: Column, stray: Column, borrowed: Column) -> Column:
        status = F.when(text == "", V.ABSENT).when((stray != "") | dollars.isNull(), V.UNPARSEABLE).otherwise(V.OK)
        value = F.concat(dollars.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0")).try_cast(MONEY)
        note = F.when(text == "", None).when(stray != "", F.concat(F.lit("stray digits in word amount: "), stray)).when(dollars.isNull(), "unrecognised number words").when(borrowed, "printed cents unreadable; cents taken from the figures")
        return _struct(value=F.when(status == V.OK, value), raw_text=F.when(text == "", raw).otherwise(text), status=status, note=note, degraded=(status == V.OK) & borrowed)

    return let(clean(raw, unicode), lambda text: let(stripped(F.lower(text)), lambda body: parse(text, body)))


# --- verification against a known figure ----------------------------------------------------------


def _group(n: Column) -> Column:
    """Words of 0-999."""
    words = F.split(F.lit(",".join(V.below_thousand())), ",")  # one literal, folded
    return F.array_remove(F.split(F.element_at(words, (n + 1).cast("int")), " "), "")


def standard_form(dollars: Column) -> Column:
    parts, rest = [], dollars
    for name, size in (("billion", 10**9), ("million", 10**6), ("thousand", 10**3)):
        n = ((rest - rest % size) / size).cast("long")
        parts.append(F.when(n > 0, F.concat(_group(n % 1000), F.array(F.lit(name)))).otherwise(F.array().cast("array<string>")))
        rest = rest % size
    return F.concat(*parts, _group(rest))


def token_forms(dollars: Column) -> Column:
    """array<array<string>>: the number words that an amount may be written with."""
    standard = standard_form(F.greatest(dollars, F.lit(0)))
    hundreds = ((dollars - dollars % 100) / 100).cast("long")
    compact = F.concat(_group(hundreds % 1000), F.array(F.lit("hundred")), _group(dollars % 100))
    forms = F.when(dollars.between(1000, 9999), F.array_distinct(F.array(standard, compact))).otherwise(F.array(standard))
    return F.when(dollars <= 0, F.array(F.array(F.lit("zero")))).otherwise(forms)


_MATCH = "struct<available:array<struct<word:string,fixed:string,real:boolean>>,missing:array<string>,found:array<struct<expected:string,matched:string,distance:int>>>"


def _match_one(acc: Column, expected: Column) -> Column:
    available = acc["available"]
    exact = _first(available, lambda t: t["fixed"] == expected)
    bound = F.when(F.length(expected) <= 5, 1).otherwise(2)
    alike = lambda t: ~t["real"] & (F.abs(F.length(t["word"]) - F.length(expected)) <= bound)
    near = F.filter(F.transform(available, lambda t, i: F.when(alike(t), _struct(d=F.levenshtein(t["word"], expected), i=i + 1))), lambda x: x["d"] <= bound)

    def taken(pick: Column) -> Column:
        one = F.array(_struct(expected=expected, matched=F.get(available, pick["i"] - 1)["word"], distance=pick["d"]))
        return _struct(
            available=F.filter(available, lambda t, i: i + 1 != pick["i"]),
            missing=F.when(pick["i"] > 0, acc["missing"]).otherwise(F.concat(acc["missing"], F.array(expected))),
            found=F.when(pick["i"] > 0, F.concat(acc["found"], one)).otherwise(acc["found"]),
        ).cast(_MATCH)

    fuzzy = let(F.array_min(near), lambda b: _struct(i=F.coalesce(b["i"], F.lit(0)), d=b["d"]))
    pick = let(exact, lambda e: F.when(e > 0, _struct(i=e, d=F.lit(0))).otherwise(fuzzy))
    return let(pick, taken)


_AVAILABLE = "array<struct<word:string,fixed:string,real:boolean>>"


def _available(words: Column) -> Column:
    return F.transform(words, lambda w: _struct(word=w, fixed=corrected(w), real=is_number_word(w))).cast(_AVAILABLE)


def match_form(form: Column, available: Column) -> Column:
    """struct<available, missing, found> after looking for each word of the form once, exactly or, for no real number word, nearly."""
    zero = _struct(available=available, missing=F.array().cast("array<string>"), found=F.array()).cast(_MATCH)
    return F.aggregate(form, zero, _match_one)


_SCALE_NAMES = (*V.SCALES, "hundred")
_FOUND = "array<struct<expected:string,matched:string,distance:int>>"
_CLAIMS = "array<struct<scale:string,times:int>>"


def scale_claims(fixed: Column) -> Column:
    """array<struct<scale, times>>: multiples of scale words that a text, in words as they are spelt right, states without contradiction."""
    pairs = F.transform(fixed, lambda t, i: _struct(scale=t, times=F.when((i > 0) & one_of(t, _SCALE_NAMES), _small(F.get(fixed, i - 1)))))
    stated = F.array_distinct(F.filter(pairs, lambda p: p["times"] > 0))
    return let(stated, lambda s: F.filter(s, lambda p: F.size(F.filter(s, lambda q: q["scale"] == p["scale"])) == 1))


#: Texts without digits, and those whose only digits are in one printed '.../100'.
_NO_STRAY = r"(?U)^[^0-9]*$|^(?:[^0-9]*\s)?(?:[0-9]{0,3}|xx|no|none|zero)?[/\\.\-]*100(?:\s[^0-9]*)?$"
_SCALED = r"\b(?:" + "|".join([*_SCALE_NAMES, *(wrong for wrong, right in V.MISSPELLINGS.items() if right in _SCALE_NAMES)]) + r")\b"


def _standard_text(dollars: Column) -> Column:
    """``standard_form`` of less than 10^12 as a text; 'zero' for nothing."""
    words = F.split(F.lit(",".join(V.below_thousand())), ",")
    parts, rest = [], F.greatest(dollars, F.lit(0))
    for name, size in ((" billion", 10**9), (" million", 10**6), (" thousand", 10**3), ("", 1)):
        n = ((rest - rest % size) / size).cast("int")
        parts.append(F.when(n.between(1, 999), F.concat(F.element_at(words, n + 1), F.lit(name))))
        rest = rest % size
    return F.when(dollars <= 0, "zero").when(dollars < 10**12, F.concat_ws(" ", *parts))


def _plainly(text: Column, dollars: Column) -> Column:
    """Whether a text begins with the figure's words in their order, misspelt or not, and then names neither a scale nor stray digits: it matches, without a search."""

    def spelt(body: Column) -> Column:
        out = body
        for wrong, right in V.MISSPELLINGS.items():
            out = F.regexp_replace(out, rf"\b{wrong}\b", right)
        return F.when(body.rlike(r"\b(?:" + "|".join(V.MISSPELLINGS) + r")\b"), out).otherwise(body)

    def same(x: Column) -> Column:
        return F.startswith(x["body"], x["standard"]) & ~F.substring(x["body"], F.length(x["standard"]), F.length(x["body"])).rlike(_SCALED)

    def begins(lowered: Column) -> Column:
        body = let(F.concat(F.trim(F.regexp_replace(lowered, "[^a-z]+", " ")), F.lit(" ")), spelt)
        return let(_struct(body=body, standard=F.concat(_standard_text(dollars), F.lit(" "))), same) & lowered.rlike(_NO_STRAY)

    return F.coalesce(let(F.lower(text), begins), F.lit(False))


def verify_by_tokens(raw: Column, dollars: Column, cents: Column, evidence: bool = True) -> Column:
    """struct<outcome, found, missing, stray, claims>: matched, tokens_missing or contradiction.

    The known figure's words must all stand in the text, no stray digits may disagree with its
    cents, and no scale may be claimed that no reading of the figure has. Without evidence a text that lacks some word of each form
    is not searched: its outcome is known, what is found and missing stays null.
    """

    def judge(text: Column, words: Column, forms: Column, tried: Column) -> Column:
        least = F.array_min(F.transform(tried, lambda m, i: _struct(n=F.size(m["missing"]), i=i)))
        stray = F.regexp_extract(without_cents_suffix(F.lower(text))["text"], r"\d{1,2}", 0)
        fixed = F.transform(words, lambda w: w["fixed"])
        claims = let(F.flatten(F.transform(forms, scale_claims)), lambda allowed: F.filter(let(fixed, scale_claims), lambda c: ~F.array_contains(allowed, c)))
        parts = _struct(best=F.get(tried, least["i"]), complete=least["n"] == 0, stray=stray, claims=claims, blank=F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "")
        return let(parts, lambda x: outcome(forms, x["best"], x["complete"], x["stray"], x["claims"], x["blank"]))

    def outcome(forms: Column, best: Column, complete: Column, stray: Column, claims: Column, blank: Column) -> Column:
        disagrees = (stray != "") & F.coalesce(stray.try_cast("int") != cents, F.lit(True))
        verdict = F.when(blank | ~complete | disagrees, "tokens_missing").when(F.size(claims) > 0, "contradiction").otherwise("matched")
        none = F.array().cast("array<string>")
        return _struct(
            outcome=verdict,
            found=best["found"],
            missing=F.when(blank, F.get(forms, F.lit(0))).when(complete, none).otherwise(best["missing"]),
            stray=F.when(~blank & complete & disagrees, stray),
            claims=F.when(verdict == "contradiction", claims),
        )

    def findable(form: Column, words: Column) -> Column:
        bound = lambda x: F.when(F.length(x) <= 5, 1).otherwise(2)
        near = lambda t, x: ~t["real"] & (F.abs(F.length(t["word"]) - F.length(x)) <= bound(x)) & (F.levenshtein(t["word"], x) <= bound(x))
        return F.forall(form, lambda x: F.exists(words, lambda t: (t["fixed"] == x) | near(t, x)))

    def searched(text: Column) -> Column:
        pair = _struct(words=_available(_letters(F.lower(text))), forms=token_forms(dollars))
        search = lambda p: let(F.transform(p["forms"], lambda f: match_form(f, p["words"])), lambda tried: judge(text, p["words"], p["forms"], tried))
        if evidence:
            return let(pair, search)
        return let(pair, lambda p: F.when(F.exists(p["forms"], lambda f: findable(f, p["words"])), search(p)).otherwise(_struct(outcome=F.lit("tokens_missing"), **nothing)))

    def plain(text: Column) -> Column:
        pair = _struct(words=_letters(F.lower(text)), form=F.get(token_forms(dollars), F.lit(0)))
        found = let(pair, lambda p: F.transform(p["form"], lambda w, i: _struct(expected=w, matched=F.get(p["words"], i), distance=F.lit(0))))
        more = {"found": found, "missing": F.array().cast("array<string>")} if evidence else {}
        return _struct(outcome=F.lit("matched"), **(nothing | more))

    nothing = {"found": F.lit(None).cast(_FOUND), "missing": F.lit(None).cast("array<string>"), "stray": F.lit(None).cast("string"), "claims": F.lit(None).cast(_CLAIMS)}
    return let(F.coalesce(raw, F.lit("")), lambda text: F.when(_plainly(text, dollars), plain(text)).otherwise(searched(text)))
