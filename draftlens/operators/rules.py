"""Five rules with three outcomes, and the verdict. PASS needs evidence; doubt is UNABLE, never FAIL."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.amounts import cents_of, verify_by_tokens
from ..functions.dates import months_between
from ..functions.fields import ok
from ..functions.text import let, python_repr, remembered, tokens, within_distance


@dataclass(frozen=True)
class Config:
    """Parameters of the rules; literals in the plan."""

    expected_payee: str = "Town of Whitby"
    payee_tolerance: int = 2
    amount_tolerance: Decimal = Decimal("0.00")
    max_age_months: int = 6
    reject_postdated: bool = False
    #: Without evidence only statuses and confidences are computed, which is what counts and verdicts need.
    evidence: bool = True

    def outcome(self, status: Column | str, evidence: Column, confidence: Column | None = None) -> Column:
        return outcome(status, evidence if self.evidence else F.lit(None).cast("string"), confidence)

    @property
    def distinctive(self) -> str:
        """The payee's longest word that is no generic one; the first on ties."""
        words = "".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in self.expected_payee.lower()).split()
        words = words[1:] if words[:1] == ["the"] else words
        return max([w for w in words if w not in V.GENERIC_PAYEE_WORDS] or words, key=len)


def outcome(status: Column | str, evidence: Column, confidence: Column | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.struct(status.alias("status"), evidence.alias("evidence"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"))


def _unable(f: Column, cfg: Config) -> Column:
    reason = F.coalesce(f["note"], F.when(f["status"] == V.ABSENT, "not returned").when(f["status"] == V.UNPARSEABLE, "could not be parsed").otherwise("ambiguous"))
    raw = F.when(F.coalesce(f["raw_text"].cast("string"), F.lit("")) != "", F.concat(F.lit(" (raw: "), python_repr(f["raw_text"].cast("string")), F.lit(")"))).otherwise("")
    return cfg.outcome(V.UNABLE, F.concat(reason, raw))


def disagreed(f: Column) -> Column:
    """Repeated reads that differ leave an ambiguous field without a value."""
    return (f["status"] == V.AMBIGUOUS) & f["value"].isNull()


def _disagreed(f: Column, what: str, cfg: Config) -> Column:
    return cfg.outcome(V.UNABLE, F.concat(F.lit(f"repeated reads disagreed on the {what}: "), F.coalesce(f["note"], F.lit(""))), f["confidence"])


def payee_rule(f: Column, cfg: Config) -> Column:
    near = within_distance(tokens(f["value"]), cfg.distinctive, cfg.payee_tolerance)
    text = python_repr(f["raw_text"])
    return (
        F.when(disagreed(f), _disagreed(f, "payee", cfg))
        .when(~ok(f), _unable(f, cfg))
        .when(near, cfg.outcome(V.PASS, F.concat(text, F.lit(f" names {cfg.expected_payee!r}")), f["confidence"]))
        .otherwise(cfg.outcome(V.FAIL, F.concat(text, F.lit(f" does not name {cfg.expected_payee!r}")), f["confidence"]))
    )


def amount_rule(num: Column, words: Column, cfg: Config) -> Column:
    """Figures against words: agreement passes; only then are the figure's words looked for in the text.

    A figure of cents alone has no number word that could be looked for ("zero" says no more than that there are no dollars), so nothing is matched for it.
    """
    figure = F.concat(F.lit("figures $"), num["value"].cast("string"))
    match = verify_by_tokens(words["raw_text"], num["value"].cast("long"), cents_of(num["value"]), cfg.evidence)
    close = F.abs(num["value"] - words["value"]) <= F.lit(cfg.amount_tolerance)
    cents_alone = (num["value"] > 0) & (num["value"] < 1)

    def fallback(m: Column, otherwise: Column) -> Column:
        claims = F.array_join(F.transform(m["claims"], lambda c: F.concat(c["times"].cast("string"), F.lit(" "), c["scale"])), ", ")
        return (
            F.when((m["outcome"] == "matched") & ~cents_alone, cfg.outcome(V.PASS, F.concat(figure, F.lit(" == words — resolved by token-match"))))
            .when(m["outcome"] == "contradiction", cfg.outcome(V.FAIL, F.concat(figure, F.lit(" but the words state "), claims)))
            .otherwise(otherwise)
        )

    unread = cfg.outcome(V.UNABLE, F.concat(figure, F.lit(" but the written amount could not be read: "), F.coalesce(words["note"], words["status"])), words["confidence"])
    both = F.concat(figure, F.when(words["value"] == num["value"], " == words $").otherwise(" != words $"), words["value"].cast("string"))
    differs = F.when(words["degraded"], cfg.outcome(V.UNABLE, F.concat(both, F.lit(" after a repair; does not corroborate")))).otherwise(cfg.outcome(V.FAIL, both))
    return (
        F.when(disagreed(num), _disagreed(num, "numeric amount", cfg))
        .when(~ok(num), _unable(num, cfg))
        .when(disagreed(words), cfg.outcome(V.UNABLE, F.concat(figure, F.lit(" but repeated reads disagreed on the words: "), F.coalesce(words["note"], F.lit(""))), words["confidence"]))
        .when(~ok(words), let(match, lambda m: fallback(m, unread)))
        .when(close & words["degraded"], cfg.outcome(V.PASS, F.concat(both, F.lit(" — resolved by corroboration"))))
        .when(close, cfg.outcome(V.PASS, both))
        .otherwise(let(match, lambda m: fallback(m, differs)))
    )


def signature_rule(f: Column, cfg: Config = Config()) -> Column:
    return (
        F.when(f["status"] == V.AMBIGUOUS, cfg.outcome(V.UNABLE, F.concat(F.lit("signature verdict unreliable: "), F.coalesce(f["note"], F.lit("orientation unknown"))), f["confidence"]))
        .when(~ok(f), _unable(f, cfg))
        .when(f["value"], cfg.outcome(V.PASS, F.lit("signature detected"), f["confidence"]))
        .otherwise(cfg.outcome(V.FAIL, F.lit("no signature detected"), f["confidence"]))
    )


def date_rule(f: Column, today: Column, cfg: Config) -> Column:
    note = F.when(f["note"].isNull(), "").when(f["status"] == V.AMBIGUOUS, F.concat(F.lit(" [ambiguous: "), f["note"], F.lit("]"))).otherwise(F.concat(F.lit(" ["), f["note"], F.lit("]")))
    day = f["value"].cast("string")
    old = F.concat(day, F.lit(" is stale-dated ("), months_between(today, f["value"]).cast("string"), F.lit(f" months old, limit {cfg.max_age_months})"), note)
    later = F.concat(day, F.lit(" is post-dated (today "), today.cast("string"), F.lit(")"), note)
    return (
        F.when(disagreed(f), _disagreed(f, "date", cfg))
        .when(~ok(f), _unable(f, cfg))
        .when(f["value"] < F.add_months(today, -cfg.max_age_months), cfg.outcome(V.FAIL, old, f["confidence"]))
        .when(f["value"] > today, cfg.outcome(V.FAIL if cfg.reject_postdated else V.PASS, later, f["confidence"]))
        .otherwise(cfg.outcome(V.PASS, F.concat(day, F.lit(f" is within {cfg.max_age_months} months"), note), f["confidence"]))
    )


def memo_rule(f: Column, cfg: Config = Config()) -> Column:
    return F.when(disagreed(f), _disagreed(f, "memo", cfg)).when(ok(f), cfg.outcome(V.PASS, F.concat(F.lit("memo present: "), python_repr(f["raw_text"])), f["confidence"])).otherwise(_unable(f, cfg))


def verdict(rules: Column) -> Column:
    """FAIL beats UNABLE beats clean. rules: map of rule id to outcome."""
    has = lambda s: F.exists(F.map_values(rules), lambda r: r["status"] == s)
    return F.when(has(V.FAIL), V.INVALID).when(has(V.UNABLE), V.REVIEW).otherwise(V.VALID)


#: The fields that each rule judges.
_FIELDS = {"payee": ("payee",), "amount_match": ("amount_numeric", "amount_words"), "signature": ("signature",), "date": ("cheque_date",), "memo": ("memo",)}


def judged(df: DataFrame, today: Column, cfg: Config | None = None, only: tuple[str, ...] = V.RULES) -> DataFrame:
    """df with rules, a map in rule order of the rules in ``only``; df has the fields that they judge, others are not evaluated."""
    cfg = cfg or Config()
    names = [r for r in V.RULES if r in only]

    def each(d: Column) -> Column:
        made = {
            "payee": lambda: payee_rule(d["payee"], cfg), "amount_match": lambda: amount_rule(d["amount_numeric"], d["amount_words"], cfg), "signature": lambda: signature_rule(d["signature"], cfg),
            "date": lambda: date_rule(d["cheque_date"], today, cfg), "memo": lambda: memo_rule(d["memo"], cfg),
        }
        return F.create_map(*[x for k in names for x in (F.lit(k), made[k]())])

    # one value for the optimizer, which would copy the rules' expressions to every use of a status otherwise
    def rules() -> Column:
        return let(F.struct(*[F.col(c) for r in names for c in _FIELDS[r]]), each)

    return df.withColumn("rules", remembered(("rules", repr(cfg), str(today), *names), rules))


def validated(df: DataFrame, today: Column, cfg: Config | None = None) -> DataFrame:
    """df, which has the six fields, with rules (a map in rule order) and verdict."""
    return judged(df, today, cfg).withColumn("verdict", verdict(F.col("rules")))
