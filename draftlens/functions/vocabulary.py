"""The words, patterns and defaults that decide how documents are read."""

from __future__ import annotations

# fixed values: number words
ONES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
NOISE = ("and", "dollars", "dollar", "dollers", "only", "of", "xx", "no", "none")
MISSPELLINGS = {
    "fivety": "fifty", "fifthy": "fifty", "ninty": "ninety", "eigthy": "eighty", "eightteen": "eighteen",
    "thirtheen": "thirteen", "fourty": "forty", "hundered": "hundred", "thousend": "thousand", "twelth": "twelve",
    "fourteeen": "fourteen",
}

# fixed values: month names
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6,
    "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10,
    "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# fixed values: payees
GENERIC_PAYEE_WORDS = ("town", "city", "of", "the", "corporation", "municipality", "regional", "township")

# fixed values: states
OK, ABSENT, UNPARSEABLE, AMBIGUOUS = "OK", "ABSENT", "UNPARSEABLE", "AMBIGUOUS"
PASS, FAIL, UNABLE = "PASS", "FAIL", "UNABLE"
VALID, REVIEW, INVALID = "VALID", "REVIEW", "INVALID"
VERDICTS = (VALID, REVIEW, INVALID)
# fixed values: extractor field names
FIELD_NAMES = {
    "PayTo": "payee", "NumberAmount": "amount_numeric", "WordAmount": "amount_words", "CheckDate": "cheque_date",
    "PayerSignatures": "signature", "Memo": "memo",
}


def below_thousand() -> list[str]:
    """Words of 0-999, '' for 0, by rule."""
    ones = {v: k for k, v in ONES.items()}
    tens = {v: k for k, v in TENS.items() if k not in MISSPELLINGS}

    def words(n: int) -> list[str]:
        if n >= 100:
            return [ones[n // 100], "hundred", *words(n % 100)]
        if n >= 20:
            return [tens[n - n % 10], *words(n % 10)]
        return [ones[n]] if n else []

    return [" ".join(words(n)) for n in range(1000)]

RULES = ("payee", "amount_match", "signature", "date", "memo")
