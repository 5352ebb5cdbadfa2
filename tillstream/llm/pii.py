"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

E-mail addresses, network addresses, card numbers (Luhn) and international phone numbers are the
base kinds. On top of them come bank account numbers (mod 97), national phone numbers, social
security numbers, values assigned to names that say secret (`token = "..."`) and keys in the form
that known services issue; those stay only if their score, raised or lowered by words close before
the span, reaches `min_score`. Base spans stay whatever their score, which `spans` tells. All of it is SQL functions: the text is split at a pattern's matches, and
the lengths of pieces and matches add up to the places of the spans.

Patterns take a stretch of letters or digits whole or not at all (possessive quantifiers, and no
start in the middle of a stretch), so a very long word costs no more than its length. The matches
are those of the plain patterns, leftmost and not overlapping within a kind.

Results: NULL and empty texts have no spans. Offsets count code points, the end is exclusive.
Spans are ordered by start, then by kind in the order of KINDS. Spans of different kinds may
overlap. Other columns are left out, so clashing names do no harm; repeated rows repeat results.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm.arrays import let, running_sums

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "tel", "ssn", "secret", "key")
MIN_SCORE = 0.5
CONTEXT_CHARS = 40  # looked at before a span, back to the span before it of the same kind
CONTEXT_GAIN = 0.3
CONTEXT_LOSS = 0.3

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of 14 to 19 digits with single spaces or hyphens between them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+"
             r"(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])"),
    "tel": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z.-])",
    # A name, a sign that assigns, and the value up to the next blank or quote.
    "secret": (r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|client[_-]?secret|secret|token|"
               r"passwor[dt]|passwd|pwd|contraseña|mot de passe|kennwort)(?![A-Za-z0-9])[\"']?"
               r"\x20{0,2}[:=]\x20{0,2}[\"']?[^\s\"',;<>]{6,}+"),
    # How the keys of widely used services start, and their letters.
    "key": (r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}+|gh[opsu]_[A-Za-z0-9]{36}+|"
            r"xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|"
            r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+)(?![A-Za-z0-9])"),
}
# Of these signs a text must contain one for a pattern to be worth trying.
MARKS = {"email": "@", "ip": ".", "phone": "+", "tel": "-.", "ssn": "-", "secret": "=:",
         "key": ("AKIA", "gh", "xox", "sk-", "eyJ")}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "tel": 0.5,
          "ssn": 0.3, "secret": 0.7, "key": 0.9}
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment", "phone": r"phone|call|\btel|fax|mobile",
    "iban": "iban|account|bank|konto", "tel": r"phone|call|\btel|fax|mobile",
    "ssn": "ssn|social security|insurance", "secret": "login|config|user|auth|export",
    "key": "key|token|secret|auth",
}
# Words that make a span less likely: numbers of things, made-up values.
AGAINST = {
    "email": "example", "ip": r"version|release|\bv\b", "card": "isbn|serial|tracking",
    "phone": "isbn|order|invoice", "iban": "example|serial", "tel": "isbn|order|invoice|article|serial",
    "ssn": "isbn|order|invoice|article|serial|part", "secret": "example|placeholder|dummy|fake",
    "key": "example|placeholder|dummy|fake",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid Luhn checksum."""
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account number, without spaces, leaves 1 modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, place: Column) -> Column:
        letter = F.substring(turned, place, F.lit(1))
        digit = F.ascii(letter) - 48
        return F.when(digit < 10, (rest * 10 + digit) % 97).otherwise(
            (rest * 100 + F.ascii(letter) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^(?:{_PART}\.){{3}}{_PART}$"))
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "secret":  # a plain word behind the sign is no secret
        return F.rlike(match, F.lit(r"[:=][^:=]*[0-9!$%&*+/?@^_~-]"))
    return F.lit(True)


_SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,value:string,score:double>>"


def _spans_of(kind: str, text: Column, min_score: float) -> Column:
    pattern = F.lit(PATTERNS[kind])

    def place(matches: Column) -> Column:
        pieces = F.split(text, PATTERNS[kind], -1)
        return let(pieces, lambda gaps: let(
            running_sums(F.transform(gaps, lambda g, i: F.length(g) + F.coalesce(
                F.length(F.get(matches, i - 1)), F.lit(0)))),
            lambda starts: F.transform(matches, lambda m, i: F.struct(
                F.get(starts, i).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind_no"),
                F.lit(kind).alias("kind"),
                (F.get(starts, i) + F.length(m)).alias("end"),
                m.alias("value"),
                let(F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS))), lambda before: F.greatest(
                    F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(
                        F.rlike(before, F.lit(CONTEXT[kind])), CONTEXT_GAIN).otherwise(0.0) - F.when(
                        F.rlike(before, F.lit(AGAINST[kind])), CONTEXT_LOSS).otherwise(0.0)))).alias(
                    "score")))))

    def kept(span: Column) -> Column:
        ok = _valid(kind, span["value"])
        return ok if kind in BASE_KINDS else ok & (span["score"] >= min_score)

    found = let(F.regexp_extract_all(text, pattern, 0), lambda matches: F.when(
        F.size(matches) > 0, F.filter(place(matches), kept)).otherwise(
        F.array().cast(_SPAN)))
    if kind in MARKS:
        marked = [F.contains(text, F.lit(mark)) for mark in MARKS[kind]]
        found = F.when(reduce(or_, marked), found).otherwise(F.array().cast(_SPAN))
    return found


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, spans): per document the ordered spans with kind, offsets, value and score."""
    whole = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    columns = [_spans_of(kind, F.col("_text"), min_score) for kind in KINDS]
    return whole.select(doc_id, F.sort_array(F.concat(*columns)).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    counts = [_number_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return spans(docs, doc_id, text).select(
        doc_id, *counts, F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
