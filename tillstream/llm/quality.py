"""Quality rules as weak supervision.

Each rule looks at one measure of a text and votes good, bad, or abstains. How often a rule is
right is not known beforehand: expectation-maximisation estimates, from the votes over all
documents alone, each rule's accuracy on good and on bad texts and the share of good ones. A
document's posterior probability of being good then decides, in place of having to pass every
rule. Labels are not used.

Votes of all documents are counted by pattern with DataFrame functions. There are at most
3^rules patterns however many documents there are, and in practice some hundred; the driver
gets their counts and fits the model on them, so its work does not grow with the corpus.

Two measures are hard floors that no vote outweighs (`base_failed`): too few words, and too many
words in repeated passages.

Results: NULL and empty texts have no words; they fail. A very long text is measured whole.
Repeated rows count again and get equal results. Ties (a posterior of exactly a half) are kept.
An empty table gives no rows, and a model fitted on one knows its starting values only. Extra
columns do no harm whatever their names: `judge` leaves them out, `keep_good` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

WINDOW = 3  # words of a passage that counts as repeated if found twice
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated passages

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BLANKS = b" \t\n\v\f\r"
_ALL = bytes(range(256))


def _without(keep: bytes) -> bytes:
    return bytes(b for b in _ALL if b not in keep)


_NOT_SYMBOLS, _NOT_CAPITALS = _without(_SYMBOLS), _without(_CAPITALS)
_NOT_SMALL, _NOT_SHOUTS, _NOT_MARKS = _without(_SMALL), _without(b"!"), _without(_MARKS)
# A word of letters (any beyond ASCII counts as one), with one mark behind it at most.
_PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff'-]+[.,;:!?]?(?!\S)")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_capitals", "n_small", "n_shouts", "n_marks", "n_bare", "n_plain", "n_top_word")


def _repeated(words: list[bytes]) -> int:
    """Words in windows of `WINDOW` that occur twice or more in the text."""
    places = len(words) - WINDOW + 1
    if places < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    window = ids[:places]
    for i in range(1, WINDOW):
        window = window * len(codes) + ids[i:i + places]
        if i < WINDOW - 1 or len(codes) ** (i + 1) > 1 << 40:
            window = np.unique(window, return_inverse=True)[1]
    _, place, n = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[place] > 1)
    inside = np.zeros(len(words), np.bool_)
    for i in range(WINDOW):
        inside[starts + i] = True
    return int(inside.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """`MEASURES` of one UTF-8 text. Words stand between ASCII blanks, lines between \\n."""
    text = text or b""
    words = text.split()
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, _BLANKS).decode()),
        len(text.translate(None, _NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words) if len(counts) < len(words) else 0,
        len(lines),
        len(text.translate(None, _NOT_CAPITALS)),
        len(text.translate(None, _NOT_SMALL)),
        len(text.translate(None, _NOT_SHOUTS)),
        len(text.translate(None, _NOT_MARKS)),
        len(words) - len(text.translate(None, _MARKS).split()),
        len(_PLAIN.findall(text)),
        max(counts.values(), default=0),
    )


_STRUCT = "struct<" + ", ".join(f"{name}: bigint" for name in MEASURES) + ">"


def measures_of(docs: DataFrame, text: str = "text") -> Column:
    """The measures of each text of `docs`, as a struct."""
    common.ship_code(docs.sparkSession)

    @F.arrow_udf(_STRUCT)
    def measured(texts: pa.Array) -> pa.Array:
        # The empty row stands for the types where there are no texts.
        rows = [measure(value.as_py()) for value in texts]
        columns = zip(*rows) if rows else [[]] * len(MEASURES)
        return pa.StructArray.from_arrays(
            [pa.array(list(column), pa.int64()) for column in columns], names=list(MEASURES))

    return measured(F.col(text).cast("binary"))


def signals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, measures): one row per document."""
    found = docs.select(F.col(doc_id).alias("id"), measures_of(docs, text).alias("m"))
    return found.select(F.col("id").alias(doc_id), *[F.col(f"m.{name}") for name in MEASURES])


# Rules -----------------------------------------------------------------------------------

ANY = float("inf")
NEVER = (ANY, -ANY)
ALWAYS = (-ANY, ANY)


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio of two measures: good inside `good`, bad outside `fair`, both with their
    ends, and abstains between. A ratio with divisor 0 abstains. Most rules know one kind of
    junk; that a text is not of that kind says little, so they never vote good."""

    name: str
    over: tuple[str, ...]
    under: tuple[str, ...]
    good: tuple[float, float] = NEVER
    fair: tuple[float, float] = ALWAYS

    def vote(self) -> Column:
        total = lambda names: reduce(add, [F.col(n) for n in names]).cast("double")
        ratio = total(self.over) / F.nullif(total(self.under), F.lit(0.0))
        return F.when(ratio.between(*self.good), 1).when(
            ~ratio.between(*self.fair), -1).otherwise(0)


# Bounds in the manner of public rule sets for web text, with room between good and bad.
RULES = (
    Rule("length", ("n_words",), ("one",), good=(100, ANY), fair=(50, ANY)),
    Rule("marks", ("n_marks",), ("word_chars",), good=(0, 0.08), fair=(0, 0.12)),
    Rule("plain words", ("n_plain",), ("n_words",), good=(0.85, 1), fair=(0.6, 1)),
    Rule("repeated passages", ("n_repeat_words",), ("n_words",), fair=(0, 0.4)),
    Rule("one word", ("n_top_word",), ("n_words",), fair=(0, 0.3)),
    Rule("word length", ("word_chars",), ("n_words",), fair=(2, 14)),
    Rule("symbols", ("n_symbols",), ("n_words",), fair=(0, 0.1)),
    Rule("repeated lines", ("n_dup_lines",), ("n_lines",), fair=(0, 0.3)),
    Rule("capitals", ("n_capitals",), ("n_capitals", "n_small"), fair=(0, 0.5)),
    Rule("shouting", ("n_shouts",), ("n_words",), fair=(0, 0.2)),
    Rule("bare marks", ("n_bare",), ("n_words",), fair=(0, 0.2)),
)


def _pattern(rules: Sequence[Rule]) -> Column:
    """All votes of a row as one text, a sign per rule."""
    return F.concat(*[F.element_at(F.array(*map(F.lit, "-0+")), rule.vote() + 2)
                      for rule in rules])


def patterns(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(pattern, n): how many documents got which votes; at most 3^rules rows."""
    return measured.withColumn("one", F.lit(1)).groupBy(_pattern(rules).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"))


# The model -------------------------------------------------------------------------------

START_GOOD = 0.7  # share of good texts, and accuracy of rules, before the first round
START_RIGHT = 0.8
PRIOR_VOTES = 20.0  # the starting accuracy weighs as much as so many votes
LEAST, MOST = 0.55, 0.99  # bounds of accuracies: a rule is better than chance
ROUNDS, CLOSE = 200, 1e-9


@dataclass(frozen=True)
class Model:
    """Share of good texts, and per rule how often it is right when it votes."""

    good: float
    right: tuple[float, ...]

    def weights(self) -> list[float]:
        """Log odds that a vote of each rule adds to or takes from being good."""
        return [float(np.log(r / (1 - r))) for r in self.right]

    def log_odds(self) -> float:
        return float(np.log(self.good / (1 - self.good)))


def estimate(counts: dict[str, int], n_rules: int) -> Model:
    """Expectation-maximisation over vote patterns and their counts. Rules are taken to err
    independently, and to abstain on good and bad texts alike."""
    ordered = sorted(counts)
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[s] for s in p] for p in ordered],
                     np.float64).reshape(len(ordered), n_rules)
    n = np.array([counts[p] for p in ordered], np.float64)
    voted = n @ np.abs(votes)
    model = Model(START_GOOD, (START_RIGHT,) * n_rules)
    for _ in range(ROUNDS):
        odds = model.log_odds() + votes @ np.array(model.weights())
        is_good = 1 / (1 + np.exp(-odds))
        hits = (n * is_good) @ (votes > 0) + (n * (1 - is_good)) @ (votes < 0)
        right = (hits + PRIOR_VOTES * START_RIGHT) / (voted + PRIOR_VOTES)
        good = (n @ is_good + START_GOOD) / (n.sum() + 1)
        before, model = model, Model(float(np.clip(good, 0.001, 0.999)),
                                     tuple(map(float, np.clip(right, LEAST, MOST))))
        if np.abs(np.subtract((model.good, *model.right), (before.good, *before.right))
                  ).max() < CLOSE:
            break
    return model


def fit(measured: DataFrame, rules: Sequence[Rule] = RULES) -> Model:
    """The model of the votes over all rows of `signals`."""
    counts = {row.pattern: row.n for row in patterns(measured, rules).collect()}
    return estimate(counts, len(rules))


def posterior(measured: DataFrame, model: Model, rules: Sequence[Rule] = RULES,
              name: str = "score") -> DataFrame:
    """The rows of `signals` with the probability that a text is good."""
    with_votes = measured.withColumn("one", F.lit(1))
    parts = [rule.vote() * F.lit(weight) for rule, weight in zip(rules, model.weights())]
    odds = reduce(add, parts, F.lit(model.log_odds()))
    return with_votes.withColumn(name, 1 / (1 + F.exp(-odds))).drop("one")


def base_failed() -> Column:
    """The hard floors, on the columns of `signals`."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _verdict(measured: DataFrame, model: Model, rules: Sequence[Rule]) -> DataFrame:
    return posterior(measured, model, rules).withColumns({"base_failed": base_failed(), "kept": (
        ~base_failed() & (F.col("score") >= 0.5))})


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
          rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, measures, score, base_failed, kept) of every document, by a model of all."""
    measured = common.written(signals(docs, doc_id, text), "quality-signals")
    return _verdict(measured, fit(measured, rules), rules)


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    whole = common.written(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        measures_of(docs, text).alias("m")), "quality-documents")
    flat = whole.select("row", *[F.col(f"m.{name}") for name in MEASURES])
    kept = _verdict(flat, fit(flat, rules), rules).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
