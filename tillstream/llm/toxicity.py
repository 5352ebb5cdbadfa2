"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, each occurrence
weighted by DECAY to the power of its span, and is normalised. Letters need not be neighbours,
so words with inserted or gapped letters stay close to the insult they hide. A document's words
are its tokens between white space and runs of single characters spelled out ("i d i o t").

Landmarks are words of labelled documents. Every word is mapped to its kernel values with them,
whitened by the landmarks' own kernel (Nyström), and a linear support vector machine separates
the words. Labels belong to documents, so each toxic document contributes its most suspicious
word, first by how much more often it stands in toxic documents, then by the machine itself. Of the
words of clean documents the `COMMON_CLEAN` most common are negative, and in every further round
the `HARD_CLEAN` that the machine finds most suspicious. A long word is learned and looked at in
all its parts. A document scores as its strongest word, through a
logistic curve fitted to labelled documents. As the kernel is a sum over letter triples, the
trained machine is one weight per triple, and scoring needs no pairs of words.

The sample to learn from is bounded by `per_class` documents of each label, chosen by a hash of
the id and read whole. Everything else covers all rows and whole texts.

Results: NULL and empty texts score as documents without words. Labels that are NULL are
ignored; an id labelled more than once is toxic if any of its labels is. Without labels of both
kinds every score is 0. Ties are broken by the words themselves. Repeated rows count again in
training and get equal scores; an empty table gives no rows. Only `text` decides a score; other
columns are left alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

PER_CLASS = 2500  # documents to learn from, of each label
LANDMARKS = 160
DECAY = 0.7
SPAN = 8  # letters a subsequence may reach over
CHUNK = 16  # longer words are taken in overlapping chunks of this length
ROUNDS = 3
WITNESSES = 4  # words of a toxic document that are taken for toxic ones in training
LIFT = 3.0  # times as often in toxic as in clean documents stands a word that may be toxic
COMMON_CLEAN = 8000  # words of clean documents that are negative in every round
HARD_CLEAN = 3000  # and that are added after each round, the most suspicious ones
COST = 4.0
CERTAIN = 2.0  # values beyond twice the machine's margin say no more
DISGUISED_SHARE = 0.08  # of toxic documents hold a word that is learned in disguises as well
SEED = 7
CACHE_WORDS = 150_000
LETTERS = 64  # least number that letters are coded by; more letters raise it
DENSE = 1 << 21  # triple codes up to this number are looked up in a dense table

TOP = 5  # strongest distinct words that decide about a document
EDGES = "<>"  # stand for the start and the end of a word, and count as letters

_SPELLED = re.compile(r"(?<!\S)(?:[^\W_]\s+){2,}[^\W_](?!\S)")
_AROUND = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    out = text.split()
    out.extend("".join(run.split()) for run in _SPELLED.findall(text))
    return out


def edged(word: str) -> str:
    """The word between edge marks, without the signs around it."""
    return EDGES[0] + _AROUND.sub("", word) + EDGES[1]


# --- the kernel --------------------------------------------------------------------------------

@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples i < j < k of a word within SPAN, and their weights."""
    found = [(i, j, k) for i in range(length) for j in range(i + 1, length)
             for k in range(j + 1, min(length, i + SPAN))]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float64)


class Alphabet:
    """All letters told apart; others, which stand in no labelled document, only widen gaps."""

    def __init__(self, letters: str):
        self.letters = letters
        self.base = max(LETTERS, len(letters) + 1)
        self._table = None

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(0x110000, np.int64)
            for i, letter in enumerate(self.letters):
                self._table[ord(letter)] = i + 1
        return self._table

    def __getstate__(self):
        return {"letters": self.letters, "base": self.base, "_table": None}

    def features(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length at a time: their places, triple codes and normed weights.

        Codes of a word are distinct where its weight is not 0; weights have norm 1, or are all
        0 for words of less than three known letters.
        """
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, places in by_length.items():
            at, weights = _triples(length)
            if not len(at):
                continue
            step = max(1, 200_000 // len(at))
            for start in range(0, len(places), step):
                chosen = places[start:start + step]
                codes = self.table[np.frombuffer("".join(words[i] for i in chosen).encode(
                    "utf-32-le", "surrogatepass"), np.uint32)].reshape(len(chosen), length)
                three = codes[:, at]
                code = (three[:, :, 0] * self.base + three[:, :, 1]) * self.base + three[:, :, 2]
                weight = np.where((three > 0).all(2), weights[None, :], 0.0)
                order = np.argsort(code, axis=1, kind="stable")
                code = np.take_along_axis(code, order, 1)
                weight = np.take_along_axis(weight, order, 1)
                # Occurrences of one triple add up, on the first of them.
                first = np.ones(code.shape, bool)
                first[:, 1:] = code[:, 1:] != code[:, :-1]
                flat = np.flatnonzero(first.ravel())
                summed = np.zeros(code.size)
                summed[flat] = np.add.reduceat(weight.ravel(), flat)
                weight = summed.reshape(code.shape)
                norm = np.sqrt((weight * weight).sum(1, keepdims=True))
                yield np.array(chosen), code, weight / np.where(norm > 0, norm, 1)


class Triples:
    """Values by triple code, 0 for other codes: a dense table while codes are few, and a search
    in the sorted codes otherwise."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, base: int):
        self.codes = self.values = None
        if base ** 3 <= DENSE:
            self.values = np.zeros(base ** 3, values.dtype)
            self.values[codes] = values
        else:
            self.codes, self.values = codes, values

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        if self.codes is None:
            return self.values[code]
        if not len(self.codes):
            return np.zeros(code.shape, self.values.dtype)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.values[at], 0)


def chunks(word: str) -> list[str]:
    """The forms a word is looked at in: as it stands, and its letters alone where other signs
    stand between them; long forms in overlapping chunks."""
    whole = edged(word)
    out = []
    for form in (whole,) if whole[1:-1].isalpha() else (whole, edged(_SIGNS.sub("", word))):
        if len(form) <= CHUNK:
            out.append(form)
        else:
            half = CHUNK // 2
            out.extend(form[i:i + CHUNK] for i in range(0, len(form) - half, half))
    return out


def disguised(word: str, pick: random.Random) -> list[str]:
    """The word with a letter put in, doubled, or left out, as insults are disguised."""
    at = pick.randrange(1, len(word))
    other = pick.randrange(1, len(word))
    return [word[:at] + pick.choice("abcdefghijklmnopqrstuvwxyz") + word[at:],
            word[:other] + pick.choice("xqzjkw") + word[other:],
            word[:at] + word[at - 1] + word[at:], word[:other] + word[other + 1:]]


# --- the model ---------------------------------------------------------------------------------

@dataclass
class Model:
    alphabet: Alphabet
    triples: Triples  # the machine's weight of each triple
    bias: float
    curves: np.ndarray  # of two logistic curves: a weight per document feature, and a constant

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; above 0 is suspicious."""
        parts, owner = [], []
        for i, word in enumerate(words):
            found = chunks(word)
            parts.extend(found)
            owner.extend([i] * len(found))
        value = np.full(len(parts), self.bias)
        for places, code, weight in self.alphabet.features(parts):
            value[places] += (self.triples[code] * weight).sum(1)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), value)
        return out

    def document(self, values: list[float]) -> list[float]:
        """What decides about a document: its strongest distinct words."""
        best = [min(v, CERTAIN) for v in sorted(values, reverse=True)[:TOP]]
        least = self.bias - 1
        return best + [least] * (TOP - len(best))

    def score(self, features: np.ndarray) -> np.ndarray:
        """One word may be enough, and so may several weaker ones."""
        x = (features @ self.curves[:, :-1].T + self.curves[:, -1]).max(1)
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _newton(features: np.ndarray, target: np.ndarray, weight: np.ndarray, kind: str,
            penalty: float) -> np.ndarray:
    """Linear weights (the last is the bias) by Newton steps: a support vector machine with
    squared hinge loss, or a logistic curve; target is +1 or -1."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(30):
        margin = target * (x @ w)
        if kind == "svm":
            active = weight * (margin < 1)
            slope, curve = -2 * active * target * (1 - margin), 2 * active
        else:
            p = 1 / (1 + np.exp(np.clip(margin, -50, 50)))
            slope, curve = -weight * target * p, weight * p * (1 - p)
        step = np.linalg.solve(
            (x * curve[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)),
            x.T @ slope + ridge * w)
        size = min(1.0, 10 / max(np.abs(step).max(), 1e-12)) if kind != "svm" else 1.0
        w = w - size * step
        if np.abs(step).max() < 1e-7:
            break
    return w


def train(toxic: list[list[str]], clean: list[list[str]], toxic_weight: float = 1.0,
          clean_weight: float = 1.0, landmarks: int = LANDMARKS) -> Model:
    """A model from the distinct words of toxic and of clean documents."""
    in_toxic = Counter(w for words in toxic for w in words)
    in_clean = Counter(w for words in clean for w in words)
    letters = Counter()
    for counts in (in_toxic, in_clean):
        for word, n in counts.items():
            for letter in set(word):
                if letter.isalnum():
                    letters[letter] += n
    alphabet = Alphabet(EDGES + "".join(l for l, _ in sorted(
        letters.items(), key=lambda x: (-x[1], x[0]))))
    vocabulary = sorted(set(in_toxic) | set(in_clean))
    rate = {}
    for word in vocabulary:
        p = in_toxic[word] / len(toxic)
        q = (in_clean[word] + 0.5) / (len(clean) + 1)
        both = (in_toxic[word] + in_clean[word] + 0.5) / (len(toxic) + len(clean) + 1)
        spread = (both * (1 - both) * (1 / len(toxic) + 1 / (len(clean) + 1))) ** 0.5
        rate[word] = (p - q) / max(spread, 1e-12) if p >= LIFT * q else -1.0
    witness = [sorted(words, key=lambda w: (-rate[w], w))[:WITNESSES] for words in toxic]
    # Landmarks: the words that explain most toxic documents, and common clean ones.
    explains = Counter(words[0] for words in witness if words)
    for words in witness:
        explains.update({w: 0.25 for w in words[1:] if rate[w] > 0})
    picked = [w for w, _ in sorted(explains.items(), key=lambda x: (-x[1], x[0]))]
    ordinary = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))
                if rate[w] < 2]
    parts = [c for words, most in ((picked, landmarks * 3 // 4), (ordinary, landmarks // 4))
             for c in list(dict.fromkeys(c for w in words[:most] for c in chunks(w)))[:most]]
    marks = list(dict.fromkeys(parts))
    found = [(place, codes, weights) for places, code, weight in alphabet.features(marks)
             for place, codes, weights in zip(places, code, weight)]
    seen = np.unique(np.concatenate([codes[weights > 0] for _, codes, weights in found]
                                    or [np.zeros(0, np.int64)]))
    # Row 0 is that of triples no landmark has.
    row = Triples(seen, np.arange(len(seen)) + 1, alphabet.base)
    table = np.zeros((len(seen) + 1, len(marks)))
    for place, codes, weights in found:
        table[row[codes], place] += weights
    table[0] = 0
    values, vectors = np.linalg.eigh(table.T @ table)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-4))[None, :] @ vectors.T

    def mapped(forms: list[str]) -> np.ndarray:
        out = np.zeros((len(forms), len(marks)))
        for places, code, weight in alphabet.features(forms):
            for start in range(0, len(places), 512):
                part = slice(start, start + 512)
                rows = row[code[part]]
                i, j = np.nonzero((rows > 0) & (weight[part] > 0))
                if len(i):
                    first = np.flatnonzero(np.diff(i, prepend=-1))
                    out[places[part][i[first]]] = np.add.reduceat(
                        table[rows[i, j]] * weight[part][i, j][:, None], first)
        return out @ whiten

    often = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    negative = dict.fromkeys(often[:COMMON_CLEAN])
    model = Model(alphabet, Triples(seen, np.zeros(len(seen)), alphabet.base), -1.0,
                  np.zeros((2, TOP + 1)))
    for round_ in range(ROUNDS):
        positive: Counter = Counter()
        for words in witness:
            for w in words:
                if rate[w] > 0:
                    positive[w] += 1 / len(words)
        # Disguised forms of likely insults are learned along with them.
        pick = random.Random(SEED)
        for word, n in list(positive.items()):
            bare = _AROUND.sub("", word)
            often = in_toxic[word] >= DISGUISED_SHARE * len(toxic)
            if often and len(bare) >= 4 and bare.isalpha():
                for form in disguised(bare, pick):
                    if form not in in_clean:
                        positive[form] += n / 4
        # Any part of an insult may be the telling one; no part of a clean word may be suspicious.
        learned = [(c, 1.0, n / len(chunks(w))) for w, n in positive.items() for c in chunks(w)]
        learned += [(c, -1.0, in_clean[w] ** 0.5) for w in negative for c in chunks(w)]
        forms = [form for form, _, _ in learned]
        target, weight = (np.array([row[i] for row in learned]) for i in (1, 2))
        # A word on both sides counts on each; both sides weigh the same in all.
        side = target > 0
        weight[side] *= len(weight) / (2 * max(weight[side].sum(), 1e-9))
        weight[~side] *= len(weight) / (2 * max(weight[~side].sum(), 1e-9))
        w = _newton(mapped(forms), target, weight, "svm", 1 / COST)
        triples = Triples(seen, table[1:] @ (whiten @ w[:-1]), alphabet.base)
        model = Model(alphabet, triples, float(w[-1]), np.zeros((2, TOP + 1)))
        if round_ + 1 < ROUNDS:
            known = dict(zip(vocabulary, model.decide(vocabulary).tolist()))
            witness = [sorted(words, key=lambda w: (-known[w], w))[:WITNESSES]
                       for words in toxic]
            negative.update(dict.fromkeys(sorted(in_clean, key=lambda w: (-known[w], w))[
                :HARD_CLEAN]))
    known = dict(zip(vocabulary, model.decide(vocabulary).tolist()))
    features = np.array([model.document([known[w] for w in words]) for words in toxic + clean])
    target = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.where(target > 0, toxic_weight, clean_weight)
    # More suspicion never lowers a score: features that would are left out.
    for curve, used in zip(model.curves, ([0], list(range(TOP)))):
        while True:
            w = _newton(features[:, used], target, weight / weight.mean(), "logistic", 1e-2)
            if (w[:-1] >= 0).all():
                break
            used = [i for i, value in zip(used, w) if value > 0]
        curve[[*used, TOP]] = w
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        per_class: int = PER_CLASS) -> Model | None:
    """A model from the labelled documents; the caller leaves out held-out rows of `labels`.

    About `per_class` labelled documents of each kind reach the driver, as distinct words.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("label_id")).agg(F.max("toxic").alias("toxic"))
    counts = {}
    for row in known.groupBy((F.col("toxic") > 0).cast("int").alias("kind")).agg(
            F.count(F.lit(1)).alias("n")).collect():
        counts[row.kind] = row.n
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") > 0, per_class / counts[1]).otherwise(per_class / counts[0])
    sample = known.where(common.hash_share(F.col("label_id"), share))

    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(sorted(set(words_of(v.as_py())))) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string())],
                names=["doc", "kind", "words"])

    # The sample of labels is bounded by per_class, so it may be broadcast.
    whole = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    chosen = whole.join(F.broadcast(sample), F.col("doc") == F.col("label_id")).select(
        F.col("doc").cast("string").alias("doc"), (F.col("toxic") > 0).cast("int").alias("kind"),
        "text")
    rows = sorted(tuple(r) for r in common.mapped(
        chosen, step, "doc string, kind int, words string").collect())
    same: dict[str, str] = {}  # equal words of different documents are one object
    kinds = [[[same.setdefault(w, w) for w in words.split("\n")] if words else []
              for _, k, words in rows if k == kind] for kind in (1, 0)]
    del rows
    if not kinds[0] or not kinds[1]:
        return None
    weights = [counts[kind] / len(part) for kind, part in zip((1, 0), kinds)]
    return train(kinds[0], kinds[1], weights[0], weights[1])




def score_column(spark, model: Model | None, text: Column) -> Column:
    """The score of a text, from 0 to 1."""
    if model is None:
        return F.lit(0.0)
    common.ship_code(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = shared.value
        known: dict[str, float] = {}
        for array in texts:
            features = np.zeros((len(array), TOP))
            for a, b, values in common.slices(array):
                split = [set(words_of(value)) for value in values]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list(set().union(*split).difference(known))
                known.update(zip(new, machine.decide(new).tolist()))
                features[a:b] = [machine.document(list(map(known.__getitem__, words)))
                                 for words in split]
            yield pa.array(machine.score(features), pa.float64())

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that score below `threshold`, with all their columns."""
    model = fit(docs, labels, doc_id, text, per_class)
    return docs.where(score_column(docs.sparkSession, model, F.col(text)) < threshold)
