"""Language identification by n-gram filters that hold all languages at once.

One Bloom filter serves all languages: a slot holds a bit per language, so the slots of an n-gram,
combined by AND, give the mask of all languages that contain it. A text's n-grams are looked up
once, the bits are counted per language, each count is corrected by the hits that the filter's
fill would give by chance, and the largest count decides.

An n-gram belongs to a language if it stands in at least `min_share` of its documents and in at
least `min_relative` of the share it has in the language where it is most common, so that words
quoted in other languages do not count for those. N-grams stay within a word and its edges.

The filter is learned from about `per_language` documents of each language, chosen by a hash of
the id and read whole; all of every text is counted at prediction. The driver gets one row per
slot of the filter at most. Results: NULL texts and texts without letters are `und` with score
0; so is everything if nothing is learned. Equal counts go to the language that sorts first.
Only the text decides; other columns are left out, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

ORDERS = (3, 4)
PER_LANGUAGE = 1500  # documents to learn from
MIN_SHARE = 0.02
MIN_RELATIVE = 0.25
SLOTS_LOG2 = 20
HASHES = 3
PER_MASK = 62  # languages in one number
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """True for code points that are letters."""
    if not _letters:
        _letters.append(np.fromiter(
            (chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text of each, and which texts have letters."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([np.array([32], np.uint32), codes])
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([np.zeros(1, np.int64), owner])
    letter = _letter_table()[codes]
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    # One space stands for all that lies between two words.
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[
        keep]
    hashes, owners = [], []
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        inner = np.ones(size, bool)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + size]
            if 0 < i < n - 1:
                inner &= letter[i:i + size]
        h = h[inner]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes.append(h ^ (h >> np.uint64(29)))
        owners.append(owner[1:1 + size][inner])  # the second place is always inside the word
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter
    return np.concatenate(hashes), np.concatenate(owners), has_letter


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOTS_LOG2) - 1)
    return [((hashes >> np.uint64(i * SLOTS_LOG2)) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # one row per PER_MASK languages, one column per slot

    def chance(self) -> np.ndarray:
        """The share of n-grams of no language that each language seems to contain."""
        return np.array([np.mean((self.masks[i // PER_MASK] >> np.uint64(i % PER_MASK))
                                 & np.uint64(1)) for i in range(len(self.languages))]) ** HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        hashes, owner, has_letter = grams(texts)
        slots = _slots(hashes)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        counts = np.zeros((len(texts), len(self.languages)))
        for row, words in enumerate(self.masks):
            found = words[slots[0]]
            for slot in slots[1:]:
                found = found & words[slot]
            for i in range(row * PER_MASK, min((row + 1) * PER_MASK, len(self.languages))):
                bit = (found >> np.uint64(i % PER_MASK)) & np.uint64(1)
                counts[:, i] = np.bincount(owner[bit > 0], minlength=len(texts))
        chance = self._chance()
        counts = np.maximum((counts - total[:, None] * chance) / (1 - chance), 0)
        best = counts.argmax(1)
        sums = counts.sum(1)
        score = np.where(sums > 0, counts[np.arange(len(texts)), best] / np.where(
            sums > 0, sums, 1), 0.0)
        return ([self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)],
                [float(s) if ok else 0.0 for s, ok in zip(score, has_letter)])

    def _chance(self) -> np.ndarray:
        if not hasattr(self, "_chances"):
            self._chances = np.minimum(self.chance(), 0.99)
        return self._chances


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE,
        min_relative: float = MIN_RELATIVE) -> Filter | None:
    """A filter of the languages in `lang`; the caller leaves out held-out rows."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in known.groupBy(lang).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    share = F.create_map(*[F.lit(x) for name in languages
                           for x in (name, min(1.0, per_language / sizes[name]))])
    sample = known.where(common.hash_share(F.col(doc_id), F.element_at(share, F.col(lang)))).select(
        F.element_at(number, F.col(lang)).alias("language"), F.col(text).alias("text"))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array(batch.column(0).to_pylist(), np.int64)
            for a, b, texts in common.slices(batch.column(1)):
                hashes, owner, _ = grams(texts)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)  # each n-gram once per document
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, language = hashes[new], numbers[a:b][owner[new]]
                order = np.lexsort((language, hashes))
                hashes, language = hashes[order], language[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (language[1:] != language[:-1])
                at = np.flatnonzero(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[at].view(np.int64)), pa.array(language[at], pa.int32()),
                    pa.array(np.diff(np.append(at, len(hashes))), pa.int64())],
                    names=["gram", "language", "n"])

    totals = {r["language"]: r["n"] for r in sample.groupBy("language").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    total = F.create_map(*[F.lit(x) for i, n in totals.items() for x in (i, float(n))])
    shares = common.mapped(sample, count, "gram long, language int, n long").groupBy(
        "gram", "language").agg(F.sum("n").alias("n")).withColumn(
        "share", F.col("n") / F.element_at(total, F.col("language")))
    # At most one entry per language and n-gram.
    kept = shares.where((F.col("share") >= min_share) & (F.col("n") >= 2)).groupBy("gram").agg(
        F.collect_list(F.struct("language", "share")).alias("in"), F.max("share").alias("top"))
    bits = kept.select("gram", F.explode(F.filter(
        "in", lambda x: x["share"] >= F.col("top") * min_relative)).alias("x")).select(
        "gram", (F.col("x.language") / PER_MASK).cast("int").alias("row"),
        F.expr(f"shiftleft(1L, x.language % {PER_MASK})").alias("bit"))
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", i * SLOTS_LOG2).bitwiseAND(
        F.lit((1 << SLOTS_LOG2) - 1)) for i in range(HASHES)]))
    masks = np.zeros(((len(languages) - 1) // PER_MASK + 1, 1 << SLOTS_LOG2), np.uint64)
    filled = bits.select("row", "bit", slot.alias("slot")).groupBy("row", "slot").agg(
        F.bit_or("bit").alias("mask")).toArrow()
    masks[filled["row"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(
        np.uint64)
    return Filter(languages, masks)


def identify(docs: DataFrame, model: Filter | None, doc_id: str = "doc_id", text: str = "text"
             ) -> DataFrame:
    """(doc_id, lang_pred, score) per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for a, b, texts in common.slices(batch.column(1)):
                names, scores = machine.predict(texts) if machine else (
                    [UNKNOWN] * (b - a), [0.0] * (b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(names, pa.string()),
                     pa.array(scores, pa.float64())], names=[doc_id, "lang_pred", "score"])

    return common.mapped(
        docs.select(doc_id, text), step,
        f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")
