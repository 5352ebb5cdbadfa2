"""Spelling variant grouping by PartEnum signatures of letter multisets.

Words that differ by one inserted, deleted or replaced letter are near. Taken as a binary vector
with a place for the first, second, ... occurrence of each letter, a word's multiset of letters
then differs in at most two places. Places are dealt to `PARTS` parts, so any two near words
agree on all but two of them: each choice of the other parts is projected to a signature on
which such words meet (partition and enumerate). Two refinements keep words of equal letters
apart that are not near: a signature holds the longer word's length, so that only words whose
lengths differ by one at most meet, and the half of the word that one edit cannot have touched,
first or last. Words that share a signature are then verified by their edit distance.

A signature that more than `hot` words share is not paired up. Its members meet instead at what
is left of them with one letter blotted out or taken out, which no more words share than there
are letters; so nothing is dropped and no group is large.

A word's form is its near word of largest count, ties by the smallest word, if that count is
`factor` times its own or more; its root is the last word reached over forms. Counts grow along
forms, so chains end, and they are short: rounds of pointer doubling follow them.

Results: NULL and empty texts have no words. A NULL id counts as an empty one where ids choose
letters to delete. Repeated rows count again. An empty table gives no rows. Other columns are
left out, so clashing names do no harm. Words of any length are kept whole.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

# Fixed values of the task: which occurrences lose a letter, and which words count.
MISSPELT = 199  # an occurrence whose crc32 this divides loses one letter
MIN_LETTERS = 6
MIN_COUNT = 5
FORM_FACTOR = 5

PARTS = 4  # parts of the places; signatures keep all but two of them
HOT = 1000  # words on a signature that are still compared pair by pair
COUNT_FLUSH = 150_000  # distinct words a counting task holds at a time

# Lower-cased UTF-8: a-z, or U+00C0 to U+00FF, which are two bytes each.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def misspell(doc: bytes, run: bytes) -> bytes:
    """The run as it counts: one letter is taken out where the checksum says so."""
    checksum = zlib.crc32(run, zlib.crc32(doc + b":"))
    if checksum % MISSPELT:
        return run
    letters = run.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): all words of `MIN_LETTERS` letters or more, over all texts."""

    def flush(found: Counter) -> pa.RecordBatch:
        # A letter beyond ASCII has two bytes.
        keep = [w for w in found if len(w) - w.count(b"\xc3") >= MIN_LETTERS]
        return pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.binary()).cast(pa.string()),
             pa.array([found[w] for w in keep], pa.int64())], names=["word", "n"])

    def count(batches) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py() or b""
                runs = Counter(_RUN.findall((value.as_py() or b"").lower()))
                for run, n in runs.items():
                    found[misspell(doc, run)] += n
                if len(found) > COUNT_FLUSH:
                    yield flush(found)
                    found.clear()
        yield flush(found)

    parts = common.mapped(
        docs.select(F.col(doc_id).cast("string").cast("binary"), F.col(text).cast("binary")),
        count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# Signatures ------------------------------------------------------------------------------

def _projections(word: str) -> list[str]:
    """The letters of every choice of all but two parts."""
    parts = [[] for _ in range(PARTS)]
    seen: dict[str, int] = {}
    for letter in word:
        nth = seen[letter] = seen.get(letter, -1) + 1
        parts[(7 * ord(letter) + 3 * nth) % PARTS].append(letter)
    texts = ["".join(sorted(part)) for part in parts]
    return ["\0".join(chosen) for chosen in itertools.combinations(texts, PARTS - 2)]


SIGNATURES = 2 * len(_projections(""))  # of a word for one length


def signatures(word: str) -> list[int]:
    """Signed 64-bit signatures: first those the word shares with words of its length or one
    letter less, then those it shares with words of one letter more."""
    projected = list(enumerate(_projections(word)))
    found = []
    for length in (len(word), len(word) + 1):
        half = (length - 1) // 2
        for side, kept in enumerate((word[:half], word[len(word) - half:])):
            for choice, letters in projected:
                name = f"{choice}\0{length}\0{side}\0{kept}\0{letters}"
                found.append(xxhash.xxh64_intdigest(name.encode()) - (1 << 63))
    return found


def _signed_words(words: DataFrame) -> DataFrame:
    def sign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [signatures(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))],
                names=["word", "n", "keys"])

    return common.mapped(words.select("word", "n"), sign, "word string, n long, keys array<long>")


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def gaps(word: str, shorter: bool) -> np.ndarray:
    """Hashes of what a word is with one letter blotted out (and, for its meeting with shorter
    words, taken out), in time linear in its length; of the shorter word, its own hash."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    powers = np.full(len(letters) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    terms = letters * powers[:-1]
    until = np.zeros(len(letters) + 1, np.uint64)  # sums of the terms before each letter
    until[1:] = np.cumsum(terms, dtype=np.uint64)
    whole = until[-1:]
    if shorter:
        return whole.view(np.int64)
    out = until[:-1] + (whole - until[1:]) * np.uint64(_INVERSE)
    blotted = (whole - terms + powers[:-1]) * np.uint64(_BASE) + np.uint64(1)
    return np.unique(np.concatenate([out, blotted])).view(np.int64)


def _with_gaps(members: DataFrame) -> DataFrame:
    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = gaps(batch.column(2)[row].as_py(), not batch.column(1)[row].as_py())
                one = pa.array(np.zeros(len(found), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [c.take(one) for c in batch.slice(row, 1).columns] + [pa.array(found)],
                    names=["key", "own", "word", "n", "gap"])

    return common.mapped(members.select("key", "own", "word", "n"), step,
                         "key long, own boolean, word string, n long, gap long")


def _verified(members: DataFrame, *keys: str) -> DataFrame:
    """Near words among those that agree on `keys`. `own` marks the members at their own length;
    the others are one letter shorter."""
    a, b = members.alias("a"), members.alias("b")
    met = F.col("a.own") & (~F.col("b.own") | (F.col("a.word") < F.col("b.word")))
    for key in keys:
        met &= F.col(f"a.{key}") == F.col(f"b.{key}")
    return a.join(b, met & (F.levenshtein("a.word", "b.word", 1) == 1)).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("n_a"),
        F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, n_a, b, n_b): every pair of near words among (word, n), once."""
    signed = common.written(_signed_words(words), "variant-signatures")
    members = signed.select("word", "n", F.posexplode("keys").alias("place", "key")).select(
        "key", (F.col("place") < SIGNATURES).alias("own"), "word", "n")
    crowded = common.written(members.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(
        F.col("words") > hot).select("key"), "variant-hot")
    if crowded.isEmpty():
        return _verified(members, "key").distinct()
    few = _verified(members.join(crowded, "key", "left_anti"), "key")
    many = _verified(_with_gaps(members.join(crowded, "key", "left_semi")), "key", "gap")
    return few.union(many).distinct()


# Forms -----------------------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: every round doubles the steps taken."""
    current = common.written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.written(current.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias(
                "moved")), "variant-roots")
        if moved.where("moved").isEmpty():
            return current
        current = moved.drop("moved")


def group(words: DataFrame, factor: int = FORM_FACTOR, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct words and their counts."""
    near = near_words(words, hot)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.union(near.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("m"), "other")).alias("best"))
    strong = -F.col("best.col1") >= factor * F.col("n")
    found = common.written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.col1")).alias("form_n")), "variant-forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             min_count: int = MIN_COUNT) -> DataFrame:
    """The words of all texts that occur `min_count` times or more, grouped."""
    words = common.written(word_counts(docs, doc_id, text).where(F.col("n") >= min_count),
                           "variant-words")
    return group(words)
