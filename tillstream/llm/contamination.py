"""Benchmark decontamination by winnowed fingerprints that are extended to whole windows.

A benchmark item is contaminated text if one of its windows of `window` words occurs in a
document; an item with fewer words is one window. For windows of L words, k-grams of k = L/2
words are hashed, and of every L - k + 1 neighbouring k-grams the one with the smallest hash is
kept, the last one of equals. Equal windows keep the same k-gram, so every shared window shows
up in the join of the fingerprints of documents and benchmark. Each hit is extended to the
windows around it, which are looked up among the benchmark's windows and compared word by word.

The benchmark is taken in blocks of about `block_words` words, each broadcast and dropped again, so
driver and tasks hold one bounded block whatever the benchmark's size; all documents are searched
for each block, and with one block they are never shuffled or paired up. A passage that a third of all documents shares is
found in each of them on its own.

Results: NULL and empty texts have no words and are never hit; items without words match
nothing; an empty benchmark hits nothing. Items with equal ids count once. Columns other than
id and text are left out, so clashing names do no harm; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

WINDOW = 13
BLOCK_WORDS = 200_000
MIN_SHARE = 20  # contaminated if hit words are at least one in so many words

# Bytes that separate words become spaces, A-Z become small; bytes above ASCII stay.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_BREAK = np.uint64(0x1234567890ABCDEF)  # stands between documents; no window spans it
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        ones = np.full(max(size, 1 << 20), _BASE)
        back = np.full(len(ones), _INVERSE)
        ones[0] = back[0] = 1
        _powers[:] = [np.cumprod(ones), np.cumprod(back)]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts side by side: bytes, places and hashes, a break after each text."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().translate(_WORDS) for t in texts]
        self.data = b" " + b" ".join(raw) + b" "
        letters = np.frombuffer(self.data, np.uint8)
        inside = letters != 32
        flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = flips[0::2], flips[1::2]
        forward, backward = _power_tables(len(letters))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * forward[:len(letters)],
                  out=sums[1:])
        hashes = _mix((sums[ends] - sums[starts]) * backward[starts])
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        of = np.searchsorted(text_ends, starts, side="left")
        # One break per text: word i moves up by the number of texts before its own.
        self.counts = np.bincount(of, minlength=len(texts))
        at = np.arange(len(starts)) + of
        size = len(starts) + len(texts)
        self.hashes = np.full(size, _BREAK)
        self.starts, self.ends = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.text = np.full(size, -1, np.int64)
        self.hashes[at], self.starts[at], self.ends[at], self.text[at] = hashes, starts, ends, of

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, in order."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _STEP + self.hashes[i:i + n]
        return _mix(out)

    def run(self, start: int, length: int) -> bytes:
        return b" ".join(self.data[self.starts[i]:self.ends[i]]
                         for i in range(start, start + length))


def gram_size(length: int) -> int:
    return (length + 1) // 2


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of every `window` neighbouring hashes, the last of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    n = len(grams) - window + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window):
        lower = grams[i:i + n] <= best
        best = np.where(lower, grams[i:i + n], best)
        at[lower] = i
    return np.unique(at + np.arange(n))


class Block:
    """The windows of some benchmark items and the fingerprints that lead to them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, dict]] = {}
        by_length: dict[int, list[int]] = {}
        for i, n in enumerate(Words([t for _, t in items]).counts.tolist()):
            if n:
                by_length.setdefault(min(n, window), []).append(i)
        for length, chosen in by_length.items():
            words, k = Words([items[i][1] for i in chosen]), gram_size(length)
            grams = words.grams(k)
            kept = winnow(grams, length - k + 1)
            windows: dict[int, dict[bytes, list[int]]] = {}
            hashes = words.grams(length)
            for start in np.flatnonzero(
                    (words.text[:len(hashes)] >= 0)
                    & (words.text[:len(hashes)] == words.text[length - 1:])).tolist():
                found = windows.setdefault(int(hashes[start]), {}).setdefault(
                    words.run(start, length), [])
                item = chosen[words.text[start]]
                if not found or found[-1] != item:
                    found.append(item)
            self.lengths[length] = (
                np.unique(grams[kept]), np.sort(np.fromiter(windows, np.uint64)), windows)

    def search(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words lie in an occurrence of a window, and (text, item) of the occurrences."""
        hit = np.zeros(len(words.hashes) + 1, np.int64)
        items: set[tuple[int, int]] = set()
        for length, (kept, known, windows) in self.lengths.items():
            k = gram_size(length)
            grams = words.grams(k)
            at = winnow(grams, length - k + 1)
            at = at[_member(grams[at], kept)]
            if not len(at):
                continue
            whole = words.grams(length)
            starts = np.unique((at[:, None] - np.arange(length - k + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts < len(whole))]
            starts = starts[_member(whole[starts], known)]
            for start in starts.tolist():
                found = windows[int(whole[start])].get(words.run(start, length))
                if found is not None:
                    hit[start] += 1
                    hit[start + length] -= 1
                    items.update((int(words.text[start]), i) for i in found)
        return np.cumsum(hit[:-1]) > 0, sorted(items)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
           block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark, block by block; the driver holds one block at a time.

    Equal ids are one item only if their texts are equal; different texts under one id each
    count under that id. Items with a NULL text have no words.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    held, size = [], 0
    for row in rows.toLocalIterator():
        held.append((row.item or "", row.text))
        size += len(row.text.split()) + 1
        if size >= block_words:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_hit, hit_words, items) per document: the number of words and of
    words that lie in an occurrence of a window, those words as a bit string (NULL if none), and
    the sorted ids, as strings, of the items found.

    A benchmark of one block is searched in one pass. A larger one is searched block by block: the
    driver and the tasks hold one block at a time, and of each pass only the documents with hits
    are kept, by number, and put together at the end."""
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    frame = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found = blocks(benchmark, block_words=block_words, window=window)
    first, second = next(found, None), next(found, None)
    if second is None:
        shared = context.broadcast(first) if first else None
        return _searched(frame, shared, f"doc {kind}").withColumnRenamed("doc", doc_id)

    # Numbers stand in a written table, so they hold when a task runs again.
    whole = common.written(frame.withColumn("number", F.monotonically_increasing_id()),
                           "contamination-documents")
    texts = whole.select(F.col("number").alias("doc"), "text")
    counts, parts = None, []
    for block in itertools.chain((first, second), found):
        shared = context.broadcast(block)
        searched = _searched(texts, shared, "doc long").drop("text")
        if counts is None:  # words are counted in the first pass
            searched = counts = common.written(searched, "contamination-pass")
        parts.append(common.written(searched.where("n_hit > 0").select(
            "doc", "hit_words", "items"), "contamination-hits"))
        shared.destroy()
    union = functools.reduce(DataFrame.unionByName, parts)
    merged = union.groupBy("doc").agg(
        F.collect_list("hit_words").alias("bits"), F.array_sort(F.array_distinct(F.flatten(
            F.collect_list("items")))).alias("items"))

    def together(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in row])
                    for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([int(np.bitwise_count(b).sum()) for b in bits], pa.int64()),
                 pa.array([b.tobytes() for b in bits], pa.binary()), batch.column(2)],
                names=["number", "n_hit", "hit_words", "items"])

    merged = common.mapped(merged.select("doc", "bits", "items"), together,
                           "number long, n_hit long, hit_words binary, items array<string>")
    words = counts.select(F.col("doc").alias("number"), "n_words")
    return whole.join(words, "number").join(merged, "number", "left").select(
        F.col("doc").alias(doc_id), "text", "n_words", F.coalesce("n_hit", F.lit(0)).cast(
            "long").alias("n_hit"), "hit_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _searched(frame: DataFrame, block, doc: str) -> DataFrame:
    """One pass over (doc, text) with one block."""
    return common.mapped(frame.select(
        "doc", "text", F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("binary").alias("hit_words"),
        F.array().cast("array<string>").alias("items")), _search(block),
        f"{doc}, text string, n_words long, n_hit long, hit_words binary, items array<string>")


def _search(block):
    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in common.slices(batch.column(1)):
                yield _search_slice(block.value if block else None, batch.slice(a, b - a), texts)

    return step


def _search_slice(block: Block | None, batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
    words = Words(texts)
    bits, items = batch.column(4).to_pylist(), batch.column(5).to_pylist()
    n_hit = np.array(batch.column(3).to_pylist(), np.int64)
    if block is not None:
        hit, found = block.search(words)
        for i in np.unique(words.text[hit & (words.text >= 0)]).tolist():
            start = int(words.counts[:i].sum()) + i  # one break before each earlier text
            mine = hit[start:start + int(words.counts[i])]
            if bits[i]:
                mine = mine | np.unpackbits(
                    np.frombuffer(bits[i], np.uint8), count=len(mine)).astype(bool)
            bits[i], n_hit[i] = np.packbits(mine).tobytes(), int(mine.sum())
        new: dict[int, set[str]] = {}
        for i, item in found:
            new.setdefault(i, set(items[i])).add(block.ids[item])
        for i, ids in new.items():
            items[i] = sorted(ids)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()), pa.array(n_hit),
         pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
        names=["doc", "text", "n_words", "n_hit", "hit_words", "items"])


def is_contaminated(min_share: int = MIN_SHARE):
    """True if hit words are at least one in `min_share` of a document's words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      window: int = WINDOW, min_share: int = MIN_SHARE) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(
        text).alias("text"))
    clean = hits(whole, benchmark, "row", "text", window).where(~is_contaminated(min_share))
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
