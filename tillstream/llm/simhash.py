"""Near-duplicate groups by SimHash and pigeonhole blocks.

A text's fingerprint has 64 bits: each is the majority of that bit over the hashes of the text's
word shingles. Two fingerprints that differ in at most `max_bits` bits agree on all but
`max_bits` of `blocks` equal blocks, so each choice of the other blocks is a key on which such
pairs meet; pairs on a key are then verified by their Hamming distance.

Only distinct fingerprints are compared; exact copies need no pairs. A key that more than
`hot` distinct fingerprints share is not paired up. Its members meet instead at the bit patterns
within half the distance of them: two fingerprints differ in at most two bits if and only if
both are within one bit of a third pattern. At most 65 fingerprints are that near to a pattern,
so no group there is larger, and nothing is dropped. Groups are connected components.

Results: NULL and blank texts have fingerprint zero and are linked like any other. Repeated rows
each get their group. Other columns are left out, so clashing names do no harm.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

SHINGLE = 3
MAX_BITS = 2
BLOCKS = 4
HOT = 64  # distinct fingerprints on a key that are still compared pair by pair
SEED = 42
WORDS_AT_A_TIME = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, WORDS_AT_A_TIME):
        part = words[start:min(start + WORDS_AT_A_TIME, total) + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(b" ".join, rows), itertools.repeat(SEED)), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits): one row per document."""

    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(value.as_py(), shingle) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits, pa.int64())], names=[doc_id, "bits"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.mapped(docs.select(doc_id, text), step, f"`{doc_id}` {kind}, bits long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _block_masks(blocks: int, max_bits: int) -> list[int]:
    """A mask of the agreeing blocks for every choice of `max_bits` blocks that may differ."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [_signed(sum(chosen)) for chosen in itertools.combinations(single, blocks - max_bits)]


def _near_patterns(distance: int) -> list[int]:
    return [_signed(sum(1 << b for b in bits))
            for n in range(distance + 1) for bits in itertools.combinations(range(64), n)]


def links(classes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT
          ) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints `bits` whose closure is that of all
    pairs at most `max_bits` bits apart; each link is itself such a pair."""
    if max_bits % 2 or not 0 <= max_bits < blocks:
        raise ValueError("max_bits must be even and below the number of blocks")
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("bits").bitwiseAND(F.lit(mask)))
                     for i, mask in enumerate(_block_masks(blocks, max_bits))])
    keyed = classes.select("bits", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.written(keyed.join(shared, "key"), "simhash-members")

    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    buckets = members.where(F.col("n") <= hot).groupBy("key").agg(
        F.sort_array(F.collect_set("bits")).alias("all"))
    pairs = F.flatten(F.transform("all", lambda x: F.transform(
        F.filter("all", lambda y: (y > x) & near(x, y)), lambda y: F.struct(
            x.alias("a"), y.alias("b")))))
    cold = buckets.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    patterns = F.array(*[F.lit(p) for p in _near_patterns(max_bits // 2)])
    met = members.where(F.col("n") > hot).select("bits").distinct().select(
        "bits", F.explode(F.transform(patterns, lambda p: F.col("bits").bitwiseXOR(p))).alias("at"))
    stars = met.groupBy("at").agg(F.sort_array(F.collect_set("bits")).alias("all")).where(
        F.size("all") > 1)
    warm = stars.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << 30)).alias(
        "b")).where(near(F.col("a"), F.col("b")))
    return cold.union(warm).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for nodes with an edge.

    Alternates the large-star and small-star steps, each a minimum per node and a join, until
    every node points at its root. Every round is written to the shared folder.
    """

    def step(pairs: DataFrame) -> DataFrame:
        lowest = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(lowest, "a")

    current = common.written(edges.select("a", "b"), "simhash-edges")
    seen = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = step(both).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b"), F.col("a").alias("u")
        ).where(F.col("a") > F.col("u")).select("a", "b")
        small = large.where(F.col("a") > F.col("b")).distinct()
        down = step(small)
        current = common.written(down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            down.select("a", F.col("m").alias("b"))).where(F.col("a") > F.col("b")).distinct(),
            "simhash-edges")
        state = current.agg(F.count(F.lit(1)), F.coalesce(
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = state


def _rooted(bits: DataFrame, max_bits: int, blocks: int, hot: int) -> DataFrame:
    """(bits, root) for every distinct fingerprint: the group it belongs to."""
    classes = common.written(bits.select("bits").distinct(), "simhash-classes")
    linked = components(links(classes, max_bits, blocks, hot))
    return common.written(classes.join(linked.withColumnRenamed("node", "bits"), "bits", "left")
                          .select("bits", F.coalesce("root", "bits").alias("root")),
                          "simhash-roots")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document; the component's id is the smallest
    document id reachable over links, and the fingerprint 16 hexadecimal digits."""
    marked = common.written(fingerprints(docs, doc_id, text, shingle).select(
        F.col(doc_id).alias("doc"), "bits"), "simhash-fingerprints")
    rooted = _rooted(marked, max_bits, blocks, hot)
    lowest = marked.groupBy("bits").agg(F.min("doc").alias("first")).join(rooted, "bits")
    named = common.written(lowest.select("bits", "root").join(lowest.groupBy("root").agg(
        F.min("first").alias("component_id")), "root").select("bits", "component_id"),
        "simhash-components")
    return marked.join(named, "bits").select(
        F.col("doc").alias(doc_id),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
               hot: int = HOT) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id. Of rows that
    repeat that id one stays, and rows without an id stay only where no row of the group has one.
    """
    common.ship_code(docs.sparkSession)

    @F.arrow_udf("long")
    def bits_of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(value.as_py(), shingle) for value in texts], pa.int64())

    # Rows are numbered in a written table, so the numbers hold when a task runs again.
    whole = common.written(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        bits_of(F.col(text)).alias("bits"), F.monotonically_increasing_id().alias("number")),
        "simhash-documents")
    marked = whole.select("bits", "number", F.col("row").getField(doc_id).alias("doc"))
    kept = marked.join(_rooted(marked, max_bits, blocks, hot), "bits").groupBy("root").agg(
        F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "number")).alias("first"))
    stay = kept.select(F.col("first.number").alias("number"))
    return whole.join(stay, "number", "left_semi").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
