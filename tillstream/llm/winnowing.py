"""Document fingerprints by winnowing.

Runs of GRAM words are hashed, and of every WINDOW neighbouring hashes the smallest is kept, the
last one of equals, with its position. Two texts that share a run of GRAM + WINDOW - 1 words
share a kept hash. All of it is SQL functions: a hash and its position are one number, hash in
the upper 32 bits and position, counted down, in the lower 31, so that a plain minimum takes
the smallest hash and, among equals, the last position.

Words stand between white space. A text of fewer than GRAM words is one run, and fewer than
WINDOW hashes are one window. Results: NULL texts are empty; a text without words has an empty
fingerprint, which is wholly like another empty one and unlike all others. Other columns are
left out, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.llm import common
from tillstream.llm.arrays import let

GRAM = 5
SIDE = 4
WINDOW = SIDE * SIDE
_LAST = (1 << 31) - 1


def winnow(text: Column) -> Column:
    """The fingerprint of a text: an array of numbers that hold hash and position."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")

    def hashed(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - GRAM, F.lit(0))), lambda i:
                            F.shiftleft(F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)])
                                        .bitwiseAND(F.lit(0xFFFFFFFF)), 31)
                            + (F.lit(_LAST).cast("long") - i))
        return let(grams, lowest)

    def lowest(v: Column) -> Column:
        # Minima of SIDE neighbours, then of SIDE of those: nulls past the end are skipped.
        near = F.transform(v, lambda x, i: F.least(x, *[F.get(v, i + j) for j in range(1, SIDE)]))
        return let(near, lambda a: F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(a) - WINDOW, F.lit(0))),
            lambda i: F.least(*[F.get(a, i + SIDE * j) for j in range(SIDE)]))))

    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(w, lambda x: F.xxhash64(x)), hashed)))


def positions(fingerprint: Column) -> Column:
    """(hash, position) pairs of a fingerprint; positions count words from 0."""
    return F.transform(fingerprint, lambda x: F.struct(
        F.shiftright(x, 31).alias("hash"),
        (F.lit(_LAST).cast("long") - x.bitwiseAND(F.lit(_LAST))).alias("position")))


def digest(fingerprint: Column) -> Column:
    return F.sha2(F.array_join(fingerprint.cast("array<string>"), ","), 256)


def likeness(one: Column, other: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints, from 0 to 1."""
    hashes = lambda f: F.transform(f, lambda x: F.shiftright(x, 31))
    return let(hashes(one), lambda a: let(hashes(other), lambda b: F.when(
        (F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint) per document."""
    return docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "fingerprint", winnow(F.col("text")))


def with_next(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds `next_text` and `next_fingerprint`: those of the next document by ascending id,
    after the last those of the first. Equal ids are ordered by text; NULL ids come first.

    Ids are dealt to ranges of about equal size, whose limits are quantiles of all ids, and
    each range looks ahead on its own; the last row of a range gets the first of the next one.
    """
    spark = marked.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = marked.agg(F.percentile_approx(
        doc_id, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    limits = sorted(set(limits))
    # Binary search for the number of limits at or below the id.
    steps = [1 << i for i in range(len(limits).bit_length() - 1, -1, -1)] if limits else []
    if steps:
        bounds = F.array(*[F.lit(x) for x in limits])
        at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, step: F.when(
            F.get(bounds, low + step - 1) <= F.col(doc_id), low + step).otherwise(low))
    else:
        at = F.lit(0)
    dealt = marked.withColumn("_range", at)
    order = Window.partitionBy("_range").orderBy(F.col(doc_id).asc_nulls_first(), "text")
    ahead = dealt.withColumn("_ahead", F.lead(F.struct("text", "fingerprint")).over(order))

    # One row per range: its first document. Ranges number 4 per shuffle partition at most.
    plain = dealt.select(F.col(doc_id).alias("_id"), "_range", "text")
    first = plain.groupBy("_range").agg(
        F.min("_id").alias("_least"), F.max(F.col("_id").isNull()).alias("_open"))
    first = first.withColumn("_least", F.when(~F.col("_open"), F.col("_least")))
    heads = plain.join(F.broadcast(first.withColumnRenamed("_range", "_r")), (
        F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_least"))).groupBy(
        "_range").agg(F.min("text").alias("text"))
    heads = common.written(heads.withColumn("fingerprint", winnow(F.col("text"))), "winnow-heads")
    turns = Window.orderBy("_range")
    following = common.written(heads.select("_range").withColumn("_following", F.coalesce(
        F.lead("_range").over(turns), F.min("_range").over(Window.partitionBy()))),
        "winnow-ranges")
    entry = following.join(heads.withColumnRenamed("_range", "_following"), "_following").select(
        F.col("_range"), F.struct("text", "fingerprint").alias("_entry"))
    both = ahead.join(common.written(entry, "winnow-entries"), "_range", "left")
    following_document = F.coalesce("_ahead", "_entry")
    return both.select(
        doc_id, "text", "fingerprint",
        following_document["text"].alias("next_text"),
        following_document["fingerprint"].alias("next_fingerprint"))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text, whose last quarter is taken
    from the start of the next document, and against the next document's."""
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = with_next(fingerprints(docs, doc_id, text), doc_id).select(
        doc_id, n.cast("long").alias("n_chars"), F.col("fingerprint").alias("_own"),
        F.col("next_fingerprint").alias("_next"),
        F.concat(F.substring("text", F.lit(1), n - quarter),
                 F.substring("next_text", F.lit(1), quarter)).alias("_text"))
    own, other = F.col("_own"), F.col("_edited")
    return edited.withColumn("_edited", winnow(F.col("_text"))).select(
        doc_id, "n_chars", F.sha2("_text", 256).alias("edited_sha256"),
        digest(own).alias("fingerprint"), digest(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, F.col("_next")).alias("near_next"))
