import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tillstream.llm import queries, winnowing as W


def kept(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = table.select("i", W.positions(W.winnow(F.col("t"))).alias("p")).collect()
    return {r.i: [(x.hash, x.position) for x in r.p] for r in rows}


def grams(spark, text):
    words = text.split()
    runs = [words[i:i + W.GRAM] for i in range(max(len(words) - W.GRAM, 0) + 1)] if words else []
    if not runs:
        return []
    table = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r array<string>")
    hashed = [F.xxhash64(F.get("r", F.lit(j))) for j in range(W.GRAM)]
    hashed = [F.when(F.get("r", F.lit(j)).isNotNull(), h) for j, h in enumerate(hashed)]
    return [r[0] for r in table.orderBy("i").select(
        F.xxhash64(*hashed).bitwiseAND(F.lit(0xFFFFFFFF))).collect()]


def test_kept_hashes_are_the_last_smallest_of_every_window(spark):
    pick = random.Random(1)
    texts = [" ".join(pick.choice("abcde") for _ in range(n)) for n in (0, 1, 4, 5, 12, 20, 21, 90)]
    texts.append("same " * 60)
    got = kept(spark, texts)
    for i, text in enumerate(texts):
        hashes = grams(spark, text)
        windows = range(max(len(hashes) - W.WINDOW, 0) + 1) if hashes else []
        expected = {max(range(a, min(a + W.WINDOW, len(hashes))), key=lambda j: (-hashes[j], j))
                    for a in windows}
        assert sorted(p for _, p in got[i]) == sorted(expected), text
        assert all(h == hashes[p] for h, p in got[i])


def test_shared_runs_share_a_kept_hash(spark):
    pick = random.Random(2)
    some = lambda n: " ".join(str(pick.random()) for _ in range(n))
    shared = some(W.GRAM + W.WINDOW - 1)
    got = kept(spark, [some(n) + " " + shared + " " + some(m) for n, m in ((0, 9), (40, 0), (7, 31))])
    sets = [{h for h, _ in x} for x in got.values()]
    assert sets[0] & sets[1] and sets[1] & sets[2] and sets[0] & sets[2]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + other[:quarter]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [range(50), [0, 1, 2, 10**12, 10**12 + 1, -5] + list(range(100, 130)),
                                 [7]])
def test_next_document_by_id_whatever_the_ranges(spark, documents, write, ids):
    rows = [(i, f"text {i} " * (abs(i) % 9) + "é" * (abs(i) % 5)) for i in ids]
    random.Random(3).shuffle(rows)
    got = queries.op7_winnowing(spark, write(documents=documents(*rows).repartition(5))).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == expected(rows)


def test_query_on_odd_rows(spark, odd_documents, write):
    got = queries.op7_winnowing(spark, write(documents=odd_documents)).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted((tuple(r)[:3] for r in got), key=str) == expected(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    one = [r for r in got if r.doc_id == 1]
    assert {r.near_next for r in one} == {1.0}


def test_clashing_columns_and_empty_table(clashing):
    assert W.compare(clashing.limit(0)).count() == 0
    assert W.compare(clashing).count() == clashing.count()


def test_likeness_equals_that_of_plain_sets(spark, documents):
    pick = random.Random(8)
    some = lambda n: " ".join(pick.choice("abcdefghijkl") for _ in range(n))
    long = some(300)
    texts = ["", None, some(3), long, long, long[:400] + some(40), some(120), "same " * 90, "x"]
    docs = documents(*enumerate(texts))
    edited = []
    for i, text in enumerate(texts):
        text, other = text or "", texts[(i + 1) % len(texts)] or ""
        edited.append(text[:len(text) - len(text) // 4] + other[:len(text) // 4])
    own, changed = ({i: {h for h, _ in x} for i, x in kept(spark, t).items()} for t in (
        [t or "" for t in texts], edited))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for row in W.compare(docs).collect():
        i = row.doc_id
        assert row.near_edited == pytest.approx(like(own[i], changed[i])), i
        assert row.near_next == pytest.approx(like(own[i], own[(i + 1) % len(texts)])), i
