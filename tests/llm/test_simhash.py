import random

import xxhash
from pyspark.sql import functions as F

from tillstream.llm import queries, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(bits, limit=2):
    """Component of each place: the smallest place reachable."""
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(bits))]


def test_fingerprint_equals_the_definition(monkeypatch):
    texts = [None, "", " \t\n", "One", "one two", "one two three", "ÀB é A b\x0bc d\x1ce f g h a b c",
             "a b c d e f " * 50]
    expected = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == expected
    monkeypatch.setattr(simhash, "WORDS_AT_A_TIME", 7)
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == expected
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def _classes(spark, bits):
    return spark.createDataFrame([(simhash._signed(b),) for b in bits], "bits long")


def _partition(spark, bits, **how):
    rows = simhash.components(simhash.links(_classes(spark, bits), **how)).collect()
    root = {r.node: r.root for r in rows}
    places = {}
    for i, b in enumerate(bits):
        places.setdefault(root.get(simhash._signed(b), simhash._signed(b)), []).append(i)
    return sorted(places.values())


def _expected(bits):
    places = {}
    for i, r in enumerate(brute_groups(bits)):
        places.setdefault(r, []).append(i)
    return sorted(places.values())


def _some_bits(seed):
    pick = random.Random(seed)
    bits = [pick.getrandbits(64) for _ in range(60)]
    for _ in range(160):  # chains of near ones
        near = pick.choice(bits)
        for _ in range(pick.randint(1, 3)):
            near ^= 1 << pick.randrange(64)
        bits.append(near)
    return sorted(set(bits))


def test_links_and_components_equal_all_pairs(spark):
    bits = _some_bits(1)
    assert _partition(spark, bits) == _expected(bits)


def test_hot_keys_lose_no_link(spark):
    """Every key counts as hot, so all links come from shared patterns."""
    bits = _some_bits(2)
    assert _partition(spark, bits, hot=1) == _expected(bits)
    assert _partition(spark, bits, hot=3) == _expected(bits)


def test_links_are_near_and_few_in_a_dense_group(spark):
    pick = random.Random(5)
    centre = pick.getrandbits(64)
    bits = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)})
    found = simhash.links(_classes(spark, bits)).collect()
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 for r in found)
    assert len(found) < 65 * len(bits)
    assert _partition(spark, bits) == _expected(bits)


def test_query_on_odd_rows(spark, odd_documents, write):
    folder = write(documents=odd_documents)
    rows = queries.op5_simhash(spark, folder).collect()
    source = odd_documents.collect()
    assert len(rows) == len(source)
    roots = brute_groups([brute_fingerprint(r.text) for r in source])
    lowest = {}
    for r, root in zip(source, roots):
        if r.doc_id is not None:
            lowest[root] = min(lowest.get(root, r.doc_id), r.doc_id)
    expected = sorted(((r.doc_id, f"{brute_fingerprint(r.text):016x}", lowest.get(root))
                       for r, root in zip(source, roots)), key=str)
    assert sorted(map(tuple, rows), key=str) == expected


def test_clashing_columns_empty_table_and_kept_documents(clashing):
    assert simhash.groups(clashing.limit(0)).count() == 0
    assert simhash.keep_first(clashing.limit(0)).columns == clashing.columns
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 3, 6, 7, 8]
    # A document without an id and without a copy stays as well.
    assert kept.where(F.col("doc_id").isNull()).count() == 1
