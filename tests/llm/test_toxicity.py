import itertools
import random
import zlib

import numpy as np

from tillstream.llm import queries
from tillstream.llm import toxicity as T

CLEAN = "the house and water over there with mother thing under light garden river stone".split()
BAD = ["worthless", "moron", "idiot"]


def rows(n=400, seed=1):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        words = [pick.choice(CLEAN) + pick.choice(["", "", "s", "ly", "er"]) for _ in range(
            pick.randint(6, 40))]
        toxic = pick.random() < 0.3
        if toxic:
            for _ in range(pick.randint(1, 3)):
                words.insert(pick.randrange(len(words)), pick.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


def brute_kernel(a, b):
    """The normalised subsequence kernel by listing all triples."""
    def features(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < T.SPAN:
                key = word[i] + word[j] + word[k]
                out[key] = out.get(key, 0) + T.DECAY ** (k - i + 1)
        return out
    x, y = features(a), features(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(key, 0) for key, v in x.items()) / norm


def test_kernel_equals_its_definition():
    alphabet = T.Alphabet("abcdefghijklmnopqrstuvwxyz")
    words = ["idiot", "idxiot", "banana", "ababab", "stupid", "stttupid"]
    table = np.zeros((T.LETTERS ** 3, len(words)))
    for places, code, weight in alphabet.features(words):
        for place, codes, weights in zip(places, code, weight):
            np.add.at(table[:, place], codes, weights)
    got = table.T @ table
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert abs(got[i, j] - brute_kernel(words[i], words[j])) < 1e-9
    assert got[0, 1] > 0.4 > got[0, 2]


def test_spelled_and_long_words():
    assert "idiot" in T.words_of("you i d i o t there")
    assert T.words_of(None) == T.words_of(" \n") == []
    assert T.edged("(idiot!)") == "<idiot>"
    assert all(len(c) <= T.CHUNK for c in T.chunks("x" * 1000))
    assert T.chunks("abc") == ["<abc>"]
    assert T.chunks("a.b-c!") == ["<a.b-c>", "<abc>"]


def test_all_letters_of_the_sample_count(monkeypatch):
    """A second script in a tenth of the documents, in a dense table and by searching."""
    data = rows()
    move = {ord(c): chr(0x430 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    accents = "".join(chr(c) for c in range(0xe0, 0x180) if chr(c).islower())
    others = [accents[i:i + 12] for i in range(0, 84, 12)]
    others += [w[::-1] for w in others]
    words = [[sorted({*T.words_of(t if i % 10 else t.translate(move)), *(() if kind else others)})
              for i, (_, t, y) in enumerate(data) if y == kind] for kind in (1, 0)]
    for dense in (T.DENSE, 64 ** 3, 1 << 30):
        monkeypatch.setattr(T, "DENSE", dense)
        model = T.train(*words)
        assert model.alphabet.base > T.LETTERS and len(model.alphabet.letters) < model.alphabet.base
        clean = model.decide([w.translate(move) for w in CLEAN] + CLEAN)
        found = model.decide([w.translate(move) for w in BAD] + BAD)
        assert found.min() > clean.max() + 0.25
        first = found if dense == 1 << 21 else first
        assert np.allclose(found, first)


def test_gapped_and_inserted_letters_are_tolerated():
    data = rows()
    words = [[sorted(set(T.words_of(t))) for _, t, y in data if y == kind] for kind in (1, 0)]
    model = T.train(*words)
    clean = model.decide(CLEAN)
    for word in ("worthless", "w.o.r.t.h.l.e.s.s", "wortxhless", "mo-ron", "idi0ot", "idiiot"):
        assert model.decide([word])[0] > clean.max() + 0.5, word


def test_held_out_documents(spark, documents, write):
    data = rows()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data],
                                   "doc_id long, quality int, toxic int")
    folder = write(documents=documents(*[(i, t) for i, t, _ in data]), labels=labels)
    got = queries.op10_toxicity(spark, folder).collect()
    truth = {i: y for i, _, y in data}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_do_not_matter(spark, documents, tmp_path):
    data, results = rows(150), []
    for name, flip in (("a", False), ("b", True)):
        labels = spark.createDataFrame(
            [(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y)
             for i, _, y in data], "doc_id long, quality int, toxic int")
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        documents(*[(i, t) for i, t, _ in data]).write.parquet(
            str(tmp_path / name / "documents.parquet"))
        results.append(sorted(map(tuple, queries.op10_toxicity(
            spark, str(tmp_path / name)).collect())))
    assert results[0] == results[1]


def test_odd_rows_and_labels(spark, clashing, write):
    labels = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (6, 1, 0), (7, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int")
    got = queries.op10_toxicity(spark, write(documents=clashing, labels=labels)).collect()
    assert len(got) == clashing.count()
    assert all(0 <= r.score <= 1 for r in got)
    kept = T.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns


def test_without_labels_nothing_is_toxic(spark, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.fit(clashing, labels) is None
    assert T.drop_toxic(clashing, labels).count() == clashing.count()
    assert T.drop_toxic(clashing.limit(0), labels).count() == 0
