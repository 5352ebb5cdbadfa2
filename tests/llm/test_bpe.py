import hashlib
import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tillstream.llm import bpe, queries  # noqa: E402


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(queries.tokenizer_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_holds_its_words_and_no_others():
    words = {w: [i, i + 1] for i, w in enumerate(
        [b"tap", b"taps", b"top", b"tops", b" a", b"\xc3\xa9t\xc3\xa9", b"x"])}
    lexicon = bpe.compile_lexicon(words)
    found = bpe.look_up(lexicon, sorted(words))
    assert found.tolist() == list(range(len(words)))
    for rank, word in enumerate(sorted(words)):
        ids = lexicon["ids"][lexicon["starts"][rank]:lexicon["starts"][rank + 1]]
        assert ids.tolist() == words[word]
    assert set(bpe.look_up(lexicon, [b"", b"t", b"ta", b"tapss", b"\xc3"]).tolist()) == {-1}


def test_lexicon_shares_endings():
    words = {a + b"ing": [1] for a in (b"walk", b"talk", b"bring")}
    lexicon = bpe.compile_lexicon(words)
    assert len(lexicon["final"]) < sum(map(len, words))
    assert int(lexicon["final"].sum()) == 1


def test_empty_lexicon():
    assert bpe.look_up(bpe.compile_lexicon({}), [b"a", b""]).tolist() == [-1, -1]


def test_encoding_equals_the_library(library, vocabulary):
    pick = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "é", "ß", "'s", "'ll", "12", " ", "<|endoftext|>", "日本",
              "😀", "Ᲊ", "꟎", "²", "\x85", "\x1c", ".", "՘", " the", "Ωμ"]
    texts = ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 40))) for _ in range(800)]
    texts += ["ab" * 3000, " " * 3000, "!?" * 2000, "a" * 49, "a" * 48, None, ""]
    words = {" the".encode(): bpe.merge(vocabulary, b" the")}
    codec = bpe.OpenCodec(vocabulary, bpe.compile_lexicon(words))
    packed = codec.encode(texts)
    for text, ids in zip(texts, packed):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(
            text or "", add_special_tokens=False).ids, text
    assert codec.decode(packed) == [t or "" for t in texts]


def test_long_and_short_merges_agree(vocabulary, monkeypatch):
    words = [b"internationalisation", b"aaaaaaaaaaaaaaaaa", "éèêë".encode() * 5]
    short = [bpe.merge(vocabulary, w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.merge(vocabulary, w) for w in words] == short


def test_word_counts_cover_all_texts(documents, monkeypatch):
    counts = {r.word: r.n for r in bpe.word_counts(
        documents((1, "a b a"), (2, "b c1 b."), (3, None), (4, "b"))).collect()}
    assert counts == {"a": 2, "b": 3}


def test_frequent_words_are_at_most_so_many(spark):
    counts = spark.createDataFrame([(f"w{i}", i // 10 + 1) for i in range(200)], "word string, n long")
    got = {r.word for r in bpe.frequent_words(counts, 55).collect()}
    assert got == {f"w{i}" for i in range(150, 200)}
    assert bpe.frequent_words(counts, 5).count() == 0
    assert bpe.frequent_words(counts, 1000).count() == 200
    assert bpe.frequent_words(counts.limit(0)).count() == 0


def test_encode_and_decode_one_after_the_other(odd_documents):
    codec = bpe.fit(odd_documents, queries.tokenizer_path())
    both = bpe.decode(bpe.encode(odd_documents, codec), codec)
    once = bpe.round_trip(odd_documents, codec)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_query_on_odd_rows(spark, odd_documents, write, library):
    folder = write(documents=odd_documents)
    rows = queries.op1_bpe(spark, folder).collect()
    source = [(r.doc_id, expected(library, r.text)) for r in odd_documents.collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, tuple(r)[1:]) for r in rows), key=key) == sorted(source, key=key)


def test_clashing_columns_and_empty_table(clashing, library):
    codec = bpe.fit(clashing.limit(0), queries.tokenizer_path())
    assert bpe.digests(clashing.limit(0), codec).count() == 0
    rows = bpe.digests(clashing, codec).collect()
    assert len(rows) == clashing.count()
    assert {r.doc_id: tuple(r)[1:] for r in rows}[8] == expected(library, "é日本😀   ñ")
