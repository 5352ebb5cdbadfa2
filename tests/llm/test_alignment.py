"""Alignment against plain loops over the tokens of both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tillstream.llm import alignment, bpe, common, queries

A_PATH, B_PATH = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "a\n  b\n\n  \n c ", "a\t b  c",
    "\x1c x\x1d\x1e y", "don't  stop", "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 700,
    "long" * 200 + " word " + "y" * 300, "日本語のテキスト です", "😀 👩‍👩‍👧 é é", "▁ blank",
    "a▁b c", "nul \x00 byte", "tab\tand\r\nlines x　y", "1234567 89,0 3.14",
    "    def f(x):\n        return x\n", "ß" * 90 + " " * 70, "﻿start �",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A_PATH)
    first.encode_special_tokens = True
    first.no_truncation()
    first.no_padding()
    return first, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def tokens(libraries):
    """(id, bytes) of both sides for a text, or None where either does not give it back."""
    first, second = libraries
    letters = bpe._byte_letters()

    def encode(text):
        whole = f" {text or ''}".encode()
        if not text:
            return None
        a = [(t, bytes(letters[c] for c in first.id_to_token(t)))
             for t in first.encode(f" {text}", add_special_tokens=False).ids]
        b = [(t, bytes([int(second.id_to_piece(t)[3:5], 16)]) if second.is_byte(t)
              else second.id_to_piece(t).replace("▁", " ").encode())
             for t in second.encode(text)]
        if any(b"".join(part for _, part in side) != whole for side in (a, b)):
            return None
        return a, b

    return encode


def ranges(side):
    end = 0
    for token, part in side:
        yield token, end, end + len(part)
        end += len(part)


def brute_links(pair, kind):
    a, b = (list(ranges(side)) for side in pair)
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    group = lambda end: sum(c < end for c in cuts)
    out = []
    for i, (x, s, e) in enumerate(a):
        for j, (y, t, f) in enumerate(b):
            weight = {"end": int(e == f), "overlap": max(0, min(e, f) - max(s, t)),
                      "group": int(group(e) == group(f))}[kind]
            if weight:
                out.append((i, j, x, y, weight))
    return out


def brute_groups(pair):
    a, b = (list(ranges(side)) for side in pair)
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    out, low = [], 0
    for high in cuts:
        sides = [",".join(str(t) for t, _, e in side if low < e <= high) for side in (a, b)]
        out.append("|".join(sides))
        low = high
    return out


def brute_compare(rows, tokens):
    pairs = [(doc, tokens(text)) for doc, text in rows]
    found = [(doc, pair and [(x, y) for _, _, x, y, _ in brute_links(pair, "end")])
             for doc, pair in pairs]
    count = Counter(link for _, links in found for link in links or ())
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for (doc, pair), (_, links) in zip(pairs, found):
        if pair is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = brute_groups(pair)
        out.append((doc, len(pair[0]), len(pair[1]), len(groups), len(links),
                    sum(count[link] == most[link[1]] for link in links),
                    sum(count[link] for link in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def compared(docs):
    tools = alignment.load(docs, A_PATH, B_PATH)
    return sorted((tuple(r) for r in alignment.compare(docs, tools).collect()), key=repr)


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m, k, n = rng.integers(1, 9, 3)
        x, y = rng.integers(0, 3, (m, k)), rng.integers(0, 3, (k, n))

        def sparse(dense):
            rows, columns = np.nonzero(dense)
            return alignment.Csr(
                np.searchsorted(rows, np.arange(dense.shape[0] + 1)), columns,
                dense[rows, columns], dense.shape[1])

        found = np.zeros((m, n), np.int64)
        for rows, columns, values in alignment.products(sparse(x), sparse(y), np.ones(m), 2):
            found[rows, columns] += values
        assert (found == x @ y).all()
        turned = sparse(x).transposed()
        assert (turned.indptr == sparse(x.T).indptr).all()
        assert (turned.indices == sparse(x.T).indices).all()


def test_odd_texts_equal_brute_force(spark, documents, tokens):
    rows = [(i, text) for i, text in enumerate([*ODD, None, "the same", "the same"])]
    assert compared(documents(*rows)) == brute_compare(rows, tokens)


def test_words_make_the_tokens_of_whole_texts(spark, documents, libraries, tokens):
    """Random mixes of blanks, letters and marks; small caches that start anew."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice([" ", " ", "  ", "\n", "\t", "ab", "Cd", "é", "ing", "'s", "7",
                                    ".", "　", "\x1f", "日", "-"]) for _ in range(60)))
            for i in range(300)]
    assert compared(documents(*rows)) == brute_compare(rows, tokens)


def test_links_of_every_kind(spark, documents, tokens):
    rows = [(1, "Überraschungen don't  align 日本"), (2, None), (3, "a▁b"), (4, "xxxxxxxxxxxxx")]
    docs = documents(*rows)
    tools = alignment.load(docs, A_PATH, B_PATH)
    for kind in alignment.KINDS:
        found = sorted(tuple(r) for r in alignment.links(docs, tools, kind).collect())
        expected = sorted((doc, *link) for doc, text in rows if tokens(text)
                          for link in brute_links(tokens(text), kind))
        assert found == expected, kind
    with pytest.raises(ValueError):
        alignment.links(docs, tools, "start")


def test_clashing_columns_and_repeated_rows(spark, clashing, odd_documents, tokens):
    short = odd_documents.where("length(text) < 1000 OR text IS NULL")
    rows = [(r.doc_id, r.text) for r in short.collect()]
    assert compared(clashing.where("length(text) < 1000 OR text IS NULL")) == brute_compare(
        rows, tokens)
    assert compared(clashing.limit(0)) == []


def test_very_long_texts(spark, documents, libraries):
    text = "word and word " * 60_000
    found = {r[0]: r for r in compared(documents((1, text), (2, "z" * 300_000)))}
    first, second = libraries
    assert found[1][1] == len(first.encode(f" {text}", add_special_tokens=False).ids)
    assert found[1][2] == len(second.encode(text))
    assert found[2][3] > 1000


def test_whole_table_has_bounded_pairs(spark):
    """Documents of the smallest table against the libraries; pairs are ends of each other."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    tools = alignment.load(docs, A_PATH, B_PATH)
    opened = tools.open()
    assert opened.by_word
    pairs = alignment.pair_counts(alignment.aligned(docs, tools)).collect()
    for row in pairs:
        a = opened.bytes_a[row.pair >> tools.shift]
        b = opened.bytes_b[row.pair & (1 << tools.shift) - 1]
        assert a.endswith(b) or b.endswith(a)
