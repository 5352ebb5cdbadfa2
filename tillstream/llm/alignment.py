"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes, a space and the text. The tokens of one are the rows of a
token-byte incidence matrix in compressed sparse rows. The product A x B-transposed, row by row
after Gustavson, holds the number of bytes that two tokens share: its entries are the overlap
links. Byte offsets at which a token of both ends cut the tokens into groups, and the product
of the token-group incidence matrices holds the links of tokens that share a group. Tokens
whose byte ranges end together are the overlap links with equal ends.

Neither tokenizer joins bytes across a blank that follows a letter or mark, which is checked of
the second's vocabulary when it is loaded. Both matrices are therefore block diagonal, with one
block per word, and products are made once for every different word of a slice of texts and
remembered. Where the check fails, a text is one block.

How often an id pair is linked is counted over all documents. The shorter of two tokens that end
together is the end of the longer one, so the pairs are bounded by the vocabularies however
large the corpus: their counts are collected and sent to the tasks.

Results: NULL and empty texts, and texts that either tokenizer cannot give back byte for byte,
have no tokens: zeros, and an empty text for the groups. Strings of special tokens are plain
text. A long text is cut whole. Repeated rows count again. Empty tables give no rows. Other
columns are left out, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import bpe, common

BLOCK_BYTES = 1 << 18  # bytes of rows that are multiplied at a time
SLICE_BYTES = 1_500_000  # bytes of texts that are cut into words at a time
TOGETHER = 100  # words that are encoded as one text
CACHE_WORDS = 200_000  # words a worker remembers; beyond that it starts anew
LONGEST_WORD = 256  # letters; longer words are not remembered
BLANK = "▁"  # fixed value: how the second vocabulary writes a space
ROWS = 500  # documents whose links are looked up at a time


# Sparse matrices -------------------------------------------------------------------------

@dataclass
class Csr:
    """Compressed sparse rows: row i has the columns `indices[indptr[i]:indptr[i + 1]]`."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def part(self, start: int, end: int) -> "Csr":
        low, high = self.indptr[start], self.indptr[end]
        return Csr(self.indptr[start:end + 1] - low, self.indices[low:high],
                   self.data[low:high], self.columns)

    def transposed(self) -> "Csr":
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(_starts(counts), rows[order], self.data[order], self.rows)


def _starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every stretch, one after another."""
    total = _starts(lengths)
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


def gustavson(a: Csr, b: Csr) -> Csr:
    """a x b: every row of the product is the sum of the rows of b that the entries of the row of
    a name, each times its entry."""
    lengths = np.diff(b.indptr)[a.indices]
    entry = np.repeat(np.arange(len(a.indices)), lengths)
    place = _ragged(b.indptr[a.indices], lengths)
    rows = np.repeat(np.arange(a.rows), np.diff(a.indptr))[entry]
    key = rows * b.columns + b.indices[place]
    value = a.data[entry] * b.data[place]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, value = key[first], (np.add.reduceat(value, first) if len(first) else value)
    counts = np.bincount(key // max(b.columns, 1), minlength=a.rows)
    return Csr(_starts(counts), key % max(b.columns, 1), value, b.columns)


def products(a: Csr, b: Csr, work: np.ndarray, most: int = BLOCK_BYTES
             ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of a x b, in blocks of rows whose `work`, the entries that are
    multiplied, is about `most`."""
    ends = np.cumsum(work)
    start = 0
    while start < a.rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        found = gustavson(a.part(start, end), b)
        rows = np.repeat(np.arange(start, end), np.diff(found.indptr))
        yield rows, found.indices, found.data
        start = end


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens by the bytes they cover; the tokens lie one after another."""
    starts = _starts(lengths)
    n = int(starts[-1])
    return Csr(starts, np.arange(n), np.ones(n, np.int32), n)


def group_incidence(groups: np.ndarray, n_groups: int) -> Csr:
    """Tokens by the group each is in."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int32), n_groups)


@dataclass
class Aligned:
    """Tokens of both sides by their last byte, and the group of each."""

    a_lengths: np.ndarray
    b_lengths: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    n_groups: int

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, bytes both cover), for all that share a byte."""
        across = byte_incidence(self.b_lengths).transposed()
        return products(byte_incidence(self.a_lengths), across, self.a_lengths)

    def ends_together(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) of the overlaps whose byte ranges end together."""
        a_ends, b_ends = np.cumsum(self.a_lengths), np.cumsum(self.b_lengths)
        found = [(rows[same], columns[same]) for rows, columns, _ in self.overlaps()
                 for same in [a_ends[rows] == b_ends[columns]]]
        rows, columns = zip(*found) if found else ([], [])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *columns])

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, 1), for all that are in one group."""
        members = group_incidence(self.b_groups, self.n_groups).transposed()
        work = np.diff(members.indptr)[self.a_groups]
        return products(group_incidence(self.a_groups, self.n_groups), members, work)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """Tokens of the same bytes, each at least one byte long, by their lengths."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return Aligned(a_lengths, b_lengths, np.searchsorted(cuts, a_ends),
                   np.searchsorted(cuts, b_ends), len(cuts))


# Tokenizers ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Tools:
    """Both vocabularies; made on the driver, opened once per worker."""

    vocabulary: object  # a broadcast `bpe.Vocabulary` without special strings
    model: object  # the broadcast bytes of the second model
    name: str
    shift: int  # an id pair is one number: first id << shift | second id
    kind: str  # the type of that number

    def open(self) -> "OpenTools":
        if self.name not in _open:
            _open.clear()
            _open[self.name] = OpenTools(self.vocabulary.value, self.model.value, self.shift)
        return _open[self.name]


_open: dict[str, "OpenTools"] = {}


def load(docs: DataFrame, byte_path: str, piece_path: str) -> Tools:
    context = docs.sparkSession.sparkContext
    vocabulary = bpe.load_vocabulary(byte_path)
    for i in vocabulary.special.values():
        vocabulary.tokens[i] = b""  # no text becomes one
    vocabulary = replace(vocabulary, special={})
    with open(piece_path, "rb") as source:
        model = source.read()
    import sentencepiece

    shift = len(sentencepiece.SentencePieceProcessor(model_proto=model)).bit_length()
    kind = "int" if len(vocabulary.tokens).bit_length() + shift < 32 else "long"
    return Tools(context.broadcast(vocabulary), context.broadcast(model),
                 f"{context.applicationId} {byte_path} {piece_path}", shift, kind)


# Texts of letters that every version of Unicode in use knows, and no mark for a blank.
_USUAL = re.compile("[\0-\u052f]*")


def _ranked(vocabulary: bpe.Vocabulary):
    """The first vocabulary for a library that wants ids in the order of merges; None if they are
    not. It takes letters for letters by another version of Unicode, so it gets usual texts only."""
    import tiktoken

    merged = [i for _, i in sorted(vocabulary.merges.values())]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("ranked", pat_str=bpe.SPLIT, special_tokens={}, mergeable_ranks={
        token: i for i, token in enumerate(vocabulary.tokens) if token})


def piece_bytes(processor) -> list[bytes]:
    """The bytes of every token of the second vocabulary."""
    return [bytes([int(piece[3:5], 16)]) if processor.is_byte(i)
            else piece.replace(BLANK, " ").encode()
            for i, piece in enumerate(map(processor.id_to_piece, range(len(processor))))]


class OpenTools:
    def __init__(self, vocabulary: bpe.Vocabulary, model: bytes, shift: int):
        import sentencepiece

        self.shift = shift

        self.codec = bpe.OpenCodec(vocabulary, bpe.compile_lexicon({}))
        self.ranked = _ranked(vocabulary)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = vocabulary.tokens, piece_bytes(self.pieces)
        self.lengths_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.lengths_b = np.array(list(map(len, self.bytes_b)), np.int64)
        # A piece with a blank behind another character could join two words.
        self.by_word = not any(BLANK in self.pieces.id_to_piece(i).lstrip(BLANK)
                               for i in range(len(self.pieces)))
        # Tokens in the text of groups, by what stands behind them: A and "," or "|", B and ","
        # or ";".
        self.shown = [f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"),
                                                       (len(self.bytes_b), ",;"))
                      for mark in marks for i in range(size)]
        self.words = Words()

    def encode(self, blocks: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of both tokenizers for texts that start with a space."""
        first = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in self.codec.encode(blocks)]
        self.codec.known.clear()
        return first, self.pieces.encode([block[1:] for block in blocks], num_threads=1)

    def _one_by_one(self, blocks: list[str]) -> tuple[np.ndarray, ...]:
        first, second = self.encode(blocks)
        whole = np.array([
            b"".join(map(self.bytes_a.__getitem__, a.tolist())) == block.encode()
            and b"".join(map(self.bytes_b.__getitem__, b)) == block.encode()
            for block, a, b in zip(blocks, first, second)], np.bool_)
        first = [a if ok else a[:0] for a, ok in zip(first, whole)]
        second = [b if ok else [] for b, ok in zip(second, whole)]
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(blocks)) for side in (first, second))
        a_ids = np.concatenate([np.zeros(0, np.int64), *first])
        return whole, n_a, n_b, a_ids, np.array([i for ids in second for i in ids], np.int64)

    def _together(self, blocks: list[str]) -> tuple[np.ndarray, ...] | None:
        """The same of many words as one text, in which they stay apart; None if either side
        does not give the text back."""
        texts = ["".join(blocks[i:i + TOGETHER]) for i in range(0, len(blocks), TOGETHER)]
        raw = "".join(texts).encode()
        ends = np.cumsum([len(block.encode()) for block in blocks])
        first = map(self.ranked.encode_ordinary, texts)
        second = self.pieces.encode([text[1:] for text in texts], num_threads=1)
        sides = [np.array([i for ids in side for i in ids], np.int64) for side in (first, second)]
        counts = []
        for ids, tokens, lengths in zip(sides, (self.bytes_a, self.bytes_b),
                                        (self.lengths_a, self.lengths_b)):
            if b"".join(map(tokens.__getitem__, ids.tolist())) != raw:
                return None
            counts.append(np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends, "right"),
                                  prepend=0))
        return np.ones(len(blocks), np.bool_), *counts, *sides

    def learn(self, blocks: list[str]) -> "Words":
        """What alignment finds in each block, made for all of them side by side."""
        tokens = None
        if self.by_word and self.ranked is not None and len(blocks) > 1 and all(
                _USUAL.fullmatch(b) and not b[-1].isspace() for b in blocks):
            tokens = self._together(blocks)
        whole, n_a, n_b, a_ids, b_ids = tokens or self._one_by_one(blocks)
        a_starts, b_starts = _starts(n_a), _starts(n_b)
        found = align(self.lengths_a[a_ids], self.lengths_b[b_ids])
        row, column = found.ends_together()
        pairs = a_ids[row] << self.shift | b_ids[column]
        pair_starts = np.searchsorted(row, a_starts)
        # Where each group starts on either side, and from that the order of its text.
        a_first = np.searchsorted(found.a_groups, np.arange(found.n_groups + 1))
        b_first = np.searchsorted(found.b_groups, np.arange(found.n_groups + 1))
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        size_a, size_b = len(self.bytes_a), len(self.bytes_b)
        last = np.zeros(len(a_ids), np.bool_)
        last[a_first[1:] - 1] = True
        order[np.arange(len(a_ids)) + b_first[found.a_groups]] = a_ids + size_a * last
        last = np.zeros(len(b_ids), np.bool_)
        last[b_first[1:] - 1] = True
        order[np.arange(len(b_ids)) + a_first[found.b_groups + 1]] = (
            2 * size_a + b_ids + size_b * last)
        shown = list(map(self.shown.__getitem__, order.tolist()))
        ends = (a_starts + b_starts).tolist()
        texts = ["".join(shown[i:j]) for i, j in zip(ends, ends[1:])]
        groups = found.a_groups[a_starts[1:] - 1] if len(a_ids) else np.zeros(len(blocks), np.int64)
        n_groups = np.zeros(len(blocks), np.int64)
        filled = np.flatnonzero(whole)
        n_groups[filled] = np.diff(groups[filled] + 1, prepend=0)
        return Words(whole, n_a, n_b, n_groups, texts, pairs, pair_starts)

    def blocks(self, text: str) -> list[str]:
        """A space and the text, cut before every blank that does not follow a blank."""
        whole = f" {text}"
        if not self.by_word:
            return [whole]
        if not _UNEVEN.search(whole):
            return [f" {word}" for word in text.split(" ")]
        return [*filter(None, _CUT.split(whole))]


# Blanks behind blanks, or at the end.
_UNEVEN = re.compile(r"\s |\s\Z")
# A blank behind a mark, unless only blanks follow: those stay with the last word.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


@dataclass
class Words:
    """Alignments of blocks, one entry each."""

    whole: np.ndarray = None
    n_a: np.ndarray = None
    n_b: np.ndarray = None
    n_groups: np.ndarray = None
    texts: list[str] = None
    pairs: np.ndarray = None
    starts: np.ndarray = None

    def __post_init__(self):
        if self.whole is None:
            none = np.zeros(0, np.int64)
            self.whole, self.n_a, self.n_b, self.n_groups = none.astype(np.bool_), none, none, none
            self.texts, self.pairs, self.starts = [], none, np.zeros(1, np.int64)
        self.places: dict[str, int] = {}

    def add(self, blocks: list[str], more: "Words") -> None:
        for block in blocks:
            self.places[block] = len(self.places)
        self.starts = np.concatenate([self.starts, more.starts[1:] + len(self.pairs)])
        self.pairs = np.concatenate([self.pairs, more.pairs])
        self.texts.extend(more.texts)
        for name in ("whole", "n_a", "n_b", "n_groups"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))


COLUMNS = "n_a long, n_b long, n_groups long, groups string"


def _align_texts(tools: OpenTools, texts: list[str | None], kind: pa.DataType) -> list[pa.Array]:
    """`COLUMNS` and the id pairs of each text."""
    cut = [tools.blocks(text) if text else [] for text in texts]
    if len(tools.words.texts) > CACHE_WORDS:
        tools.words = Words()
    known = tools.words
    new = set().union(*cut).difference(known.places)
    usual, rare = [], []
    for block in new:
        if len(block) <= LONGEST_WORD:
            (usual if _USUAL.fullmatch(block) and not block[-1].isspace() else rare).append(block)
    for short in (usual, rare):
        if short:
            known.add(short, tools.learn(short))
    out = ([], [], [], [], [])
    for blocks in cut:
        long = sorted({block for block in blocks if len(block) > LONGEST_WORD})
        source, places = known, known.places
        if long:  # looked up in a table of the text's own
            source, own = Words(), sorted(set(blocks))
            source.add(own, tools.learn(own))
            places = source.places
        at = np.fromiter(map(places.__getitem__, blocks), np.int64, len(blocks))
        if not source.whole[at].all():
            at = at[:0]
        starts, ends = source.starts[at], source.starts[at + 1]
        out[0].append(int(source.n_a[at].sum()))
        out[1].append(int(source.n_b[at].sum()))
        out[2].append(int(source.n_groups[at].sum()))
        out[3].append("".join(map(source.texts.__getitem__, at.tolist()))[:-1])
        out[4].append(source.pairs[_ragged(starts, ends - starts)])
    lengths = np.fromiter(map(len, out[4]), np.int64, len(out[4]))
    flat = np.concatenate([np.zeros(0, np.int64), *out[4]])
    return [*[pa.array(column, pa.int64()) for column in out[:3]], pa.array(out[3], pa.string()),
            pa.ListArray.from_arrays(pa.array(_starts(lengths), pa.int32()), pa.array(flat, kind))]


def aligned(docs: DataFrame, tools: Tools, doc_id: str = "doc_id", text: str = "text"
            ) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs): the groups as text, `a1,a2|b1;a3|b2,b3`, and
    the id pair of every link whose byte ranges end together, in order."""

    def step(batches) -> Iterator[pa.RecordBatch]:
        opened = tools.open()
        for batch in batches:
            for a, b, texts in common.slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *_align_texts(opened, texts, number)],
                    names=[doc_id, "n_a", "n_b", "n_groups", "groups", "pairs"])

    number = pa.int32() if tools.kind == "int" else pa.int64()
    kind = docs.schema[doc_id].dataType.simpleString()
    return common.mapped(docs.select(doc_id, text), step,
                         f"`{doc_id}` {kind}, {COLUMNS}, pairs array<{tools.kind}>")


KINDS = ("end", "overlap", "group")


def links(docs: DataFrame, tools: Tools, kind: str = "end", doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, a_place, b_place, a, b, weight): links between token occurrences, as ids and as
    places in their text. `kind` is end, overlap (weight: bytes shared) or group."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind!r}")

    def found(opened: OpenTools, value: str) -> Iterator[tuple]:
        first, second = opened.encode([f" {value}"])
        a, b = first[0], np.array(second[0], np.int64)
        whole = f" {value}".encode()
        if any(b"".join(map(side.__getitem__, ids.tolist())) != whole
               for side, ids in ((opened.bytes_a, a), (opened.bytes_b, b))):
            return
        both = align(opened.lengths_a[a], opened.lengths_b[b])
        if kind == "end":
            rows, columns = both.ends_together()
            parts = [(rows, columns, np.ones(len(rows), np.int32))]
        else:
            parts = both.overlaps() if kind == "overlap" else both.shared_groups()
        for rows, columns, weight in parts:
            yield rows, columns, a[rows], b[columns], weight.astype(np.int64)

    def step(batches) -> Iterator[pa.RecordBatch]:
        opened = tools.open()
        for batch in batches:
            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py()
                for columns in found(opened, value) if value else ():
                    ids = batch.column(0).take(pa.array(np.full(len(columns[0]), row)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, *[pa.array(column, pa.int64()) for column in columns]],
                        names=[doc_id, "a_place", "b_place", "a", "b", "weight"])

    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}"
    names = ("a_place", "b_place", "a", "b", "weight")
    return common.mapped(docs.select(doc_id, text), step,
                         ", ".join([schema, *[f"{name} long" for name in names]]))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each id pair."""
    return pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"))


def compare(docs: DataFrame, tools: Tools, doc_id: str = "doc_id", text: str = "text"
            ) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent one
    of its second id, ties included), count_sum (of the counts over its links), groups_sha256."""
    found = common.written(aligned(docs, tools, doc_id, text).select(
        F.col(doc_id).alias("id"), "n_a", "n_b", "n_groups",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "pairs"), "alignments")
    counts = pair_counts(found).toArrow().sort_by("pair")  # bounded by the vocabularies
    pair, n = counts["pair"].to_numpy().astype(np.int64), counts["n"].to_numpy()
    second = pair & (1 << tools.shift) - 1
    highest = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, second, n)
    arrays = common.ShippedArrays(docs.sparkSession, {
        "pair": pair.astype(np.int32 if tools.kind == "int" else np.int64),
        "n": n.astype(np.int64), "best": (n == highest[second]).astype(np.int64)})

    def step(batches) -> Iterator[pa.RecordBatch]:
        _open.clear()  # the words that this worker remembers from aligning
        known = arrays.open()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column("pairs")
                at = np.searchsorted(known["pair"], lists.flatten().to_numpy())
                ends = _starts(lists.value_lengths().to_numpy())
                sums = [np.diff(_starts(known[name][at])[ends]) for name in ("best", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(name) for name in head], pa.array(np.diff(ends)),
                     *map(pa.array, sums)], names=[*head, "n_links", "n_best", "count_sum"])

    head = ("id", "n_a", "n_b", "n_groups", "groups_sha256")
    kinds = [f"{name} {found.schema[name].dataType.simpleString()}" for name in head]
    summed = common.mapped(found, step, ", ".join(
        [*kinds, "n_links long, n_best long, count_sum long"]))
    return summed.select(F.col("id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best",
                         "count_sum", "groups_sha256")
