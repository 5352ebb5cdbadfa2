"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

The words that fill most of the corpus are counted over all documents, and the most frequent
ones are compiled, with their token ids, into a minimal acyclic transducer: states with the
same endings are one state, and the numbers on the arcs of a word add up to its rank, under
which its ids are found. The arrays of the transducer lie in one file that every executor
fetches and maps into memory. Words that it does not hold are merged pair by pair, exactly.

Results: NULL and empty texts have no ids and decode to the empty text. The strings of special
tokens in a text become their ids, as the tokenizers library does by default. Other columns of
the input are left out, so clashing names do no harm; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import common

# Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 17
LONGEST_WORD = 64  # bytes of a word in the lexicon; longer ones are merged
COUNT_FLUSH = 150_000  # distinct words a counting task holds at a time
CACHE_WORDS = 400_000  # words a worker remembers; beyond that it starts anew
COUNT_STEPS = 32  # steps for every doubling of a word's count
SHORT = 48  # pieces up to this length are merged by plain scans, others with a heap


@dataclass
class Vocabulary:
    """A byte-level BPE as plain data: token bytes by id, merges by pair, special strings."""

    tokens: list[bytes]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, merged id)
    byte_ids: list[int]
    special: dict[str, int]
    unknown_letters: str  # characters the split takes for neither letter nor digit


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _newer_letters(path: str) -> str:
    """Letters and digits of newer Unicode versions that the library's split does not know."""
    import unicodedata

    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]")
    out = []
    for code in range(0x80, 0x110000):
        mark = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(mark) != "Cn" or not known.match(mark):
            continue
        if len(split(f"a{mark}")) == 2 and len(split(f"1{mark}")) == 2:
            out.append(mark)
    return "".join(out)


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as source:
        data = json.load(source)
    letters, model = _byte_letters(), data["model"]
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    ids = dict(model["vocab"]) | special
    tokens = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        plain = all(c in letters for c in text) and text not in special
        tokens[i] = bytes(letters[c] for c in text) if plain else text.encode()
    merges = {}
    for rank, (left, right) in enumerate(
            m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
        merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    byte_ids = [0] * 256
    for letter, b in letters.items():
        byte_ids[b] = ids[letter]
    return Vocabulary(tokens, merges, byte_ids, special, _newer_letters(path))


_NONE = (1 << 62, -1)


def merge(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """The ids of one piece of text: the lowest ranked pair is merged first, leftmost first."""
    ids = [vocabulary.byte_ids[b] for b in word]
    get = vocabulary.merges.get
    if len(ids) > SHORT:
        return _merge_long(get, ids)
    found = [get(pair, _NONE) for pair in zip(ids, ids[1:])]
    while found and (best := min(found)) is not _NONE:
        at = found.index(best)
        ids[at:at + 2] = [best[1]]
        del found[at]
        if at:
            found[at - 1] = get((ids[at - 1], best[1]), _NONE)
        if at < len(found):
            found[at] = get((best[1], ids[at + 1]), _NONE)
    return ids


def _merge_long(get, ids: list[int]) -> list[int]:
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := get((ids[i], ids[j]))):
            heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in ids if i >= 0]


# --- the lexicon -------------------------------------------------------------------------------

def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of letters that stand between single spaces, over all texts."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush():
            keep = [w for w in found if len(w) <= LONGEST_WORD]
            return pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.string()), pa.array([found[w] for w in keep], pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                found.update(filter(str.isalpha, (value.as_py() or "").split(" ")))
                if len(found) > COUNT_FLUSH:
                    yield flush()
                    found.clear()
        yield flush()

    parts = common.mapped(docs.select(F.col(text)), count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer of the words as arrays.

    Arcs are sorted by (state, byte). Along a word, the outputs of its arcs add up to its rank
    among the sorted words; `starts` and `ids` hold the ids by rank.
    """
    ordered = sorted(words)
    registry: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)), of finished states

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[False, []]]  # the nodes of the last word, unfinished
    last = b""
    for word in ordered:
        common_length = 0
        while (common_length < min(len(last), len(word))
               and last[common_length] == word[common_length]):
            common_length += 1
        for depth in range(len(last), common_length, -1):
            path[depth - 1][1].append((last[depth - 1], finish(path[depth])))
        del path[common_length + 1:]
        path.extend([False, []] for _ in range(len(word) - common_length))
        path[len(word)][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], finish(path[depth])))
    root = finish(path[0])
    # States are finished after all states below them.
    below = np.zeros(len(states), np.int64)
    keys, targets, outputs = [], [], []
    for state, (final, arcs) in enumerate(states):
        passed = int(final)
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(passed)
            passed += int(below[target])
        below[state] = passed
    lists = [words[w] for w in ordered]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32),
        "outputs": np.array(outputs, np.int32), "root": np.array([root], np.int64),
        "final": np.array([f for f, _ in states], np.bool_),
        "starts": np.cumsum([0, *map(len, lists)]).astype(np.int64),
        "ids": np.array([i for ids in lists for i in ids], np.uint32),
    }


def look_up(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The rank of each word, or -1; all words walk through the transducer side by side."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rank = np.full(len(words), -1, np.int64)
    keys = lexicon["keys"]
    if not len(words) or not len(keys):
        return rank
    offsets = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    alive = np.flatnonzero(lengths > 0)
    state = np.full(len(alive), lexicon["root"][0], np.int64)
    total = np.zeros(len(alive), np.int64)
    depth = 0
    while len(alive):
        wanted = state * 256 + text[offsets[alive] + depth]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        ok = keys[at] == wanted
        alive, at = alive[ok], at[ok]
        state = lexicon["targets"][at].astype(np.int64)
        total = total[ok] + lexicon["outputs"][at]
        depth += 1
        ended = lengths[alive] == depth
        accepted = ended & lexicon["final"][state]
        rank[alive[accepted]] = total[accepted]
        alive, state, total = alive[~ended], state[~ended], total[~ended]
    return rank


# --- encoding ----------------------------------------------------------------------------------

class Codec:
    """Encodes and decodes in the tasks; made on the driver, opened once per worker."""

    def __init__(self, vocabulary, arrays: common.ShippedArrays):
        self.vocabulary, self.arrays = vocabulary, arrays

    def open(self) -> "OpenCodec":
        if self.arrays.name not in _open:
            _open.clear()
            _open[self.arrays.name] = OpenCodec(self.vocabulary.value, self.arrays.open())
        return _open[self.arrays.name]


_open: dict[str, "OpenCodec"] = {}


class OpenCodec:
    def __init__(self, vocabulary: Vocabulary, lexicon: dict[str, np.ndarray]):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = regex.compile(SPLIT)
        self.unknown = frozenset(vocabulary.unknown_letters)
        # Letters from the first one that may be unknown on; most texts have none.
        self.rare = re.compile(f"[{min(self.unknown, default=chr(0x10ffff))}-\U0010ffff]")
        self.marks = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, self.marks))})")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.rare.search(text) and not self.unknown.isdisjoint(text):
            stand_in = "".join("\ue000" if c in self.unknown else c for c in text)
            return [text[m.start():m.end()] for m in self.split.finditer(stand_in)]
        return self.split.findall(text)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        ranks = look_up(self.lexicon, raw)
        starts, ids = self.lexicon["starts"], self.lexicon["ids"]
        for word, data, rank in zip(words, raw, ranks.tolist()):
            if rank >= 0:
                self.known[word] = ids[starts[rank]:starts[rank + 1]].tobytes()
            else:
                self.known[word] = np.array(merge(self.vocabulary, data), "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            text = text or ""
            if any(mark in text for mark in self.marks):
                parts = []
                for i, part in enumerate(self.special.split(text)):
                    parts.extend([self.vocabulary.special[part]] if i % 2 else self.pieces(part))
                split.append(parts)
            else:
                split.append(self.pieces(text))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        for i in [w for w in new if isinstance(w, int)]:
            self.known[i] = np.array([i], "<u4").tobytes()
        self._learn([w for w in new if isinstance(w, str)])
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def decode(self, packed: list[bytes | None]) -> list[str]:
        get = self.vocabulary.tokens.__getitem__
        return [b"".join(map(get, np.frombuffer(p or b"", "<u4").tolist()))
                .decode("utf-8", "replace") for p in packed]


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words, as many as possible but at most `most`, equally frequent ones
    together.

    Words are put on steps of their count, COUNT_STEPS for every doubling. The words of each step
    are counted, and the highest steps that hold `most` words are taken: no task sorts all
    words, and none sends a list of its own.
    """
    step = F.floor(F.log2("n") * COUNT_STEPS)
    held, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(
            F.desc("step")).collect():
        held += row["words"]
        if held > most:
            break
        least = row["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).select("word")


def fit(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, text: str = "text"
        ) -> Codec:
    """A codec for the vocabulary at `path`, with a lexicon of the corpus's frequent words.

    The driver gets at most `lexicon_words` frequent words and the number of words per step of
    counts, and nothing else of the corpus.
    """
    spark = docs.sparkSession
    vocabulary = load_vocabulary(path)
    counts = common.written(word_counts(docs, text), "bpe-words")
    words, unknown = {}, frozenset(vocabulary.unknown_letters)
    for row in frequent_words(counts, lexicon_words).collect():
        if unknown.isdisjoint(row.word):
            data = f" {row.word}".encode()
            words[data] = merge(vocabulary, data)
    arrays = common.ShippedArrays(spark, compile_lexicon(words))
    return Codec(spark.sparkContext.broadcast(vocabulary), arrays)


def encode(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text"
           ) -> DataFrame:
    """(doc_id, ids): ids as a binary of little-endian unsigned 32-bit integers."""

    def step(batches) -> Iterator[pa.RecordBatch]:
        tools = codec.open()
        for batch in batches:
            for a, b, texts in common.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(tools.encode(texts), pa.binary())],
                    names=[doc_id, "ids"])

    return common.mapped(
        docs.select(doc_id, text), step, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, codec: Codec, doc_id: str = "doc_id", ids: str = "ids"
           ) -> DataFrame:
    """(doc_id, ids, decoded): the text of the ids, special tokens included."""

    def step(batches) -> Iterator[pa.RecordBatch]:
        tools = codec.open()
        for batch in batches:
            for a, b, packed in common.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b],
                     pa.array(tools.decode(packed), pa.string())],
                    names=[doc_id, "ids", "decoded"])

    return common.mapped(
        encoded.select(doc_id, F.col(ids).alias("ids")), step, f"`{doc_id}` {encoded.schema[doc_id].dataType.simpleString()}, ids binary,"
              " decoded string")


def round_trip(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text"
               ) -> DataFrame:
    """(doc_id, ids, decoded): `encode` and `decode` in one pass, with one worker per task."""

    def step(batches) -> Iterator[pa.RecordBatch]:
        tools = codec.open()
        for batch in batches:
            for a, b, texts in common.slices(batch.column(1)):
                packed = tools.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(packed, pa.binary()),
                     pa.array(tools.decode(packed), pa.string())],
                    names=[doc_id, "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.mapped(docs.select(doc_id, text), step,
                         f"`{doc_id}` {kind}, ids binary, decoded string")


def digests(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text"
            ) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the text decoded from them."""
    return round_trip(docs, codec, doc_id, text).select(
        doc_id,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
