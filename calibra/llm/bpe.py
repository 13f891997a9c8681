"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's most frequent pre-tokens are compiled, with their ids, into an automaton that shares prefixes and
suffixes; numbers on its arcs add up to a word's place in the table of ids. Workers map the compiled file into
memory. A pre-token that it lacks is merged exactly, however long it is. Rows: null and empty texts have no ids and decode
to ""; repeated rows each give a row, rows without doc_id too; very long texts are encoded whole; of equally frequent words
the first in order are taken, which changes no id; an empty table gives an empty lexicon and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import freed, most, pieces, written
from calibra.llm.tokens import IDS, ByteLevel, Merges, specials

#: Words in the lexicon at most, and their bytes: a bound on the driver's work and on what is broadcast (about 2 MB).
#: Longer words are merged exactly, as all words are that the lexicon lacks.
LEXICON_WORDS, WORD_BYTES = 50_000, 64
#: Distinct words that a counting task holds before it sends them on.
COUNT_WORDS = 400_000
MAGIC = b"MATL0001"


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A transducer from distinct non-empty words to ids (little-endian 32-bit), as bytes of a file.

    States are made in the order of sorted words: once a word ends, the part of the last word that no later word can
    share is looked up in a register of equal states, so the automaton is minimal at every step.
    """
    words = sorted(entries)
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) from the root along the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, label = path.pop()
            child = arcs[state][label]
            same = register.setdefault((final[child], tuple(arcs[child].items())), child)
            arcs[state][label] = same

    last = b""
    for word, _ in words:
        shared = len(os.path.commonprefix([last, word]))
        settle(shared)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for label in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][label] = len(arcs) - 1
            path.append((state, label))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)

    number, order, stack = {}, [], [0]
    while stack:  # states that are in use, the root first
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack += arcs[s].values()
    below: dict[int, int] = {}

    def count(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            rest = [c for c in arcs[x].values() if c not in below]
            if rest:
                todo += rest
            else:
                below[x] = final[x] + sum(below[c] for c in arcs[x].values())
                todo.pop()
        return below[s]

    count(0)
    first, labels, targets, outputs = [0], bytearray(), [], []
    for s in order:
        before = int(final[s])
        for label, child in sorted(arcs[s].items()):
            labels.append(label)
            targets.append(number[child])
            outputs.append(before)
            before += below[child]
        first.append(len(labels))
    ids = [x for _, x in words]
    at = np.concatenate([[0], np.cumsum([len(x) // IDS.itemsize for x in ids])]).astype(IDS)
    head = struct.pack("<8s4I", MAGIC, len(order), len(labels), len(ids), int(at[-1]))
    tables = [np.array(x, IDS).tobytes() for x in (first, targets, outputs, at)]
    return head + b"".join(tables) + b"".join(ids) + bytes(final[s] for s in order) + bytes(labels)


class Lexicon:
    """A compiled lexicon, mapped into memory from a file that is unlinked at once."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.NamedTemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, words, ids = struct.unpack_from("<8s4I", self.map)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        view, at = memoryview(self.map), struct.calcsize("<8s4I")

        def part(n: int) -> memoryview:
            nonlocal at
            at += 4 * n
            return view[at - 4 * n : at].cast("I")

        self.first, self.target, self.output, self.at = part(states + 1), part(arcs), part(arcs), part(words + 1)
        self.ids_from = at
        at += 4 * ids
        self.final, self.labels, self.words, self.states = view[at : at + states], at + states, words, states

    def number(self, word: bytes) -> int:
        """The word's number, or -1."""
        state, total, find, first, base = 0, 0, self.map.find, self.first, self.labels
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return -1
            total += self.output[arc]
            state = self.target[arc]
        return total if self.final[state] else -1

    def ids(self, word: bytes) -> bytes | None:
        k = self.number(word)
        return None if k < 0 else self.map[self.ids_from + 4 * self.at[k] : self.ids_from + 4 * self.at[k + 1]]


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, compiled: bytes) -> None:
        self.merges, self.lexicon = Merges(path), Lexicon(compiled)
        self.encode = ByteLevel(self.pieces, specials(path))
        self.bytes_of = [self.merges.bytes_of.get(i, b"") for i in range(max(self.merges.bytes_of) + 1)]
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def pieces(self, keys: list[str]) -> list[bytes]:
        found = [self.lexicon.ids(k.encode("utf-8", "surrogatepass")) for k in keys]
        rest = [k for k, x in zip(keys, found) if x is None]
        merged = iter(self.merges(rest)) if rest else iter(())
        return [next(merged) if x is None else x for x in found]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(path: str, compiled: bytes) -> Codec:
    return Codec(path, compiled)


def codec(path: str, compiled: Broadcast) -> Codec:
    return _codec(path, compiled.value)


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n) of words of WORD_BYTES bytes or fewer, over all texts: each task counts its own, the shuffle adds up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, seen = ByteLevel(lambda keys: [b""] * len(keys), specials(path)), Counter()

        def rows() -> pa.RecordBatch:
            words: Counter = Counter()
            for k, n in seen.items():
                for w in cutter.pattern.findall(k):
                    if len(w) <= WORD_BYTES and len(w.encode("utf-8", "surrogatepass")) <= WORD_BYTES:
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                keys, codes, starts, odd = cutter.keys(part.column("text"))
                keep = np.repeat(~odd, np.diff(starts))
                for k, n in zip(keys, np.bincount(codes[keep], minlength=len(keys)).tolist()):
                    if n and len(k) <= 4 * WORD_BYTES:
                        seen[k] += n
                    elif n:
                        seen.update({x: n * m for x, m in Counter(cutter.pattern.findall(k)).items() if len(x) <= WORD_BYTES})
                for i in np.flatnonzero(odd).tolist():
                    seen.update(x for s in cutter.cut.split(part.column("text")[i].as_py()) if s not in cutter.special for x in cutter.pattern.findall(s) if len(x) <= WORD_BYTES)
                if len(seen) > COUNT_WORDS:
                    yield rows()
        yield rows()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """Compiles the `words` most frequent words of all texts (ties: by word)."""
    counted = written(word_counts(docs, path, text).where("word <> ''"), "counted")
    top = [r.word for r in most(counted, "n", "word", words).select("word").collect()]
    freed(counted)
    ids = Merges(path)(top)
    return compile_lexicon((w.encode(), x) for w, x in zip(top, ids))


def encode(docs: DataFrame, path: str, lexicon: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, starts = c.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, lexicon: Broadcast) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); a null list decodes to ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, lexicon: Broadcast) -> DataFrame:
    """Encodes and decodes every text, and returns what identifies both: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lexicon)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, starts = c.encode(part.column("text"))
                ids, cuts = ids.tolist(), starts.tolist()
                own = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(map(len, own), pa.int64()),
                        pa.array([sha(",".join(map(c.decimal.__getitem__, x)).encode()) for x in own], pa.string()),
                        pa.array([sha(c.decode(x).encode("utf-8", "surrogatepass")) for x in own], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
