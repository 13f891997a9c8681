"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunks of the ids that have one, and a bitmap
that tells which of them go on. A directory tells the bits set before each block of 512, and one within it those before
each word of 64, so a place's rank, and by it the place of its next chunk, takes three look-ups: any token is read
without its neighbours, and the files are read back that way. Files hold documents in ascending doc_id order, over all
files too. Null and empty texts have only the end id; rows without doc_id come first and keep none; rows with equal
doc_id follow each other, ordered by a hash of the text; very long texts are stored whole; an empty table gives no files
and no rows; columns besides the key and the text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import LARGE_STEP, pieces, shared_folder, written
from calibra.llm.tokens import IDS, encoder

MAGIC, BLOCK, WORD = b"DAC00002", 512, 64
#: Tokens after which a file is closed; a document is never cut. Tokens looked up at once.
FILE_TOKENS, LOOK_UP = 3_000_000, 1 << 17
#: Tasks whose files' starts are added up together.
GROUP = 1024


def pack(doc_ids: pa.Array, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes: documents and where each one's ids start (one entry more), then the levels."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)]).view("<u8")
        in_words = np.bitwise_count(bits).astype(np.int64)
        before = np.cumsum(in_words) - in_words
        blocks = before[:: BLOCK // WORD].astype("<u8")
        words = (before - np.repeat(before[:: BLOCK // WORD], BLOCK // WORD)).astype("<u2")
        levels.append((len(rest), (rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes(), blocks.tobytes(), words.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<8sQQI", MAGIC, len(doc_ids), len(ids), len(levels))
    table = doc_ids.fill_null(0).to_numpy().astype("<i8").tobytes() + doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + starts.astype("<u8").tobytes()
    return head + table + b"".join(struct.pack("<QQQQ", n, *map(len, x[1:])) + b"".join(x) for n, *x in levels)


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, self.n, levels = struct.unpack_from("<8sQQI", raw)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = struct.calcsize("<8sQQI")

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids = pa.array(part("<i8", docs), mask=part("u1", docs).astype(bool))
        self.starts = part("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n, b, k, w = struct.unpack_from("<QQQQ", raw, at)
            at += 32
            self.levels.append((part("u1", n), part("<u8", b // 8), part("<u8", k // 8), part("<u2", w // 2)))

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, each found by itself."""
        at = np.asarray(places, np.int64)
        out, who = np.zeros(len(at), IDS), None
        for k, (chunks, bits, blocks, words) in enumerate(self.levels):
            own = chunks[at].astype(IDS)
            if who is None:
                out = own
            else:
                out[who] |= own << IDS.type(8 * k)
            if k + 1 == len(self.levels):
                break
            word = bits[at >> 6]
            bit = (at & 63).astype(np.uint64)
            on = np.flatnonzero(word >> bit & np.uint64(1))
            if not len(on):
                break
            who = on if who is None else who[on]
            at, word, bit = at[on], word[on], bit[on]
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            at = blocks[at >> 9].astype(np.int64) + words[at >> 6] + before
        return out

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of each document, some LOOK_UP tokens looked up at once."""
        a = 0
        while a < len(self.doc_ids):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + LOOK_UP, side="right")) - 1)
            ids, cuts = self[np.arange(self.starts[a], self.starts[b])], (self.starts[a : b + 1] - self.starts[a]).tolist()
            yield from ((a + i, ids[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:])))
            a = b


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all; another attempt at the same task writes the same bytes."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(data)
    store.move(draft, f"{path}/{name}")


def write(docs: DataFrame, path: str, end: int, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, appends `end`, and writes the files; returns their list (file, n_docs, n_tokens, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        rows: list[tuple[str, int, int]] = []

        def close() -> None:
            doc_ids, size, ids = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2))
            name = f"part-{task:07d}-{len(rows):05d}.dac"
            put(folder, name, pack(doc_ids, np.concatenate([[0], np.cumsum(size)]), ids))
            rows.append((name, len(doc_ids), len(ids)))
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text", LARGE_STEP):
                ids, starts = encode(part.column("text"))
                held.append((part.column("doc_id"), np.diff(starts) + 1, np.insert(ids, starts[1:], end)))
                if sum(len(x[2]) for x in held) >= FILE_TOKENS:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))], ["task", "file", "n_docs", "n_tokens"])

    # equal rows may be dealt to several tasks: which of them comes first changes nothing
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = written(ordered.mapInArrow(run, "task int, file string, n_docs long, n_tokens long"), "files")
    return started(files).select("file", "n_docs", "n_tokens", "start")


def started(files: DataFrame) -> DataFrame:
    """files (task, file, n_tokens) with `start`, the tokens of all files before each. Sums go up by tasks and groups of GROUP
    tasks, so what one task orders is a task's files, a group's tasks, or the groups."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = F.floor(F.col("task") / GROUP)
    tasks = files.groupBy("task").agg(F.sum("n_tokens").alias("n")).withColumn("group", group)
    groups = tasks.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group"), "n").alias("first"))
    tasks = tasks.withColumn("second", before(Window.partitionBy("group").orderBy("task"), "n")).join(groups, "group").select("task", (F.col("first") + F.col("second")).alias("first"))
    return files.withColumn("own", before(Window.partitionBy("task").orderBy("file"), "n_tokens")).join(tasks, "task").withColumn("start", F.col("first") + F.col("own")).drop("first", "own")


def read(folder: str, files: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task reads its files by name,
    and each document's ids by their places, through the rank directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{path}/{name}") as raw:
                    f = Reader(raw.readall())
                crcs = pa.array([zlib.crc32(ids) for _, ids in f.documents()], pa.int64())
                yield pa.RecordBatch.from_arrays([f.doc_ids, pa.array(f.starts[:-1] + first), pa.array(np.diff(f.starts)), crcs], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(files.count(), 16 * files.sparkSession.sparkContext.defaultParallelism))
    return files.select("file", "start").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Writes all documents to a new shared folder and reads them back."""
    folder = shared_folder(docs.sparkSession, "dac")
    return read(folder, write(docs, path, end, folder))
