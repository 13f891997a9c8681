"""What the text operators share: tables, shared folders, words in NumPy, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handed to one vectorised step, in bytes; bounds what a worker holds beside its Arrow batch.
STEP_BYTES = 4 << 20
#: The same where a step holds many numbers for each word, and where it holds few: equal words of a step are handled once.
SMALL_STEP, LARGE_STEP = 2 << 20, 8 << 20


#: Spark's bound on the bytes of an Arrow batch, which both sides of a Python worker hold; its default is too much for small executors.
ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have STEP_BYTES bytes at most."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW)) > STEP_BYTES:
        spark.conf.set(ARROW, str(STEP_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir. Where that is unset, a temporary folder in
    local mode; on a cluster an error, since executors would each write to their own disk."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            base = "file://" + tempfile.mkdtemp(prefix="calibra-")
            context.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes a plan's shuffle files when it ends, instead of when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, over: Iterable[DataFrame] = ()) -> DataFrame:
    """df, written to the shared folder and read back: later plans start from files that outlive an executor.

    over: what earlier calls returned and no later plan reads; their folders go once df is written.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.parquet(path)
    out._folder = path
    freed(*over)
    return out


def freed(*found: DataFrame) -> None:
    """Deletes the folders of what written() returned. Only for intermediates that no plan reads any more."""
    for df in found:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches, or over a group's table, after which the worker gives freed memory back: workers last
    from task to task, and what one has once held stays with it otherwise."""

    @functools.wraps(run)
    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    @functools.wraps(run)
    def over_rows(rows):
        try:
            return run(rows)
        finally:
            _give_back()

    @functools.wraps(run)
    def over_group(key, rows):
        try:
            return run(key, rows)
        finally:
            _give_back()

    # Spark asks for the number of arguments
    return over_batches if inspect.isgeneratorfunction(run) else over_rows if run.__code__.co_argcount == 1 else over_group


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES):
    """Slices of a batch with about `step_bytes` of text each; a row is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(size) - size) // step_bytes  # by where a row begins, so a batch that is little longer stays whole
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where each text's words start (one entry more than texts). Null: no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:
        mask = full.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(mask)])[starts]
        words = words.filter(full)
    return words, starts.astype(np.int64)


def coded(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words and each word's place among them."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.dictionary.to_pylist(), d.indices.to_numpy().astype(np.int64)


A_TO_Z = {c: c + 32 for c in range(65, 91)}


def lowered(words: list[str]) -> list[str]:
    """Words with A-Z, and nothing else, in lower case."""
    return [w.lower() if w.isascii() else w.translate(A_TO_Z) for w in words]


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all k-word windows of a row of word hashes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + codes[j : j + n]
        h ^= h >> np.uint64(32)
    return mixed(h)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and length, in a row."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every end of the edges (a, b): component is the least id that can be reached.

    Alternates the large-star and small-star contractions; each round is a few shuffles of at most the edges,
    pre-aggregated, and its result is written to the shared folder, so no lineage grows. An empty input gives an empty result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small, "edges", over=[e])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    found = e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(found.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components", over=[e])


def most(counted: DataFrame, n: str, tie: str, k: int) -> DataFrame:
    """The k rows of largest n (ties: by `tie`) of what written() returned. A histogram of the logarithm of n finds how far
    down they reach, so little more than k rows are put in order, however many partitions there are."""
    level = F.floor(F.log2(n) * 8)
    low, total = 0, 0
    for r in sorted(counted.groupBy(level.alias("b")).count().collect(), key=lambda r: -r.b):  # 504 rows at most
        low, total = r.b, total + r["count"]
        if total >= k:
            break
    return counted.where(level >= low).orderBy(F.desc(n), tie).limit(k)


#: Words of a filter of document ids, at most (8 MB); bits that it has of each id.
FILTER_WORDS, FILTER_BITS = 1 << 20, 4


def filter_cells(key: str) -> Column:
    """What in_filter() looks up for a row's id: hashes of it. Rows without an id hash as their seed does."""
    return F.array(*(F.xxhash64(F.lit(s), F.col(f"`{key}`").cast("long")) for s in range(FILTER_BITS)))


#: How far a hash is shifted for its bits in a filter of hashes.
HASH_SHIFTS = (0, 13, 26, 38)


def hash_cells(key: str) -> Column:
    """The same for a column of well mixed 64-bit hashes: the hash shifted, as in_hashes() does."""
    return F.array(*(F.shiftright(F.col(key), s) for s in HASH_SHIFTS))


def in_hashes(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter made with hash_cells() has."""
    b = (h.view(np.int64)[:, None] >> np.array(HASH_SHIFTS)) & np.int64(len(found) * 64 - 1)
    return (found[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)


def bit_filter(ids: DataFrame, cells: Column | None = None) -> np.ndarray:
    """A Bloom filter of some doc_ids (column doc_id, or what `cells` says): ten bits or more for each id, FILTER_WORDS words of 64 bits at most.

    It never misses an id. A full one lets more rows through, which the exact join behind it drops.
    """
    n = ids.count()
    size = 1 << min(FILTER_WORDS.bit_length() - 1, max(4, (n * 10 // 64).bit_length()))
    bits = ids.select(F.explode(filter_cells("doc_id") if cells is None else cells).alias("b")).select(F.expr(f"b & {size * 64 - 1}L").alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(size, np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def in_filter(found: np.ndarray, cells: pa.ListArray) -> np.ndarray:
    """Which rows' cells a filter has."""
    b = cells.flatten().to_numpy().reshape(-1, FILTER_BITS) & np.int64(len(found) * 64 - 1)
    return (found[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)


def crc32_text(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def ascii_words(text: str) -> list[str]:
    return re.findall(WORD, text or "")
