"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

A document's ids end with an end id; one that is longer than a sequence is cut into full sequences, behind a first
piece that may be shorter. Full pieces are sequences of their own. The others are dealt into blocks of about
BLOCK_ITEMS; each block is evolved on ISLANDS tasks, between epochs each island's elite migrates to the next one, and
the best elite of all islands stands. A block that reaches its lower bound ends at once, for no packing is better. Null and
empty texts are pieces of one id; repeated rows, and rows without doc_id, are packed each; long texts are encoded whole;
equal packings are told apart by their islands' numbers; an empty table gives no rows; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import LARGE_STEP, lean, pieces, written
from calibra.llm.tokens import encoder

#: Items that evolve together; a block is one task's work, and wastes half a sequence at most in the mean.
BLOCK_ITEMS, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, GENERATIONS = 4, 40


def cut(docs: DataFrame, path: str, capacity: int, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text, encoded whole."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in pieces(batch, "text", LARGE_STEP):
                ids, starts = encode(part.column("text"))
                rows = []
                ids = np.insert(ids, starts[1:], end)
                starts = starts + np.arange(len(starts))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    at, n = 0, (b - a) % capacity or min(capacity, b - a)
                    k = 0
                    while at < b - a:
                        rows.append((doc_id, k, at, n, zlib.crc32(ids[a + at : a + at + n])))
                        at, n, k = at + n, capacity, k + 1
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins by free space: the fullest bin that still takes a document is found by one bit operation."""

    def __init__(self, capacity: int) -> None:
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity = 0, capacity

    def _file(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].append(b)
        self.mask |= 1 << f

    def add_bin(self, items: list[int], free: int) -> None:
        self.items.append(items)
        self.free.append(free)
        self._file(len(self.free) - 1)

    def best_fit(self, item: int, size: int) -> None:
        over = self.mask >> size
        if not over:
            self.add_bin([item], self.capacity - size)
            return
        f = size + (over & -over).bit_length() - 1
        b = self.by_free[f].pop()
        if not self.by_free[f]:
            self.mask &= ~(1 << f)
        self.items[b].append(item)
        self.free[b] = f - size
        self._file(b)


Packing = list[tuple[int, list[int]]]  # (free space, items) of each bin


def fitted(sizes: list[int], order: list[int], capacity: int, kept: Packing = ()) -> Packing:
    bins = Bins(capacity)
    for free, items in kept:
        bins.add_bin(list(items), free)
    for i in order:
        bins.best_fit(i, sizes[i])
    return list(zip(bins.free, bins.items))


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs. For each a up to half the capacity: documents over capacity - a share a bin with none
    of size a or more, those over half of it with none of their kind, and what of the sizes from a to half doesn't fit
    beside the latter needs bins of its own (the bound of Martello and Toth)."""
    if not sizes:
        return 0
    count = np.bincount(np.array(sizes), minlength=capacity + 1).astype(np.int64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    a, half = np.arange(capacity // 2 + 1), capacity // 2 + 1  # sizes over half the capacity start at `half`
    over = n[-1] - n[half]
    beside = n[capacity - a + 1] - n[half]
    room = beside * capacity - (total[capacity - a + 1] - total[half])
    rest = total[half] - total[a]
    return int((over + np.maximum(0, -(-(rest - room) // capacity))).max())


def fitness(p: Packing, capacity: int) -> tuple[int, int]:
    """Fewer bins first, then fuller full ones."""
    return -len(p), sum((capacity - f) ** 2 for f, _ in p)


def crossed(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Injects a random half of a's well-filled bins into b, drops b's bins with any of their documents, and best-fits
    the documents that this displaces, largest first. The emptiest bins give up their documents too."""
    well = sorted(a, key=lambda x: x[0])[: max(1, len(a) * 3 // 4)]
    inject = [x for x, u in zip(well, rng.random(len(well))) if u < 0.5] or well[:1]
    held = {i for _, items in inject for i in items}
    rest, displaced = [], []
    for x in b:
        if held.isdisjoint(x[1]):
            rest.append(x)
        else:
            displaced += [i for i in x[1] if i not in held]
    rest.sort(key=lambda x: x[0])
    for _ in range(min(len(rest), 1 + len(b) // 50)):
        displaced += rest.pop()[1]
    displaced.sort(key=lambda i: -sizes[i])
    # bins with less room than the smallest displaced document needs stay as they are
    least = sizes[displaced[-1]] if displaced else capacity + 1
    kept = inject + rest
    return [x for x in kept if x[0] < least] + fitted(sizes, displaced, capacity, [x for x in kept if x[0] >= least])


def evolved(sizes: list[int], capacity: int, seed: list[int], elites: list[Packing] = ()) -> Packing:
    """The best packing that this island finds; elites: packings that came from others."""
    rng = np.random.default_rng(seed)
    bound = lower_bound(sizes, capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [*elites, fitted(sizes, order, capacity)]
    while len(people) < POPULATION and min(map(len, people)) > bound:
        noise = np.array(sizes) * rng.uniform(0.7, 1.3, len(sizes))
        people.append(fitted(sizes, np.argsort(-noise).tolist(), capacity))
    ranked = sorted(((fitness(p, capacity), p) for p in people), key=lambda x: x[0], reverse=True)
    for _ in range(GENERATIONS):
        if len(ranked[0][1]) <= bound:
            break
        i, j = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossed(ranked[i][1], ranked[j][1], sizes, capacity, rng)
        ranked.append((fitness(child, capacity), child))
        ranked.sort(key=lambda x: x[0], reverse=True)
        del ranked[POPULATION:]
    return ranked[0][1]


def pack(items: DataFrame, capacity: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """items (uid long, unique; length long, 1 to capacity) -> (uid, sequence_id, offset); sequences hold up to capacity."""
    schema = "block long, island int, uid long, length long, bin int"

    def epoch(number: int):
        @lean
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("uid", kind="stable")
            own = rows[rows["elite"] == 0] if (rows["elite"] == 0).any() else rows.drop_duplicates("uid")
            sizes = own["length"].tolist()
            elites = []
            for _, e in rows.groupby("elite"):
                if number and e["bin"].min() >= 0:
                    place: dict[int, list[int]] = {}
                    for i, b in enumerate(e["bin"].tolist()):
                        place.setdefault(b, []).append(i)
                    elites.append([(capacity - sum(sizes[i] for i in x), x) for x in place.values()])
            found = evolved(sizes, capacity, [number, int(key[0]), int(key[1])], elites)
            bins = np.empty(len(sizes), np.int32)
            for b, (_, x) in enumerate(found):
                bins[x] = b
            return pd.DataFrame({"block": key[0], "island": key[1], "uid": own["uid"].to_numpy(), "length": sizes, "bin": bins})

        return run

    part = items.where(F.col("length") < capacity)
    blocks = max(1, -(-part.count() // block_items))
    rows = part.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "uid", "length", F.lit(-1).alias("bin"), F.lit(0).alias("elite"))
    before: list[DataFrame] = []
    for number in range(EPOCHS):
        found = written(rows.groupBy("block", "island").applyInPandas(epoch(number), schema), "islands", over=before)
        before = [found]
        stay = found.withColumn("elite", F.lit(0))
        move = found.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("elite", F.lit(1))
        rows = stay.unionByName(move)
    size = found.groupBy("block", "island").agg(F.max("bin").alias("bins"))
    best = size.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select("block", F.col("best.island").alias("island"))
    chosen = found.join(best, ["block", "island"]).select("uid", (F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "length")
    # a sequence holds at most `capacity` pieces, so no window grows
    running = F.expr("sum(length) over (partition by sequence_id order by length desc, uid rows between unbounded preceding and current row)")
    chosen = chosen.select("uid", "sequence_id", (running - F.col("length")).alias("offset"))
    alone = items.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return chosen.unionByName(alone)


def packed(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of every document."""
    items = written(cut(docs, path, capacity, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return items.join(pack(items.select("uid", "length"), capacity), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
