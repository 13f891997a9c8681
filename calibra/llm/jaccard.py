"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes its set of distinct word shingles, as 64-bit hashes. Texts with equal sets form a class; joins see
one row for each class. Shingles are put in one order, the corpus's frequent ones last, so each set's prefix holds its
rarest ones: two sets that are similar enough share a shingle of both prefixes, and if both prefixes are l - 1 longer,
at least l. Each class chooses its l by estimated cost, and a pair of classes is held to the lesser l of the two.

Links are found in two steps, so that a group of many near copies never meets in all its pairs. First each prefix
shingle's holders meet only its hub, the holder with the fewest rarer shingles; verified links merge into components.
Then holders of a shingle meet across components only. Every pair of an emitted row is checked exactly, on whole sets.

Null and empty texts have no shingles and link with nothing; fewer than k words are one shingle; repeated rows are
one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.llm.common import SMALL_STEP, bit_filter, bounded, coded, components, filter_cells, freed, hashed, in_filter, lean, lowered, mixed, most, pieces, shingles, word_lists, written

#: Frequent shingles that the order knows by their frequency, at most: a bound on what is broadcast (about 3 MB).
FREQUENT = 200_000
#: The longest adaptive prefixes ask for this many shared shingles; what a verification costs beside a posting.
MOST_MATCHES, VERIFY_COST = 3, 8.0
#: Stands for a null doc_id where sets are fetched by id and signature.
NO_ID = -(2**63)
#: Bits of a set by which a pair of sets that differ too much is known before its sets are sent (a power of two).
PARITY_BITS = 512
#: Shingles that a counting task holds.
COUNT_STEP = 4_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, in a row, and where each text's start (one entry more)."""
    words, starts = word_lists(texts)
    distinct, codes = coded(words)
    h = hashed(lowered(distinct))[codes] if distinct else np.empty(0, np.uint64)
    n = np.diff(starts)
    doc = np.repeat(np.arange(len(n)), n)
    w = shingles(h, k)
    inside = doc[: len(w)] == doc[k - 1 :] if len(w) else np.empty(0, bool)
    docs, values = doc[: len(w)][inside], w[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        docs = np.concatenate([docs, short])
        values = np.concatenate([values, [shingles(h[starts[i] : starts[i + 1]], int(n[i]))[0] for i in short]])
    by = np.lexsort((values, docs))
    docs, values = docs[by], values[by]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[new], values[new]
    return values, np.searchsorted(docs, np.arange(len(n) + 1))


def signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    full = np.diff(starts) > 0
    out = []
    for salt in (0, 1):
        total = np.zeros(len(starts) - 1, np.uint64)
        if full.any():
            total[full] = np.add.reduceat(mixed(values + np.uint64(salt * 77777)), starts[:-1][full])
        out.append(total.view(np.int64))
    return out[0], out[1]


def parities(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """PARITY_BITS bits of each set, as 64-bit integers: each element flips one. Where two sets' bits differ, their elements do."""
    out, docs = [], len(starts) - 1
    for a in range(0, docs, 1024):
        b = min(docs, a + 1024)
        v = values[starts[a] : starts[b]]
        doc = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
        held = np.bincount(doc * PARITY_BITS + (v & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=(b - a) * PARITY_BITS)
        out.append(np.packbits((held & 1).astype(bool)).view(np.int64))
    flat, width = np.concatenate(out) if out else np.empty(0, np.int64), PARITY_BITS // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * width, pa.int32()), pa.array(flat))


def need(n, percent: int):
    """Shingles that a set of n must share with any set that is similar enough."""
    return (n * percent + 99) // 100


def frequent(docs: DataFrame, k: int, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of frequent shingles and their counts: each task sends what it meets three times or more.

    Counts need not be exact: any order of shingles gives right results, a good one gives short lists.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def rows() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 2].view(np.int64)), pa.array(n[n > 2])], ["t", "n"])

        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                v, _ = shingle_sets(part.column("text"), k)
                held.append(v)
                total += len(v)
                if total > COUNT_STEP:
                    yield rows()
                    total = 0
        yield rows()

    counted = written(docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")), "counted")
    top = most(counted, "n", "t", size).toArrow()
    freed(counted)
    t, n = top["t"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by = np.argsort(t)
    return t[by], n[by]


def prefixes(docs: DataFrame, k: int, percent: int, order: Broadcast) -> DataFrame:
    """(doc_id, n, s1, s2, bits, prefix): each set's size, signature, parities, and first shingles in the order, MOST_MATCHES - 1 more than one match needs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = order.value
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                v, starts = shingle_sets(part.column("text"), k)
                s1, s2 = signatures(v, starts)
                bits, n = parities(v, starts), np.diff(starts)
                doc = np.repeat(np.arange(len(n)), n)
                often = np.zeros(len(v), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    often = np.where(known[at] == v, count[at], 0)
                v = v[np.lexsort((v, often, doc))]
                size = np.minimum(n, n - need(n, percent) + MOST_MATCHES)
                take = np.arange(len(v)) - np.repeat(starts[:-1], n) < np.repeat(size, n)
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(v[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2), bits, cells], ["doc_id", "n", "s1", "s2", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits array<long>, prefix array<long>")


def sent(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, b, items) of each row (cid, b, id, s1, s2) in wanted; items: the whole set of class cid, ascending, as bytes. id: a doc_id of the class, NO_ID for null.

    Texts stay where they are read: a filter of the wanted ids picks the rows whose sets are made and sent.
    """
    chosen = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("id").alias("doc_id")).distinct()))  # FILTER_WORDS words at most

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(chosen.value, batch.column("b"))))
            for part in pieces(batch, "text", SMALL_STEP):
                v, starts = shingle_sets(part.column("text"), k)
                s1, s2 = signatures(v, starts)
                items = pa.array([v[x:y].tobytes() for x, y in zip(starts, starts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s1), pa.array(s2), items], ["id", "s1", "s2", "items"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    made = own.withColumn("b", filter_cells("id")).mapInArrow(run, "id long, s1 long, s2 long, items binary")
    # rows of one id with equal sets give one
    return made.groupBy("id", "s1", "s2").agg(F.first("items").alias("items")).join(wanted, ["id", "s1", "s2"]).select("cid", "b", "items")


def verified(moved: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough, of sets (cid, b, items) that were sent to b; b's own set is among them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    x = moved.where("cid <> b").select(F.col("cid").alias("a"), "b", F.col("items").alias("x"))
    y = moved.where("cid = b").select("b", F.col("items").alias("y"))
    return x.join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def joined(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (cid, doc_id, n, s1, s2), members (doc_id, n, s1, s2) and links (a, b) between classes, after hub and cross joins.

    Links are enough of them to connect all classes that links connect; both classes of a link are similar enough.
    All three are written; everything on the way to them is deleted.
    """
    bounded(docs.sparkSession)
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, k))  # FREQUENT shingles at most
    rows = written(prefixes(docs, k, percent, order).withColumn("uid", F.monotonically_increasing_id()), "prefixes")
    members = written(rows.select("doc_id", "n", "s1", "s2"), "members")
    found = rows.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min(F.struct("uid", "doc_id")).alias("row"), F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")
    )
    full = written(found.select(F.col("row.uid").alias("cid"), F.coalesce("row.doc_id", F.lit(NO_ID)).alias("id"), "doc_id", "n", "s1", "s2", "bits", "prefix"), "full", over=[rows])
    classes = written(full.drop("prefix"), "classes")
    cells = full.select("cid", "n", F.posexplode("prefix").alias("i", "t")).withColumn("p", F.expr(f"n - ((n * {percent} + 99) div 100) + 1"))
    # all that a shingle's holders need to know of each other, in one pass over them
    each = Window.partitionBy("t")
    hub = F.min(F.when(F.col("i") < F.col("p"), F.struct(F.col("i").alias("j"), F.col("cid").alias("b"), F.col("n").alias("m")))).over(each)
    cells = cells.withColumns({"df": F.count("*").over(each), "lo": F.min("n").over(each), "hi": F.max("n").over(each), "total": F.sum("n").over(each), "hub": hub})
    # of two or three holders all sizes are known: who has none of a like size near it can't link by this shingle
    like = lambda a, b: f"{percent} * greatest({a}, {b}) <= 100 * least({a}, {b})"
    mid = "(total - lo - hi)"
    alone = f"df = 1 or (df = 2 and not ({like('lo', 'hi')})) or (df = 3 and not case n when {mid} then {like('lo', 'n')} or {like('hi', 'n')} else {like('n', mid)} end)"
    postings = written(cells.where(f"not ({alone})").select("t", "cid", "n", "i", "p", "df", "hub"), "postings", over=[full])

    # shingles that two sets of n and m must share
    shared = f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs (a, b): those whose parities leave room, by the whole sets of their classes."""
        pairs = written(pairs, f"{name}_pairs")
        x = classes.select(F.col("cid").alias("a"), "n", F.col("bits").alias("x"))
        y = classes.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        differ = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda u, v: u + v)
        near = pairs.join(x, "a").join(y, "b").where(differ <= F.expr(f"n + m - 2 * {shared}")).select("a", "b")
        near = written(near, f"{name}_near", over=[pairs])
        ends = near.select(F.col("a").alias("cid"), "b").unionByName(near.select(F.col("b").alias("cid"), "b").distinct())
        wanted = written(ends.join(classes.select("cid", "id", "s1", "s2"), "cid"), f"{name}_ends", over=[near])
        moved = written(sent(docs, wanted, k), f"{name}_sets", over=[wanted])
        return written(verified(moved, percent), f"{name}_links", over=[moved])

    def may_link(level: str) -> str:
        """Whether two rows (n, i) and (m, j) of one shingle can belong to a link, with `level` matches so far."""
        return f"{percent} * greatest(n, m) <= 100 * least(n, m) and least(n - i, m - j) - 1 + {level} >= {shared}"

    near = postings.where("i < p and cid <> hub.b").select(F.col("cid").alias("a"), "n", "i", "hub.*").where(may_link("1"))
    links = checked(near.select("a", "b").distinct(), "hub")

    comp = components(links)
    # each class's l: the least cost of its postings and of the candidates that l matches leave
    own, costs = Window.partitionBy("cid"), []
    for x in range(1, MOST_MATCHES + 1):
        cost = F.sum(F.expr(f"if(i < p + {x - 1}, df - 1, 0)")).over(own) * (1 + VERIFY_COST / x)
        costs.append(F.when(F.expr(f"(n * {percent} + 99) div 100") >= x, F.struct(cost.alias("cost"), F.lit(x).alias("l"))))
    placed = postings.drop("hub").join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = placed.withColumn("own", F.array_min(F.array(*costs))["l"]).withColumn("l", F.explode(F.sequence(F.lit(1), "own"))).where("i < p + l - 1")
    several = Window.partitionBy("t", "l")
    owned = F.max((F.col("own") == F.col("l")).cast("int")).over(several)
    placed = placed.withColumns({"lo": F.min("component").over(several), "hi": F.max("component").over(several), "owned": owned}).where("lo < hi and owned = 1")
    placed = written(placed.select("t", "l", "cid", "n", "i", "own", "component"), "cells", over=[postings, comp])
    left = placed.where("own = l").select("t", "l", F.col("cid").alias("a"), "n", "i", F.col("component").alias("c"))
    right = placed.select(F.col("t").alias("t2"), F.col("l").alias("l2"), F.col("cid").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), "own", F.col("component").alias("d"))
    met = left.join(right, F.expr(f"t = t2 and l = l2 and c <> d and (own > l or a < b) and {may_link('l')}"))
    found = checked(met.groupBy("a", "b", "l").agg(F.count("*").alias("shared")).where("shared >= l").select("a", "b").distinct(), "cross")
    freed(placed)
    return written(classes.drop("bits", "id"), "named", over=[classes]), members, written(links.unionByName(found), "links", over=[links, found])


def clustered(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, s1, s2, n_shingles, component_id (the least doc_id that links lead to, its own included), component of every row.

    s1 and s2 sign a row's set, so that rows of one doc_id are told apart. component numbers the components, also those without
    any doc_id, whose component_id is null; it is null for a row without shingles.
    """
    classes, members, links = joined(docs, k, percent)
    comp = components(links)
    named = classes.join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("n", "s1", "s2", "component_id", "component")
    out = members.join(named, ["n", "s1", "s2"], "left").select("doc_id", "s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")
    return written(out, "clustered", over=[classes, members, links, comp])


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one of least doc_id (rows without doc_id last), of those the one whose set has
    the least signature, of equal rows any. Rows without words all stay. Columns may have any names.

    Most rows pass where they are read: a filter of the ids of rows that may go picks those that are joined.
    """
    names, schema = docs.columns, docs.schema
    found = clustered(docs, k, percent).where("component is not null")
    key = ["id", "s1", "s2"]
    found = found.select("component", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "s1", "s2")
    first = found.groupBy("component").agg(F.min(F.struct((F.col("id") == NO_ID).alias("none"), *key)).alias("first")).select("first.id", "first.s1", "first.s2", F.lit(True).alias("stays"))
    judged = found.groupBy(*key).agg(F.count("*").alias("rows")).join(first, key, "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    judged = written(judged, "judged")
    some = judged.where("not stays or rows > 1").select(F.col("id").alias("doc_id")).distinct()
    chosen = docs.sparkSession.sparkContext.broadcast(bit_filter(some))  # FILTER_WORDS words at most

    def part(hit: bool):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in pieces(batch, "text", SMALL_STEP):
                    may = in_filter(chosen.value, some.column("b"))
                    if not hit:
                        may = ~may
                        may[~may] = np.diff(word_lists(some.column("text").filter(pa.array(~may)))[1]) == 0
                        yield pa.RecordBatch.from_arrays(some.column("row").filter(pa.array(may)).flatten(), names)
                        continue
                    some = some.filter(pa.array(may))
                    v, starts = shingle_sets(some.column("text"), k)
                    s1, s2 = signatures(v, starts)
                    cells = pa.RecordBatch.from_arrays([some.column("id"), pa.array(s1), pa.array(s2), some.column("row")], ["id", "s1", "s2", "row"])
                    yield cells.filter(pa.array(np.diff(starts) > 0))

        return run

    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    whole = docs.select(id_.alias("id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("b", filter_cells("id"))
    kept = whole.mapInArrow(part(True), T.StructType([T.StructField(c, T.LongType()) for c in ("id", "s1", "s2")] + [T.StructField("row", schema)]))
    kept = kept.join(judged.where("stays").select("id", "s1", "s2"), ["id", "s1", "s2"], "left_semi").groupBy("id", "s1", "s2").agg(F.first("row").alias("row"))
    return whole.mapInArrow(part(False), schema).unionByName(kept.select(*(F.col("row")[c].alias(c) for c in names)))
