"""Quality rules with suffix-array repetition.

Each text's words get a suffix array, by doubling of ranks, and longest common prefixes, by lifting through the
stored ranks. A place's longest repeat is the larger of its two neighbours' common prefixes: the intervals above a
least length are the maximal repeated substrings, and their spans' union is what the text repeats. A text whose
repeats cover too much of it, or whose longest repeat is too long, is rejected. Null and empty texts have no words
and fail; repeated rows give equal rows; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import SMALL_STEP, coded, lean, pieces, word_lists

#: Repeats count from this many words; limits of the fraction of words in repeats, in hundredths, and of the longest one.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 30, 60
MIN_WORDS, MAX_WINDOWS = 50, 50


def repeats(codes: np.ndarray) -> np.ndarray:
    """For each place of a row of codes (0 or more), the length of the longest substring from there that occurs elsewhere too."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], np.diff(codes[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels, step = [rank.copy()], 1
    group = np.cumsum(new) - 1
    active = order[(np.bincount(group)[group] > 1)]
    while len(active):
        # active: places whose group isn't single yet, in groups by rank
        second = rank[np.minimum(active + step, n)]
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        head = np.concatenate([[True], np.diff(first) != 0])
        new = head | np.concatenate([[True], np.diff(second) != 0])
        at = np.arange(len(active))
        base = first + at - np.maximum.accumulate(np.where(head, at, 0))
        rank[active] = np.maximum.accumulate(np.where(new, base, 0))
        levels.append(rank.copy())
        group = np.cumsum(new) - 1
        active = active[np.bincount(group)[group] > 1]
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    pair = np.flatnonzero(levels[0][a] == levels[0][b])  # neighbours that share a first word
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        equal = (levels[k][x] == levels[k][y]) & (x < n) & (y < n)
        common += np.where(equal, 1 << k, 0)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Places in the union of the repeats of `least` words or more; width: of their first `width` words only."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + (longest[at] if width is None else width), minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _step(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words, starts = word_lists(texts)
    n, docs = np.diff(starts), len(texts)
    doc = np.repeat(np.arange(docs), n)
    distinct, codes = coded(words)
    chars = np.fromiter(map(len, distinct), np.int64, len(distinct))
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=docs).astype(np.int64)
    # codes are made each document's own, so no common prefix crosses documents
    _, own = np.unique(doc * max(1, len(distinct)) + codes, return_inverse=True)
    longest = repeats(own)
    lines = pc.split_pattern(texts, "\n")
    where = np.repeat(np.arange(docs), np.diff(lines.offsets.to_numpy()))
    distinct, line = coded(lines.flatten())
    full = np.fromiter((bool(x.strip(" \t\n\v\f\r")) for x in distinct), bool, len(distinct))[line]
    key = where[full] * max(1, len(distinct)) + line[full]
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, doc, longest)
    return {
        "n_words": n,
        "word_chars": by_doc(chars[codes]),
        "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": np.bincount(where[full][again], minlength=docs).astype(np.int64),
        "n_repeat_words": by_doc(covered(longest, 3, 3)),
        "n_covered_words": by_doc(covered(longest, min_repeat)),
        "longest_repeat": top,
    }


def measures(docs: DataFrame, min_repeat: int = MIN_REPEAT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text: words, their characters, symbols, repeated lines, words in repeated 3-word windows, words in maximal repeats, the longest repeat."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                found = _step(part.column("text"), min_repeat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[x], pa.int64()) for x in names)], ["doc_id", *names])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{x} long" for x in ["doc_id", *names]))


def judged(docs: DataFrame) -> DataFrame:
    """The measures, base_failed (too few words, or too many in repeated windows) and kept (neither that nor too repetitive)."""
    m = measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOWS * F.col("n_words"))
    repetitive = (100 * F.col("n_covered_words") > MAX_COVERED * F.col("n_words")) | (F.col("longest_repeat") > MAX_LONGEST)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep. Rows go through one task each: no join, so repeated ids keep their own verdicts."""
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                m = _step(part.column("text"), MIN_REPEAT)
                good = (m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= MAX_WINDOWS * m["n_words"]) & (100 * m["n_covered_words"] <= MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_LONGEST)
                yield part.filter(pa.array(good)).select(names)

    return docs.mapInArrow(run, docs.schema)
