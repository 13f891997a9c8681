"""Text to token ids, a batch at a time: texts are cut where no token can cross, and each distinct piece is encoded once."""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from calibra.llm.common import ragged, word_lists

IDS = np.dtype("<u4")
#: No id: stands for cells that only the whole pattern can cut.
ODD = 0xFFFFFFFF
#: What may stand behind a word as a pre-token of its own.
STOPS = frozenset(".,;:!?)")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; the package that holds it is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Strings and their ids, in arrays; what isn't known yet is asked for once in a call.

    When more than `cap` strings or BYTES bytes are kept, the half used last stays; strings longer than LONG bytes go at the
    next call, so the memo's size is bounded. `missing` takes distinct strings and gives all their ids in a row, and how
    many each has.
    """

    LONG, BYTES = 1024, 48 << 20

    def __init__(self, missing: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], cap: int = 500_000) -> None:
        self.missing, self.cap, self.calls = missing, cap, 0
        self.words, self.flat = pa.array([], pa.large_string()), np.empty(0, IDS)
        self.n, self.size, self.used = (np.empty(0, np.int64) for _ in range(3))

    def forget(self) -> None:
        if len(self.words) <= self.cap and self.size.sum() <= self.BYTES and (self.size <= self.LONG).all():
            return
        order = np.argsort(-self.used, kind="stable")
        order = order[self.size[order] <= self.LONG]
        if len(order) > self.cap or self.size[order].sum() > self.BYTES:
            order = order[: self.cap // 2]
            order = order[np.cumsum(self.size[order]) <= self.BYTES // 2]
        keep = np.sort(order)
        self.flat = ragged(self.flat, (np.cumsum(self.n) - self.n)[keep], self.n[keep])
        self.words = self.words.take(pa.array(keep))
        self.n, self.size, self.used = self.n[keep], self.size[keep], self.used[keep]

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and how many each has."""
        self.forget()
        self.calls += 1
        had = len(self.words)
        both = pa.concat_arrays([self.words, words.cast(pa.large_string())]).dictionary_encode()
        codes = both.indices.to_numpy()[had:]
        if len(both.dictionary) > had:
            new = both.dictionary[had:]
            flat, n = self.missing(new)
            self.flat, self.n = np.concatenate([self.flat, flat]), np.concatenate([self.n, n])
            self.size = np.concatenate([self.size, pc.binary_length(new).to_numpy()])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.words = both.dictionary
        self.used[codes] = self.calls
        n = self.n[codes]
        return ragged(self.flat, (np.cumsum(self.n) - self.n)[codes], n), n


def in_a_row(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids given as bytes, and how many each has."""
    return np.frombuffer(b"".join(found), IDS), np.fromiter(map(len, found), np.int64, len(found)) // IDS.itemsize


def interleaved(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of `total` strings in their order, from groups of (places, ids in a row, how many each has)."""
    begin, n, before = np.zeros(total, np.int64), np.zeros(total, np.int64), 0
    for at, flat, own in groups:
        begin[at], n[at] = before + np.cumsum(own) - own, own
        before += len(flat)
    return ragged(np.concatenate([g[1] for g in groups]), begin, n), n


def summed(n: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Sums of n over runs of these sizes."""
    return np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])])


def letters_and_stop(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which words up to U+00FF are letters, which are letters and one stop, and all words without stops at their end."""
    latin, body = pc.match_substring_regex(words, r"^[\x{0}-\x{ff}]*$"), pc.utf8_rtrim(words, characters="".join(sorted(STOPS)))
    trimmed = pc.subtract(pc.binary_length(words), pc.binary_length(body)).to_numpy()
    letters = pc.and_(latin, pc.utf8_is_alpha(body)).to_numpy(zero_copy_only=False)
    return letters & (trimmed == 0), letters & (trimmed == 1), body


def last_bytes(words: pa.Array) -> np.ndarray:
    """The last byte of each of these large strings, none of which is empty."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + 1 + len(words)]
    return np.frombuffer(words.buffers()[2], np.uint8)[ends - 1]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Byte-pair merging of many pieces at once: in each round every piece makes its merge of least rank.

    Short pieces stand in a matrix, a row each, as symbols with links to the symbols left and right of them; a round
    touches one place of each row. Rows are grouped by length, so little is padded. Pieces of more than WIDE bytes stand in
    one row behind each other, and a round makes all merges of one rank, so time grows with their bytes. Ids are the vocabulary's.
    """

    NONE, WIDE = np.int64(1) << 40, 64

    def __init__(self, path: str) -> None:
        rules = json.load(open(path, encoding="utf-8"))
        to_byte = byte_symbols()
        self.bytes_of = {i: bytes(to_byte[c] for c in w) for w, i in rules["model"]["vocab"].items()}
        self.bytes_of |= {x["id"]: x["content"].encode() for x in rules["added_tokens"]}
        ids = rules["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_and_id = key[order], (np.arange(len(key), dtype=np.int64) << 20 | made)[order]
        self.of_byte = np.array([ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        self.first = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        # all merges of a rank can be made at once if no symbol is part of an earlier merge than one that makes it
        parts = np.array([[ids[a], ids[b]] for a, b in pairs], np.int64)
        made_last, used_first, at = np.full(made.max() + 2, -1), np.full(max(made.max(), parts.max()) + 2, len(pairs)), np.arange(len(pairs))
        np.maximum.at(made_last, made, at)
        np.minimum.at(used_first, parts.ravel(), np.repeat(at, 2))
        self.by_rank = bool((made_last[made] < used_first[made]).all())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of merging a with b; NONE where there is no such merge (or no symbol: below 0)."""
        key = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_and_id[at], self.NONE)

    def __call__(self, keys: list[str]) -> list[bytes]:
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        at = 0
        order = np.argsort(size, kind="stable")
        while at < len(order):
            if not (n := int(size[order[at]])):
                at += 1
                continue
            if n > self.WIDE and self.by_rank:
                rows = order[at:]
                for i, x in zip(rows.tolist(), self.long([raw[i] for i in rows])):
                    out[i] = x
                break
            width = max(8, 1 << (n - 1).bit_length())
            end = int(np.searchsorted(size[order], width, side="right"))
            end = min(end, at + max(1, (1 << 20) // width))
            rows = order[at:end]
            for i, x in zip(rows.tolist(), self.merged([raw[i] for i in rows], size[rows], width)):
                out[i] = x
            at = end
        return out

    def long(self, raw: list[bytes]) -> list[bytes]:
        """Ids of long pieces: ranks in ascending order, all places of one at once, of overlapping ones every other from the left."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, n = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), int(size.sum())
        sym = np.append(self.of_byte[flat], -1)  # place n stands for "no symbol"
        right, left = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        left[0] = n
        starts = np.cumsum(size) - size
        left[starts], right[starts[1:] - 1] = n, n
        alive = np.ones(n, bool)
        rank = np.append(np.where(right[:n] < n, self.first[flat * 256 + flat[np.minimum(right[:n], n - 1)]], self.NONE), self.NONE)
        places: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def file(at: np.ndarray) -> None:
            at = at[rank[at] < self.NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for a, b in zip(cuts, cuts[1:]):
                x = int(r[a])
                if x not in places:
                    places[x] = []
                    heapq.heappush(todo, x)
                places[x].append(at[a:b])

        file(np.arange(n))
        while todo:
            r = heapq.heappop(todo)
            i = np.unique(np.concatenate(places.pop(r)))
            i = i[alive[i] & (rank[i] == r)]
            if not len(i):
                continue
            tied = np.concatenate([[False], right[i[:-1]] == i[1:]])
            if tied.any():
                at = np.arange(len(i))
                i = i[(at - np.maximum.accumulate(np.where(tied, 0, at))) % 2 == 0]
            j = right[i]
            k = right[j]
            sym[i], alive[j], rank[j], right[i] = r & 0xFFFFF, False, self.NONE, k
            left[k] = i
            left[n] = n
            p = left[i]
            rank[i] = self.ranks(sym[i], np.where(k < n, sym[k], -1))
            rank[p] = self.ranks(np.where(p < n, sym[p], -1), sym[i])
            rank[n] = self.NONE
            file(np.unique(np.concatenate([i, p[p < n]])))
        ends = np.concatenate([[0], np.cumsum(alive)])
        ids, cuts = sym[:n][alive].astype(IDS).tobytes(), (ends[np.append(starts, n)] * IDS.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def merged(self, raw: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        m, w = len(raw), width + 1
        chars = np.zeros((m, w), np.int64)
        place = np.arange(w)
        here = place[None, :] < size[:, None]
        chars[here] = np.frombuffer(b"".join(raw), np.uint8)
        sym = np.where(here, self.of_byte[chars], -1)
        rank = np.full((m, w), self.NONE, np.int64)
        rank[:, :-1] = np.where(here[:, 1:], self.first[chars[:, :-1] * 256 + chars[:, 1:]], self.NONE)
        # place `width` of each row stands for "no symbol"
        right, left = np.minimum(place + 1, width) + np.zeros((m, 1), np.int64), np.where(place == 0, width, place - 1) + np.zeros((m, 1), np.int64)
        right = np.where(right < size[:, None], right, width)
        rows, alive = np.arange(m), here.copy()
        while len(rows):
            i = rank[rows, :].argmin(axis=1) if len(rows) < m else rank.argmin(axis=1)
            best = rank[rows, i]
            go = best < self.NONE
            rows, i, best = rows[go], i[go], best[go]
            if not len(rows):
                break
            j = right[rows, i]
            k = right[rows, j]
            sym[rows, i] = best & 0xFFFFF
            alive[rows, j] = False
            sym[rows, j] = -1
            rank[rows, j] = self.NONE
            right[rows, i] = k
            left[rows, k] = i
            sym[rows, width] = -1
            p = left[rows, i]
            new = sym[rows, i]
            rank[rows, i] = self.ranks(new, sym[rows, k])
            before = self.ranks(sym[rows, p], new)
            rank[rows, p] = np.where(p == width, self.NONE, before)
            rank[rows, width] = self.NONE
        counts = alive.sum(axis=1)
        flat, cuts = sym[alive].astype(IDS).tobytes(), [0, *(np.cumsum(counts) * IDS.itemsize).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class ByteLevel:
    """Byte-level BPE without a prefix space. `pieces` gives ids for pre-tokens.

    A space with no white space beside it, and a line end with none, always start a new pre-token, so such
    texts are cut there. Other texts go through the whole pattern; special tokens are cut out first.
    """

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pieces: Callable[[list[str]], Iterable[bytes]], special: dict[str, int], cap: int = 500_000) -> None:
        self.memo, self.special = Known(self.pieces, cap), special
        self.parts = Known(lambda words: in_a_row(list(pieces(words.to_pylist()))), cap)
        self.pattern = regex.compile(self.SPLIT)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @staticmethod
    def irregular(keys: pa.Array) -> np.ndarray:
        """Keys that white space begins or ends, or that hold nothing else, beside their mark."""
        marked = pc.or_(pc.starts_with(keys, "\n"), pc.starts_with(keys, "\x02"))
        body = pc.if_else(marked, pc.utf8_slice_codeunits(keys, 1, None), keys)
        size = pc.binary_length(body)
        odd = pc.or_(pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(body)), size), pc.and_(pc.equal(size, 0), pc.not_equal(keys, "\x02")))
        return odd.to_numpy(zero_copy_only=False)

    def whole(self, text: str) -> np.ndarray:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], IDS))
            elif part:
                out.append(self.parts(pa.array(self.pattern.findall(part), pa.large_string()))[0])
        return np.concatenate(out) if out else np.empty(0, IDS)

    @staticmethod
    def unmarked(cells: list[str]) -> list[str]:
        return [k if k[:1] == "\n" else k[1:] if k[:1] == "\x02" else " " + k for k in cells]

    def pieces(self, cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cells, and how many each has; an irregular cell has ODD alone. A space and letters are one pre-token, and a stop behind them is one more."""
        plain, stopped, body = letters_and_stop(cells)
        spaced = lambda x: pc.binary_join_element_wise(pa.scalar("", pa.large_string()), x, pa.scalar(" ", pa.large_string()))
        simple = plain | stopped
        marks = last_bytes(cells.filter(pa.array(stopped)))
        rest = cells.filter(pa.array(~simple))
        bad = self.irregular(rest)
        other = [() if x else self.pattern.findall(k) for x, k in zip(bad.tolist(), self.unmarked(rest.to_pylist()))]
        parts = pa.concat_arrays([spaced(body.filter(pa.array(simple))), pa.array(map(chr, marks.tolist()), pa.large_string()), pa.array(itertools.chain.from_iterable(other), pa.large_string())])
        flat, n = self.parts(parts)
        ends, (a, b) = np.concatenate([[0], np.cumsum(n)]), (int(simple.sum()), int(simple.sum()) + len(marks))
        bodies, stops = flat[: ends[a]], flat[ends[a] : ends[b]]
        own, behind = n[:a].copy(), n[a:b]
        with_stop = stopped[simple]
        bodies = np.insert(bodies, np.repeat(ends[1 : a + 1][with_stop], behind), stops)
        own[with_stop] += behind
        at, counts = np.flatnonzero(~simple), summed(n[b:], list(map(len, other)))
        odd = np.full(int(bad.sum()), ODD, IDS)
        return interleaved([(np.flatnonzero(simple), bodies, own), (at[~bad], flat[ends[b] :], counts[~bad]), (at[bad], odd, np.ones(len(odd), np.int64))], len(cells))

    def cells(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """What spaces and line ends cut the texts into, where each text's cells start, and which texts need the whole
        pattern for what they hold; those are cut as empty ones are."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring(texts, "\x02")
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\x02", pc.replace_substring(texts, "\n", " \n"), "")))
        lists = pc.split_pattern(marked, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        return lists.flatten(), starts - starts[0], odd.to_numpy(zero_copy_only=False).copy()

    def keys(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each piece's key, where each text's pieces start, and which texts need the whole pattern."""
        cells, starts, odd = self.cells(texts)
        cells = cells.dictionary_encode()
        codes, bad = cells.indices.to_numpy().astype(np.int64), self.irregular(cells.dictionary)
        if bad.any():
            odd |= np.add.reduceat(np.concatenate([bad[codes], [False]]).astype(np.int64), starts[:-1])[: len(odd)] > 0
        return self.unmarked(cells.dictionary.to_pylist()), codes, starts, odd

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's start (one entry more). Null and empty: none."""
        if not len(texts):
            return np.empty(0, IDS), np.zeros(1, np.int64)
        cells, starts, odd = self.cells(texts)
        flat, n = self.memo(cells)
        ends = np.concatenate([[0], np.cumsum(n)])[starts]
        size, bad = np.diff(ends), flat == ODD
        if bad.any():
            odd[np.searchsorted(ends, np.flatnonzero(bad), side="right") - 1] = True
        if not odd.any():
            return flat, ends
        out, at = [], 0
        for i in np.flatnonzero(odd):
            own = self.whole(texts[int(i)].as_py())
            out += [flat[at : ends[i]], own]
            at, size[i] = ends[i + 1], len(own)
        return np.concatenate([*out, flat[at:]]), np.concatenate([[0], np.cumsum(size)])


class WordLevel:
    """BPE that drops white space, lower-cases, and marks word ends in its vocabulary; ids by the tokenizers library.

    Texts are cut at ASCII white space, which no token crosses. Pieces of characters up to U+00FF, for which
    normalising is plain lower-casing, are cut into pre-tokens, so that many pieces share their ids; others go to
    the library whole. Asked-for pre-tokens go to it in one call, and ids of word ends show where each one ends.
    """

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""

    def __init__(self, path: str, cap: int = 500_000) -> None:
        self.library = _library(path)
        rules = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in rules["added_tokens"]]
        self.ends = np.zeros(max(rules["model"]["vocab"].values()) + 64, bool)
        self.ends[[i for w, i in rules["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.pattern = regex.compile(self.SPLIT)
        self.memo, self.parts = Known(self.pieces, cap), Known(self.joined, cap)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return in_a_row([np.array(e.ids, IDS).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def joined(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = parts.to_pylist()
        ids = np.array(self.library.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, IDS)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(parts) else self.each(parts)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        plain, stopped, body = letters_and_stop(words)
        simple = plain | stopped
        marks = last_bytes(words.filter(pa.array(stopped)))
        at, keys = np.flatnonzero(~simple), words.filter(pa.array(~simple)).to_pylist()
        special = any("<|" in k for k in keys)
        cut = np.array([max(k) <= "\xff" and not (special and any(x in k.lower() for x in self.special)) for k in keys], bool)
        other = [self.pattern.findall(k.lower()) for k, x in zip(keys, cut.tolist()) if x]
        parts = [pc.utf8_lower(body.filter(pa.array(simple))), pa.array(map(chr, marks.tolist()), pa.large_string()), pa.array(itertools.chain.from_iterable(other), pa.large_string())]
        flat, n = self.parts(pa.concat_arrays(parts))
        ends, a = np.concatenate([[0], np.cumsum(n)]), int(simple.sum())
        b = a + len(marks)
        own, behind, with_stop = n[:a].copy(), n[a:b], stopped[simple]
        bodies = np.insert(flat[: ends[a]], np.repeat(ends[1 : a + 1][with_stop], behind), flat[ends[a] : ends[b]])
        own[with_stop] += behind
        groups = [(np.flatnonzero(simple), bodies, own), (at[cut], flat[ends[b] :], summed(n[b:], list(map(len, other))))]
        if not cut.all():
            groups.append((at[~cut], *self.each([k for k, x in zip(keys, cut.tolist()) if not x])))
        return interleaved(groups, len(words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, starts = word_lists(texts)
        if not len(words):
            return np.empty(0, IDS), np.zeros(len(texts) + 1, np.int64)
        flat, n = self.memo(words)
        return flat, np.concatenate([[0], np.cumsum(n)])[starts]


def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def specials(path: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]}


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteLevel | WordLevel:
    """One encoder for each Python worker; its memo lasts from task to task."""
    rules = json.load(open(path, encoding="utf-8"))
    if rules["normalizer"] is None and rules["pre_tokenizer"]["type"] == "ByteLevel":
        return ByteLevel(Merges(path), specials(path))
    return WordLevel(path)
