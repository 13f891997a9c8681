"""Text operators against brute force, on rows with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calibra.llm import bpe, chat, dac, jaccard, media, packing, quality, queries, rules, substring, tokens, urls
from calibra.llm.common import components, lowered

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=random.randint(1, 7))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n))


LONG = prose(20_000, 1)
BASE = prose(120, 2)
TEXTS = [
    None, "", " \n\t", "one", "one two", "One  TWO", BASE, BASE, BASE.upper(), BASE.replace(BASE.split()[60], "zzz", 1), prose(30, 3) + "\n" + " ".join(BASE.split()[:80]) + "\n" + prose(40, 4),
    LONG, LONG + " end", "é 中文 😀 <|endoftext|> don't\u00a0x\r\n", "a b c d e f g h i j " * 30, prose(60, 6), prose(60, 7) + "\n" + prose(60, 8) + "\n" + prose(60, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", float(i)) for i, t in enumerate(TEXTS)] + [(3, "one", "en", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


alphabet = st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "'s", "é", "1", ".", "!!", "<|endoftext|>", "\x1c", "\x85", "\x02", "\u0301", "ﬁ", "Σ", "İ", "中", "😀", "\r\n", "²", "_"])


@settings(max_examples=300, deadline=None)
@given(st.lists(alphabet, max_size=14).map("".join))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_library_s(path, text):
    ids, starts = tokens.encoder(path)(pa.array([None, text, ""]))
    assert starts.tolist() == [0, 0, len(ids), len(ids)]
    assert ids.tolist() == tokens._library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_while_the_memo_forgets(path):
    r, parts = random.Random(4), ["a", "Größe", "naïve", "µ", "ª", "²", "7", " ", "  ", "\n", "\t", "\x02", "<|endoftext|>", "'s", ".", ",", "?)", "...", "İ", "中", "\x85", "THE"]
    texts = ["".join(r.choice(parts) + r.choice(["", "", " "]) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts[70] = texts[1200] = "ab" * 2000
    encode, lib = tokens.encoder.__wrapped__(path), tokens._library(path)
    encode.memo.cap, encode.parts.cap = 300, 200
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, starts = encode(pa.array([*part, None]))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [e.ids for e in lib.encode_batch_fast([*part, ""], add_special_tokens=False)]
        assert len(encode.memo.words) <= 300 + len(" ".join(part).split()) * 4


def test_long_pieces_merge():
    text = "ab" * 3000 + " " + "\n" * 50 + "é" * 700
    assert tokens.encoder(BYTE)(pa.array([text]))[0].tolist() == tokens._library(BYTE).encode(text, add_special_tokens=False).ids


def test_very_long_words(spark):
    r = random.Random(9)
    texts = ["".join(r.choices("etaoinshrdlu", k=300_000)), "a" * 100_001, "é中" * 20_000 + " x", "".join(r.choices("ab", k=65)) + " " + "b" * 63]
    lib = tokens._library(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    compiled = bpe.build_lexicon(df, BYTE)
    assert bpe.Lexicon(compiled).words == 2  # " x", and a space and 63 letters
    found = by_id(bpe.digests(df, BYTE, spark.sparkContext.broadcast(compiled)))
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_lexicon_is_exact_and_minimal():
    words = sorted({w.encode() for w in VOCABULARY})
    lex = bpe.Lexicon(bpe.compile_lexicon((w, np.array([i, 7], "<u4").tobytes()) for i, w in enumerate(words)))
    assert [lex.number(w) for w in words] == list(range(len(words)))
    assert lex.number(b"") == lex.number(b"zz") == -1 and lex.ids(words[3]) == np.array([3, 7], "<u4").tobytes()
    # states of a minimal automaton: distinct sets of continuations
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert lex.states == len({frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes})


def test_bpe_round_trip(spark, docs, empty):
    lex = spark.sparkContext.broadcast(bpe.build_lexicon(docs, BYTE, 50))
    lib = tokens._library(BYTE)
    found = by_id(bpe.digests(docs, BYTE, lex))
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BYTE, lex), BYTE, lex).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(empty, BYTE, lex).count() == 0 and bpe.Lexicon(bpe.build_lexicon(empty, BYTE)).words == 0


def test_token_files(docs, empty):
    lib, at, found = tokens._library(WORD), 0, dac.stored(docs, WORD).collect()
    rows = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(3, "one")])
    for r, (i, t) in zip(sorted(found, key=lambda r: r.start), rows, strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert dac.stored(empty, WORD).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_are_addressable(ids):
    ids = np.array(ids, "<u4")
    f = dac.Reader(dac.pack(pa.array([4]), np.array([0, len(ids)]), ids))
    at = np.random.default_rng(1).permutation(len(ids))
    assert (f[at] == ids[at]).all() and all(f[at[i : i + 1]] == ids[at[i]] for i in range(min(20, len(at))))


def test_token_files_of_rows_without_id(spark):
    rows = [(None, "b a"), (-(2**63), "c"), (None, "a"), (7, None), (7, ""), (7, "x y"), *[(9, "same words")] * 40]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(4)
    found = sorted(dac.stored(df, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -(2**63), 7, 7, 7, *[9] * 40]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert sorted(r.n_tokens for r in found[:3]) == [2, 2, 3] and len({r.ids_crc32 for r in found[6:]}) == 1


def test_media_round_trip(docs, empty):
    found = by_id(media.features(media.write(docs)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].payload_sha256, found[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert found[i].bad_frames == 0 and found[i].n_frames == len(padded) // 192
    assert found[6].media_sha256 == found[7].media_sha256 and media.features(media.write(empty)).count() == 0


def test_media_resynchronises_and_checks():
    b = media.stream(b"x" * 2000)
    a = media.parse(b)
    assert a.vbr["frames"] == len(a.offsets) == 11 and a.tags["payload_bytes"] == "2000" and a.duration == 11 * 1152 / media.Fraction(48000)
    cut = bytearray(b[: a.offsets[4]] + b"\xff\xfb junk" + b[a.offsets[4] :] + b"TAG" + bytes(125))
    cut[a.offsets[2] + 8] ^= 1
    c = media.parse(bytes(cut))
    assert len(c.offsets) == 11 and c.skipped == 7 and c.bad == 1
    assert len(media.parse(b"").offsets) == len(media.parse(b"\xff" * 500).offsets) == 0


@pytest.mark.parametrize("mark", [b"TAG", b"ID3", b"Xing", b"Info", b"VBRI", media.HEAD])
def test_media_payload_is_no_tag(mark):
    for units in (1, 2, 3):
        for at in range(192 * units - len(mark) + 1):
            raw = b"x" * at + mark + b"y" * (192 * units - len(mark) - at)
            b = media.stream(raw)
            a = media.parse(b)
            assert media.payload(b, a) == raw and len(a.offsets) == units


@given(st.binary(max_size=900), st.integers(0, 3), st.binary(max_size=40))
@settings(max_examples=150, deadline=None)
def test_media_payload_among_junk(raw, frame, junk):
    b = media.stream(raw)
    a = media.parse(b)
    assert media.payload(b, a) == media.padded(raw)
    at = int(a.offsets[min(frame, len(a.offsets) - 1)])
    junk = junk.replace(b"\xff", b"\xfe")
    cut = b[:at] + junk + b[at:] + b"TAG" + b"title".ljust(125, b"\0")
    c = media.parse(cut)
    assert media.payload(cut, c) == media.padded(raw) and c.skipped == len(junk) and c.tags["TIT2"] == "title"


def test_media_tables():
    a = media.parse(media.stream(b"x" * 192 * 400))
    assert len(a.seek) == 100 and a.seek == sorted(a.seek) and all(abs(p - a.offsets[len(a.offsets) * i // 100]) <= 240 * 401 / 256 + 240 for i, p in enumerate(a.seek))
    head = bytes([0xFF, 0xFB, 0x64, 0xC0])
    frame = bytearray(head + bytes(236))
    frame[36:62] = b"VBRI" + bytes(4) + (9).to_bytes(2, "big") + (960).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 1, 2, 1)) + bytes(0)
    frame[62:68] = b"".join(x.to_bytes(2, "big") for x in (240, 240, 240))
    a = media.parse(bytes(frame) + (head + bytes(236)) * 3)
    assert (a.vbr["frames"], a.vbr["bytes"], a.vbr["quality"], a.seek, len(a.offsets)) == (3, 960, 9, [0, 240, 480, 720], 3)


def test_packing(docs, empty):
    lib = tokens._library(BYTE)
    rows = packing.packed(docs, BYTE).collect()
    whole = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(TEXTS)}
    sequences, pieces_of = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces_of[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for s in sequences.values():
        ends = [a + n for a, n in sorted(s)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(s)] and ends[-1] <= 1024
    assert len(pieces_of[3]) == 2
    for i, ids in whole.items():
        if i != 3:
            p = sorted(pieces_of[i], key=lambda r: r.piece)
            assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(ids) and all(r.length == 1024 for r in p[1:])
    bound = -(-(sum(map(len, whole.values())) + 2) // 1024)
    assert len(sequences) <= bound + 1 and packing.packed(empty, BYTE).count() == 0


def test_genetic_packing_beats_none():
    r = random.Random(1)
    sizes = [r.choice([300, 340, 360, 400, 420, 512, 600]) for _ in range(400)]
    found = packing.evolved(sizes, 1024, [1])
    assert sorted(i for _, x in found for i in x) == list(range(400)) and all(1024 - f == sum(sizes[i] for i in x) for f, x in found)
    assert len(found) <= len(packing.fitted(sizes, sorted(range(400), key=lambda i: -sizes[i]), 1024))


@given(st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_repeats_by_brute_force(c):
    def common(i, j):
        n = 0
        while i + n < len(c) and j + n < len(c) and c[i + n] == c[j + n]:
            n += 1
        return n

    assert rules.repeats(np.array(c, np.int64)).tolist() == [max([common(i, j) for j in range(len(c)) if j != i], default=0) for i in range(len(c))]


def test_rules(docs, empty):
    found = by_id(rules.judged(docs))
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        again = {j + k for j, g in enumerate(grams) if i != 11 and i != 12 and grams.count(g) > 1 for k in range(3)}
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        if i not in (11, 12):
            assert r.n_repeat_words == len(again)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert not found[0].kept and not found[14].kept and not found[16].kept and found[6].kept and found[15].kept
    assert sorted(r.doc_id for r in rules.filtered(docs).collect()) == sorted(r.doc_id for r in rules.judged(docs).where("kept").collect())
    assert rules.judged(empty).count() == 0 and rules.filtered(docs).columns == docs.columns


def sets(t, k):
    w = lowered(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    s = [(i, sets(t, k)) for i, t in rows]
    root = list(range(len(s)))
    for _ in s:
        for a in range(len(s)):
            for b in range(len(s)):
                x, y = s[a][1], s[b][1]
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(lambda: 1 << 60)
    for a, (i, _) in enumerate(s):
        least[root[a]] = min(least[root[a]], i)
    return sorted((i, len(x), least[root[a]] if x else i) for a, (i, x) in enumerate(s))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_by_brute_force(spark, k, percent):
    r, rows = random.Random(4), []
    for group in range(6):
        w = prose(r.choice([4, 30, 80, 150]), 100 + group).split()
        for _ in range(12):
            v = list(w)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = r.choice(VOCABULARY)
            rows.append((len(rows) * 3, " ".join(v)))
    common = prose(60, 999)
    rows += [(1000 + i, prose(50, 500 + i) + " " + common) for i in range(20)]
    rows += [(2000 + i, t) for i, t in enumerate(TEXTS)] + [(2003, "one")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    found = sorted(tuple(x) for x in jaccard.clustered(df, k, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute_components(rows, k, percent)


def test_jaccard_empty(empty):
    assert jaccard.clustered(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 151)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 150, 150: 150, 151: 150}


def test_repeated_passages_are_found(spark, docs, empty):
    passage = prose(70, 50)
    rows = [(i, prose(40 + i, 1000 + i) + "\n" + (passage if i % 3 else prose(70, 2000 + i)) + "\n" + prose(35, 3000 + i)) for i in range(30)]
    fuzzy = passage.split()
    fuzzy[20], fuzzy[45] = "q1", "q2"
    rows.append((50, prose(30, 200) + " " + " ".join(fuzzy) + " " + prose(30, 201)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    found = defaultdict(set)
    for r in substring.spans(df).collect():
        found[r.doc_id] |= set(range(r.start, r.end))
        assert r.src_doc_id < r.doc_id
    for i, t in rows:
        if i < 30:
            must = set(range(40 + i, 110 + i)) if i % 3 and i > 1 else set()
            assert must <= found[i] and len(found[i] - must) <= 3
    assert len(found[50] & set(range(30, 100))) >= 66
    left = {r.doc_id: r.text for r in substring.without_spans(df, substring.spans(df)).collect()}
    assert left[0] == rows[0][1] and left[1] == rows[1][1] and passage not in left[2] and rows[2][1].startswith(left[2][:100])
    assert substring.spans(empty).count() == 0
    spans = {(r.doc_id, r.src_doc_id) for r in substring.spans(docs).collect()}
    assert {(7, 6), (8, 6), (9, 6), (10, 6), (12, 11)} <= spans
    assert substring.without_spans(docs, substring.spans(docs)).columns == docs.columns


def test_chains_by_brute_force():
    r = random.Random(3)
    for _ in range(200):
        cells = sorted({(r.randint(0, 80), r.randint(0, 80), r.randint(5, 20)) for _ in range(r.randint(1, 14))})
        y0, x0, n = (list(c) for c in zip(*cells))
        y1, x1 = [a + k for a, k in zip(y0, n)], [a + k for a, k in zip(x0, n)]
        score = []
        for i in range(len(cells)):
            before = [score[j] - substring.GAP_COST * (y0[i] - y1[j] + x0[i] - x1[j]) for j in range(i) if y1[j] - 4 <= y0[i] and x1[j] - 4 <= x0[i]]
            score.append(n[i] + max([0, *before]))
        found = substring.linked(y0, y1, x0)
        assert sorted(i for c in found for i in c) == list(range(len(cells)))
        whole = lambda c: sum(n[i] for i in c) - substring.GAP_COST * sum(y0[b] - y1[a] + x0[b] - x1[a] for a, b in zip(c, c[1:]))
        assert max(map(whole, found)) == pytest.approx(max(score)) or any(y0[b] - y1[a] > substring.REACH or x0[b] - x1[a] > substring.REACH for c in [range(len(cells))] for a in c for b in c if a < b)


def test_boxes():
    r = np.random.default_rng(1)
    for n in (1, 5, 1000):
        columns = [r.integers(-(2**63), 2**63 - 1, n), r.integers(0, 9, n), np.full(n, -(2**63))]
        assert all((a == b).all() for a, b in zip(columns, substring.unboxed(substring.boxed(columns), 3), strict=True))


def every_span(texts):
    """Words of each text that lie in a passage shared with an earlier one, by all five-word matches of all pairs."""
    rows = [np.array([hash(w) & 0xFFFFFFFF for w in lowered(t.split())], np.uint32) for t in texts]
    found = defaultdict(set)
    for i, y in enumerate(rows):
        for x in rows[:i]:
            where = defaultdict(list)
            for j in range(len(x) - 4):
                where[x[j : j + 5].tobytes()].append(j)
            hits = [(a, b) for a in range(len(y) - 4) for b in where.get(y[a : a + 5].tobytes(), ())]
            if hits:
                a, b = np.array(hits).T
                _, y0, y1, x0, _ = substring.runs(np.zeros(len(a), np.uint64), a, b, np.full(len(a), 5))
                cells = np.stack([y0, y1, x0], axis=1)
                for c in substring.linked(y0.tolist(), y1.tolist(), x0.tolist()):
                    for _, s, e, *_ in substring.passages([y], [x], [cells[c]], 50, 0.8):
                        found[i] |= set(range(s, e))
    return found


def test_recall_against_all_pairs(spark):
    r = random.Random(12)
    quotes = [prose(r.randint(8, 30), 900 + i).split() for i in range(20)]
    passages = [prose(r.randint(55, 140), 700 + i).split() for i in range(12)]
    texts = []
    for i in range(60):
        words = prose(r.randint(20, 80), 5000 + i).split()
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            for at in r.sample(range(len(p)), int(len(p) * r.choice([0, 0, 0.05, 0.1, 0.15]))):
                p[at] = r.choice(VOCABULARY)
            words += r.choice(quotes) + p + prose(r.randint(5, 40), r.random()).split()
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    want, found = every_span(texts), covered(spark, rows)
    both = sum(len(want[i] & found[i]) for i in range(60))
    assert both >= 0.98 * sum(map(len, want.values())) and both >= 0.98 * sum(map(len, found.values()))


def test_passages_of_repeated_ids_and_within_a_text(spark):
    a, b, c = prose(80, 60), prose(80, 61), prose(80, 62)
    rows = [(1, a), (1, b), (1, b), (2, prose(30, 63) + " " + b), (None, a), (3, c + " " + prose(70, 64) + " " + c), (4, "x y z " * 100)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, b int, row string")
    found = substring.spans(df)
    assert [(r.doc_id, r.version, r.start, r.end, r.src_doc_id, r.src_version) for r in found.collect()] == [(2, 0, 30, 110, 1, substring.version_of(b))]
    left = substring.without_spans(df, found)
    assert left.columns == df.columns and sorted(map(str, (tuple(x) for x in left.collect()))) == sorted(str((i, prose(30, 63) + " " if i == 2 else t, 1, "q")) for i, t in rows)
    within = {r.doc_id: (r.start, r.end, r.src_start) for r in substring.spans(df, within=True).where("doc_id = src_doc_id").collect()}
    assert within == {3: (150, 230, 0), 4: (51, 300, 0)}


def test_a_very_common_passage(spark):
    p = prose(60, 33)
    rows = [(i, prose(20 + i % 7, 4000 + i) + " " + p) for i in range(300)]
    found = covered(spark, rows)
    assert all(set(range(20 + i % 7, 80 + i % 7)) <= found[i] for i in range(1, 300)) and not found[0]


def test_verbatim_passages_behind_other_holders(spark, monkeypatch):
    """All seeds of a passage have other documents as first and as previous holder; they hold parts of it, too short for passages."""
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    p = words(60)
    parts = [p[a : a + 49] for a in (0, 3, 6, 9, 11)]
    rows = [(b + i, words(45) + x + words(45)) for b in (0, 20) for i, x in enumerate(parts)]
    rows += [(10, words(70) + p + words(50)), (40, words(55) + p + words(60))]
    rows = [(i, " ".join(x)) for i, x in rows]
    for step in (substring.STEP_SEEDS, 1):
        monkeypatch.setattr(substring, "STEP_SEEDS", step)
        found = [(x.doc_id, x.src_doc_id) for x in substring.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert (40, 10) in found
        assert set(range(55, 115)) <= covered(spark, rows)[40]


def test_documents_of_near_copies_have_few_spans(spark):
    base, rows = prose(200, 70).split(), []
    for i in range(80):
        r, w = random.Random(i), list(base)
        for at in r.sample(range(10, 190), 8):
            w[at] = f"new{i}x{at}"
        rows.append((i, " ".join(w)))
    found = substring.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) <= 2 * 79 and {x.doc_id for x in found} == set(range(1, 80))
    every = covered(spark, rows)
    assert all(len(every[i]) >= 195 for i in range(1, 80))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), max_size=25))
def test_fewest_spans_cover_the_same_words(cells):
    spans = [(a, a + n, i, 0, 0, n, 1.0) for i, (a, n) in enumerate(cells)]
    words = lambda found: {w for s in found for w in range(s[0], s[1])}
    few = substring.fewest(spans)
    assert words(few) == words(spans) and set(few) <= set(spans)
    assert all(words(few) != words([y for y in few if y != x]) for x in few)


def test_urls(spark):
    pages = [(1, "https://WWW.Example.com/en/77?x=1"), (2, "http://a.example.net/de/81"), (3, "http://example.net/de/1#t"), (4, "nothing"), (5, None), (6, "https://b.org/es/9"), (7, "https://notexample.com/en/7"), (8, "https://cheap-pills.shop.test/buy"), (9, "https://orchestra.test/en/3"), (10, "a\n://h/p"), (11, "https://com/en/"), (11, "https://com/en/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    found = {r.page_id: r for r in urls.judged(df, urls.fit(urls.examples(spark)), queries.URL_RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in (1, 2, 3, 6, 7, 11)] == [
        ("www.example.com", "/en/77", "example.com/en/7", "allow"), ("a.example.net", "/de/81", "example.net/de/8", "block"), ("example.net", "/de/1", "net/de/", "allow"),
        ("b.org", "/es/9", "org/es/", "block"), ("notexample.com", "/en/7", "com/en/", "block"), ("com", "/en/", "com/en/", "block")]
    assert (found[4].host, found[5].path, found[4].rule, found[10].host) == ("", "", None, "h")
    assert found[8].verdict == "block" and found[9].verdict == "allow"


def test_chat(spark):
    logs = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (5, None, "user", "x"), (None, 0, "user", "hi"), (6, 0, "user", "hi"), (6, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, 9) for r in logs], "conv_id long, turn long, role string, text string, n long")
    found = {r.conv_id: r for r in chat.rendered(df).collect()}
    assert set(found) == {2, 4, 5, 6} and (found[2].n_turns, found[2].n_copies) == (2, 2)
    assert found[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n" and found[5].text.startswith("<|im_start|>user\nx") and found[6].n_turns == 2
    assert chat.rendered(df.where("false")).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, " ".join(w + ("!!" if i % 4 == 0 else "") for w in r.choices(VOCABULARY, k=60))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    l = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    m = spark.sparkContext.broadcast(quality.fit(d, l, max_rows=200))
    s = {x.doc_id: x.score for x in quality.scored(d, m).collect()}
    assert all((s[i] >= 0.7) == (i % 4 != 0) for i in range(300, 400))
    q = quality.scored(docs, m)
    assert q.columns == ["doc_id", "text", "lang", "score"] and q.count() == len(TEXTS) + 1 and q.where("score between 0 and 1").count() == len(TEXTS) + 1
    none = spark.sparkContext.broadcast(quality.fit(empty, l.where("false")))
    assert {x.score for x in quality.scored(docs, none).collect()} == {0.5} and quality.scored(empty, none).count() == 0
    held = {x.doc_id: x.h for x in d.select("doc_id", quality.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def planted(edit, similarity, pairs=30, length=60, seed=1):
    """Rows of pairs of documents (2i, 2i + 1) that share one passage, edited in the later one, and its words there."""
    r, rows, where = random.Random(seed), [], {}
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    for i in range(pairs):
        base, a, b = words(length), words(r.randint(60, 120)), words(r.randint(60, 120))
        p = list(base)
        for at in sorted(r.sample(range(1, length - 1), round(length * (1 - similarity))), reverse=True):
            p[at : at + (edit != "insert")] = [] if edit == "delete" else words(1)
        rows += [(2 * i, " ".join(a + base + words(90))), (2 * i + 1, " ".join(b + p + words(90)))]
        where[2 * i + 1] = set(range(len(b), len(b) + len(p)))
    return rows, where


def covered(spark, rows):
    found = defaultdict(set)
    for r in substring.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id] |= set(range(r.start, r.end))
    return found


@pytest.mark.parametrize(("edit", "similarity", "least"), [("insert", 59 / 60, 1.0), ("insert", 0.9, 0.98), ("delete", 0.9, 0.98), ("insert", 0.8, 0.75), ("delete", 0.85, 0.75), ("replace", 0.9, 0.85)])
def test_edited_passages_are_found(spark, edit, similarity, least):
    rows, where = planted(edit, similarity)
    found = covered(spark, rows)
    assert sum(len(found[i] & w) >= 0.75 * len(w) for i, w in where.items()) >= least * len(where)
    assert all(len(found[i] - where.get(i, set())) <= 2 for i, _ in rows)


@pytest.mark.parametrize("parts", [(40, 40), (20, 20, 20), (30, 30, 30), (45, 45, 45), (19, 19, 19)])
def test_exact_passages_of_sentences_that_earlier_documents_have(spark, parts):
    r, rows, where = random.Random(6), [], {}
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    for i in range(40):
        sentences = [words(n) for n in parts]
        for j, s in enumerate(sentences):
            rows.append((1000 * j + i, " ".join(words(70) + s + words(70))))
        for at in (10_000 + i, 20_000 + i):
            head = words(r.randint(60, 90))
            rows.append((at, " ".join(head + sum(sentences, []) + words(70))))
            where[at] = set(range(len(head), len(head) + sum(parts)))
    found = covered(spark, rows)
    assert all(where[i] <= found[i] for i in where if i >= 20_000)


def test_chains_below_similarity_are_split(spark):
    r, rows, where = random.Random(8), [], {}
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    for i in range(20):
        blocks = [words(r.choice([52, 60, 70])) for _ in range(5)]
        earlier, later, own = [], words(60), set()
        for b in blocks:
            own |= set(range(len(later), len(later) + len(b)))
            earlier, later = earlier + b + words(45), later + b
            later += words(3)
        rows += [(2 * i, " ".join(words(60) + earlier)), (2 * i + 1, " ".join(later + words(60)))]
        where[2 * i + 1] = own
    found = covered(spark, rows)
    assert all(w <= found[i] for i, w in where.items())
    cells = np.array([[0, 20, 0], [21, 30, 22], [30, 60, 80]])
    assert [len(p) for p in substring.split(cells)] == [2, 1]


def test_passages_at_the_promised_similarity_are_found(spark):
    rows, where = planted("replace", 0.8, pairs=60)
    found = covered(spark, rows)
    assert sum(len(found[i] & w) >= 0.75 * len(w) for i, w in where.items()) >= 0.9 * len(where)
    rows, where = planted("replace", 0.85, pairs=60)
    found = covered(spark, rows)
    assert sum(len(found[i] & w) >= 0.75 * len(w) for i, w in where.items()) >= 0.98 * len(where)


def test_jaccard_links_copies_of_a_row_without_id(spark):
    base = prose(120, 77)
    near = base.replace(base.split()[60], "zzz", 1)
    df = spark.createDataFrame([(None, base), (5, base), (6, base), (9, near), (12, prose(80, 78))], "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.component_id) for r in jaccard.clustered(df, 3, 90).collect()}
    assert found == {(None, 5), (5, 5), (6, 5), (9, 5), (12, 12)}


def test_one_of_each(spark, docs, empty):
    a, b = prose(100, 77), prose(100, 78)
    near = a.replace(a.split()[60], "zzz", 1)
    rows = [(1, a), (1, b), (1, b), (2, near), (3, b + " x"), (None, near), (None, prose(90, 79)), (None, prose(90, 79)), (None, prose(90, 80)), (4, None), (4, None), (4, " "), (5, "one two")]
    df = spark.createDataFrame([(i, t, 3, 4.0, "r") for i, t in rows], "doc_id long, text string, id int, s1 double, row string").repartition(3)
    found = sorted((str(r.doc_id), r.text or "") for r in jaccard.one_of_each(df).collect())
    assert found == sorted((str(i), t or "") for i, t in [(1, a), (1, b), (None, prose(90, 79)), (None, prose(90, 80)), (4, None), (4, None), (4, " "), (5, "one two")])
    assert jaccard.one_of_each(df).schema == df.schema and jaccard.one_of_each(empty).count() == 0


def test_every_shingle_is_a_seed(spark):
    words = [np.random.default_rng(i).integers(1, 1 << 60, n).astype(np.uint64) for i, n in enumerate((70, 20, 90))]
    doc, at, _ = substring.seeds_of(np.concatenate(words), np.cumsum([0, *map(len, words)]), 34)
    assert [(d, a // 2) for d, a in zip(doc, at) if a % 2 == 0] == [(d, a) for d, n in ((0, 70), (2, 90)) for a in range(n - 4)]
    # passages whose common runs are of five words, one shingle each
    r, rows, where = random.Random(21), [], {}
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    for i in range(300):
        base, a, b = words(59), words(50), words(50)
        p = [w if j % 6 != 5 else f"new{j}" for j, w in enumerate(base)]
        rows += [(2 * i, " ".join(a + base + words(50))), (2 * i + 1, " ".join(b + p + words(50)))]
        where[2 * i + 1] = set(range(50, 109))
    found = covered(spark, rows)
    assert all(len(found[i] & w) >= 50 for i, w in where.items())
