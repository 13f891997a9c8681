"""Each stage against a brute-force version of it, on the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline as P
from calibra.llm import packing, quality, rules, substring, tokens
from calibra.llm.common import lowered, table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_duplicates", "repeated_passages", "packing"]
    first = written(P.quality_rules(spark, docs, SF), "t1")
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in rules.judged(docs).where("kept").collect()} and first.schema == docs.schema
    second = written(P.quality_classifier(spark, first, SF), "t2")
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = [{r.doc_id for r in x.collect()} for x in (first, second)]
    good = [i for i in before if labels.get(i) == 1]
    assert after <= before and sum(i in after for i in good) >= 0.9 * len(good) and second.columns == docs.columns
    third = written(P.near_duplicates(spark, second, SF), "t3")
    texts = {r.doc_id: r.text for r in second.collect()}
    shingles = {}
    for i, t in texts.items():
        w = lowered(re.findall(r"[^\x20\x09-\x0D]+", t))
        shingles[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}
    near = defaultdict(set)
    for i in texts:
        for j in texts:
            if i < j and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                near[i].add(j)
                near[j].add(i)
    kept, seen = set(), set()
    for i in sorted(texts):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    assert {r.doc_id for r in third.collect()} == kept
    fourth = written(P.repeated_passages(spark, third, SF), "t4")
    spans = defaultdict(set)
    for r in substring.spans(third).collect():
        spans[r.doc_id] |= set(range(r.start, r.end))
    for r in fourth.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text) == [x for k, x in enumerate(w) if k not in spans[r.doc_id]] and r.n_chars == len(r.text)
    last = P.packed(spark, fourth, SF).collect()
    lib = tokens._library(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert sum(r.length for r in last) == sum(len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in fourth.collect())
    assert max(r.offset + r.length for r in last) <= 1024
    assert packing.BLOCK_ITEMS and quality.THRESHOLD == 0.7
