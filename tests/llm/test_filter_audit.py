"""The filter audit against plain loops, its byte transducer and hash table, and its defined cases."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from helpers import words

from tidewarden.llm import arrays, filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, digest string, failed string, n int, _salt int"
PROSE = " ".join(f"word{i % 150}x{i % 7}" for i in range(230))
DOCS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (3, None, "en"), (4, "", "de"), (5, None, None), (6, "MANY CAPITALS HERE #", "en"),
    (7, PROSE.upper(), "de"), (8, "same " * 400, "fr"), (9, PROSE + " $", None), (None, PROSE, "fr"), (None, PROSE, "fr"),
    (None, "", ""), (10, PROSE, "fr"), (10, PROSE, "fr"), (1, PROSE, "en"), (1, PROSE, "fr"), (11, "ünï 日本 \U0001f600 É\x0b\x0c\x1c|", "de"),
    (12, "x" * 400_000, "en"), (0, "late copy's first", "en"), (13, "late copy's first", "de"), (14, "same same", "en"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, 0, 1), (4, None, 1), (7, 1, None), (9, 1, 0), (None, 1, 1), (10, 1, 1), (99, 1, 1)]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", "clash", "clash", 7, 8) for d in docs], SCHEMA).repartition(3)


def fails(doc, docs):
    text, own = doc[1] or "", words(doc[1])
    found = "A" * (len(own) < 200) + "B" * (100 * len(set(own)) < 50 * len(own))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    earlier = doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == text for d in docs)
    return found + "E" * earlier


def plain(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows, shapley = {}, Counter()
    judged = [(d[0], d[2] or "", fails(d, docs)) for d in docs]
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [i for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                failing = [f for _, f in own if letter in f]
                shapley[part, letter] += len(removed)
                rows[part, order, step] = (
                    len(left), len(removed), len(failing) - len(removed), sum(f == letter for f in failing),
                    sum(i in good for i in removed), sum(i in toxic for i in removed),
                )
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_audit_against_plain_loops(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.interactions(frame(spark, DOCS), labels)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) == 4 * 600
    assert set(rows) == plain(DOCS, LABELS)
    empty = filter_audit.interactions(frame(spark, DOCS), labels.limit(0)).filter("good_lost + toxic_lost > 0")
    assert empty.count() == 0
    assert filter_audit.interactions(frame(spark, DOCS).limit(0), labels).count() == 0


def test_one_pass_and_hash_table(monkeypatch):
    texts = [d[1] for d in DOCS] + ["a", " a", "a ", "é b é", "\x0b", "b a b a A"]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("aA# \n$é日\U0001f600"), 300)) for _ in range(50)]

    def check(all_texts):
        for part in arrays.parts(pa.array(all_texts, pa.string())):
            n = filter_audit.counts(part)
            for i in range(len(part)):
                text = all_texts[part.first + i] or ""
                own = words(text)
                want = (len(own), len(set(own)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text)))
                assert tuple(int(n[k][i]) for k in ("words", "distinct", "capitals", "points", "symbols")) == want

    check(texts)
    # a hash that is equal for all words of a length: only the bytes tell them apart
    monkeypatch.setattr(arrays, "hashes", lambda part, spans, lower=False: (spans.end - spans.start).astype(np.uint64))
    check(texts)
