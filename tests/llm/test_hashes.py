"""Different words, lines and texts never count as equal, also those on which sums of powers agree."""

import numpy as np
import pyarrow as pa

from tidewarden.llm import arrays, minhash, packing, piece_counts, tree_rules
from tidewarden.llm.queries import tokenizer


def swapped(n):
    """Two words of n letters (n a power of two) on which every sum of letter values times powers of a number agrees
    modulo 2^64 for n of 1,024 or more."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_and_equality():
    texts = [" ".join([*swapped(1024), *swapped(128), *swapped(4096), "Short", "short"]), "", "y" * 256 + " " + "y" * 257, "Ünï A é"]
    (part,) = arrays.parts(pa.array(texts))
    words = arrays.words(part)
    plain = [w.encode() for t in texts for w in t.split()]
    assert len(set(arrays.hashes(part, words).tolist())) == len(set(plain))
    assert len(set(arrays.hashes(part, words, lower=True).tolist())) == len({w.lower() for w in plain})
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(plain)), np.arange(len(plain))))
    assert arrays.same_bytes(part, words, a, b).tolist() == [plain[i] == plain[j] for i, j in zip(a, b, strict=True)]


def test_operators(spark):
    x, y = swapped(1024)
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"{x}\n{y}"), (4, x)], "doc_id long, text string")

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    found = packing.pieces(docs.filter("doc_id < 3"), tokenizer("byte_bpe_50k.json"), ids=True).collect()
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in ((1, x), (2, y))}
    assert {i: [t for r in sorted(found, key=lambda r: r["start"]) if r["doc_id"] == i for t in r["ids"]] for i in (1, 2)} == want

    sets = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert sets == {1: 1, 2: 2, 3: 3, 4: 1}

    rules = {r["doc_id"]: r["n_dup_lines"] for r in tree_rules.verdicts(docs, None).collect()}
    assert set(rules.values()) == {0}

    path = tokenizer("byte_bpe_50k.tiktoken")
    counts = {r["doc_id"]: r["n_tokens"] for r in piece_counts.token_counts(docs, path).collect()}
    alone = {r["doc_id"]: r["n_tokens"] for i in (1, 2) for r in piece_counts.token_counts(docs.filter(f"doc_id = {i}"), path).collect()}
    assert {i: counts[i] for i in (1, 2)} == alone
