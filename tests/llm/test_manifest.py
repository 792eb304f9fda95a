"""The Merkle manifest against plain loops, for several fanouts and depths of blocks, and its defined cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewarden.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos int, n int, top string, path string, key string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc, text):
    return digest(*(field(v) for v in (doc[0], doc[3], doc[2], doc[4], text)))


def climb(nodes, fanout):
    """Root, and for each node the siblings left and right of each level."""
    paths, spot = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            start = spot[i] - spot[i] % fanout
            path.append(("".join(nodes[start : spot[i]]), "".join(nodes[spot[i] + 1 : start + fanout])))
            spot[i] //= fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(docs, fanout=3):
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((d for d in docs if d[3] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        trees[s] = own, *climb([leaf(d, d[1]) for d in own], fanout)
    root, above = climb([trees[s][1] for s in sources], fanout)
    rows = []
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for d, path in zip(own, paths, strict=True):
            even = zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 2 == 0
            text = d[1].replace("\n", "") if even and d[1] is not None else d[1]
            h = leaf(d, text)
            for left, right in path + up:
                h = digest(left, h, right)
            rows.append((d[0], leaf(d, d[1]), subroot, root, digest(*(x for p in path + up for x in p)), h, h == root))
    return sorted(rows, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 7, 8, "clash", "clash", "clash") for d in docs], SCHEMA).repartition(3)


def many():
    docs = [(i * 7 % 101, f"line {i}\nend {i % 3}", "en", f"s{i % 2}", i) for i in range(101)]
    docs += [(500 + i, "a\nb", None, f"small{i}", None) for i in range(11)]
    docs += [(None, "no id\n", "de", "s1", 3), (None, None, None, None, None), (7, None, "fr", "S", 0), (8, "", "fr", "S", 0)]
    docs += [(9, "same\n", "fr", "é", 5)] * 5 + [(9, "other", "fr", "é", 5), (10, "ünï\n\n" * 20_000, "日", "\U0001f600", 7)]
    return docs


def test_query_against_plain_loops(spark):
    docs = many()
    rows = manifest.without_feeds(frame(spark, docs))
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == plain(docs)


@pytest.mark.parametrize(("fanout", "depth"), [(2, 1), (3, 2), (4, 1)])
def test_rounds_of_blocks(spark, fanout, depth):
    docs = many()
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    found = manifest.manifest(frame(spark, docs), even, F.replace("text", F.lit("\n"), F.lit("")), fanout, depth)
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")), "folded_root", "verified")
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, fanout)


def test_small_tables(spark):
    one = [(1, "x\n", "en", "s", 2)]
    (row,) = manifest.without_feeds(frame(spark, one)).collect()
    assert tuple(row) == plain(one)[0] and row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == digest()
    assert manifest.without_feeds(frame(spark, one).limit(0)).count() == 0
