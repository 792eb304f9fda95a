"""Near-duplicate vectors against all pairs, chances of the index, and the defined cases."""

import math

import numpy as np
import pytest

from tidewarden.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, n int, task int, group int, own int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "clash", 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, cosine=0.95):
    """Sorted (vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = []
    for r, (i, v) in enumerate(rows):
        usable = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if usable else None)
    near = [[s for s, y in enumerate(good) if s != r and x is not None and y is not None and len(x) == len(y)
             and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine] for r, x in enumerate(good)]
    out = []
    for r, (i, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            for s in near[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        component = None if i is None else min(rows[s][0] for s in seen)
        out.append((i, len(near[r]), component, i is None or i == component))
    return sorted(out, key=str)


def got(found):
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def turned(rng, base, cosines):
    """Vectors at given cosines from a base."""
    base = unit(base)
    aside = rng.standard_normal((len(cosines), len(base)))
    aside = unit(aside - (aside @ base)[:, None] * base)
    c = np.array(cosines)[:, None]
    return c * base + np.sqrt(1 - c * c) * aside


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FINE_ROWS", 7)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "SLICE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((150, 16)).tolist())]
    base = rng.standard_normal(16)
    rows += [(1000 + i, v) for i, v in enumerate(turned(rng, base, rng.uniform(0.94, 1, 120)).tolist())]  # one large group
    for g in range(20):  # pairs and chains
        a = rng.standard_normal(16)
        rows += [(2000 + 10 * g + i, v) for i, v in enumerate([a.tolist(), *(3 * turned(rng, a, [0.97, 0.985, 0.9])).tolist()])]
    same = rng.standard_normal(16).tolist()
    rows += [(3000 + i, same) for i in range(30)] + [(3000, same), (2999, (2 * np.array(same)).tolist())]
    assert got(vectors.near_links(frame(spark, rows))) == plain(rows)


def test_defined_cases(spark):
    x = [1.0, 0.0, 0.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]),
        (7, x), (8, [0.5, -0.0, 0.0]), (8, [0.5, 0.0, 0.0]), (9, [1.0, 0.0]), (None, x), (None, x), (10, [-1.0, 0.0, 0.0]),
        (11, [1e-38, 1e-40, 0.0]), (12, [3e38, 3e38, 3e38]), (13, [1.0, 1.0, 1.0]), (14, [0.0, 1.0, 0.0]), (14, [0.0, 0.0, 1.0]), (14, x),
    ]
    assert got(vectors.near_links(frame(spark, rows))) == plain(rows)
    assert got(vectors.near_links(frame(spark, rows[:6]))) == plain(rows[:6])
    assert vectors.near_links(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.95, 0.97])
def test_shares_of_buckets(cosine):
    """Pairs at a cosine share buckets as often as the formula says."""
    rng = np.random.default_rng(8)
    k, tables = 6, 40
    x = unit(rng.standard_normal((2000, 32)))
    y = np.concatenate([turned(rng, one, [cosine]) for one in x])
    same = (vectors.buckets(x, k, tables) == vectors.buckets(y, k, tables)).mean()
    assert abs(same - vectors.shared_cell(math.sqrt(2 - 2 * cosine)) ** k) < 0.02


def test_recall_of_lone_pairs(spark):
    """Pairs that nothing else joins, just above the limit and at 0.97: the share found."""
    rng = np.random.default_rng(9)
    for cosine, least in ((0.9501, 0.97), (0.97, 0.998)):
        x = rng.standard_normal((1500, 64))
        y = np.concatenate([turned(rng, one, [cosine]) for one in x])
        rows = [(2 * i + j, v) for j, some in enumerate((x, y)) for i, v in enumerate(some.tolist())]
        found = vectors.near_links(frame(spark, rows)).filter("n_links > 0").count()
        assert found >= least * len(rows)
