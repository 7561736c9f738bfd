"""Operator 10: a large group of near copies adds few links, and loses none."""

import random

import numpy as np
import pytest

from narralake.llm import jaccard
from narralake.llm.common import ship
from narralake.llm.components import components


def copies(n, words=120):
    r = random.Random(n)
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        text[r.randrange(words)] = f"own{i}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_links_of_near_copies_grow_with_their_number(spark, n):
    ship(spark)
    rows = [(jaccard.set_key(jaccard.shingles(t)), b"g", 1, t) for t in copies(n)]
    held = spark.createDataFrame(rows, "set binary, _label binary, copies long, text string").repartition(4)
    links = jaccard.exact_links(held)
    assert links.where("b IS NOT NULL").count() < 2 * n
    assert components(links.where("b IS NOT NULL")).select("label").distinct().count() == 1
    per_set = {bytes(r.a): r.n for r in links.where("b IS NULL").groupBy("a").sum("n").toDF("a", "n").collect()}
    # Brute force on some of them.
    sets = [set(jaccard.shingles(t).tolist()) for *_, t in rows]
    for i in range(0, n, n // 5):
        want = sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for k, s in enumerate(sets) if k != i)
        assert per_set[bytes(rows[i][0])] == want


def test_part_links_join_the_same_sets_as_all_links():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(2, 14))
        mine = r.integers(0, 2, n)
        inside = (r.random((n, n)) < 0.15) & (mine[:, None] == mine[None])
        across = (r.random((n, n)) < 0.1) & (mine[:, None] != mine[None])
        inside, across = (np.logical_and(m | m.T, ~np.eye(n, dtype=bool)) for m in (inside, across))

        def parts(pairs):
            label = list(range(n))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(k for k in range(n) if label[k] == x) for x in label}

        stars = jaccard.star_links(inside)
        part = np.arange(n)
        for a, b in stars:
            part[a] = b
        found = stars + jaccard.part_links(across, part.astype(str).astype(object))
        assert parts(found) == parts(list(zip(*np.nonzero(inside | across))))
