"""Multiprobe hashing: chances, visiting order, recall of the cells alone, hot cells, repeated rows."""

from __future__ import annotations

import numpy as np

from narralake.llm import neighbours


def rows_frame(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_chances_are_those_of_random_neighbours():
    rng = np.random.default_rng(1)
    hashes = neighbours.Hashes(16, 0.5)
    q = rng.standard_normal((1, 16))
    step = rng.standard_normal((20_000, 16))
    near = q + 0.5 * step / np.linalg.norm(step, axis=1, keepdims=True)
    chance = hashes.chances(q, np.array([0.5]))[:, 0]
    chosen, names = hashes.visits(q)
    got = hashes.cells(near)
    # Over directions, not lines: the mean over tables is near what is expected over lines.
    share = np.mean([np.isin(got[:, t], names[t, 0][chosen[t, 0]]).mean() for t in range(neighbours.TABLES)])
    assert abs(share - np.where(chosen[:, 0], chance, 0).sum(-1).mean()) < 0.1
    for t in range(neighbours.TABLES):
        left, taken = chance[t][~chosen[t, 0]], chance[t][chosen[t, 0]]
        assert taken.min() >= left.max(initial=0.0)
        assert names[t, 0][len(neighbours._OFFSETS) // 2] == hashes.cells(q)[0, t]


def test_recall_of_the_cells_alone_on_clusters(spark):
    """Most rows can be left unseen, and nine of ten neighbours are found without the exact way."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24)) * 4
    x = np.concatenate([c + 0.2 * rng.standard_normal((50, 24)) for c in centres])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = np.argsort(far, axis=1)[:, :10]
    hashes = neighbours.Hashes(24, float(np.median(np.sort(far, 1)[:, 9])))
    chosen, names = hashes.visits(x)
    cells = hashes.cells(x)
    met = np.zeros(far.shape, bool)
    for t in range(neighbours.TABLES):
        for i in range(len(x)):
            met[i] |= np.isin(cells[:, t], names[t, i][chosen[t, i]])
    assert np.take_along_axis(met, want, 1).mean() >= 0.9
    assert met.mean() < 0.3


def test_hot_cells_in_parts_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([1 + 0.01 * rng.standard_normal((300, 8)), rng.standard_normal((100, 8)), np.ones((3, 8))])
    frame = rows_frame(spark, x)
    frame = frame.unionByName(frame.where("vec_id = 7"))  # one row twice
    asked = frame.where("vec_id % 4 = 0")
    plain = neighbours.nearest(frame, asked).collect()
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "GROUP", 16)
    split = neighbours.nearest(frame, asked).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, split)) and len(plain) == 101 * 10
    hits = 0
    both = np.concatenate([x, x[7:8]])
    ids = np.r_[np.arange(len(x)), 7]
    for q in range(0, len(x), 4):
        far = np.where(ids == q, np.inf, np.sqrt(((both - x[q]) ** 2).sum(1)))
        best = {int(i) for i in ids[np.lexsort((ids, far))[:10]]}
        hits += len(best & {r.vec_id for r in plain if r.query_id == q}) / len(best)
    assert hits >= 0.95 * 101


def test_cells_grow_between_clusters_only():
    rng = np.random.default_rng(4)
    even = rng.standard_normal((400, 24))
    assert neighbours.widened(4.0, even[:60], even) == 4.0
    clusters = np.repeat(rng.standard_normal((40, 24)), 10, 0) + 1e-4 * rng.standard_normal((400, 24))
    distance = neighbours.widened(5e-4, clusters[:60], clusters)
    assert 4e-3 <= distance <= 64 * 5e-4
    assert neighbours.widened(1.0, even[:0], even) == neighbours.widened(1.0, even[:3], even[:0]) > 0
