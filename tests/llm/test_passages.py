"""Repeated passages: Fenwick chains, dense links, pieces that stand elsewhere, too, and windows of real texts."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from narralake.llm import common, passages
from narralake.llm.common import hashed, keep, text_slices, word_hashes


def fresh(name: str, n: int) -> list[str]:
    return [f"{name}{i}" for i in range(n)]


def test_seed_hashes_of_equal_runs():
    words = word_hashes(" ".join(fresh("a", 60) + fresh("a", 60)))
    for n in (1, 4, 7, 44, 50):
        runs = passages.run_hashes(words, n)
        assert len(runs) == 121 - n and len(set(runs.tolist())) == (60 if n == 1 else min(60, 121 - n))
        assert runs[0] == runs[60]
    assert len(passages.run_hashes(words[:3], 7)) == 1


def test_fenwick_is_the_greatest_of_a_prefix():
    rng = random.Random(1)
    tree, plain = passages.Fenwick(), []
    for i in range(300):
        place, value = rng.randrange(passages.FAR), rng.random()
        tree.put(place, value, i)
        plain.append((place, value, i))
        top = rng.randrange(passages.FAR)
        want = max(((v, j) for p, v, j in plain if p <= top), default=(-np.inf, -1))
        assert tree.upto(top) == want


def test_near_matches_precede_before_far_better_ones():
    x = np.r_[np.arange(400), 900 + np.arange(30), 935 + np.arange(30)]
    y = np.r_[np.arange(400), 700 + np.arange(30), 734 + np.arange(30)]
    found = passages.chains(x, y)
    assert sorted(len(c) for c in found) == [1, 2]


def test_dense_is_the_rule_over_all_ranges():
    rng = random.Random(2)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(rng.choice([60, 200, 800])), 40)))
        want = np.zeros(len(at), bool)
        for i in range(len(at)):
            for j in range(i + passages.DENSE - 1, len(at)):
                if at[j] + passages.K - at[i] <= 5 * (j - i + 1) + 15:
                    want[i : j + 1] = True
        assert (passages.dense(at) == want).all()


@pytest.mark.parametrize("others", [3, 30])
def test_pieces_of_a_passage_that_stand_elsewhere_hide_no_pair(spark, others):
    rows, rng = [], random.Random(3)
    for p in range(10):
        body = fresh(f"p{p}x", 60)
        for side in range(2):
            own = fresh(f"o{p}s{side}x", 120)
            rows.append((2 * p + side, " ".join(own[:50] + body + own[50:])))
        for piece in range(0, 49, 4):
            for o in range(others):
                own = fresh(f"d{p}n{piece}o{o}x", 40)
                rows.append((10**6 + len(rows), " ".join(own[:20] + body[piece : piece + 12] + own[20:])))
    rng.shuffle(rows)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.ref_doc_id)) for r in found}
    assert pairs == {frozenset((2 * p, 2 * p + 1)) for p in range(10)}
    assert all(r.end - r.start == 60 for r in found)


def test_every_window_of_fifty_equal_words_is_covered(spark, small):
    """Brute force over sf0.001: each of 50 equal words in two documents is in a span, but in one of its documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    texts = {r.doc_id: r.text.encode().split() for r in docs.collect()}
    at: dict[tuple, dict[int, list[int]]] = {}
    for i, t in texts.items():
        for p in range(len(t) - 49):
            at.setdefault(tuple(t[p : p + 50]), {}).setdefault(i, []).append(p)
    covered: dict[int, set[int]] = {}
    for r in passages.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    needed = missed = 0
    for where in at.values():
        if len(where) > 1:
            bare = [i for i, ps in where.items() if not all(set(range(p, p + 50)) <= covered.get(i, set()) for p in ps)]
            needed += len(where) - 1
            missed += max(0, len(bare) - 1)
    assert needed > 100 and missed <= 0.01 * needed


def test_least_is_the_least_of_each_window():
    rng = np.random.default_rng(4)
    for n in range(1, 60):
        for width in {min(w, n) for w in (1, 2, 7, 12)}:
            runs = rng.integers(0, 2**63, n).astype(np.uint64)
            windows = np.lib.stride_tricks.sliding_window_view(runs, width)
            assert (passages.least(runs, width) == np.unique(windows.argmin(axis=1) + np.arange(len(windows)))).all()


def test_marks_take_under_three_bytes_a_seed():
    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(1000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(1000)), "text": pa.array(texts)})
    out = [b for r in passages._mark_rows(iter([batch])) for b in r.column("rest").to_pylist()]
    n = sum(len(passages.seeds(t)[0]) for t in texts)
    assert sum(map(len, out)) == 3 * n
    assert len(pa.compress(b"".join(out), codec="lz4", asbytes=True)) < 3 * n


def test_links_go_to_the_first_place_of_the_least_row(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(40)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    marks = spark.sparkContext.broadcast(passages.repeated_seeds(rows))
    stored = rows.repartition(3).mapInArrow(passages._seed_rows(marks), passages._SEEDS)
    got = stored.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(passages._links, passages._LINKS)
    first, want = {}, set()
    for row, text in enumerate(texts):
        for h, at, size in zip(*(c.tolist() for c in passages.seeds(text)), strict=True):
            ref = first.setdefault(h, (row, at))
            if ref[0] != row:
                want.add((row, ref[0], at, ref[1], size))
    assert {tuple(r) for r in got.collect()} == want and want


def test_hopeless_chains_have_no_passage():
    rng, hopeless = random.Random(7), 0
    for _ in range(400):
        changed = rng.choice([0.05, 0.2, 0.3, 0.6, 0.9])
        a = [rng.randrange(rng.choice([20, 10**6])) for _ in range(rng.randrange(8, 160))]
        b = [rng.randrange(10**6) if rng.random() < changed else w for w in a]
        at = rng.randrange(len(a) - 3)
        b[at : at + 4] = a[at : at + 4]
        b = b[rng.randrange(at + 1) :]
        chain = [(at, at - len(a) + len(b), 4)]
        if passages.hopeless(a, b, chain, (False,) * 4):
            hopeless += 1
            assert not passages.passages_of(*passages.matched(np.array(a), np.array(b), chain)[:2])
    assert hopeless > 50


def test_shuffles_of_kept_tables_go(spark):
    """Without this their files stay for as long as the query runs."""

    def files() -> set[str]:
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {n for n in (str(f) for f in str(disk.getAllFiles().mkString("\n")).split("\n")) if n.endswith(".data")}

    before = files()
    keep(spark.range(1000).repartition(3), "a")
    keep(spark.range(10), "b")  # Spark itself holds the job that ran last
    for _ in range(50):
        if not files() - before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")


def odd_texts(rng: random.Random, n: int) -> list[str | None]:
    words = ["".join(rng.choice("abé漢🎉") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 80]))) for _ in range(300)]
    texts = [" " * rng.randrange(2) + rng.choice(" \n\t\x0b").join(rng.choices(words, k=rng.choice([1, 3, 17, 49, 50, 51, 90, 200]))) for _ in range(n)]
    return [None, "", " \n", "a", *texts]


def test_hashes_of_all_texts_at_once_are_those_of_the_library():
    texts = odd_texts(random.Random(8), 200)
    want = [[xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().split()] for t in texts]
    for found in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array([""] * 3 + texts, pa.string()).slice(3)):
        hashes, counts = hashed(found)
        assert counts.tolist() == [len(w) for w in want] and hashes.tolist() == [h for w in want for h in w]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    slices = list(text_slices(iter([batch]), 0, 500))
    assert pa.Table.from_batches(slices).column(0).to_pylist() == texts and len(slices) > 10


def test_seeds_of_all_texts_at_once_are_those_of_each():
    texts = odd_texts(random.Random(9), 60)
    want = {(*s, i) for i, t in enumerate(texts) for s in zip(*(c.tolist() for c in passages.seeds(t)), strict=True)}
    got = list(zip(*(c.tolist() for c in passages.all_seeds(pa.array(texts, pa.string()))), strict=True))
    assert len(got) == len(set(got)) and set(got) == want


def test_packed_links_are_the_links(monkeypatch):
    rng = np.random.default_rng(10)
    cols = [rng.integers(-(2**63), 2**63, 500), rng.integers(-(2**63), 2**63, 500), rng.integers(0, 2**31, 500).astype("<i4")]
    links = (*cols, cols[2][::-1].copy(), rng.choice([4, 7, 44], 500).astype(np.int8))
    monkeypatch.setattr(passages, "_link_arrays", lambda batches: iter([links]))
    out = list(passages._link_blobs(iter([])))
    got = passages._unpacked_links(np.array([x for b in out for x in b.column("links").to_pylist()], object))
    assert set(zip(*(c.tolist() for c in got), strict=True)) == set(zip(*(c.tolist() for c in links), strict=True))
    assert sum(b.num_rows for b in out) < 500  # a row a bucket, not a link


def test_weak_pairs_count_only_seeds_that_both_may_have():
    rng, left = random.Random(11), 0
    for _ in range(100):
        links = sorted((row, rng.randrange(-9, 9), x) for row in range(5) for x in rng.sample(range(150), rng.randrange(1, 60)))
        row, ref, x = (np.array(c) for c in zip(*links, strict=True))
        pairs = sorted({(r, o) for r, o, _ in links})
        pair = np.array([pairs.index((r, o)) for r, o, _ in links])
        weak = np.array([rng.random() < 0.7 for _ in pairs])
        got = passages._may_be_dense(row, ref, x, pair, np.searchsorted(pair, np.arange(len(pairs))), weak)
        for i, (r, o) in enumerate(pairs):
            known = np.array(sorted({x_ for r_, o_, x_ in links if r_ == r and o_ <= o}))
            own = [x_ for r_, o_, x_ in links if (r_, o_) == (r, o)]
            want = bool(passages.dense(known)[np.searchsorted(known, own)].any())
            assert got[i] <= weak[i] and (got[i] or not (want and weak[i]))  # steps by LEVELS may leave more
            left += bool(weak[i] and not got[i])
    assert left > 100


def test_longest_common_subsequence():
    rng = random.Random(12)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([3, 20])) for _ in range(rng.randrange(40))] for _ in range(2))
        best = [[0] * (len(b) + 1)]
        for v in a:
            best.append([0])
            for j, w in enumerate(b):
                best[-1].append(max(best[-2][j + 1], best[-1][j], best[-2][j] + (v == w)))
        in_a, in_b = passages.common(a, b)
        assert [a[i] for i in in_a] == [b[j] for j in in_b] and in_a == sorted(set(in_a)) and in_b == sorted(set(in_b))
        assert len(in_a) == best[-1][-1] or len(a) == len(b) and len(in_a) >= len(a) - 1


def test_texts_asked_often_are_copied_and_few_bytes_rule_no_passage_out(spark, monkeypatch):
    body = fresh("body", 60)
    rows = [(i, " ".join([*fresh(f"o{i}x", 30), *body, *fresh(f"p{i}x", 30)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in passages.repeated_passages(docs).collect()}
    assert len(want) == 39 and len({r[3] for r in want}) == 1  # all to the first
    monkeypatch.setattr(passages, "ASKED", 7)
    assert {tuple(r) for r in passages.repeated_passages(docs).collect()} == want

    def side(n: int) -> tuple[bytes, bytes]:
        words = word_hashes(rows[n][1]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : passages.ROUGH]
        return np.array([0, len(words)], "<i4").tobytes(), words.tobytes()

    for chain, kept in (([1, 50, 50, 4], 1), ([1, 5, 9, 4], 0)):
        parts = np.array(chain, "<i4").tobytes()
        batch = pa.RecordBatch.from_pydict(
            {"row": [1, 1], "ref": [0, 0], "side": [0, 1], "parts": [parts, None], "at": [side(1)[0], side(0)[0]],
             "data": [side(1)[1], side(0)[1]], "size": [120, 120]}
        )
        assert sum(b.num_rows for b in passages._possible_rows(iter([batch]))) == kept


def test_a_lean_function_gives_memory_back_behind_its_last_rows(monkeypatch):
    seen: list = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert [*map(seen.append, common.lean(lambda batches: iter(batches))([1, 2]))] == [None, None]
    assert seen == [1, 2, "back"]
    assert all(hasattr(getattr(passages, f), "__wrapped__") for f in ("_mark_rows", "_link_blobs", "_chain_rows", "_align_rows"))
