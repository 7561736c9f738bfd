"""Operator 10, n-gram Jaccard self-join by chosen paths.

A document is the set of its five-word runs.  Equal sets are one class.  A set
is sampled by TOKENS min-hash coordinates; in a bucket, one or two coordinates
are chosen at random (1 / similarity on average, the same for all members), and
each member goes on to the bucket named by the path so far and its value there.
Large buckets are split again, small ones are compared by brute force, and the
runs are repeated until a pair at the threshold is met with the wanted
probability.

Brute force on the sampled coordinates only links sets that may be similar, by
a spanning forest of each bucket, never by all pairs.  The components of these
links are then compared exactly, every pair once, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import give_back, gram_hashes, keep, lean, mix, sieve, table, text_batches, word_hashes, word_lists
from narralake.llm.components import components

N = 5
SIMILARITY = 0.8
TOKENS = 128
RECALL = 0.9995
DEPTH = 3
SMALL = 256
#: Sketches of a block; a bucket that no split makes smaller is compared block by block.
SKETCHES = 1024
#: Sets of an exact block; a larger component is compared block by block.
BLOCK = 128
COLUMNS = 8192

_RNG = np.random.default_rng(23)
_A = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in some bucket of the last level."""
    two = 1 / similarity - 1  # chance that a second coordinate is chosen
    step = (1 - two) * similarity + two * (1 - (1 - similarity) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - step**depth))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted set of hashes of all n-word runs; a shorter text is one run."""
    return _shingles(word_hashes(text), n)


def _shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    return np.unique(gram_hashes(words, n))


def sketch(grams: np.ndarray) -> np.ndarray:
    """TOKENS min-hash values of 32 bits."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * _A + _B).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        one = mix(grams).sum(dtype=np.uint64)
        two = mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([one, two ^ np.uint64(len(grams))], "<u8").tobytes()


def chosen(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first coordinate of each path, the second, and whether the second is used."""
    h = mix(paths)
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    second = ((first + 1 + ((h >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS)
    both = (h >> np.uint64(40)).astype(np.float64) / 2**24 < 1 / SIMILARITY - 1
    return first, second, both


def children(paths: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The next buckets of each row, given its path and its sketch."""
    first, second, both = chosen(paths)
    at = np.arange(len(paths))

    def key(coordinate: np.ndarray) -> np.ndarray:
        value = values[at, coordinate].astype(np.uint64) | (coordinate.astype(np.uint64) << np.uint64(32))
        return mix(mix(paths) * np.uint64(0x9E3779B97F4A7C15) + value)

    one, other = key(first), key(second)
    return [np.array([o, p] if b else [o]) for o, p, b in zip(one, other, both, strict=True)]


def _lists(keys: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *keys]).astype(np.uint64).view(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _sets(texts: pa.Array) -> pa.Array:
    roots = mix(np.arange(1, runs_needed() + 1, dtype=np.uint64))
    keys, sketches, firsts = [], [], []
    for words in word_lists(texts):
        grams = _shingles(words)
        if len(grams) == 0:
            keys.append(None)
            sketches.append(None)
            firsts.append(np.zeros(0, np.uint64))
            continue
        s = sketch(grams)
        keys.append(set_key(grams))
        sketches.append(s.astype("<u4").tobytes())
        firsts.append(np.concatenate(children(roots, np.broadcast_to(s, (len(roots), TOKENS)))))
    give_back()
    return pa.StructArray.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), _lists(firsts)],
        names=["set", "sketch", "buckets"],
    )


def _next(paths: pa.Array, sketches: pa.Array) -> pa.Array:
    values = np.frombuffer(b"".join(sketches.to_pylist()), "<u4").reshape(-1, TOKENS)
    return _lists(children(paths.to_numpy(zero_copy_only=False).view(np.uint64), values))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, by breadth."""
    open_ = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            out += [(at, int(j)) for j in new]
            front += new.tolist()
    return out


def star_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Each member of a part but the first, with the first."""
    first = np.arange(len(linked))
    # A forest is in order: a member's part is known before its own links follow.
    for a, b in forest(linked):
        first[b] = first[a]
    return [(int(b), int(first[b])) for b in np.flatnonzero(first != np.arange(len(linked)))]


def part_links(linked: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the parts that the links of two blocks join, one link for each of its edges."""
    names, part = np.unique(part, return_inverse=True)
    a, b = np.nonzero(linked)
    _, where = np.unique(part[a] * len(names) + part[b], return_index=True)
    first = {(int(part[a[k]]), int(part[b[k]])): (int(a[k]), int(b[k])) for k in where}
    between = np.zeros((len(names), len(names)), bool)
    for x, y in first:
        between[x, y] = between[y, x] = True
    return [first[x, y] for x, y in forest(between)]


def block_links(linked: np.ndarray, mine: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Links that a pair of blocks adds, where all links inside and between the two are known.

    The links inside each block come from the pair of the block with itself, so
    two blocks of copies add one link, not one per member.
    """
    if i == j:
        return forest(linked)
    part = np.arange(len(linked))
    for a, b in star_links(linked & (mine[:, None] == mine[None])):
        part[a] = b
    return part_links(linked & (mine[:, None] != mine[None]), part)


# ------------------------------------------------------------- blocks of a group
def in_blocks(members: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """members with _i <= _j, the pair of blocks, and _mine, the row's own block.

    A group of at most `size` members is the pair (0, 0).  A larger one is dealt
    into blocks by the member's hash, and each member meets every block once.
    """
    counts = members.groupBy(group).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.col("_n") / size).cast("int")
    sized = members.join(counts, group).withColumn("_blocks", blocks)
    mine = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        sized.withColumn("_mine", mine)
        .withColumn("_other", other)
        .withColumn("_i", F.least("_mine", "_other"))
        .withColumn("_j", F.greatest("_mine", "_other"))
        .drop("_blocks", "_other", "_n")
    )


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of equal values in the named columns of sorted batches, one table each."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, start, last = [], i, key
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


# ------------------------------------------------------------------ candidates
def _near_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Six standard deviations under the threshold.
    least = int(TOKENS * SIMILARITY - 6 * math.sqrt(TOKENS * SIMILARITY * (1 - SIMILARITY)))
    a, b = [], []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    for group in by_group(batches, ["_bucket", "_i", "_j"]):
        keys = group["set"].to_pylist()
        if len(keys) < 2:
            continue
        values = np.frombuffer(b"".join(group["sketch"].to_pylist()), "<u4").reshape(-1, TOKENS)
        same = np.zeros((len(keys), len(keys)), np.int16)
        for t in range(TOKENS):
            same += values[:, t, None] == values[None, :, t]
        mine = np.array(group["_mine"].to_pylist())
        i, j = group["_i"][0].as_py(), group["_j"][0].as_py()
        for x, y in block_links(same >= least, mine, i, j):
            a.append(keys[x])
            b.append(keys[y])
        if len(a) > 50_000:
            yield rows()
            a, b = [], []
    yield rows()


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b) spanning links of the leaf buckets of all runs; classes: set, sketch, buckets."""
    members = classes.select("set", F.explode("buckets").alias("_bucket"))
    leaves: list[DataFrame] = []
    spread = F.arrow_udf(_next, "array<long>")
    for level in range(1, DEPTH + 1):
        mark = F.xxhash64("set")
        sizes = (
            members.groupBy("_bucket")
            .agg(F.count("*").alias("_n"), F.sum(F.shiftright(mark, 16)).alias("_s"), F.bit_xor(mark).alias("_x"))
            .where("_n > 1")
        )
        sized = keep(sizes, "buckets")
        # Runs meet in the same group of copies again and again: one bucket of equal content is enough.
        small = sized if level == DEPTH else sized.where(F.col("_n") <= SMALL)
        once = small.groupBy("_n", "_s", "_x").agg(F.min("_bucket").alias("_bucket")).select("_bucket")
        members = keep(members.join(sized.select("_bucket", "_n"), "_bucket"), "members")
        leaves.append(members.join(once, "_bucket", "left_semi").select("set", "_bucket"))
        if level < DEPTH:
            large = members.where(F.col("_n") > SMALL).join(classes.select("set", "sketch"), "set")
            members = large.select("set", F.explode(spread("_bucket", "sketch")).alias("_bucket")).distinct()
    found = leaves[0]
    for leaf in leaves[1:]:
        found = found.unionByName(leaf)
    dealt = in_blocks(found, "_bucket", "set", SKETCHES).join(classes.select("set", "sketch"), "set")
    grouped = dealt.select("_bucket", "_i", "_j", "_mine", "set", "sketch").repartition("_bucket", "_i", "_j")
    # In order of the set, so that buckets with the same members name the same links.
    return grouped.sortWithinPartitions("_bucket", "_i", "_j", "set").mapInArrow(_near_forest, "a binary, b binary")


# ----------------------------------------------------------------- exact links
def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices of the shared runs."""
    sets = left + right
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


@lean
def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set and block pair: how many documents it links to (b null), and links that span (n 0).

    A block with itself links each set of a part to the part's first; two
    blocks link what the pairs of their parts need.
    """
    for group in by_group(batches, ["_label", "_i", "_j"]):
        keys, copies = group["set"].to_pylist(), np.array(group["copies"].to_pylist(), np.int64)
        i, j = group["_i"][0].as_py(), group["_j"][0].as_py()
        mine = np.array(group["_mine"].to_pylist())
        left = np.flatnonzero(mine == i)
        right = np.flatnonzero(mine == j) if i != j else left
        if not len(left) or not len(right):
            continue
        sets = dict(enumerate(map(_shingles, word_lists(group["text"].combine_chunks()))))
        shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
        sizes = np.array([len(sets[k]) for k in range(len(keys))])
        union = sizes[left][:, None] + sizes[right][None] - shared
        linked = np.zeros((len(keys), len(keys)), bool)
        linked[np.ix_(left, right)] = shared >= SIMILARITY * union - 1e-9
        linked |= linked.T
        np.fill_diagonal(linked, False)
        links = linked @ copies
        a = [keys[k] for k in np.flatnonzero(links)]
        n = links[links > 0].tolist()
        b: list = [None] * len(a)
        spanning = star_links(linked) if i == j else part_links(linked, np.array(group["_part"].to_pylist(), object))
        for x, y in spanning:
            a.append(keys[x])
            b.append(keys[y])
            n.append(0)
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())}
        )


def exact_links(held: DataFrame) -> DataFrame:
    """a, b, n of all sets of held (set, _label, copies, text), group by group in pairs of blocks.

    Blocks are compared with themselves first.  The parts that this finds then
    stand for their members, so two blocks of a large group of near copies add
    one link for each two parts, not one for each two members.
    """

    def compared(members: DataFrame, pairs: str, label: str) -> DataFrame:
        dealt = in_blocks(members, "_label", "set", BLOCK).where(pairs).repartition("_label", "_i", "_j")
        rows = dealt.select("_label", "_i", "_j", "_mine", "set", "copies", "_part", "text")
        ordered = rows.sortWithinPartitions("_label", "_i", "_j", "set")
        return keep(ordered.mapInArrow(_exact, "a binary, b binary, n long"), label)

    inside = compared(held.withColumn("_part", F.col("set")), "_i = _j", "inside")
    parts = inside.where("b IS NOT NULL").select(F.col("a").alias("set"), F.col("b").alias("_part"))
    known = held.join(parts, "set", "left").withColumn("_part", F.coalesce("_part", "set"))
    return inside.unionByName(compared(known, "_i < _j", "across"))


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, class_id (least key of its class) and n_links.

    Two documents are linked if their sets of five-word runs have a Jaccard
    similarity of 0.8 or more; a class is what links connect.  n_links counts
    the linked documents, copies included.  Texts without words (null, empty,
    white space) have no links and are classes of their own.  A null or
    repeated key is treated like any other; a class of null keys has a null
    id.  Only key and text are read, so other columns cannot clash.  An empty
    table gives an empty table.  Results do not depend on row order.
    """
    text_batches(docs)
    found = F.arrow_udf(_sets, "set binary, sketch binary, buckets array<long>")
    rows = keep(docs.select(F.col(key), found(F.col(text)).alias("_s")).select(key, "_s.*"), "sets")
    classes = keep(
        rows.where("set IS NOT NULL")
        .groupBy("set")
        .agg(
            F.min(key).alias("_rep"),
            F.count("*").alias("copies"),
            F.first("sketch").alias("sketch"),
            F.first("buckets").alias("buckets"),
        ),
        "classes",
    )
    near = components(candidate_links(classes))
    named = near.select(F.col("node").alias("set"), F.col("label").alias("_label")).join(
        classes.select("set", "_rep", "copies"), "set"
    )
    # The text of each class comes from the row with the least key; other rows of that key drop out.
    wanted = named.withColumn("_k", F.coalesce(F.col("_rep").cast("string"), F.lit("")))
    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col(text).alias("text"))
    texts, _ = sieve(texts, F.col("_k"), wanted.select("_k"), "wanted")
    own = F.arrow_udf(lambda t: pa.array([set_key(_shingles(w)) for w in word_lists(t)], pa.binary()), "binary")
    held = keep(
        texts.join(wanted, "_k").where(own("text") == F.col("set")).dropDuplicates(["set"]).select("set", "_label", "copies", "text"),
        "texts",
    )
    exact = exact_links(held)
    links = exact.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("_links"))
    grouped = components(exact.where("b IS NOT NULL"))
    full = (
        classes.select("set", "_rep", "copies")
        .join(links, "set", "left")
        .join(grouped.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("_class", F.coalesce("label", "set"))
    )
    least = full.groupBy("_class").agg(F.min("_rep").alias("_id"))
    known = keep(
        full.join(least, "_class").select(
            "set", F.col("_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_n")
        ),
        "known",
    )
    alone = rows.where("set IS NULL").select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return (
        rows.where("set IS NOT NULL")
        .select(key, "set")
        .join(known, "set")
        .select(key, "class_id", F.col("_n").alias("n_links"))
        .unionByName(alone)
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
