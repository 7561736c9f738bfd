"""Operator 1, chat formatting: reply trees to root-to-leaf conversations.

Paths are found by self-joins with doubling reach: after join k every message
knows its ancestor 2^k steps up and the score of the way there, so a chain of n
messages takes log2(n) joins.  Branches are ranked by the score of their path,
and the chosen paths are unfolded through the same tables from the longest
reach down.  No message list ever grows inside a join.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.llm.common import keep, table

START, COLON, STOP = "### ", ": ", "</turn>"
#: Control strings inside texts and their written form; the backslash is written first, read last.
ESCAPES = (("\\", "\\b"), (START, "\\h"), (STOP, "\\l"))
TRAINED_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    for plain, written in ESCAPES + (((COLON, "\\c"),) if role else ()):
        text = text.replace(plain, written)
    return text


def unescape(text: str, role: bool = False) -> str:
    for plain, written in ((((COLON, "\\c"),) if role else ()) + ESCAPES[:0:-1]) + ESCAPES[:1]:
        text = text.replace(written, plain)
    return text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns as one string, and the (start, length) of each trained text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role, True)}{COLON}", escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), len(body)))
        out += [head, body, f"\n{STOP}\n"]
        at += len(head) + len(body) + len(STOP) + 2
    return "".join(out), spans


_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(COLON) + r"(.*)", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of render."""
    turns = []
    for part in formatted.split(f"\n{STOP}\n")[:-1]:
        role, body = _TURN.fullmatch(part).groups()
        turns.append((unescape(role, True), unescape(body)))
    return turns


# ------------------------------------------------------------------- the trees
def _reaches(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per doubling (tree, node, up, sum), and for every node under a root (tree, node, n, sum).

    Messages on a cycle never reach a root; their reach stops doubling when it
    passes the number of messages.
    """
    has = nodes.select(F.col("_tree").alias("_t2"), F.col("_node").alias("_parent2"))
    known = nodes.join(
        has, (F.col("_tree") == F.col("_t2")) & (F.col("_parent") == F.col("_parent2")), "left"
    )
    level = keep(
        known.select(
            "_tree",
            "_node",
            F.col("_parent2").alias("_up"),
            F.lit(1).cast("long").alias("_n"),
            F.col("_score").alias("_sum"),
        ),
        "reach",
    )
    total = level.count()
    levels, done, reach = [], [], 1
    while True:
        done.append(level.where("_up IS NULL").select("_tree", "_node", "_n", "_sum"))
        level = level.where("_up IS NOT NULL")
        if reach > max(1, total) or level.isEmpty():
            break
        levels.append(level)
        # The step from the ancestor: one that goes on, or one that ends at the root.
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        step = level.select("_tree", "_node", "_up", "_n", "_sum").unionByName(
            ended.withColumn("_up", F.lit(None).cast("long"))
        )
        step = step.select(
            F.col("_tree").alias("_t2"),
            F.col("_node").alias("_from"),
            F.col("_up").alias("_up2"),
            F.col("_n").alias("_n2"),
            F.col("_sum").alias("_sum2"),
        )
        joined = level.join(step, (F.col("_tree") == F.col("_t2")) & (F.col("_up") == F.col("_from")))
        level = keep(
            joined.select(
                "_tree",
                "_node",
                F.col("_up2").alias("_up"),
                (F.col("_n") + F.col("_n2")).alias("_n"),
                (F.col("_sum") + F.col("_sum2")).alias("_sum"),
            ),
            "reach",
        )
        reach *= 2
    rooted = done[0]
    for d in done[1:]:
        rooted = rooted.unionByName(d)
    return levels, rooted


def paths(nodes: DataFrame, per_tree: int) -> DataFrame:
    """(_tree, _rank, _leaf, _node, _pos) of the best root-to-leaf paths of each tree."""
    levels, rooted = _reaches(nodes)
    inner = nodes.select(F.col("_tree").alias("_t2"), F.col("_parent").alias("_p2")).where("_p2 IS NOT NULL")
    leaves = rooted.join(
        inner, (F.col("_tree") == F.col("_t2")) & (F.col("_node") == F.col("_p2")), "left_anti"
    )
    best = Window.partitionBy("_tree").orderBy(F.desc("_sum"), "_node")
    ranked = leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= per_tree)
    rows = ranked.select("_tree", "_rank", F.col("_node").alias("_leaf"), "_node", "_n", F.col("_n").alias("_pos"))
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k].select(
            F.col("_tree").alias("_t2"), F.col("_node").alias("_from"), F.col("_up").alias("_up2")
        )
        half = F.lit(2**k).cast("long")
        own = F.struct(F.col("_node").alias("node"), F.least("_n", half).alias("n"), F.col("_pos").alias("pos"))
        above = F.struct(
            F.col("_up2").alias("node"), (F.col("_n") - half).alias("n"), (F.col("_pos") - half).alias("pos")
        )
        parts = F.when(F.col("_n") > half, F.array(own, above)).otherwise(F.array(own))
        # One reference to the rows so far: the plan grows by one join a level.
        same = (F.col("_tree") == F.col("_t2")) & (F.col("_node") == F.col("_from")) & (F.col("_n") > half)
        rows = (
            rows.join(step, same, "left")
            .select("_tree", "_rank", "_leaf", F.explode(parts).alias("_s"))
            .select("_tree", "_rank", "_leaf", F.col("_s.node").alias("_node"), F.col("_s.n").alias("_n"), F.col("_s.pos").alias("_pos"))
        )
    return rows.drop("_n")


def format_trees(
    messages: DataFrame,
    tree: str,
    node: str,
    parent: str,
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    per_tree: int = 1,
) -> DataFrame:
    """One row per chosen path: tree, path_rank, n_turns, formatted, spans.

    `node` is a whole number, unique within its tree; `parent` is null or
    unknown for a root.  Paths are ranked by the sum of their messages' scores
    (null: 0; no score column: all equal), then by leaf id.  Null roles and
    texts are empty, a null tree is one tree of its own, rows with a null node
    are left out, and so are messages on a cycle, which has no root.  An empty
    table gives an empty table; other columns are not read.  A conversation is
    one row in the end, so the longest must fit in one.
    """
    own = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("_tree")
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    nodes = keep(
        messages.select(
            own,
            F.col(tree).alias("_key"),
            F.col(node).cast("long").alias("_node"),
            F.col(parent).cast("long").alias("_parent"),
            points.alias("_score"),
            F.coalesce(F.col(role), F.lit("")).alias("_role"),
            F.coalesce(F.col(text), F.lit("")).alias("_text"),
        ).where(F.col(node).isNotNull()),
        "messages",
    )
    members = paths(nodes.select("_tree", "_node", "_parent", "_score"), per_tree)
    full = members.join(nodes.select("_tree", "_node", "_key", "_role", "_text"), ["_tree", "_node"])
    grouped = full.groupBy("_tree", "_rank").agg(
        F.first("_key").alias(tree),
        F.count("*").alias("n_turns"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_role", "_text"))),
            lambda m: F.struct(m["_role"].alias("role"), m["_text"].alias("text")),
        ).alias("_turns"),
    )
    written = F.arrow_udf(_render, "formatted string, spans array<struct<start:int,length:int>>")
    return grouped.withColumn("_out", written("_turns")).select(
        tree,
        F.col("_rank").alias("path_rank"),
        "n_turns",
        F.col("_out.formatted").alias("formatted"),
        F.col("_out.spans").alias("spans"),
    )


def _render(turns: pa.Array) -> pa.Array:
    done = [render([(t["role"], t["text"]) for t in row]) for row in turns.to_pylist()]
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    spans = [[{"start": s, "length": n} for s, n in found] for _, found in done]
    return pa.StructArray.from_arrays(
        [pa.array([d[0] for d in done], pa.string()), pa.array(spans, span)], names=["formatted", "spans"]
    )


def _digest(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    turns_hex, loss_n, loss_hex, chars = [], [], [], []
    for whole, found in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns_hex.append(
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parse(whole)).encode()).hexdigest()
        )
        loss = "".join(unescape(whole[s["start"] : s["start"] + s["length"]]) for s in found)
        loss_n.append(len(loss))
        loss_hex.append(hashlib.sha256(loss.encode()).hexdigest())
        chars.append(len(whole))
    return pa.StructArray.from_arrays(
        [pa.array(turns_hex), pa.array(loss_n, pa.int64()), pa.array(loss_hex), pa.array(chars, pa.int64())],
        names=["turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


def digests(paths_out: DataFrame) -> DataFrame:
    """Read formatted conversations back: digests of their turns and of the text under the loss mask."""
    read = F.arrow_udf(
        _digest, "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return paths_out.withColumn("_d", read("formatted", "spans")).select("*", "_d.*").drop("_d")


def chain(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees in which each turn answers the one before.

    Rows with the same turn follow each other by role and text; null turns come first.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.withColumn("node", F.row_number().over(by_turn).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    out = digests(format_trees(chain(given.unionByName(probe)), "conv_id", "node", "parent"))
    return out.select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


OP1_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         length(replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\l')) AS n_text,
         length(replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\l'), ': ', '\c'))
           AS n_role
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n_text + n_role + 4 + 2 + 9)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""

QUERIES = {"op1_chat_format": op1_chat_format}
ORACLES = {"op1_chat_format": OP1_SQL}
