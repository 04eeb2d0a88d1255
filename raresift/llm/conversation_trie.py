"""Prefix trie of conversations, its subtree figures by the Euler-tour technique.

Every distinct sequence of first turns is a node. The tour enters and leaves each node once: an arc in, an arc out, and one
successor for each arc. List ranking gives the arcs their positions on the tour, a running total along the positions gives the
figures of a subtree as the difference between its two arcs. So no subtree is ever gathered, however deep or wide it is.

* A prefix is known by two running sums of 64-bit hashes of (place, turn), so a conversation of any length is hashed by a
  distributed running total, and texts are not moved.
* Siblings are put in order by a distributed rank of (parent, node), so a node may have any number of children.
* List ranking first follows the arcs inside blocks of neighbouring nodes (a conversation's own tail is one run of arcs), then
  doubles the jumps between the runs until all have reached the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from raresift.operators.ordered import global_rank, running_totals
from raresift.session import cut_lineage

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
BLOCK = 1 << 16  # nodes whose arcs are followed in one task
_IDS = 4096  # ids written to one piece of a digest's text
_WORD = r"[^\x20\x09-\x0D]+"

#: DuckDB text of ``prefix_trie``; the recursive part computes CRC-32 bit by bit.
ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, count(*) AS own, CAST(conv_id AS VARCHAR) AS name FROM turns GROUP BY conv_id),
bits AS (
  SELECT conv_id, name, 0 AS step, CAST(4294967295 AS BIGINT) AS crc FROM lengths
  UNION ALL
  SELECT conv_id, name, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT conv_id, name, step, CASE WHEN step % 8 = 0 THEN xor(crc, ascii(name[step // 8 + 1])) ELSE crc END AS x
        FROM bits WHERE step < 8 * length(name))),
sizes AS (
  SELECT l.conv_id, l.conv_id - l.conv_id % 20 AS base, l.own, xor(b.crc, 4294967295) % 4 AS h
  FROM lengths l JOIN bits b ON b.conv_id = l.conv_id AND b.step = 8 * length(b.name)),
shares AS (SELECT s.*, least(s.h, coalesce(l.own, 0)) AS m FROM sizes s LEFT JOIN lengths l ON l.conv_id = s.base),
rebuilt AS (
  SELECT s.conv_id, t.place AS depth, role, text FROM shares s JOIN turns t ON t.conv_id = s.base AND t.place <= s.m
  UNION ALL
  SELECT s.conv_id, s.m + t.place - s.h, role, text FROM shares s JOIN turns t ON t.conv_id = s.conv_id AND t.place > s.h),
paths AS (
  SELECT conv_id, depth, text, list(struct_pack(role := role, text := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', [] FROM shares),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(min(text), '[^ 	-]+')) AS words
  FROM paths GROUP BY path, depth),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
above AS (SELECT path[1:d] AS path, n_children, (n_convs - 1) * words AS saved FROM counted, unnest(range(depth + 1)) AS u(d)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM above GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted n JOIN sums s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), what (two hashes and the words of the turn); texts end here."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("one"), F.xxhash64(F.lit(2), text, role).alias("two"),
        F.size(F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("one"), F.asc("two")]
    return cut_lineage(global_rank(rows, by=["conv_id"], order=order, name="place").drop("turn"))


def rebuilt(conversations: DataFrame, *, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations as they share their beginnings: (conv_id, depth, one, two, words) of each turn, and (conv_id, size).

    Conversation c starts with the first h = crc32(c) % ``heads`` turns of conversation c - c % ``group``, followed by its own
    turns after its first h.
    """
    turns = _turns(conversations)
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    head = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("long")
    sizes = cut_lineage(
        lengths.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % group})
        .join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
        .withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
        .select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    )
    parts = ["one", "two", "words"]
    shared = turns.where(F.col("place") < heads).select(F.col("conv_id").alias("of"), "place", *parts)
    first = sizes.join(shared, (F.col("base") == F.col("of")) & (F.col("place") <= F.col("m")))
    own = turns.select(F.col("conv_id").alias("of"), "place", *parts)
    rest = sizes.join(own, (F.col("conv_id") == F.col("of")) & (F.col("place") > F.col("h")))
    rows = first.select("conv_id", F.col("place").alias("depth"), *parts).unionByName(
        rest.select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), *parts)
    )
    return rows, sizes.select("conv_id", "size")


def prefix_nodes(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (key, up, depth, conv_id, n_convs, words) and each conversation's last node (key, conv_id).

    ``key`` is a pair of decimal sums, ``up`` the one of the parent (NULL at the root). The root is there if any conversation is.
    """
    wide = lambda name: F.xxhash64(F.col("depth"), F.col(name)).cast("decimal(38,0)")  # noqa: E731
    hashed = rows.withColumns({"x": wide("one"), "y": wide("two")})
    summed = cut_lineage(running_totals(
        hashed, by=["conv_id"], order=[F.asc("depth")], totals={"sx": F.col("x"), "sy": F.col("y")}
    ).select("conv_id", "depth", "words", "sx", "sy", (F.col("sx") - F.col("x")).alias("ux"), (F.col("sy") - F.col("y")).alias("uy")))
    zero = F.lit(0).cast("decimal(38,0)")
    none = F.lit(None).cast("decimal(38,0)")
    nodes = summed.groupBy("depth", "sx", "sy").agg(
        F.min("ux").alias("ux"), F.min("uy").alias("uy"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
    )
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("sx"), zero.alias("sy"), none.alias("ux"), none.alias("uy"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
    )
    last = summed.join(sizes.select("conv_id", F.col("size").alias("depth")), ["conv_id", "depth"]).select("conv_id", "depth", "sx", "sy")
    turnless = sizes.where("size = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("sx"), zero.alias("sy"))
    return nodes.unionByName(root), last.unionByName(turnless)


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with a gapless number in the order of (conv_id, depth), so that a conversation's own tail has neighbouring numbers."""
    return cut_lineage(global_rank(nodes, order=[F.asc("conv_id"), F.asc("depth")], name="node"))


def tour_arcs(tree: DataFrame) -> DataFrame:
    """(arc, next) of the Euler tour of (node, parent): the arc 2 * node enters a node, 2 * node + 1 leaves it; the last has no next."""
    # The root is no one's sibling; its NULL parent would make all ranks of one group otherwise.
    ranked = cut_lineage(global_rank(
        tree.where("parent IS NOT NULL").select("node", "parent"), order=[F.asc("parent"), F.asc("node")], name="turn"
    ))
    later = ranked.select((F.col("turn") - 1).alias("turn"), F.col("node").alias("sibling"), F.col("parent").alias("of"))
    siblings = ranked.join(later, "turn", "left").select(
        "node", F.when(F.col("of") == F.col("parent"), F.col("sibling")).alias("sibling")
    )
    first = ranked.groupBy("parent").agg(F.min("node").alias("child")).withColumnRenamed("parent", "node")
    known = tree.select("node", "parent").join(siblings, "node", "left").join(first, "node", "left")
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    after = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1)
    arcs = F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next")),
        F.struct(leave.alias("arc"), after.alias("next")),
    )
    return known.select(F.inline(arcs))


def _runs(block: pd.DataFrame) -> pd.DataFrame:
    """Each arc of a block with the first arc outside the block that follows it, and the number of steps to that one."""
    arc, then = block["arc"].to_numpy(np.int64), block["next"].fillna(-1).to_numpy(np.int64)
    order = np.argsort(arc)
    arc, then = arc[order], then[order]
    at = np.minimum(np.searchsorted(arc, then), len(arc) - 1)
    at = np.where(arc[at] == then, at, -1)  # the next arc's place, if it is in this block
    steps = np.ones(len(arc), np.int64)
    while (inside := np.flatnonzero(at >= 0)).size:
        onto = at[inside]
        steps[inside] += steps[onto]
        then[inside], at[inside] = then[onto], at[onto]
    return pd.DataFrame({"arc": arc, "next": pd.array(np.where(then < 0, None, then), "Int64"), "steps": steps})


def list_rank(arcs: DataFrame, *, block: int = 2 * BLOCK, rounds: int = 64) -> DataFrame:
    """(arc, steps) of a linked list (arc, next): how many arcs there are from this one to the end, itself included.

    Blocks of neighbouring arcs are contracted first. Of the runs that remain, only the arcs that a run from another block leads
    to take part in the doubling: each round they jump as far as the arc they point at has come. Every round is written, so
    a lost executor costs one round.
    """
    cut = cut_lineage(
        arcs.withColumn("part", F.floor(F.col("arc") / block)).groupBy("part").applyInPandas(_runs, "arc long, next long, steps long")
    )
    targets = cut.where("next IS NOT NULL").select(F.col("next").alias("arc")).distinct()
    now = cut_lineage(cut.join(targets, "arc", "left_semi"))
    for _ in range(rounds):
        if now.where("next IS NOT NULL").isEmpty():
            break
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("more"))
        now = cut_lineage(now.join(ahead, "next", "left").select(
            "arc", F.col("beyond").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
        ))
    else:
        raise RuntimeError(f"list not ranked after {rounds} rounds")
    ends = now.select(F.col("arc").alias("next"), F.col("steps").alias("more"))
    return cut.join(ends, "next", "left").select("arc", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))


def subtree_sums(tree: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(node, one sum for each of ``values``) over the subtree of every node of (node, parent, ...), its top included."""
    ranked = list_rank(tour_arcs(tree))
    own = tree.select((F.col("node") * 2).alias("arc"), *[v.alias(f"of_{name}") for name, v in values.items()])
    weighted = ranked.join(own, "arc", "left").select(
        "arc", "steps", *[F.coalesce(F.col(f"of_{name}"), F.lit(0)).cast("long").alias(f"of_{name}") for name in values]
    )
    along = running_totals(weighted, order=[F.desc("steps")], totals={name: F.col(f"of_{name}") for name in values})
    sides = along.withColumns({"node": F.floor(F.col("arc") / 2), "leaves": F.col("arc") % 2 == 1})
    return sides.groupBy("node").agg(*[
        (F.max(F.when(F.col("leaves"), F.col(name))) - F.max(F.when(~F.col("leaves"), F.col(name) - F.col(f"of_{name}")))).alias(name)
        for name in values
    ])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in that order -> (node, first, ids): up to ``_IDS`` ids as one comma-joined text."""
    for batch in batches:
        node, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.diff(node)) + 1
        starts = np.unique(np.concatenate([[0], edges, np.arange(0, len(node), _IDS)])) if len(node) else np.array([], np.int64)
        ends = np.append(starts[1:], len(node))[: len(starts)]
        yield pa.RecordBatch.from_arrays([
            pa.array(node[starts]), pa.array(conv[starts]),
            pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, ends, strict=True)], pa.string()),
        ], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) in that order -> (node, ends_sha256); a digest takes its text in piece by piece."""
    now, state = None, None
    for batch in batches:
        nodes, found = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != now:
                if state is not None:
                    nodes.append(now)
                    found.append(state.hexdigest())
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the digest of each node's comma-joined ids, ascending.

    Ids are joined to texts where a range of them lies, and only texts of a node meet; they are taken in one after the other.
    """
    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ordered.select("node", "conv_id").mapInArrow(_joined_ids, "node long, first long, ids string")
    together = pieces.repartition("node").sortWithinPartitions("node", "first")
    return together.mapInArrow(_digests, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    A node is a distinct sequence of first turns (role, text) of the rebuilt conversations, named by its smallest member and its
    depth; the root (depth 0, no parent) holds them all. ``n_leaves`` and ``saved_tokens`` are over the node's subtree:
    childless nodes, and the words that sharing the node's last turn saves. Turns are ordered by number, NULL first; turns with one
    number by a hash of role and text, so repeated rows are turns of their own and their order does not matter. NULL roles and
    texts count as empty; rows without a conv_id belong to no conversation. An empty table has no node, not even a root.
    Only conv_id, turn, role and text are read.
    """
    nodes, last = prefix_nodes(*rebuilt(conversations, group=group, heads=heads))
    numbered = _numbered(nodes)
    keys = ["depth", "sx", "sy"]
    below = numbered.where("depth > 0").select(
        "node", "conv_id", "words", "n_convs", "depth", (F.col("depth") - 1).alias("pd"), F.col("ux").alias("px"), F.col("uy").alias("py")
    )
    above = numbered.select(
        F.col("depth").alias("pd"), F.col("sx").alias("px"), F.col("sy").alias("py"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    top = numbered.where("depth = 0").select(
        "node", "conv_id", "words", "n_convs", "depth", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("parent_conv_id")
    )
    linked = below.join(above, ["pd", "px", "py"]).select("node", "conv_id", "words", "n_convs", "depth", "parent", "parent_conv_id")
    children = linked.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    tree = cut_lineage(
        linked.unionByName(top).join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    )
    sums = subtree_sums(tree, {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    })
    ends = ends_digests(last.join(numbered.select("node", *keys), keys).select("node", "conv_id"))
    return tree.join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )

