"""The trie of the turns that conversations begin with, from sorted sequences and their common prefixes.

Sequences of turns are sorted over the whole cluster and dealt in that order to blocks of bounded size. Beside each
sequence stands the number of turns that it shares with the one before it (its LCP). A sparse table holds the least LCP
of every stretch of 1, 2, 4, ... neighbours. A candidate prefix then binary-searches over it, to the left and to the right,
each by itself, how far its members reach: a node of the trie is an interval of members and a depth. Nodes in order of
(first member, depth) are in preorder, so sums over a subtree are differences of running sums.

An interval that crosses the border of its block has a piece in each block. The LCPs at the borders and the least one
inside each block, three numbers a block, form the same structure once more; over it every piece finds the block its node begins
in, which names the node together with its depth. Pieces are as few as turns are shared across borders; they are added up by name, and sums over
their subtrees come from running sums over blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .spelling import sql_crc32

LEAST_BLOCKS = 32
PER_BLOCK = 20_000
NONE = hashlib.sha256(b"").hexdigest()
_TURN = 16


def turn_token(role: Column, text: Column) -> Column:
    """32 hex digits for a turn: equal turns have equal ones; different ones do not, but for a collision of 128 bits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _TURN)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<token, chars>>) of each conversation of (conv_id, turn, role, text), in order of
    the turns: null first, equal ones by token. Null roles and texts are empty; rows of null conv_id belong to
    none. Texts are not shuffled, only their tokens; a conversation's tokens become one row."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_token(F.col("role"), F.col("text")).alias("token"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token", "chars"))).alias("t"))
    return told.select("conv_id", F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["chars"].alias("chars"))).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with."""
    low, high = 0, min(len(a), len(b)) // _TURN
    if a[: high * _TURN] == b[: high * _TURN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * _TURN : mid * _TURN] == b[low * _TURN : mid * _TURN]:
            low = mid
        else:
            high = mid
    return low


class Least:
    """A sparse table: the least value of any stretch, and how far values stay at or above a bound."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each start the end (exclusive) of the longest stretch from there whose values are all >= bound."""
        at = start.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            inside = at < len(level)
            far = inside & (level[np.where(inside, at, 0)] >= bound) if len(level) else inside & False
            at[far] += 1 << j
        return at

    def left(self, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each end (exclusive) the start of the longest stretch up to there whose values are all >= bound."""
        at = end.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[j], 1 << j
            inside = (at >= step) & (at - step < len(level))
            far = inside & (level[np.where(inside, at - step, 0)] >= bound) if len(level) else inside & False
            at[far] -= step
        return at

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least value of each stretch, end exclusive and beyond its start."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for j, values in enumerate(self.levels):
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(values[start[at]], values[end[at] - (1 << j)])
        return out


def block_nodes(ids: np.ndarray, keys: list[bytes], chars: np.ndarray, block: int, shared: np.ndarray, borders: Least) -> dict[str, np.ndarray | list]:
    """The nodes of a block, or their pieces in it, from its sorted sequences.

    `shared` holds the LCPs at the left border of each block and, at its end, that behind the last one; -1 at both ends. `borders`
    is the sparse table over (inside of block 0, border of 1, inside of 1, ...).
    """
    n = len(ids)
    length = np.array([len(k) // _TURN for k in keys], np.int64)
    lcp = np.array([shared[block], *[common_turns(a, b) for a, b in zip(keys, keys[1:])], shared[block + 1]], np.int64)  # noqa: B905
    first = np.concatenate([[0], lcp[1:n] + 1])  # the first depth at which a sequence leaves the one before
    count = length - first + 1
    offset = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n), count)
    depth = np.arange(len(row)) - offset[row] + first[row]
    table_ = Least(lcp[1:n])
    left, right = table_.left(row, depth), table_.right(row, depth)  # rows left to right, both included
    opens = (left == 0) & (lcp[0] >= depth), (right == n - 1) & (lcp[n] >= depth)
    open_ = opens[0] | opens[1]
    begins = np.full(len(row), block, np.int64)
    before = np.flatnonzero(opens[0])
    begins[before] = -(-(borders.left(np.full(len(before), 2 * block, np.int64), depth[before]) - 1) // 2)
    above = np.where(depth > 0, depth - 1, 0)
    top = table_.left(row, above)
    parent = np.where(depth > 0, offset[top] + above - first[top], -1)
    members = right - left + 1
    starts = np.concatenate([[0], np.cumsum(length)])
    own_chars = np.concatenate([chars, [0]])[np.where(depth > 0, starts[row] + depth - 1, len(chars))].astype(np.int64)
    closed_child = ~open_ & (parent >= 0)
    children = np.bincount(parent[closed_child], minlength=len(row))
    running = lambda x: np.concatenate([[0], np.cumsum(np.where(open_, 0, x))])
    till = offset[right + 1]  # the subtree is what follows in preorder up to here
    at = np.arange(len(row))
    below = lambda x: running(x)[till] - running(x)[at]
    same = np.concatenate([(lcp[1:n] == length[1:]) & (length[:-1] == length[1:]), [False]])
    last = np.zeros(n, np.int64)
    stop = n - 1
    for i in range(n - 1, -1, -1):
        stop = stop if same[i] else i
        last[i] = stop
    ended = np.flatnonzero(depth == length[left])
    joined = {i: ",".join(map(str, ids[left[i] : last[left[i]] + 1].tolist())) for i in ended.tolist()}
    ends: list[str | None] = [NONE] * len(row)
    for i, text in joined.items():
        ends[i] = text if open_[i] else hashlib.sha256(text.encode()).hexdigest()
    for i in np.flatnonzero(open_).tolist():
        ends[i] = joined.get(i)
    least = Least(ids).least(left, right + 1)
    known = np.where(parent >= 0, parent, 0)
    return {
        "open": open_, "block": np.full(len(row), block, np.int64), "begins": begins, "depth": depth, "conv_id": least,
        "parent_conv_id": np.ma.masked_array(least[known], (parent < 0) | open_[known]), "parent_begins": np.where(parent >= 0, begins[known], -1), "n_convs": members,
        "n_children": children, "n_leaves": below(children == 0), "saved_tokens": below((members - 1) * own_chars), "chars": own_chars, "ends": ends,
    }


_NODES = {"open": "boolean", "ends": "string"}
_COLUMNS = ("open", "block", "begins", "depth", "conv_id", "parent_conv_id", "parent_begins", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars", "ends")
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(seqs: DataFrame, per_block: int = PER_BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """The nodes of the trie of `seqs` (conv_id long, turns array<struct<token, chars>>; tokens of 32 hex digits): conv_id
    (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    Rows are dealt to blocks by sequence and id, so one sequence that very many conversations share is spread as
    well. Sequences without a turn are members of the root only. Repeated rows count as often as they occur. An empty table has no
    node. A sequence has to fit a row, at 16 bytes a turn.
    """
    keyed = cut(seqs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["token"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars")))
    blocks = max(least_blocks, -(-keyed.count() // per_block))
    ranged = keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("block", F.spark_partition_id())
    ranged = cut(ranged)
    number, shared, inside = _borders(ranged)
    if not number:
        return ranged.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT))
    woven = np.empty(2 * len(inside) - 1, np.int64)
    woven[::2], woven[1::2] = inside, shared[1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)  # a block, of bounded size
        for block in held.column("block").unique().to_pylist() if held.num_rows else []:
            rows = held.filter(pa.compute.equal(held.column("block"), block)).combine_chunks()
            k, want = number[block]
            if rows.num_rows != want:
                raise RuntimeError(f"block {block} has {rows.num_rows} of its {want} rows")
            keys = rows.column("key").to_pylist()
            chars = rows.column("chars").combine_chunks()
            flat = (chars.flatten() if isinstance(chars, pa.Array) else pa.chunked_array(chars).combine_chunks().flatten()).to_numpy(zero_copy_only=False)
            found = block_nodes(rows.column("conv_id").to_numpy(), keys, flat.astype(np.int64), k, shared, Least(woven))
            yield pa.RecordBatch.from_arrays([pa.array(found[c], pa.string() if c == "ends" else pa.bool_() if c == "open" else pa.int64()) for c in _COLUMNS], names=list(_COLUMNS))

    nodes = cut(ranged.mapInArrow(run, ", ".join(f"{c} {_NODES.get(c, 'long')}" for c in _COLUMNS)))
    opened = _open_nodes(nodes.where("open"), len(inside))
    closed = nodes.where("NOT open").withColumnRenamed("ends", "ends_sha256")
    lost = closed.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id")
    up = opened.select(F.col("begins").alias("b"), (F.col("depth") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    lost = lost.join(up, (F.col("parent_begins") == F.col("b")) & (F.col("depth") == F.col("d")), "left")
    opened = opened.join(up, (F.col("parent_begins") == F.col("b")) & (F.col("depth") == F.col("d")), "left")
    return closed.where("parent_conv_id IS NOT NULL OR depth = 0").select(*RESULT).unionByName(lost.select(*RESULT)).unionByName(opened.select(*RESULT))


def _borders(ranged: DataFrame) -> tuple[dict[int, tuple[int, int]], np.ndarray, np.ndarray]:
    """({block: (its place among the blocks with rows, rows)}, LCPs at the borders, LCPs of first and last inside): three numbers
    a block reach the driver. The one window sees a row for each block."""
    edges = ranged.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    edges = edges.withColumn("before", F.lag("last").over(Window.orderBy("block"))).select("block", "n", "before", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, first, last = (batch.column(i).to_pylist() for i in (2, 3, 4))
            shared = [-1 if a is None else common_turns(a, b) for a, b in zip(before, first, strict=True)]
            inside = [common_turns(a, b) for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(inside, pa.int64())], names=["block", "n", "shared", "inside"])

    rows = sorted(edges.mapInArrow(run, "block int, n long, shared long, inside long").collect())
    number = {r["block"]: (k, r["n"]) for k, r in enumerate(rows)}
    return number, np.array([*[r["shared"] for r in rows], -1], np.int64), np.array([r["inside"] for r in rows], np.int64)


def _open_nodes(pieces: DataFrame, blocks: int) -> DataFrame:
    """Nodes that cross a border, from their pieces. Those that begin in the same block, at greater depth, and all that begin in blocks
    between a node's first and last one lie below it."""
    told = pieces.groupBy("begins", "depth").agg(
        F.max("parent_begins").alias("parent_begins"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("block").alias("ends_in"),
        F.sum("n_children").alias("closed_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"),
    )
    kids = told.groupBy(F.col("parent_begins").alias("b"), (F.col("depth") - 1).alias("d")).agg(F.count(F.lit(1)).alias("open_children"))
    told = told.join(kids, (F.col("begins") == F.col("b")) & (F.col("depth") == F.col("d")), "left").drop("b", "d")
    told = cut(told.withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0))).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars")).withColumn("own_leaf", (F.col("n_children") == 0).cast("long")))
    deeper = Window.partitionBy("begins").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = told.groupBy("begins").agg(F.sum("own_saved").alias("s"), F.sum("own_leaf").alias("l"))
    each = told.sparkSession.range(blocks).join(sums, F.col("id") == F.col("begins"), "left").select("id", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("l", F.lit(0)).alias("l"))
    upto = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each block
    each = cut(each.select("id", F.sum("s").over(upto).alias("till_s"), F.sum("l").over(upto).alias("till_l"), "s", "l"))
    begun = each.select(F.col("id").alias("i1"), F.col("till_s").alias("s1"), F.col("till_l").alias("l1"))
    ended = each.select(F.col("id").alias("i2"), (F.col("till_s") - F.col("s")).alias("s2"), (F.col("till_l") - F.col("l")).alias("l2"))
    told = told.withColumn("deep_s", F.sum("own_saved").over(deeper)).withColumn("deep_l", F.sum("own_leaf").over(deeper))
    told = told.join(begun, F.col("begins") == F.col("i1")).join(ended, F.col("ends_in") == F.col("i2"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest over the pieces of a node, which come in the order of their blocks."""
        key, digest = None, None
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            for begins, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if (begins, depth) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (begins, depth), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield _digests(done)
                done = []
        if key:
            yield _digests([(*key, digest.hexdigest())])

    texts = pieces.where("ends IS NOT NULL").select("begins", "depth", "ends", "block").repartition("begins", "depth").sortWithinPartitions("begins", "depth", "block")
    digests = texts.mapInArrow(hashed, "b long, d long, sha string")
    told = told.join(digests, (F.col("begins") == F.col("b")) & (F.col("depth") == F.col("d")), "left")
    return cut(told.select(
        "begins", "depth", "parent_begins", "conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.col("deep_l") + F.col("l2") - F.col("l1")).alias("n_leaves"), (F.col("saved") + F.col("deep_s") + F.col("s2") - F.col("s1")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(NONE)).alias("ends_sha256"),
    ))


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    b, d, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(d, pa.int64()), pa.array(sha, pa.string())], names=["b", "d", "sha"])


def rebuilt(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like others: the first h turns of conversation c - c % `every`, then the own turns after
    the first h; h is the unsigned CRC-32 of the decimal c, modulo `most`."""
    own = cut(seqs)
    head = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").withColumn("h", h)
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


ORACLE_SQL = {
    "op12_prefix_trie": f"""
WITH rows AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok, coalesce(length(text), 0) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok, chars) - 1 AS r, tok, chars FROM rows),
c AS (SELECT conv_id, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM rows)),
both_ AS (
  SELECT c.conv_id, 0 AS part, r, tok, chars FROM c JOIN t ON t.conv_id = c.base AND t.r < c.h
  UNION ALL SELECT c.conv_id, 1, r, tok, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.r >= c.h),
s AS (SELECT conv_id, tok, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d FROM both_),
m AS MATERIALIZED (
  SELECT conv_id, 0 AS d, '' AS p, NULL AS up, 0 AS chars FROM c
  UNION ALL SELECT conv_id, d, p, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY d), ''), chars
  FROM (SELECT conv_id, d, chars, sha256(string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY d)) AS p FROM s)),
node AS MATERIALIZED (SELECT d, p, max(up) AS up, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars FROM m GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (d, p)),
below AS (
  SELECT m.d, m.p, sum((n - 1) * full_.chars) AS saved, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves
  FROM full_ JOIN m ON m.conv_id = full_.conv_id AND m.d <= full_.d GROUP BY m.d, m.p),
long_ AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
ends AS (SELECT d, p, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN long_ USING (conv_id, d) GROUP BY d, p)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, CAST(a.n AS BIGINT) AS n_convs, CAST(a.k AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ AS a LEFT JOIN node AS b ON b.d = a.d - 1 AND b.p = a.up JOIN below ON below.d = a.d AND below.p = a.p LEFT JOIN ends ON ends.d = a.d AND ends.p = a.p""",
}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
