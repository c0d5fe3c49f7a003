"""SimHash near-duplicates found with a forest of vantage-point trees.

Method. Every text gets a SimHash. Two fingerprints link when they differ in at most `total` bits and,
on one of several parts of their bits at least, in at most that part's radius. Linked texts form groups.

* For op3 (64 bits, radius 4) the parts cover all bits and the sum of (radius + 1) is `total` + 1: by pigeonhole
  every pair within `total` is found. One part with the whole radius is the textbook tree; on 64
  nearly random bits its triangle bounds prune almost nothing (distances to a vantage point lie at
  32 +- 4, and the bound has a width of 8), hence the parts. The guests of a radius grow with a tree's depth;
  where the parts' trees would deal more than `MOST_COPIES` copies, five parts of radius 0 take their place.
* There is a tree for each part. A node holds a vantage point v and a cut c: fingerprints with d(x, v) <= c
  belong to the near child. By the triangle inequality partners of x within r lie only in children
  that [d - r, d + r] reaches; a fingerprint is at home in one leaf and a guest in further leaves
  whose boundary it overlaps. Only overlapping leaves are searched.
* The trees are fitted on a bounded sample (`sample` fingerprints); they only steer the work, and
  all fingerprints pass through them. A leaf is a shard of the Spark job. A leaf of more than about twice
  `capacity` fingerprints is dealt in chunks to cells (chunk i against chunk j), so that no task holds
  an unbounded group, and nothing is dropped.
* In a cell the fingerprints are grouped by their part, or by other parts that the search names for it; only groups
  within that part's radius are compared. A cell reports stars that span its links, never all pairs; star contractions
  join the stars.

Near duplicates by shingles (`similar_groups`, `keep_one`) take wide fingerprints, in trees of radius 0 over a few
bits each and with many parts inside a cell (`forest_shape`), and check the groups on the shingle sets: see there.
Equal texts count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table, uniform
from .components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
PART_RADII = (1, 0, 0, 0)
#: Copies of a fingerprint at most that trees with guests may deal on average; beyond, parts of radius 0 are taken.
MOST_COPIES = 6
CAPACITY = 1 << 16
SAMPLE = 65_536
#: Ids at most that are broadcast to a join; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts and shingles at most that one task checks against each other; larger groups are dealt to several.
MOST_TEXTS, MOST_SHINGLES = 1024, 1 << 20
SKETCH = 1024
_CHUNK = 1 << 15
_BLOCK = 1 << 21


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of a shingle's bits: its hash, and beyond that the hash mixed anew."""
    if k == 0:
        return h
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED, words: int = 1) -> np.ndarray:
    """SimHash of one UTF-8 text, as `words` unsigned 64-bit numbers; 0 for null or no words."""
    said = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not said:
        return np.zeros(words, dtype=np.uint64)
    joined = b" ".join(said)
    lengths = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(said) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(said) - shingle + 1], ends[shingle - 1 :]
    counts = np.zeros((words, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), _CHUNK):
        pairs = zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)
        for w in range(words):
            bits = np.unpackbits(_mixed(hashes, w).view(np.uint8)).view(np.uint64).reshape(-1, 8)  # a byte a bit
            lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # 255 rows fit a byte
            counts[w] += np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(starts), axis=1).view(np.uint64)[:, 0]


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) for each row; fp holds the unsigned fingerprint's bits. Null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle, seed)[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


# ---------------------------------------------------------------- vantage-point trees


class Part(NamedTuple):
    """Bits start .. start + width - 1 of a fingerprint, and the radius of their tree."""

    start: int
    width: int
    radius: int


def parts_of(radii: Sequence[int], bits: int = 64) -> list[Part]:
    """`bits` cut into parts of nearly equal width, one for each radius."""
    edges = [round(bits * i / len(radii)) for i in range(len(radii) + 1)]
    return [Part(a, b - a, r) for a, b, r in zip(edges, edges[1:], radii, strict=False)]


def part_values(fps: np.ndarray, part: Part) -> np.ndarray:
    """The part's bits of each row of `fps` (n, words)."""
    word, at = divmod(part.start, 64)
    v = fps[:, word] >> np.uint64(at)
    if at + part.width > 64:
        v = v | (fps[:, word + 1] << np.uint64(64 - at))
    return v & np.uint64((1 << part.width) - 1)


def fit_tree(sample: np.ndarray, leaf: int) -> list[tuple]:
    """Nodes ('node', vantage, cut, near, far) and ('leaf', number) over part values; node 0 is the root.

    The vantage point of a node is, of a few candidates, the one whose distances spread most; the cut
    is the distance that divides the sample most evenly. A set that no candidate divides is a leaf.
    """
    rng, values = np.random.default_rng(0), np.unique(sample, return_counts=True)
    nodes: list[tuple] = []
    leaves = 0

    def grow(points: np.ndarray, weights: np.ndarray) -> int:
        nonlocal leaves
        at, total = len(nodes), weights.sum()
        nodes.append(())
        best = None
        if total > leaf and len(points) > 1:
            for v in rng.choice(points, size=min(8, len(points)), replace=False):
                d = np.bitwise_count(points ^ v)
                below = np.cumsum(np.bincount(d, weights=weights, minlength=65))
                c = int(np.argmin(np.abs(below - total / 2)))
                if 0 < below[c] < total and (best is None or abs(below[c] - total / 2) < best[0]):
                    best = (abs(below[c] - total / 2), v, c, d)
        if best is None:
            nodes[at] = ("leaf", leaves)
            leaves += 1
        else:
            _, v, c, d = best
            near = grow(points[d <= c], weights[d <= c])
            far = grow(points[d > c], weights[d > c])
            nodes[at] = ("node", int(v), c, near, far)
        return at

    if len(sample):
        grow(*values)
    else:
        nodes.append(("leaf", 0))
    return nodes


def route(values: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, at home?) for every leaf that may hold a partner within `radius`;
    a guest goes only to leaves numbered above its own, since its partners there come to meet it else."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, np.arange(len(values)), np.ones(len(values), dtype=bool))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        node = nodes[at]
        if node[0] == "leaf":
            found.append((idx, node[1], home))
            continue
        _, v, c, near, far = node
        d = np.bitwise_count(values[idx] ^ np.uint64(v)).astype(np.int64)
        inside = d - radius <= c
        outside = d + radius > c
        todo.append((near, idx[inside], home[inside] & (d[inside] <= c)))
        todo.append((far, idx[outside], home[outside] & (d[outside] > c)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    idx = np.concatenate([f[0] for f in found])
    leaf = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
    home = np.concatenate([f[2] for f in found])
    own = np.zeros(len(values), dtype=np.int64)
    own[idx[home]] = leaf[home]
    keep = home | (leaf > own[idx])
    return idx[keep], leaf[keep], home[keep]


# ---------------------------------------------------------------- links inside a cell


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (..., words), broadcast like numpy's operators."""
    return sum(np.bitwise_count(left[..., w] ^ right[..., w]).astype(np.int16) for w in range(left.shape[-1]))


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n points that the pairs (a, b) link."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _between(fps: np.ndarray, a: np.ndarray, b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two index lists, block by block."""
    rows, firsts, seconds = max(1, _BLOCK // max(1, len(b))), [], []
    for k in range(0, len(a), rows):
        i, j = np.nonzero(distances(fps[a[k : k + rows], None], fps[b][None]) <= total)
        firsts.append(a[k + i])
        seconds.append(b[j])
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.empty(0, np.int64),) * 2


def dense_links(fps: np.ndarray, points: np.ndarray, total: int, leaders: int = 16, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span all links among `points`.

    Points within reach of a leader form its ball and are linked by it, so a large group of close points costs a
    few passes. Balls, and the points outside of them, are then compared across, not within.
    """
    rest, balls, a, b = points, [], [], []
    alone: list[np.ndarray] = []
    for _ in range(leaders):
        if not len(rest):
            break
        near = distances(fps[rest], fps[rest[0]]) <= total
        if near.sum() >= least:
            balls.append(rest[near])
            a.append(np.full(near.sum(), rest[0]))
            b.append(rest[near])
            rest = rest[~near]
        else:
            alone.append(rest[:1])
            rest = rest[1:]
    rest = np.concatenate([*alone, rest])
    for k, ball in enumerate(balls):
        for other in [*balls[:k], rest]:
            x, y = _between(fps, other, ball, total)
            _, once = np.unique(x, return_index=True)  # a point needs one link to a ball
            a.append(x[once])
            b.append(y[once])
    for k in range(0, len(rest), 1024):
        x, y = _between(fps, rest[k : k + 1024], rest[k:], total)
        a.append(x[x < y])
        b.append(y[x < y])
        x, y = x[x > y], y[x > y]
        a.append(y)
        b.append(x)
    return np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64)


def links_in_cell(fps: np.ndarray, part: Part, total: int, few: int = 1024) -> np.ndarray:
    """For each fingerprint the smallest index among those that links of the cell reach."""
    n = len(fps)
    values = part_values(fps, part)
    order = np.argsort(values, kind="stable")
    u, start, count = np.unique(values[order], return_index=True, return_counts=True)
    flips = [sum(1 << int(x) for x in c) for r in range(part.radius + 1) for c in combinations(range(part.width), r)] if math.comb(part.width, part.radius) <= len(u) else None
    firsts, seconds = [], []
    if flips is not None:  # look the neighbours of each value up
        for f in flips:
            other = u ^ np.uint64(f)
            at = np.minimum(np.searchsorted(u, other), len(u) - 1)
            hit = (u[at] == other) & (other >= u)
            firsts.append(np.flatnonzero(hit))
            seconds.append(at[hit])
    else:
        for k in range(0, len(u), 1024):
            i, j = np.nonzero(np.bitwise_count(u[k : k + 1024, None] ^ u[None]) <= part.radius)
            firsts.append(i[j >= i + k] + k)
            seconds.append(j[j >= i + k])
    p, q = np.concatenate(firsts), np.concatenate(seconds)
    pairs = count[p] * count[q]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for x, y in zip(p[pairs > few].tolist(), q[pairs > few].tolist(), strict=True):
        points = order[start[x] : start[x] + count[x]]
        i, j = dense_links(fps, points if x == y else np.concatenate([points, order[start[y] : start[y] + count[y]]]), total)
        a.append(i)
        b.append(j)
    p, q, pairs = p[pairs <= few], q[pairs <= few], pairs[pairs <= few]
    ends = np.cumsum(pairs)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, _BLOCK):  # all pairs of small groups, numbered through
        number = np.arange(lo, min(lo + _BLOCK, int(ends[-1])))
        g = np.searchsorted(ends, number, side="right")
        inside = number - (ends[g] - pairs[g])
        i, j = start[p[g]] + inside // count[q[g]], start[q[g]] + inside % count[q[g]]
        i, j = order[i[i < j]], order[j[i < j]]
        near = distances(fps[i], fps[j]) <= total
        a.append(i[near])
        b.append(j[near])
    return connect(n, np.concatenate(a), np.concatenate(b))


def _words(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    """Fingerprints of a long or binary column as (n, words)."""
    if words == 1:
        return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, words)


def _gathered(batches: Iterator[pa.RecordBatch], words: int, rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, fingerprints) of many small batches at once; routing costs by the tree's nodes, not by its rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held)
            yield whole.column(0).to_numpy(), _words(whole.column(1), words)
            held, n = [], 0
    if n:
        whole = pa.Table.from_batches(held)
        yield whole.column(0).to_numpy(), _words(whole.column(1), words)


class Search(NamedTuple):
    """A tree over `part`, and the parts by which the fingerprints of one of its cells are compared."""

    part: Part
    inner: tuple[Part, ...]


def searches_of(parts: Sequence[Part]) -> list[Search]:
    """One tree a part, compared by that part."""
    return [Search(part, (part,)) for part in parts]


def equal_parts(total: int, bits: int = 64) -> list[Search]:
    """Trees of radius 0 that find every pair within `total` bits, at total + 1 copies whatever the table's size.

    One of total + 1 parts is equal in both. The others hold at most `total` differing bits, so one of them is equal
    too, or the first of them differs in one bit at most: by these the pairs of a cell are compared.
    """
    parts = parts_of((0,) * (total + 1), bits)
    return [Search(p, tuple(q._replace(radius=int(k == 0)) for k, q in enumerate(x for x in parts if x != p))) for p in parts]


def fitted(taken: np.ndarray, searches: Sequence[Search], leaf: int) -> tuple[list[list[tuple]], list[tuple], float]:
    """Each search's tree over the sample `taken`, where the sample goes, and the copies a fingerprint."""
    trees = [fit_tree(part_values(taken, s.part), leaf) for s in searches]
    routed = [route(part_values(taken, s.part), tree, s.part.radius) for s, tree in zip(searches, trees, strict=True)]
    return trees, routed, sum(len(r[0]) for r in routed) / max(1, len(taken))


def forest_links(points: DataFrame, searches: Sequence[Search], total: int, words: int = 1, capacity: int = CAPACITY, sample: int = SAMPLE, instead: Sequence[Search] | None = None, leaf: int | None = None) -> DataFrame:
    """(a, b) long: stars that span all links between the rows (node long, fp long or binary) of `points`.

    Two rows link if they meet in a cell of some search, differ there in at most the radius of an inner part, and in all
    bits in at most `total`. Nodes must be distinct. Leaves are meant to hold `leaf` rows (`capacity` if not given). If
    the trees would deal more than MOST_COPIES copies a row, those of `instead` are taken.
    """
    n, kind = points.count(), points.schema["fp"].dataType.simpleString()
    if n == 0:
        return points.selectExpr("node AS a", "node AS b")
    # A hash of the node takes the same rows on every run, `sample` of them in the mean.
    rows = (points if n <= sample else points.where(uniform(SEED, "node") < sample / n)).select("fp").toArrow()
    taken = _words(rows.column(0), words)
    scale = n / max(1, len(taken))
    goal = max(4, round((leaf or capacity) / scale))
    trees, routed, copies = fitted(taken, searches, goal)
    if instead and copies > MOST_COPIES:
        searches = instead
        trees, routed, copies = fitted(taken, searches, goal)
    split = {}
    for t, (_, leaves, home) in enumerate(routed):
        for at, homes, guests in zip(*np.unique(leaves, return_counts=True), np.bincount(leaves, weights=~home)[np.unique(leaves)], strict=True):
            if homes * scale > 2 * capacity:  # chunks of home rows and of guests, by the sample's shares
                split[t, int(at)] = max(1, math.ceil((homes - guests) * scale / capacity)), math.ceil(guests * scale / capacity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fps in _gathered(batches, words):
            for t, search in enumerate(searches):
                idx, leaves, home = route(part_values(fps, search.part), trees[t], search.part.radius)
                cells = [(leaves, np.zeros(len(idx), np.int64), idx)]
                for leaf in {x for x in np.unique(leaves).tolist() if (t, x) in split}:
                    kh, kg = split[t, leaf]
                    here = leaves == leaf
                    cells[0] = tuple(x[(cells[0][0] != leaf)] for x in cells[0])
                    salt = (node[idx[here]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    hi, gi = idx[here & home], idx[here & ~home]
                    hc, gc = (salt[home[here]] % np.uint64(kh)).astype(np.int64), (salt[~home[here]] % np.uint64(max(kg, 1))).astype(np.int64)
                    for other in range(kh):
                        cells.append((np.full(len(hi), leaf), np.minimum(hc, other) << 32 | np.maximum(hc, other), hi))
                        cells.append((np.full(len(gi), leaf), other << 32 | 1 << 31 | gc, gi))
                    for other in range(kg):
                        cells.append((np.full(len(hi), leaf), hc << 32 | 1 << 31 | other, hi))
                for leaf, cell, at in cells:
                    if len(at):
                        fp = pa.array(fps[at, 0].view(np.int64)) if words == 1 else pa.array([x.tobytes() for x in fps[at]], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(leaf * len(searches) + t), pa.array(cell), pa.array(node[at]), fp], names=["shard", "cell", "node", "fp"])

    def compare(group: pa.Table) -> pa.Table:
        node, first = np.unique(group.column("node").to_numpy(), return_index=True)
        fps = _words(group.column("fp"), words)[first]
        near = [links_in_cell(fps, part, total) for part in searches[group.column("shard")[0].as_py() % len(searches)].inner]
        label = near[0] if len(near) == 1 else connect(len(fps), np.tile(np.arange(len(fps)), len(near)), np.concatenate(near))
        linked = label != np.arange(len(label))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    dealt = points.select("node", "fp").mapInArrow(deal, f"shard long, cell long, node long, fp {kind}")
    return dealt.groupBy("shard", "cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, part_radii: Sequence[int] = PART_RADII, capacity: int = CAPACITY, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(id_col, fp long, component_id) for each row of `docs`: the smallest id reachable through links.

    Null text counts as empty (fingerprint 0), and empty texts link like any other. A null id gets a
    component like any row but never names one; a component of null ids only has a null component_id.
    Repeated rows stay. An empty table gives an empty result; other columns are ignored. Each text is
    used whole.
    """
    if sum(r + 1 for r in part_radii) != radius + 1:
        raise ValueError("the sum of part radius + 1 must be radius + 1")
    rows = cut(with_fingerprint(docs, id_col, text_col, shingle, seed))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    links = forest_links(classes.select(F.col("fp").alias("node"), "fp"), searches_of(parts_of(part_radii)), radius, 1, capacity, sample, equal_parts(radius))
    roots = cut(components(links))
    linked = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "least")
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component")))
    moved = linked.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component")
    named = cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return rows.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


# ---------------------------------------------------------------- groups by shingle similarity


class Shape(NamedTuple):
    tables: int  # trees of radius 0
    bits: int  # of each of them
    words: int  # of a fingerprint
    total: int  # bits in which linked fingerprints may differ


#: Bits of a part by which the fingerprints of a cell are compared, with radius 1.
INNER = 16


def forest_shape(n: int, similarity: float, recall: float) -> Shape:
    """Trees and width of fingerprints for n texts.

    Bits of two texts of that similarity differ with probability p = acos(2s / (1 + s)) / pi. A tree of radius 0 over b
    bits has them in one leaf with (1 - p)^b at least; a cell's part of k = INNER bits and radius 1 shows them with
    (1 - p)^k + k p (1 - p)^(k - 1). As many trees, and as many words for the parts in a cell, are taken as `recall` needs
    for each. b is 0 up to 16,384 texts, where one cell holds all, and grows by 0.69 for each doubling: cells grow
    as n^0.31 (500,000 texts at 10^9), so that the trees, each a copy of the fingerprint, number 20 at 10^9 and not 54.
    `total` lies four standard deviations above the mean; unrelated texts lie some seven below half of the bits.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    needed = lambda shown: max(1, math.ceil(math.log(1 - recall) / math.log(1 - shown)))
    bits = max(0, math.ceil(0.69 * (math.log2(max(1, n)) - 14)))
    tables = needed((1 - p) ** bits) if bits else 1
    words = -(-max(INNER * needed((1 - p) ** INNER + INNER * p * (1 - p) ** (INNER - 1)), tables * bits) // 64)
    return Shape(tables, bits, words, math.floor(64 * words * p + 4 * math.sqrt(64 * words * p * (1 - p))))


def shaped(shape: Shape, spread: int = 12) -> list[Search]:
    """The searches of a shape. With few trees the parts in a cell are dealt to several tasks, at up to `spread` copies."""
    inner = [Part(at, INNER, 1) for at in range(0, 64 * shape.words, INNER)]
    shares = max(1, spread // shape.tables)
    return [Search(Part(shape.bits * t, shape.bits, 0), tuple(inner[k::shares])) for t in range(shape.tables) for k in range(min(shares, len(inner)))]


def _text_key(text: bytes | None) -> int:
    """64 bits of a text less case of A-Z and amount of white space."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()) if text else b"")


def _keyed(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, words: int) -> DataFrame:
    """(id, th long, fp binary) for each row: the text's key and wide fingerprint."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            own = np.array([_text_key(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array([fingerprint(t, shingle, seed, words).tobytes() for t in texts], pa.binary())], names=["id", "th", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, th long, fp binary")


def _sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(th long, shingles binary, size long): a text's key, its sorted distinct 64-bit shingle hashes, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out, sizes = [], [], []
            for x in batch.column(0):
                words = x.as_buffer().to_pybytes().lower().split() if x.is_valid else []
                spans = (words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))) if words else ()
                hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s)) for s in spans), dtype=np.uint64))
                out.append(hashes.tobytes())
                sizes.append(len(hashes))
                own.append(xxhash.xxh64_intdigest(b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=["th", "shingles", "size"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "th long, shingles binary, size long")


class ShingleSets:
    """Sets of sorted hashes with sketches: for each residue of the hashes by SKETCH whether an odd number has it."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        odd = [np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)) for s in sets]
        self.sketch = np.array(odd, dtype=np.uint8).view(np.uint64).reshape(len(sets), -1)

    def partners(self, v: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` whose set has the similarity (Jaccard) with set v.

        Of sets of p and q shingles that have it at most (p + q) * (1 - s) / (1 + s) are in one only, and as many bits
        of the sketches differ at most; only what passes that is intersected.
        """
        p, s = int(self.size[v]), self.similarity
        q = self.size[others]
        others = others[(np.minimum(p, q) >= s * np.maximum(p, q) - 1e-6) & (q > 0)]
        if not len(others) or not p:
            return others[:0]
        differ = distances(self.sketch[others], self.sketch[v])
        others = others[differ <= (p + self.size[others]) * ((1 - s) / (1 + s)) + 1e-6]
        found = []
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            q = self.size[some]
            data = np.concatenate([self.sets[x] for x in some])
            at = np.minimum(np.searchsorted(self.sets[v], data), p - 1)
            both = np.add.reduceat((self.sets[v][at] == data).astype(np.int64), np.cumsum(q) - q)
            found.append(some[both >= s * (p + q - both)])
        return np.concatenate(found) if found else others[:0]

    def groups(self, members: np.ndarray) -> list[np.ndarray]:
        """`members` in groups that links of similar pairs hold together; each search removes what it reaches."""
        out, rest = [], members
        while len(rest):
            group, front, rest = [int(rest[0])], [int(rest[0])], rest[1:]
            while front and len(rest):
                near = self.partners(front.pop(), rest)
                if len(near):
                    rest = rest[~np.isin(rest, near)]
                    group += near.tolist()
                    front += near.tolist()
            out.append(np.array(group))
        return out


def _loaded(group: pa.Table, similarity: float) -> tuple[np.ndarray, ShingleSets]:
    """Distinct th of a cell's rows, ascending, and their sets."""
    th, first = np.unique(group.column("th").to_numpy(), return_index=True)
    held = group.column("shingles").take(pa.array(first)).to_pylist()
    return th, ShingleSets([np.frombuffer(x, np.uint64) for x in held], similarity)


def _checked(points: DataFrame, similarity: float) -> DataFrame:
    """(th, grp, root, k, chunk, lead) for `points` (th, grp, shingles, size): root is the smallest th that similar
    pairs within a chunk of the group reach; a group that fits one task is one chunk (k = 1) and done.

    lead marks a few points of each chunk's largest part.
    """
    sizes = cut(points.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("h")).select("grp", F.greatest(F.ceil(F.col("m") / MOST_TEXTS), F.ceil(F.col("h") / MOST_SHINGLES)).cast("int").alias("k")))
    shares = max(1, sizes.count() // 16)
    dealt = points.join(sizes, "grp").withColumn("chunk", F.pmod(F.xxhash64("th"), F.col("k")).cast("int"))
    cell = F.when(F.col("k") == 1, F.pmod(F.xxhash64("grp"), F.lit(shares))).otherwise(F.col("grp"))

    def check(group: pa.Table) -> pa.Table:
        th, sets = _loaded(group, similarity)
        order = np.argsort(group.column("th").to_numpy(), kind="stable")
        grp = group.column("grp").to_numpy()[order]  # th are distinct: rows in the order of `th`
        root, lead = th.copy(), np.zeros(len(th), dtype=bool)
        by = np.argsort(grp, kind="stable")
        for members in np.split(by, np.flatnonzero(np.diff(grp[by])) + 1):
            found = sets.groups(members)
            for g in found:
                root[g] = th[g].min()
            lead[max(found, key=len)[:4]] = True
        return pa.table({"th": th, "grp": grp, "root": root, "k": group.column("k").take(pa.array(order)), "chunk": group.column("chunk").take(pa.array(order)), "lead": lead})

    return dealt.withColumn("big", F.col("k") > 1).withColumn("cell", cell).groupBy("big", "cell", "chunk").applyInArrow(check, "th long, grp long, root long, k int, chunk int, lead boolean")


def _met(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b) pairs of roots of each cell's rows (grp, side, low, high, th, root, moves, shingles) that a similar pair
    joins, of which one row at least moves; pairs that follow from others are left out."""

    def check(group: pa.Table) -> pa.Table:
        th, sets = _loaded(group, similarity)
        order = np.unique(group.column("th").to_numpy(), return_index=True)[1]
        own = group.column("root").to_numpy()[order]
        root, moves, a, b = own.copy(), group.column("moves").to_numpy(zero_copy_only=False)[order], [], []
        for v in np.flatnonzero(moves).tolist():
            for x in sets.partners(v, np.flatnonzero(root != root[v])).tolist():
                if root[x] != root[v]:
                    a.append(own[v])
                    b.append(own[x])
                    root[root == root[x]] = root[v]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("grp", "side", "low", "high").applyInArrow(check, "a long, b long")


def _renamed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` with the column root replaced by the smallest root that `links` (a, b) reach."""
    roots = components(links).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(roots, F.col("root") == F.col("__node"), "left").withColumn("root", F.coalesce("__root", "root")).drop("__node", "__root")


def _across(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(th, root) for the groups of several chunks in `found` (th, grp, root, k, chunk, lead).

    First a few leading points of all chunks meet, which joins the parts of one large group; chunk 0 comes to every
    meeting. Then the points outside of a group's largest part meet all of that part's chunks and each other; pairs
    inside the part need no check. What is left apart has no similar pair across.
    """
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / 256).cast("int")))
    leads = found.where("lead").select("grp", "th", "root", "chunk", each.alias("low")).where("chunk = 0 OR chunk DIV 256 = low")
    keys = ["grp", F.lit(0).alias("side"), "low", F.lit(0).alias("high")]
    met = _met(leads.select(*keys, "th", "root", F.lit(True).alias("moves")).join(sets, "th"), similarity)
    now = cut(_renamed(found.select("th", "grp", "k", "chunk", "root"), met))
    most = now.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("n"))
    most = cut(most.select("grp", "main", F.ceil((F.col("m") - F.col("n")) / MOST_TEXTS).cast("int").alias("ko")).where("ko > 0"))
    if most.isEmpty():
        return now.select("th", "root")
    mixed = now.join(most, "grp").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "th"), F.col("ko")).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    main = mixed.where("root = main").select("grp", F.lit(1).alias("side"), F.col("chunk").alias("low"), upto("ko").alias("high"), "th", "root", F.lit(False).alias("moves"))
    rest = mixed.where("root <> main")
    cross = rest.select("grp", F.lit(1).alias("side"), upto("k").alias("low"), F.col("own").alias("high"), "th", "root", F.lit(True).alias("moves"))
    pair = rest.withColumn("other", upto("ko")).select("grp", F.lit(2).alias("side"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "th", "root", F.lit(True).alias("moves"))
    more = _met(main.unionByName(cross).unionByName(pair).join(sets, "th"), similarity)
    return _renamed(now.select("th", "root"), more)


def _within(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on `ids` (column __key), by a broadcast if they are few."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs[id_col] == side["__key"], how)


def _similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.97, capacity: int = CAPACITY, sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, th) of `docs`, (th, least id, root) for each class of equal texts, and ids (__key) of several rows;
    see similar_groups."""
    n = docs.count()
    shape = forest_shape(n, similarity, recall)
    rows = cut(_keyed(docs, id_col, text_col, shingle, seed, shape.words))
    classes = cut(rows.groupBy("th").agg(F.min("id").alias("least"), F.min("fp").alias("fp")))
    links = forest_links(classes.select(F.col("th").alias("node"), "fp"), shaped(shape), shape.total, shape.words, max(capacity, n >> shape.bits) if shape.bits else capacity, sample, leaf=max(1, n >> shape.bits))
    groups = cut(components(links).select(F.col("node").alias("th"), F.col("root").alias("grp")))
    chosen = cut(classes.join(groups, "th").select("th", "least"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    named = _within(texts, "__id", chosen.where("least IS NOT NULL").select(F.col("least").alias("__key")).distinct(), "left_semi")
    if not chosen.where("least IS NULL").isEmpty():  # the texts of classes with null ids only
        named = named.unionByName(texts.where("__id IS NULL"))
    sets = _sets(named, "__text", shingle).join(groups, "th")
    spare = cut(rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__key")))
    if not spare.isEmpty() or not rows.where("id IS NULL").isEmpty():
        sets = sets.dropDuplicates(["th"])
    sets = cut(sets)
    found = cut(_checked(sets, similarity))
    roots = found.where("k = 1").select("th", "root")
    several = found.where("k > 1")
    if not several.isEmpty():
        roots = roots.unionByName(_across(several, sets.select("th", "shingles"), similarity))
    return rows.select("id", "th"), cut(classes.join(roots, "th", "left").select("th", "least", F.coalesce("root", "th").alias("root"))), spare


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, th, component_id) for each row of `docs`, linked where two texts share `similarity` (0.8) of their
    `shingle`-word (5) shingles (Jaccard). th is a 64-bit key of the text; texts equal but for case and white space
    are one class.

    The forest searches wide SimHashes, with as many trees and parts as the `recall` of pairs at the very threshold needs
    from each (forest_shape). Its groups are then checked on the shingle sets: all pairs of a group that fits a task, and in larger
    groups all pairs that could join two parts, whether the forest named them or not. So nothing links without a
    similar pair, and the only loss are pairs whose texts no chain of links brings into one group. Nulls, empty
    texts, repeated rows and an empty table are treated as in near_duplicates; ids may be of any ordered type.
    """
    rows, grouped, _ = _similar_classes(docs, id_col, text_col, **options)
    least = cut(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(grouped.select("th", "root").join(least, "root").select("th", "component_id"))
    return rows.join(named, "th", "left").select(F.col("id").alias(id_col), "th", "component_id")


def _text_hash(text: Column) -> Column:
    """_text_key, as a column."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_text_key(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts], dtype=np.uint64).view(np.int64))

    return F.arrow_udf(run, "long")(text)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each group of similar texts, that of the smallest id, all columns kept.

    Groups are those of texts, whatever the ids: a group without ids keeps a row too, and two groups that
    share their smallest id keep one each. Null ids come last; of rows equal in id and text (but for case and
    white space) the one whose columns hash lowest stays.
    """
    rows, grouped, spare = _similar_classes(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "th")).alias("first")
    kept = cut(grouped.groupBy("root").agg(first).select(F.col("first.least").alias("id"), F.col("first.th").alias("th")))
    gone = cut(rows.where("id IS NOT NULL").join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("__key")).distinct())
    mark, th = free_name(docs, "keep"), free_name(docs, "th")
    packed = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    left = _within(packed.where("__id IS NOT NULL"), "__id", gone, "left_anti")
    nameless = kept.where("id IS NULL")
    if spare.isEmpty() and nameless.isEmpty():
        return left.select("__row.*")
    once = _within(left, "__id", spare, "left_anti")
    many = packed.join(spare, packed["__id"] == spare["__key"], "left_semi")
    if not nameless.isEmpty():
        many = many.unionByName(packed.where("__id IS NULL"))
    many = many.withColumn("__th", _text_hash(F.col("__text")))
    chosen = kept.select(F.col("id").alias(mark), F.col("th").alias(th))
    many = many.join(chosen, many["__id"].eqNullSafe(chosen[mark]) & (many["__th"] == chosen[th]), "left_semi")
    one = many.groupBy("__id", "__th").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return once.select("__row.*").unionByName(one.select("__row.*"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
#: XXH64 of shingles has no DuckDB function; tests/llm compares with a brute-force version.
ORACLE_SQL: dict[str, str] = {}
