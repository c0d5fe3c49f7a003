"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs with one word between,
each of value 1, so length alone moves nothing. Training takes a bounded sample of labelled rows, half
of each label, in `shards` tasks; every shard runs FTRL with per-coordinate rates and L1, which leaves
few weights, and the weights of the shards are averaged (one shard learned best on the tables here;
the bound on the rows bounds its task). The weights have at most 2^bits entries and
travel to the scoring tasks inside the closure.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BITS = 20
MOST_ROWS = 12_000
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
#: Features of fewer rows are not learned: they would only memorise those rows.
LEAST_SEEN = 4
MOST_WEIGHT = 2.0
THRESHOLD = 0.7
SEED = 3
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_GOLD, _MIX, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def hashed(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Feature numbers of one UTF-8 text, repeats included; empty for null."""
    words = text.translate(_KEEP).split() if text else []
    ids = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) * _GOLD
    down = np.uint64(64 - bits)
    pairs, skips = ids[:-1] * _MIX + ids[1:], ids[:-2] * _SKIP + (ids[2:] ^ _MIX)
    return np.concatenate([ids >> down, (pairs * _GOLD) >> down, (skips * _GOLD) >> down]).astype(np.int64)


def train(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of FTRL-proximal over rows of distinct feature numbers; the bias is not penalised.
    Where label 1 is the rarer, its rows weigh more, so that both labels weigh the same."""
    seen = np.bincount(np.concatenate(rows), minlength=1 << bits) if rows else np.zeros(1 << bits)
    rows = [x[seen[x] >= LEAST_SEEN] for x in rows]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    heavier = min(MOST_WEIGHT, max(1.0, (len(labels) - sum(labels)) / max(1, sum(labels))))

    def weight(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = rows[k]
            zs, ns = z[at], n[at]
            w, bias = weight(zs, ns), -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]) * (heavier if labels[k] else 1.0)
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * bias
            nb += g * g
    return weight(z, n), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, shards: int = SHARDS, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) learned from at most `most_rows` labelled rows, half of each label.

    Rows are taken by a hash of the id, so reruns learn the same. Null ids and labels are left out; of
    several labels of one id the highest counts. Without labels nothing is learned: bias 0. Other columns are
    ignored whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("known")).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64(F.lit(SEED), "known"), F.col("known")]
    taken = cut(known.where("y = 0").orderBy(*order).limit(most_rows // 2).unionByName(known.where("y = 1").orderBy(*order).limit(most_rows // 2)))
    side = F.broadcast(taken.select("known", "y"))  # at most most_rows ids
    text = docs.join(side, F.col("id") == F.col("known")).select(F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("id").alias("h"), "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashed(x.as_buffer().to_pybytes() if x.is_valid else None, bits)).astype(np.int32) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["shard", "h", "y", "at"])

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        rows = [np.asarray(x.values.to_numpy(), dtype=np.int64) for x in group.column("at")]
        w, bias = train(rows, group.column("y").to_pylist(), bits, epochs)
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w[at], bias), pa.float64())})

    # Rows of a repeated id beyond the first add nothing to the bounded sample.
    rows = text.dropDuplicates(["h"]).mapInArrow(features, "shard int, h long, y int, at array<int>")
    parts = rows.groupBy("shard").applyInArrow(learn, "at long, w double")
    mean = parts.groupBy("at").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("at").toArrow()
    at, w = mean.column("at").to_numpy(), mean.column("w").to_numpy()
    if not len(at):
        return np.empty(0, np.int64), np.empty(0), 0.0
    trained = int(mean.column("n").to_numpy()[0])  # every shard reports a bias, at -1
    return at[1:], w[1:] / trained, float(w[0] / trained)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score double) for every row of `docs`; null and empty texts get the bias alone.

    Repeated rows stay and score alike, texts are read whole, other columns are ignored whatever their names, an
    empty table gives an empty result.
    """
    at, w, bias = model
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << bits)
        weights[at] = w
        live = weights != 0
        for batch in batches:
            out = []
            for x in batch.column(1):
                found = hashed(x.as_buffer().to_pybytes() if x.is_valid else None, bits)
                found = np.unique(found[live[found]])
                out.append(1 / (1 + np.exp(-np.clip(weights[found].sum() + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; -1 for a null id."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)), F.lit(-1)).cast("int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
#: A trained model: tests/llm check held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
