"""Balanced label propagation: documents that share a key move towards one shard, shards stay even.

All steps are joins, group-bys and windows. Linked documents (two or more of one key) start in a shard
given by a hash of the row; large groups go first, the others into the room they leave. In each round a key's members, counted for each shard, name the shard that holds most
of them and has room; members elsewhere ask to move there, and are let in by a hash as far as the shard's quota
of rows goes. Documents without links cut no edge wherever they lie, so they fill the shards up to
their exact quota in the end; what exceeds a quota joins them. The law kept is `rows`: the sizes of
any two shards differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table, uniform

SHARDS = 8
#: Propagation ends when nobody wishes to move or no shard lets another row in; rounds at most, as a safeguard, and rounds in a row that may
#: bring no link closer to its shard.
ROUNDS, IDLE = 200, 6
SEED = 5


def _propagate(linked: DataFrame, shards: int, quota: dict[int, int], rounds: int, seed: int, avoid_full: bool) -> DataFrame:
    """`linked` (group, ..., shard) after some rounds of moves; loads stay near or below the quotas.

    With `avoid_full` a full shard neither attracts nor gives up rows, so a group larger than a shard fills
    one after the other. Without, full shards still swap rows; where all wishes lead to full shards, a round sends the
    scattered groups to the shards with room instead.
    """
    least, idle, stuck = None, 0, False
    for step in range(rounds):
        load = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        full = [s for s in range(shards) if load.get(s, 0) >= quota[s]]
        closed, shut = full if avoid_full else [], full if avoid_full or stuck else []
        held = linked.where(~F.col("shard").isin(closed)).groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        # Most members win; a hash of key and shard breaks ties, so that ties spread over the shards.
        rank = F.struct("n", F.xxhash64(F.lit(seed), "group", "shard").alias("tie"))
        told = held.groupBy("group").agg(F.max_by("shard", F.when(~F.col("shard").isin(shut), rank)).alias("to"), F.sum("n").alias("members"), F.max("n").alias("there"))
        wish = cut(told.where("members > there AND to IS NOT NULL").select(F.col("group").alias("g"), "to", (F.col("members") - F.col("there")).alias("away")))
        away = wish.agg(F.sum("away")).first()[0]
        idle = 0 if least is None or away is not None and away < least else idle + 1
        if not away or idle > IDLE:
            break
        least, wish = min(away, least or away), wish.drop("away")
        asked = cut(linked.join(wish, F.col("group") == F.col("g"), "left").drop("g"))
        asked = asked.withColumn("to", F.when(~F.col("shard").isin(closed), F.col("to")))
        flows = {(r["shard"], r["to"]): r["n"] for r in asked.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most shards * (shards + 1) rows
        want = {t: sum(n for (a, b), n in flows.items() if b == t and a != t) for t in range(shards)}
        # A shard admits what its quota leaves now, plus what surely departs: a swap that is met on both sides.
        share = {}
        for s in range(shards):
            for t in range(shards):
                n = flows.get((s, t), 0)
                if s != t and n:
                    free = max(0, quota[t] - load.get(t, 0)) * n / want[t]
                    share[s, t] = min(1.0, (free + min(n, flows.get((t, s), 0))) / n)
        if not any(share.values()):
            if avoid_full or stuck:
                break
            stuck = True
            continue
        stuck = False
        cases = F.lit(0.0)
        for (s, t), p in share.items():
            cases = F.when((F.col("shard") == s) & (F.col("to") == t), F.lit(p)).otherwise(cases)
        move = F.col("to").isNotNull() & (uniform(seed + 100 + step, *[c for c in linked.columns if c != "shard"]) < cases)
        linked = cut(asked.withColumn("shard", F.when(move, F.col("to")).otherwise(F.col("shard"))).drop("to"))
    return linked


def assign_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED, order: tuple[str, ...] = ("doc_id", "size")) -> DataFrame:
    """`rows` (group string, and the columns `order`, which also tell rows apart) with shard int and slot long.

    Rows of equal group are linked; a null group has no links. Every row gets a shard in 0..shards-1
    and a slot; slots of a shard have no gaps. A group too large for one shard is spread over as many as
    its rows need at least. Rows equal in all columns are interchangeable. Empty input, empty result.
    """
    rows = cut(rows)
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}
    many = cut(rows.where("group IS NOT NULL").groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("group").alias("g"), (F.col("n") > max(2, min(quota.values()) // 16)).alias("large")))
    linked = cut(rows.join(many, F.col("group") == F.col("g")).drop("g"))
    single = rows.join(many, F.col("group") == F.col("g"), "left_anti")
    big, left = linked.where("large").drop("large"), dict(quota)
    if not big.isEmpty():  # they go first, while there is room; at most 16 * shards groups
        even = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(shards)).cast("int")
        big = cut(_propagate(cut(big.withColumn("shard", even)), shards, quota, rounds + shards, seed, True))
        left = {s: max(0, quota[s]) for s in range(shards)} | {r["shard"]: max(0, quota[r["shard"]] - r["n"]) for r in big.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        big = big.withColumn("shard", F.lit(0))
    room, at, start = max(1, sum(left.values())), 0, F.lit(0)
    draw = uniform(seed + 1, *order)
    for s in range(shards):  # a hash of the row deals shards by the room that is left
        start = F.when(draw * room >= at, F.lit(s)).otherwise(start) if left[s] else start
        at += left[s]
    small = _propagate(cut(linked.where("NOT large").drop("large").withColumn("shard", start)), shards, left, rounds, seed, False)
    linked = big.unionByName(small)
    placed = cut(numbered(linked, ["shard"], [*order, "group"], "slot"))
    full = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    cap = F.element_at(F.array(*[F.lit(quota[s]) for s in range(shards)]), F.col("shard") + 1)
    stay = placed.where(F.col("slot") < cap)
    rest = placed.where(F.col("slot") >= cap).drop("shard", "slot").unionByName(single)
    used = {s: min(full.get(s, 0), quota[s]) for s in range(shards)}
    pool = numbered(rest, [], [*order, "group"], "place", rows=total - sum(used.values()))
    at, shard, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        end = at + quota[s] - used[s]
        here = (F.col("place") >= at) & (F.col("place") < end)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("place") - at + used[s]).otherwise(slot)
        at = end
    filled = pool.withColumn("shard", shard).withColumn("slot", slot).drop("place")
    return stay.withColumn("slot", F.col("slot").cast("long")).unionByName(filled.select(*stay.columns))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, group): null text has size 1, the CRC of no bytes, and no links."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("group"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of `docs`; links are equal texts.

    The law is `rows`, so grown_shard is null. Repeated rows stay and get slots of their own. Null texts have size
    1 and no links, null ids are ids like others; texts of any length only leave a hash and a size. Other
    columns are ignored whatever their names; an empty table gives an empty result.
    """
    placed = assign_shards(described(docs, id_col, text_col), shards, rounds, seed, ("doc_id", "size", "text_crc32"))
    return placed.select(F.col("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_shard": op10_shard}
#: Shards hang on Spark's xxhash64; tests/llm check the law, the slots and the cut groups.
ORACLE_SQL: dict[str, str] = {}
