"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Normalising keeps runs of ASCII letters and digits and of non-ASCII characters as words and lower-cases A-Z.
Every benchmark word gets a code of two symbols, any other word the same empty code. Each window of `width`
consecutive item words becomes a pattern of codes, so that a match starts and ends at word borders; an item of
fewer words is one window. A text is scanned once; matches come back as spans of the original text.

The benchmark reaches the tasks inside the closure, in blocks of at most `most_windows` windows (a benchmark
below that is one block and one automaton). A window takes 2 * `width` nodes of some 50 bytes at most, so the
default bounds an automaton to about 400 MB; a Python worker builds it once and keeps it. With more blocks every
block scans the documents and the findings are merged, so a task's memory does not follow the benchmark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

WIDTH = 10
MOST_WINDOWS = 400_000
_TO = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO).split() if text else []


def windows_of(words: list[bytes], width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The distinct windows of an item."""
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


class Windows:
    """Codes of the benchmark's words and the automaton of its windows (None without any)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), width):
                owners.setdefault(w, set()).add(item)
        known = dict.fromkeys(x for w in owners for x in w)
        base = math.isqrt(len(known)) + 1  # few children for each node; first and second symbols differ
        self.codes = {x: chr(1 + i // base) + chr(2 + base + i % base) for i, x in enumerate(known)}
        self.automaton = ahocorasick.Automaton() if owners else None
        for w, ids in owners.items():
            self.automaton.add_word("".join([self.codes[x] for x in w]), (len(w), tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, tuple[str, ...]]]]:
        """(index of the last symbol, (words, item ids)) of every window in `words`."""
        if self.automaton is None or not words:
            return iter(())
        get = self.codes.get
        return self.automaton.iter("".join([get(w, "\0\0") for w in words]))


_BUILT: dict[str, Windows] = {}


def _built(key: str, items: list[tuple[str, bytes]], width: int) -> Windows:
    """The windows of a block, built once in a Python worker, which serves many tasks."""
    from pixelweave.llm import decontaminate

    if key not in decontaminate._BUILT:
        decontaminate._BUILT.clear()
        decontaminate._BUILT[key] = decontaminate.Windows(items, width)
    return decontaminate._BUILT[key]


def scan(text: bytes | None, windows: Windows) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """(words, hit words, item ids sorted as strings, byte spans of the original text)."""
    words = words_of(text)
    found = list(windows.matches(words))
    if not found:
        return len(words), 0, [], []
    steps, ids = np.zeros(len(words) + 1, dtype=np.int64), set()
    for last, (n_words, owners) in found:
        end = last // 2 + 1
        steps[end - n_words] += 1
        steps[end] -= 1
        ids.update(owners)
    hit = np.cumsum(steps[:-1]) > 0
    border = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    kept = np.frombuffer(text.translate(_TO), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))  # word i: edge[2i] to edge[2i+1]
    spans = [(int(edge[2 * a]), int(edge[2 * b - 1])) for a, b in zip(border[::2], border[1::2], strict=True)]
    return len(words), int(hit.sum()), sorted(ids), spans


def _pieces(item: str, text: bytes, width: int, most: int) -> Iterator[tuple[str, bytes, int]]:
    """(item, text, windows): the item, cut where it has more windows than `most`; no window is lost."""
    words = words_of(text)
    for i in range(0, max(1, len(words) - width + 1), most):
        part = words[i : i + most + width - 1]
        if part:
            yield item, b" ".join(part), max(1, len(part) - width + 1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, most: int) -> Iterator[tuple[str, list[tuple[str, bytes]]]]:
    """(key, items) of blocks of at most `most` windows; one block at a time is in the driver."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).distinct()
    block: list[tuple[str, bytes]] = []
    held = 0

    def keyed() -> tuple[str, list[tuple[str, bytes]]]:
        return hashlib.sha256(repr((width, block)).encode()).hexdigest(), block

    for row in items.toLocalIterator():
        for item, text, n in _pieces(row.item, bytes(row.text), width, most):
            if block and held + n > most:
                yield keyed()
                block, held = [], 0
            block.append((item, text))
            held += n
    if block:
        yield keyed()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(id_col, n_words long, n_hit long, items array<string>, spans array<struct<start, end>>) for each
    row of `docs`; spans are byte offsets into the original UTF-8 text, end exclusive.

    Null or empty texts have no words and no hits. Items with a null id or text, or without a word, are
    skipped; rows of one item id add up. Repeated document rows stay, each with its own result; an
    empty benchmark hits nothing; other columns are ignored. Whole texts are scanned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def over(block: tuple[str, list[tuple[str, bytes]]], source: DataFrame, out: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _built(*block, width)
            for batch in batches:
                found = [scan(x.as_buffer().to_pybytes() if x.is_valid else None, windows) for x in batch.column(1)]
                spans = pa.array([[{"start": a, "end": b} for a, b in f[3]] for f in found], span_type)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.string())), spans], names=["id", "n_words", "n_hit", "items", "spans"])

        return source.mapInArrow(run, out)

    blocks = _blocks(benchmark, item_col, item_text_col, width, most_windows)
    first, second = next(blocks, ("", [])), next(blocks, None)
    if second is None:
        return over(first, rows, schema).withColumnRenamed("id", id_col)
    return _merged(rows, [first, second], blocks, over, schema, id_col)


def _merged(rows: DataFrame, begun: list, blocks: Iterator, over, schema: str, id_col: str) -> DataFrame:
    """Findings of several blocks. Rows are told apart by a hash of the text beside the id; equal rows
    have equal findings, so they are counted and repeated. Spans add up as a sorted union, and hit
    words are counted anew from the union by the caller's spans."""
    base = rows.withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    parts = None
    for block in [*begun, *blocks]:
        part = over(block, base.select(F.struct("id", "h").alias("id"), "text").dropDuplicates(["id"]), schema.replace(schema.split(",")[0], f"id struct<id: {base.schema['id'].dataType.simpleString()}, h: string>"))
        part = cut(part)
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"))
    fused = F.aggregate(
        "raw", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    merged = merged.withColumn("spans", fused).drop("raw")
    text = base.join(merged, F.struct(base["id"], base["h"]).eqNullSafe(merged["id"]), "inner").select(base["id"].alias("id"), "text", "n_words", "items", "spans")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    piece = lambda s: F.regexp_count(F.translate(F.decode(F.substring(F.encode("text", "UTF-8"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(word))
    hits = F.aggregate(F.transform("spans", piece), F.lit(0), lambda a, b: a + b).cast("long")
    return text.select(F.col("id").alias(id_col), "n_words", hits.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """`docs` without the rows that hold a benchmark window; all columns are kept.

    The rows travel through the scan themselves, so nothing is shuffled. A benchmark of one block is one scan; with more, what
    a block keeps is written before the next block scans it, so no task holds two automata.
    """
    at = docs.columns.index(text_col)

    def without(block: tuple[str, list[tuple[str, bytes]]], source: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _built(*block, width)
            for batch in batches:
                keep = []
                for x in batch.column(at):
                    words = words_of(x.as_buffer().to_pybytes()) if x.is_valid else []
                    keep.append(next(windows.matches(words), None) is None)
                yield batch.filter(pa.array(keep, pa.bool_()))

        return source.mapInArrow(run, source.schema)

    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, width, most_windows)):
        docs = without(block, cut(docs) if k else docs)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
QUERIES = {"op1_decontaminate": op1_decontaminate}
