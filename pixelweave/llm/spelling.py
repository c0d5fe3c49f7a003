"""Spelling variants: words one edit apart, found through a reduced alphabet.

Every letter is hashed to one of a few symbols. The reduced words are then so few, and their alphabet so small,
that the full one-edit neighbourhood of each can be written out: itself, every deletion, every replacement and every
insertion of a symbol. The neighbourhoods are joined with the reduced vocabulary, the words behind both sides are
looked up, and each candidate pair is verified on the original strings. Two words one edit apart have reduced
words at most one edit apart, so no pair is lost; a reduced word meets one of larger key only, as the other finds the
same pair from its own side.

A word points at its most frequent near word if that one is at least `factor` times as frequent. Frequencies grow
along such pointers, so they form no cycle, and their ends are found by doubling them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SYMBOLS = 8
LEAST_LETTERS = 5
LEAST_COUNT = 3
FACTOR = 2
DAMAGED_ONE_IN = 97
_RUN, _BREAK = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Characters of a text that are split into runs at a time, distinct words that a task holds, and keys made at a time.
_STRETCH, _HELD, _KEYS = 1_000_000, 200_000, 2_000_000


def runs_of(text: bytes | None) -> Iterator[Counter]:
    """Counts of the lower-cased letter runs of a text, a stretch at a time; stretches end between runs."""
    whole, at = (text or b"").translate(_LOWER).decode(), 0
    while at < len(whole):
        gap = _BREAK.search(whole, min(at + _STRETCH, len(whole)))
        end = gap.start() if gap else len(whole)
        yield Counter(_RUN.findall(whole, at, end))
        at = end


def damaged(run: str, start: int, one_in: int) -> str:
    """The run, without one code point where the checksum of `<doc_id>:<run>` says so; `start` is that of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), start)
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int | None = DAMAGED_ONE_IN) -> DataFrame:
    """(word, n long): letter runs of all texts with at least `least_letters` code points and `least_count` occurrences.

    One run in `one_in` of each document, chosen by a checksum, loses a code point (None: no run does). Null
    texts have no runs; a null id counts as empty. Repeated rows count as often as they occur. Words are added up
    in each task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for found in runs_of(text.as_buffer().to_pybytes() if text.is_valid else None):
                    for run, n in found.items():
                        if len(run) >= least_letters:
                            word = damaged(run, start, one_in) if one_in else run
                            if len(word) >= least_letters:
                                held[word] += n
                    if len(held) > _HELD:
                        yield told()
        yield told()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with every letter replaced by its symbol, a digit."""
    letters = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
    return F.translate(word, letters, "".join(str(ord(c) % symbols) for c in letters))


_BASE = np.uint64(11)


def keys_of(words: np.ndarray) -> np.ndarray:
    """A number for each row of symbols (words of one length, symbols from 1); exact up to 18 symbols, a hash above."""
    key = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        key = key * _BASE + words[:, i]
    return key


def neighbourhood(words: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of all reduced words within one edit of each row of `words`, the row itself included; a row's keys may repeat.

    With p the key of a word's first i symbols and s that of the symbols from i on, an edit between them has the
    key p * base^k + s, with the new symbol, if any, in between.
    """
    n, length = words.shape
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length + 1, _BASE)]), dtype=np.uint64)
    rows = np.arange(n)
    before = np.zeros(n, np.uint64)
    after = keys_of(words)
    yield rows, after.copy()
    for i in range(length + 1):
        left = length - i
        for c in range(1, symbols + 1):
            yield rows, (before * _BASE + np.uint64(c)) * power[left] + after  # a symbol before the i-th
        if i < length:
            after = after - words[:, i] * power[left - 1]
            yield rows, before * power[left - 1] + after  # without the i-th
            for c in range(1, symbols + 1):
                other = words[:, i] != c
                yield rows[other], ((before * _BASE + np.uint64(c)) * power[left - 1] + after)[other]  # another one in its place
            before = before * _BASE + words[:, i]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, symbols as a matrix) of the reduced words of each length."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, _KEYS // (20 * int(length) + 20))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            flat = np.frombuffer("".join(words[j] for j in part).encode(), np.uint8).reshape(len(part), length)
            yield part, flat.astype(np.uint64) - np.uint64(0x2F)  # the digit 0 is symbol 1


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of `words` (word, n; each word once) that one inserted, deleted
    or replaced code point turns into each other. Words are of a-z and U+00C0 to U+00FF."""
    words = words.select("word", "n", reduced(F.col("word"), symbols).alias("reduced"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for at, matrix in _by_length(batch.column(2).to_pylist()):
                key[at] = keys_of(matrix)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64))], names=["word", "n", "key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in _by_length(batch.column(0).to_pylist()):
                own = keys_of(matrix)
                for rows, keys in _gathered(neighbourhood(matrix, symbols), own):
                    yield pa.RecordBatch.from_arrays([pa.array(own[rows].view(np.int64)), pa.array(keys.view(np.int64))], names=["of", "at"])

    known = cut(words.mapInArrow(keyed, "word string, n long, key long"))
    met = words.select("reduced").distinct().mapInArrow(around, "of long, at long")
    one, two = (known.select(F.col("word").alias(w), F.col("n").alias(n), F.col("key").alias(k)) for w, n, k in (("near", "near_n", "k1"), ("word", "n", "k2")))
    pairs = met.join(one, F.col("at") == F.col("k1")).join(two, F.col("of") == F.col("k2")).where(F.levenshtein("word", "near", 1) == 1)
    back = pairs.withColumn("way", F.explode(F.when(F.col("of") == F.col("at"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    turned = [F.when(F.col("way") == 1, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("word", "near"), ("n", "near_n"), ("near", "word"), ("near_n", "n"))]
    return back.select(*turned).repartition("word").dropDuplicates(["word", "near"])


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys not below the word's own, in larger pieces, each key of a word once in a piece."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for rows, keys in found:
        up = keys >= own[rows]
        held.append((rows[up], keys[up]))
        size += int(up.sum())
        if size >= _KEYS:
            yield _distinct(held)
            held, size = [], 0
    if size:
        yield _distinct(held)


def _distinct(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rows, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[first], keys[first]


def spelling_variants(words: DataFrame, factor: float = FACTOR, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near long, form, form_n, root) for every row of `words` (word, n; each word once).

    form: the near word of largest n, ties by code point, where that n is at least `factor` (above 1) times the
    word's; root: the last word that forms lead to. An empty vocabulary gives an empty result.
    """
    words = cut(words.select("word", "n"))
    best = near_pairs(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"), F.col("n"))).alias("best"))
    enough = -F.col("best.less") >= F.lit(factor) * F.col("best.n")
    best = cut(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = _ends(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    told = words.join(best.join(ends, "word", "left"), "word", "left")
    return told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root) of pointers (word, root) followed to their ends: each round takes every pointer twice as far."""
    forms = cut(forms)
    while True:
        further = forms.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = cut(forms.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")))
        forms = step.select("word", "root")
        if step.where("moved").isEmpty():
            return forms


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


def crc_table() -> list[int]:
    """The 256 remainders of the CRC-32 polynomial, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sql_crc32(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of the UTF-8 bytes of a text of code points below 2048."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, ({crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1])))"


ORACLE_SQL = {
    "op11_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, w, count(*) AS k
  FROM documents, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS t(w) GROUP BY ALL),
summed AS (SELECT w, k, {sql_crc32("d || ':' || w")} AS h FROM runs WHERE length(w) >= 5),
cut AS (SELECT k, CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM summed),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes AS a JOIN holes AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM holes AS a JOIN v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM holes AS a JOIN v ON a.rest = v.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
best AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN ranked ON v.word = ranked.word AND r = 1),
walk AS (SELECT word, word AS root FROM best UNION ALL SELECT walk.word, best.form FROM walk JOIN best ON walk.root = best.word WHERE best.form IS NOT NULL)
SELECT best.*, walk.root FROM best JOIN walk USING (word) JOIN best AS b ON walk.root = b.word WHERE b.form IS NULL""",
}
QUERIES = {"op11_spelling": op11_spelling}
