"""Language ID with language-bitmask n-gram filters.

Training counts byte n-grams of normalised texts for each language. A language contains an n-gram if
its rate there is at least `least_rate` of the n-gram's highest rate in any language, and it occurs
twice or more. The filter is a bit-sliced Bloom filter: a slot holds one bit for each language, and the
bitwise AND of an n-gram's slots gives all languages that contain it, in one look-up. A language's
popcount over a text, corrected for the false positives its share of set slots makes likely, decides.

More than 64 languages use several planes of 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, uniform
from .toxicity import fold

SIZES = (3, 4)
PER_LANGUAGE = 3_000
LEAST_RATE = 0.2
PROBES = 3
#: Slots of a filter at most (128 MB a plane), enough for 2^22 n-grams of a language; beyond, false positives grow, and are corrected for.
MOST_SLOTS = 1 << 24
#: Characters of a text whose n-grams are held at once.
STRETCH = 1 << 20
#: n-grams of a language that a task holds before it counts them.
MOST_HELD = 1 << 20
SEED = 8
UNKNOWN = "und"
_SPACES = re.compile(b" +")
_BLANK = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def grams_in(text: str | None, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """n-grams of a text as numbers (bytes below, length above), a stretch of the text at a time; none without a letter.

    The text is lower-cased, all ASCII but letters becomes a space, and words stand between single spaces.
    """
    if not text or not any(map(str.isalpha, text)):
        return
    longest = max(SIZES)
    left = b" "
    for at in range(0, len(text), stretch):
        last = at + stretch >= len(text)
        piece = text[at : at + stretch].lower().encode("utf-8", "replace").translate(_BLANK)
        b = np.frombuffer(_SPACES.sub(b" ", left + piece + (b" " if last else b"")), dtype=np.uint8)
        left = b[max(0, len(b) - longest + 1) :].tobytes()
        found = []
        for n in SIZES:
            starts = max(0, len(b) - (n if last else longest) + 1)
            g = np.full(starts, n << 56, dtype=np.uint64)
            for k in range(n):
                g |= b[k : k + starts].astype(np.uint64) << np.uint64(8 * k)
            found.append(g)
        yield np.concatenate(found)


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text."""
    found = list(grams_in(text))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def slots_of(found: np.ndarray, slots: int, probes: int = PROBES) -> list[np.ndarray]:
    """Filter positions of n-grams, an array for each probe; `slots` is a power of two."""
    down = np.uint64(65 - slots.bit_length())
    return [((found ^ (found >> np.uint64(29))) * np.uint64(m)) >> down for m in _MULTIPLIERS[:probes]]


class Filter:
    """Planes of uint64 slots, the languages in order, and each language's chance of a false positive."""

    def __init__(self, languages: list[str], planes: np.ndarray, probes: int = PROBES):
        self.languages, self.planes, self.probes = languages, planes, probes
        fill = [float(((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false = np.array(fill) ** probes if languages else np.empty(0)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """n-grams that the filter reports for each language."""
        total, at = np.zeros(len(self.languages), dtype=np.int64), slots_of(found, self.planes.shape[1], self.probes)
        for p, plane in enumerate(self.planes):
            masks = plane[at[0]]
            for positions in at[1:]:
                masks = masks & plane[positions]
            here = len(self.languages[64 * p : 64 * p + 64])
            if here <= 8:
                seen = np.bincount(masks.astype(np.int64), minlength=1 << here)
                for i in range(here):
                    total[64 * p + i] = seen[(np.arange(len(seen)) >> i) & 1 == 1].sum()
            else:
                for i in range(here):
                    total[64 * p + i] = int(((masks >> np.uint64(i)) & np.uint64(1)).sum())
        return total

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected counts that it has); ties go to the first language."""
        n, total = 0, np.zeros(len(self.languages), dtype=np.int64)
        for found in grams_in(text):
            n += len(found)
            total += self.counts(found)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        fixed = np.maximum((total - self.false * n) / np.maximum(1 - self.false, 1e-9), 0.0)
        best = int(np.argmax(fixed))
        return self.languages[best], float(fixed[best] / fixed.sum()) if fixed.sum() > 0 else 0.0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = PER_LANGUAGE, least_rate: float = LEAST_RATE, probes: int = PROBES, most_slots: int = MOST_SLOTS) -> Filter:
    """A filter of all languages in `docs`, learned from about `per_language` rows of each (a hash of
    `key_col` picks them). Rows of null language or text are left out; without any, the filter is empty.

    Texts are counted whole, a stretch at a time. A filter has four to eight slots for each n-gram of the largest language, which
    keeps its false positives between 3 and 15 %; they are corrected for. Beyond `most_slots` / 4 n-grams the share grows as
    (1 - exp(-probes * n-grams / slots)) ^ probes.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Filter([], np.zeros((1, 2), np.uint64), probes)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    sample = rows.where(uniform(SEED, "key") < share[F.col("lang")]).select(number[F.col("lang")].alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(lang: int, found: list[np.ndarray]) -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lang, np.int32)), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                key = lang.as_py()
                for found in grams_in(text.as_py()):
                    held.setdefault(key, []).append(found)
                    size[key] = size.get(key, 0) + len(found)
                    if size[key] > MOST_HELD:  # memory follows neither the batch nor the task, nor a text
                        yield told(key, held.pop(key))
                        size[key] = 0
        for key, found in held.items():
            yield told(key, found)

    seen = cut(sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    if not totals:
        return Filter([], np.zeros((1, 2), np.uint64), probes)
    total = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n)])
    rate = seen.withColumn("rate", F.col("n") / total[F.col("lang")])
    held = cut(rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("n") >= 2) & (F.col("rate") >= least_rate * F.col("top"))).select("lang", "gram"))
    most = held.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << min(most_slots.bit_length() - 1, max(10, (4 * most).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, found = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            at = np.concatenate(slots_of(found, slots, probes)).astype(np.int64)
            bit = np.tile(np.uint64(1) << (lang % 64).astype(np.uint64), probes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(lang // 64, probes).astype(np.int32)), pa.array(at), pa.array(bit)], names=["plane", "slot", "bit"])

    table_ = held.mapInArrow(place, "plane int, slot long, bit long").groupBy("plane", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most planes * most_slots rows
    planes = np.zeros((-(-len(languages) // 64), slots), dtype=np.uint64)
    planes[table_.column("plane").to_numpy(), table_.column("slot").to_numpy()] = table_.column("bits").to_numpy().view(np.uint64)
    return Filter(languages, planes, probes)


def predict(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; `und` and 0 where the text is null or has no letter (Unicode L*; digits,
    fractions and Roman numerals are none).

    Repeated rows stay, texts are read whole, other columns are ignored whatever their names, an empty table gives
    an empty result. With an empty model every row is `und`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    languages, planes, probes = model.languages, model.planes, model.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Filter(languages, planes, probes).decide
        for batch in batches:
            found = [decide(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language": op8_language}
#: A trained model: tests/llm check held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
