"""Line-first quality rules, in DataFrame operations only.

A line fails if it has words and (rules in this order, each a pattern on the trimmed line):

* punctuation: no sentence ends in it, or a third of its words end in `!!` or in symbols;
* navigation: it has two bars or arrows between words, or is a chain of menu words;
* boilerplate: it holds a stock phrase (licence, cookie, sign-in notices and the like) for every 30 words.

The patterns run in time linear in the line: nothing before a mark is matched, and runs are matched
possessively from their first character on.

Failing lines are removed; a document that loses more than `most_lost` of its word characters is
rejected, as is one with too few words or mostly repeated three-word windows (the base rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, WORD, free_name, let, packed, table

MIN_WORDS = 50
MOST_REPEATED = 0.5
MOST_LOST = 0.3
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(?:[ \t\r]|$)"
#: Ends of words that end in two exclamation marks or in a run of symbols.
NOISY_END = r"(?<![.,!])(?:[.,]|!(?!!))*+!![.,!]*+(?:[ \t]|$)|(?<![#*$%&|<>])[#*$%&|<>]{2,}+[.,!]*+(?:[ \t]|$)"
#: A bar or arrow behind a word and before a blank.
BAR = r"[^ \t|»>→][ \t]*+[|»>→][ \t]"
MENU = r"(?i)^(?:home|about|contact|login|search|menu|next|previous|back|share|sitemap)(?:[ \t]++(?:home|about|contact|us|login|search|menu|next|previous|back|share|sitemap))*+[.!?]?$"
BOILERPLATE = r"(?i)all rights reserved|licensed under|released under the|general public license|terms of (?:use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|sign (?:in|up)|subscribe|copyright|powered by"
PHRASE_WORDS = 30
HAS_WORD = r"[^\x20\x09-\x0D]"


def line_fails(line: Column) -> Column:
    """Whether one line breaks a rule; a line without words never does."""
    words = F.regexp_count(line, F.lit(WORD))
    noisy = line.rlike(r"!!|[#*$%&|<>]{2}") & (3 * F.regexp_count(line, F.lit(NOISY_END)) >= words)
    navigation = (F.regexp_count(line, F.lit(BAR)) >= 2) | line.rlike(MENU)
    stock = line.rlike(BOILERPLATE) & (PHRASE_WORDS * F.regexp_count(line, F.lit(BOILERPLATE)) >= words)
    bad = ~line.rlike(SENTENCE_END) | noisy | navigation | stock
    return line.rlike(HAS_WORD) & bad


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more among `words`, the first included.

    Each window is packed into one long: its position in as many low bits as the text's length takes, hash bits
    above; one sort brings equal windows together. Neighbours with equal hash bits are compared word by
    word, and where these differ, with all windows of the same bits.
    """
    n = F.size(words)

    def packed(ws: Column, b: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)), b).bitwiseOR(i.cast("long")))

    def place(x: Column, b: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")

    def alike(x: Column, y: Column, b: Column) -> Column:
        return F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b)

    def same(ws: Column, x: Column, y: Column, b: Column) -> Column:
        p, q = place(x, b), place(y, b)
        return alike(x, y, b) & (F.get(ws, p - 1) == F.get(ws, q - 1)) & (F.get(ws, p) == F.get(ws, q)) & (F.get(ws, p + 1) == F.get(ws, q + 1))

    def repeats(ws: Column, found: Column, b: Column) -> Column:
        m = F.size(found)

        def again(i: Column) -> Column:
            x, left, right = F.get(found, i), F.get(found, i - 1), F.get(found, i + 1)
            near = ((i > 0) & same(ws, x, left, b)) | ((i < m - 1) & same(ws, x, right, b))
            clash = ((i > 0) & alike(x, left, b)) | ((i < m - 1) & alike(x, right, b))
            return near | (clash & F.exists(found, lambda y: (x != y) & same(ws, x, y, b)))

        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), m - 1), again), lambda i: place(F.get(found, i), b)))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1), p + 3) - p, F.lit(3))), F.lit(0), lambda a, b: a + b)

    bits = F.length(F.bin(n))
    count = let(words, lambda ws: let(bits, lambda b: let(F.sort_array(packed(ws, b)), lambda found: let(repeats(ws, found, b), covered))))
    return F.when(n >= 4, count).otherwise(0).cast("long")


def measures(docs: DataFrame, text_col: str = "text", most_lost: float = MOST_LOST, min_words: int = MIN_WORDS, most_repeated: float = MOST_REPEATED, result_col: str = "__q") -> DataFrame:
    """`docs` with a struct column `result_col`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    n_bad_lines (long), lost_chars (long), clean_text, base_failed and kept.

    Null text counts as empty: no words, base_failed, not kept, clean_text null. Lines are split at \\n; a line
    without words is neither a failure nor a duplicate. Repeated rows get equal results. Words and texts may
    have any length. An empty table stays empty. As with `withColumn`, a column named `result_col` is replaced; all
    others stay, whatever their names. Where `result_col` is the text's own name, the struct takes the text's place.
    """
    named = docs.withColumn(result_col, F.lit(0))
    w, p_ = free_name(named, "words"), free_name(named, "parts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.split(text, "\n")
    parts = F.transform(lines, lambda s: F.struct(s.alias("line"), line_fails(s).alias("bad")))
    out = docs.withColumn(w, words).withColumn(p_, parts)
    full = F.filter(p_, lambda p: p["line"].rlike(HAS_WORD))
    dup = F.size(full) - F.size(F.array_distinct(F.transform(full, lambda p: p["line"])))
    n_words, chars = F.size(w).cast("long"), F.length(F.regexp_replace(text, BLANK, "")).cast("long")
    lost = F.aggregate(F.filter(p_, lambda p: p["bad"]), F.lit(0), lambda a, p: a + F.length(F.regexp_replace(p["line"], BLANK, ""))).cast("long")
    clean = F.when(F.col(text_col).isNotNull(), F.array_join(F.transform(F.filter(p_, lambda p: ~p["bad"]), lambda p: p["line"]), "\n"))
    out = out.withColumn(result_col, F.struct(
        n_words.alias("n_words"), chars.alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"), repeated_words(F.col(w)).alias("n_repeat_words"),
        F.size(F.filter(p_, lambda p: p["bad"])).cast("long").alias("n_bad_lines"), lost.alias("lost_chars"), clean.alias("clean_text"),
    ))
    q = F.col(result_col)
    failed = (q["n_words"] < min_words) | (q["n_repeat_words"] > most_repeated * q["n_words"])
    return out.withColumn(result_col, q.withField("base_failed", failed).withField("kept", ~failed & (q["lost_chars"] <= most_lost * q["word_chars"]))).drop(w, p_)


def clean_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` without rejected rows, the text without its failing lines; `length_col`, if there, follows it."""
    rows = docs.select(packed(docs).alias("row"), F.col(text_col).alias("text"))
    # A filter would be pushed below the measures and compute them a second time; a generator is not.
    found = measures(rows, "text", **options).select("row", F.explode(F.filter(F.array("__q"), lambda q: q["kept"])).alias("__q"))
    clean, columns = F.col("__q.clean_text"), []
    for c in docs.columns:
        if c == text_col:
            columns.append(clean.alias(c))
        elif c == length_col:
            columns.append(F.length(clean).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return found.select(*columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words", "__q.base_failed", "__q.kept", "__q.n_bad_lines", "__q.lost_chars")


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


# The patterns as RE2 takes them: it has neither possessive runs nor look-around, and is linear anyway.
_SQL_NOISY = r"(?:!!|[#*$%&|<>]{2,})[.,!]*(?:[ \t]|$)"
_LINE_BAD = f"""(regexp_matches(l, '{HAS_WORD}') AND (NOT regexp_matches(l, '{_sql_text(SENTENCE_END)}')
  OR (regexp_matches(l, '!!|[#*$%&|<>]{{2}}') AND 3 * len(regexp_extract_all(l, '{_SQL_NOISY}')) >= len(regexp_extract_all(l, '{WORD}')))
  OR len(regexp_extract_all(l, '{BAR.replace("*+", "*")}')) >= 2 OR regexp_matches(l, '{MENU.replace("*+", "*").replace("++", "+")}')
  OR (regexp_matches(l, '{BOILERPLATE}') AND {PHRASE_WORDS} * len(regexp_extract_all(l, '{BOILERPLATE}')) >= len(regexp_extract_all(l, '{WORD}')))))"""
#: CTEs that end in `quality`; shared with the pipeline's SQL.
QUALITY_CTES = f"""
base AS (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w,
  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lined AS (SELECT *, list_filter(ls, lambda l: {_LINE_BAD}) AS bad_lines, list_filter(ls, lambda l: NOT {_LINE_BAD}) AS good_lines, list_filter(ls, lambda l: regexp_matches(l, '{HAS_WORD}')) AS full_lines FROM base),
win AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM base, unnest(range(1, len(w) - 1)) AS t(i)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win), (SELECT unnest(range(0, 3)) AS k) WHERE c > 1 GROUP BY doc_id),
counted AS (SELECT lined.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(bad_lines) AS BIGINT) AS n_bad_lines,
  CAST(coalesce(list_sum(list_transform(bad_lines, lambda l: length(regexp_replace(l, '{BLANK}', '', 'g')))), 0) AS BIGINT) AS lost_chars
  FROM lined LEFT JOIN rep USING (doc_id)),
quality AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)"""
ORACLE_SQL = {
    "op5_quality_rules": f"""WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {MOST_LOST} * word_chars AS kept, n_bad_lines, lost_chars FROM quality""",
}
QUERIES = {"op5_quality_rules": op5_quality_rules}
