"""Format-preserving Feistel pseudonyms for personal numbers and dates, in DataFrame operations only.

Candidates are found by one pattern and validated: card numbers by the Luhn digit, IPv4 addresses by
their octets, dates by the calendar, social security numbers by the ranges that are given out, telephone numbers by
their layout. A valid value is permuted by a keyed, balanced Feistel network inside its own format, so equal
values get equal pseudonyms in all documents, different values different ones, and the key's holder can go back.

* Card (13 to 19 digits; also in groups of 4-4-4-4 or 4-6-5 between single spaces or hyphens): the digits before
  the check digit are permuted, the check digit is computed anew, the separators stay.
* Telephone: `+C (AAA) NNN-NNNN`, `(AAA) NNN-NNNN`, `AAA-NNN-NNNN`, `AAA.NNN.NNNN` with or without country code, and
  `+CC` followed by one to five groups of digits. The country code and the separators stay, the other digits are
  permuted, so one number in two layouts stays one.
* Social security number: all its digits, among the numbers that can be valid.
* IPv4: the 32 bits. Date (YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY): the day in 1700-01-01 to 2099-12-31
  (146,097 days = 189 * 773). Month-first, one-digit and written dates stay.
* E-mail: digits and ASCII letters of the address before the last domain label, each by kind, as runs of
  at most 12 permuted in place (case is kept apart).

What fails validation stays as it is, like any other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, table

#: The query's key comes from this setting of the session.
KEY_SETTING = "spark.pixelweave.pseudonyms.key"
ROUNDS = 8
CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,5}(?![0-9A-Za-z])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])|(?<![0-9A-Za-z./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z/])"
EMAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){1,8}"
_ALL = "|".join([EMAIL, CARD, PHONE, IP, DATE.replace(r"([./])[0-9]{2}\1", r"[./][0-9]{2}[./]"), SSN])
EPOCH, DAYS = "1700-01-01", (189, 773)


def permute(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """struct<a, b>: the pair (a in 0..size_a-1, b in 0..size_b-1) after the Feistel rounds, or before them."""

    def f(i: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 14), 16, 10).cast("long"), size)

    def step(acc: Column, i: Column) -> Column:
        sign = -1 if back else 1
        new_a = F.when(i % 2 == 0, F.pmod(acc["a"] + sign * f(i, acc["b"], size_a), size_a)).otherwise(acc["a"])
        new_b = F.when(i % 2 == 1, F.pmod(acc["b"] + sign * f(i, acc["a"], size_b), size_b)).otherwise(acc["b"])
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(base: int, n: Column) -> Column:
    """base ** n as a long, from a table."""
    most = 18 if base == 10 else 12
    return F.element_at(F.array(*[F.lit(base**k) for k in range(most // 2 + 2)]), n + 1)


def permute_digits(digits: Column, tweak: str, key: str, back: bool = False) -> Column:
    """A string of 1 to 18 decimal digits, permuted among those of its length."""

    def run(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        left, right = F.coalesce(F.substring(d, F.lit(1), u).try_cast("long"), F.lit(0)), F.substring(d, u + 1, n - u).cast("long")
        out = permute(left, right, _power(10, u), _power(10, n - u), F.concat(F.lit(tweak), n.cast("string")), key, back)
        return let(out, lambda o: F.concat(F.when(u > 0, F.lpad(o["a"].cast("string"), u, F.lit("0"))).otherwise(""), F.lpad(o["b"].cast("string"), n - u, F.lit("0"))))

    return let(digits, run)


def permute_letters(letters: Column, tweak: str, key: str, back: bool = False) -> Column:
    """A string of 1 to 12 lower-case ASCII letters, permuted among those of its length."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"

    def number(s: Column) -> Column:
        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 97)

    def spell(v: Column, n: Column) -> Column:
        at = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.array_join(F.transform(at, lambda k: F.substring(F.lit(alphabet), (F.pmod((v / _power(26, k)).cast("decimal(20,6)").cast("long"), F.lit(26)) + 1).cast("int"), F.lit(1))), "")

    def run(s: Column) -> Column:
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        out = permute(number(F.substring(s, F.lit(1), u)), number(F.substring(s, u + 1, n - u)), _power(26, u), _power(26, n - u), F.concat(F.lit(tweak), n.cast("string")), key, back)
        return let(out, lambda o: F.concat(spell(o["a"], u), spell(o["b"], n - u)))

    return let(letters, run)


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes `payload` followed by it pass the Luhn test."""
    digits = F.reverse(F.filter(F.split(payload, ""), lambda c: c != ""))
    doubled = F.transform(digits, lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(s: Column, digits: Column) -> Column:
    """`s` with its digits replaced by `digits`, in order; all else stays."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substring(digits, acc["n"] + 1, F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(F.split(s, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda acc: acc["out"])


def is_card(s: Column) -> Column:
    same = ~(s.contains(" ") & s.contains("-"))
    return same & let(_digits(s), lambda d: (F.length(d) >= 13) & (luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))))


def _card(s: Column, key: str, back: bool) -> Column:
    payload = let(_digits(s), lambda d: permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, back))
    return let(payload, lambda p: _refilled(s, F.concat(p, luhn_digit(p))))


def _ip(s: Column, key: str, back: bool) -> Column:
    part = lambda k: F.get(F.split(s, r"\."), F.lit(k)).cast("long")
    out = permute(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65_536), F.lit(65_536), F.lit("ip"), key, back)
    low, high = lambda x: F.pmod(x, F.lit(256)).cast("string"), lambda x: F.shiftright(x, 8).cast("string")
    return let(out, lambda o: F.concat_ws(".", high(o["a"]), low(o["a"]), high(o["b"]), low(o["b"])))


def _day(s: Column) -> Column:
    iso = F.when(F.substring(s, 5, 1) == "-", s).otherwise(F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))
    return F.date_diff(iso.try_cast("date"), F.lit(EPOCH).cast("date"))


def _is_day(s: Column) -> Column:
    return F.coalesce(_day(s).between(0, DAYS[0] * DAYS[1] - 1), F.lit(False)) & ((F.substring(s, 5, 1) == "-") | (F.substring(s, 3, 1) == F.substring(s, 6, 1)))


def _date(s: Column, key: str, back: bool) -> Column:
    n = let(_day(s), lambda d: permute(F.floor(d / DAYS[1]), F.pmod(d, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key, back))
    day = let(n, lambda o: F.date_add(F.lit(EPOCH).cast("date"), (o["a"] * DAYS[1] + o["b"]).cast("int")).cast("string"))
    sep = F.substring(s, 3, 1)
    return let(day, lambda d: F.when(F.substring(s, 5, 1) == "-", d).otherwise(F.concat(F.substring(d, 9, 2), sep, F.substring(d, 6, 2), sep, F.substring(d, 1, 4))))


def _phone(s: Column, key: str, back: bool) -> Column:
    head = F.regexp_extract(s, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def run(code: Column) -> Column:
        tail = F.substring(s, F.length(code) + 1, F.length(s))
        return F.concat(code, _refilled(tail, permute_digits(_digits(tail), "phone", key, back)))

    return let(head, run)


def _is_ssn(s: Column) -> Column:
    area = F.substring(s, 1, 3)
    return (area != "000") & (area != "666") & (area < "900") & (F.substring(s, 5, 2) != "00") & (F.substring(s, 8, 4) != "0000")


def _ssn(s: Column, key: str, back: bool) -> Column:
    """Numbers of 898 areas, 99 groups and 9,999 serials, as a pair below 898 * 99 and below 9,999."""
    area = F.substring(s, 1, 3).cast("long")
    first = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(s, 5, 2).cast("long") - 1
    out = permute(first, F.substring(s, 8, 4).cast("long") - 1, F.lit(898 * 99), F.lit(9_999), F.lit("ssn"), key, back)

    def told(o: Column) -> Column:
        place = F.floor(o["a"] / 99)
        return F.concat_ws("-", F.lpad((place + F.when(place >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((o["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((o["b"] + 1).cast("string"), 4, "0"))

    return let(out, told)


def _email(s: Column, key: str, back: bool) -> Column:
    head, tail = F.regexp_extract(s, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(s, r"^(.*)(\.[^.]*)$", 2)
    runs = F.regexp_extract_all(head, F.lit(r"[0-9]{1,12}|[a-z]{1,12}|[A-Z]{1,12}|[^0-9a-zA-Z]+"), F.lit(0))
    one = lambda r, i: F.when(r.rlike("^[0-9]"), permute_digits(r, "mail", key, back)).when(r.rlike("^[a-z]"), permute_letters(r, "mail", key, back)).when(r.rlike("^[A-Z]"), F.upper(permute_letters(F.lower(r), "mail", key, back))).otherwise(r)
    return F.concat(F.array_join(F.transform(runs, one), ""), tail)


def kind_of(s: Column) -> Column:
    """Kind of a validated candidate, null for one that fails."""
    octets = F.forall(F.split(s, r"\."), lambda o: o.try_cast("int") <= 255)
    return (
        F.when(s.contains("@"), F.lit("email"))
        .when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets & ~s.rlike(r"(^|\.)0[0-9]"), F.lit("ip")))
        .when(s.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(_is_ssn(s), F.lit("ssn")))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), F.when(_is_day(s), F.lit("date")))
        .when(s.rlike(r"^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]|^[0-9]{4}[ -][0-9]{6}"), F.when(is_card(s), F.lit("card")))
        .otherwise(F.when(F.length(_digits(s)).between(8, 18), F.lit("phone")))
    )


def replaced(s: Column, kind: Column, key: str, back: bool = False) -> Column:
    return (
        F.when(kind == "email", _email(s, key, back)).when(kind == "phone", _phone(s, key, back)).when(kind == "ip", _ip(s, key, back))
        .when(kind == "ssn", _ssn(s, key, back)).when(kind == "card", _card(s, key, back)).when(kind == "date", _date(s, key, back)).otherwise(s)
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str, back: bool = False, kinds_col: str = "__kinds") -> DataFrame:
    """`docs` with personal values of `text_col` permuted (with `back`: restored) and `kinds_col` array<string>,
    the kinds of what was replaced, in order.

    The key is secret: who has it can go back. Null text stays null with no kinds; texts without a digit or @ are not
    searched further. Repeated rows and all columns stay, but for one named `kinds_col`, which is replaced as by
    `withColumn`; an empty table stays empty; whole texts are searched.
    """
    named = docs.withColumn(kinds_col, F.lit(0))
    text, hit, told = F.col(text_col), free_name(named, "hits"), free_name(named, "told")
    empty = F.expr("cast(array() as array<string>)")
    hits = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(empty)
    out = docs.withColumn(hit, F.coalesce(hits, empty))
    out = out.withColumn(told, F.transform(hit, lambda s: let(kind_of(s), lambda k: F.struct(k.alias("kind"), replaced(s, k, key, back).alias("new")))))
    gaps = F.split(text, _ALL, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(told, lambda t: t["new"]), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    kinds = F.transform(F.filter(told, lambda t: t["kind"].isNotNull()), lambda t: t["kind"])
    return out.withColumn(text_col, F.when(F.size(hit) > 0, joined).otherwise(text)).withColumn(kinds_col, kinds).drop(hit, told)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, "only for trials: set a key of your own")
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
    count = lambda *names: F.size(F.filter("__kinds", lambda k: k.isin(*names))).cast("long")
    return out.select("doc_id", "text", count("card", "phone", "ssn", "ip").alias("n_numbers"), count("date").alias("n_dates"), count("email").alias("n_emails"))


QUERIES = {"op7_pseudonyms": op7_pseudonyms}
#: Keyed permutations: tests/llm check the exact round trip, the formats and the links.
ORACLE_SQL: dict[str, str] = {}
