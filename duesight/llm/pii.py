"""Pseudonyms for personal data that keep the format, in built-in functions only.

Numbers and dates are found by pattern, validated (checksums, ranges, calendar)
and moved by a keyed Feistel permutation to another value of the same format: a
card number to another with a right check digit, a date to another date, an
address to another address. The punctuation stays. A permutation never joins
two values, and equal values get equal pseudonyms in all documents. The local
part and domain of an e-mail address, which are no numbers, become a keyed
digest. A match that fails its validation stays as it is.

Kinds: email; iban (check digits mod 97); ip (four numbers up to 255); date
(year-month-day or day/month/year from 1900 on, 73,000 days); ssn (3-2-4 digits,
no area 000, 666 or 9xx, no group 00, no serial 0000); card (13 to 19 digits,
Luhn); phone (8 to 15 digits, with a country code or an area code in brackets or
3-3-4 digits). Of matches that overlap the first counts, then the order above.

Null text stays null. Empty, repeated and very long texts need no special care,
as no row depends on another; columns other than the text are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Only for tests and checks; pass your own.
KEY = "example key, not secret"
ROUNDS = 10

_FREE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{0,12}[0-9]{8,26}" + _END,
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})"
            r"(?![A-Za-z0-9]|[./-][0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "card": _FREE + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})" + _END,
    "phone": r"(?<![A-Za-z0-9+(])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
             r"|[0-9]{3}-[0-9]{3}-[0-9]{4}|\+[0-9]{8,15}|\+[0-9]{1,3}([ .-])[0-9]{1,4}(?:\5[0-9]{2,4}){2,4})" + _END,
}
ANY = "|".join(PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", (365, 200)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def power_of_ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted(left: Column, right: Column, size_left, size_right, tweak: str, key: str) -> Column:
    """(left, right) of a product of two ranges moved by a Feistel network with additions modulo their sizes."""
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    start = F.struct(as_long(left).alias("a"), as_long(right).alias("b"),
                     as_long(size_left).alias("m"), as_long(size_right).alias("n"))

    def turn(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i, s["m"], s["n"], s["b"]).cast("binary"), 256)
        number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(number, s["m"]), s["m"]).alias("b"),
                        s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def moved_digits(d: Column, tweak: str, key: str) -> Column:
    """A string of digits as another of its length. Of more than 18, the last 18 move."""
    head, tail = F.left(d, F.greatest(F.length(d) - 18, F.lit(0))), F.right(d, F.lit(18))
    n = F.length(tail)
    u = F.floor(n / 2).cast("int")
    moved = permuted(F.coalesce(F.left(tail, u).try_cast("long"), F.lit(0)), F.right(tail, n - u),
                     power_of_ten(u), power_of_ten(n - u), tweak, key)
    text = F.transform(F.array(moved), lambda s: F.concat(
        F.when(u > 0, F.lpad(s["a"].cast("string"), u, "0")).otherwise(""), F.lpad(s["b"].cast("string"), n - u, "0")))
    return F.concat(head, F.get(text, F.lit(0)))


def with_digits(m: Column, d: Column) -> Column:
    """`m` with its digits replaced by those of `d` in turn."""
    start = F.struct(F.lit("").alias("s"), d.alias("d"))
    return F.aggregate(F.split(m, ""), start, lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.left(a["d"], F.lit(1))).alias("s"),
                                     F.substr(a["d"], F.lit(2)).alias("d"))
    ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["d"].alias("d"))), lambda a: a["s"])


def luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits, the last one being the check digit."""
    def add(s: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def mod97(s: Column) -> Column:
    """Digits and letters (A = 10) as one number, modulo 97."""
    def add(a: Column, c: Column) -> Column:
        return F.pmod(a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.conv(c, 36, 10).cast("int"), F.lit(97))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), add)


def bound(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("p"), F.left(digest, F.lit(16)), F.lit("@mail.invalid"))


def iban(m: Column, key: str) -> Column:
    tail = F.regexp_extract(m, "[0-9]{1,18}$", 0)
    moved = lambda t: F.concat(
        F.substr(m, F.lit(5), F.length(m) - 4 - F.length(t)), moved_digits(t, "iban", key))
    rest = bound(F.when(F.length(tail) > F.length(m) - 4, F.substr(m, F.lit(5))).otherwise(tail), moved)
    checked = bound(rest, lambda r: F.concat(F.left(m, F.lit(2)), F.lpad(
        (F.lit(98) - mod97(F.concat(r, F.left(m, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), r))
    return F.when(mod97(F.concat(F.substr(m, F.lit(5)), F.left(m, F.lit(4)))) == 1, checked)


def ip(m: Column, key: str) -> Column:
    part = lambda k: F.get(F.split(m, r"\."), F.lit(k)).cast("int")
    right = reduce(lambda a, b: a & b, [part(k) <= 255 for k in range(4)])
    moved = permuted(part(0) * 256 + part(1), part(2) * 256 + part(3), 1 << 16, 1 << 16, "ip", key)
    return F.when(right, bound(moved, lambda s: F.concat_ws(
        ".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)])))


def date(m: Column, key: str) -> Column:
    """Day before month if both are possible."""
    piece = lambda k: F.get(F.split(m, "[-/.]"), F.lit(k))
    year_first = F.length(piece(0)) == 4
    swapped = ~year_first & (piece(1).cast("int") > 12)
    year = F.when(year_first, piece(0)).otherwise(piece(2))
    month = F.when(swapped, piece(0)).otherwise(piece(1))
    day = F.when(year_first, piece(2)).when(swapped, piece(1)).otherwise(piece(0))
    number = F.datediff(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"),
                        F.lit(FIRST_DAY).cast("date"))
    inside = number.isNotNull() & (number >= 0) & (number < DAYS[0] * DAYS[1])
    moved = permuted(number % DAYS[0], F.floor(number / DAYS[0]), *DAYS, "date", key)
    new = bound(moved, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["b"] * DAYS[0] + s["a"]).cast("int")))
    sign = F.regexp_extract(m, "[-/.]", 0)
    y, mo, d = (lambda t, f=f: F.date_format(t, f) for f in ("yyyy", "MM", "dd"))
    return F.when(inside, bound(new, lambda t: F.when(year_first, F.concat(y(t), sign, mo(t), sign, d(t)))
                                .when(swapped, F.concat(mo(t), sign, d(t), sign, y(t)))
                                .otherwise(F.concat(d(t), sign, mo(t), sign, y(t)))))


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).cast("int") for k in range(3))
    right = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permuted(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
    return F.when(right, bound(moved, lambda s: F.concat_ws(
        "-", F.lpad((s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))))


def card(m: Column, key: str) -> Column:
    """The first digit, which names the kind of card, stays."""
    def new(d: Column) -> Column:
        middle = moved_digits(F.substr(d, F.lit(2), F.length(d) - 2), "card", key)
        return bound(F.concat(F.left(d, F.lit(1)), middle, F.lit("0")), lambda x: F.concat(
            F.left(x, F.length(x) - 1), F.pmod(-luhn(x), F.lit(10)).cast("string")))

    return bound(digits_of(m), lambda d: F.when(F.pmod(luhn(d), F.lit(10)) == 0, with_digits(m, new(d))))


def phone(m: Column, key: str) -> Column:
    """The last ten digits move, of shorter numbers all after the country code's first."""
    def new(d: Column) -> Column:
        stay = F.when(F.length(d) > 10, F.length(d) - 10).otherwise(F.when(m.startswith("+"), 1).otherwise(0))
        return F.concat(F.left(d, stay), moved_digits(F.substr(d, stay + 1), "phone", key))

    return bound(digits_of(m), lambda d: F.when(F.length(d).between(8, 15), with_digits(m, new(d))))


KINDS = {"email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


def pseudonyms(docs: DataFrame, key: str = KEY, column: str = "text", counts: bool = False) -> DataFrame:
    """`docs` with pseudonyms in its text; with the number of each kind as n_<kind> if asked."""
    names = {}
    for name in ("matches", "gaps", "found"):
        names[name] = f"_{name}"
        while names[name] in docs.columns:
            names[name] += "_"
    matches, gaps, found = names.values()
    text = F.col(column)
    some = text.rlike("[0-9@]")
    whole = {k: "^(?:" + p.replace(r"\3", r"\1").replace(r"\4", r"\2").replace(r"\5", r"\1") + ")$"
             for k, p in PATTERNS.items()}

    def replaced(m: Column) -> Column:
        kind = F.coalesce(*[F.when(m.rlike(p), F.lit(k)) for k, p in whole.items()])
        value = lambda k: reduce(
            lambda rest, x: F.when(k == x, KINDS[x](m, key)).otherwise(rest), reversed(KINDS), F.lit(None).cast("string"))
        return bound(kind, lambda k: F.struct(k.alias("kind"), value(k).alias("new")))

    out = docs.withColumn(matches, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    out = out.withColumn(gaps, F.when(F.size(matches) > 0, F.split(text, ANY, -1)))
    out = out.withColumn(found, F.transform(matches, replaced))
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(
        F.get(F.col(found), i)["new"], F.get(F.col(matches), i), F.lit("")))), "")
    out = out.withColumn(column, F.when(F.size(matches) > 0, filled).otherwise(text))
    if counts:
        number = lambda k: F.size(F.filter(found, lambda x: (x["kind"] == k) & x["new"].isNotNull()))
        out = out.withColumns({f"n_{k}": number(k).cast("long") for k in KINDS})
    return out.drop(matches, gaps, found)
