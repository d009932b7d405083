"""Format-preserving pseudonyms for personal data (built-in functions only).

Matches are validated (Luhn digit of card numbers, octets, ranges of social
security numbers, calendar dates), read as a list of small numbers with their
moduli, permuted by a keyed Feistel network over the two halves of that list,
and written back in the same format, valid again.  The permutation depends on
the key and the kind only, so equal values get equal pseudonyms in all
documents, whatever their spacing; with the key it can be undone.

Null text stays null; texts without matches stay as they are; invalid numbers
are left alone.  Repeated rows are treated one by one; empty tables give empty
results; extra columns pass through ``pseudonymise`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 6
# Pseudonymised dates are the first 250 x 292 days from 1900-01-01 on.
DATE_MODULI = (250, 292)
EPOCH = "1900-01-01"

KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "date": r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!-?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d\d-\d{4}(?!-?\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d(])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<![\d-])(?:\d[ -]?){12,18}\d(?!-?\d)",
}
ANY = "|".join(KINDS.values())


def _hash(key: str, kind: str, r: int, i: Column, other: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(r)), i.cast("string"), F.array_join(other, ",")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def feistel(values: Column, moduli: Column, key: str, kind: str, undo: bool = False) -> Column:
    """Keyed permutation of a list of numbers, each below its modulus."""
    def step(r: int):
        def of(v: Column) -> Column:
            n = F.size(v)
            half = F.floor(n / 2).cast("int")
            left = r % 2 == 0
            other = F.slice(v, half + 1, n - half) if left else F.slice(v, F.lit(1), half)

            def moved(o: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    h = _hash(key, kind, r, i, o)
                    inside = i < half if left else i >= half
                    return F.when(inside, F.pmod(x - h if undo else x + h, F.get(moduli, i))).otherwise(x)

                return F.transform(v, one)

            return let(F.transform(other, lambda x: x.cast("string")), moved)

        return of

    out = values
    for r in (reversed(range(ROUNDS)) if undo else range(ROUNDS)):
        out = let(out, step(r))
    return out


def _digits(text: Column) -> Column:
    """The digits of a string as a list of longs."""
    d = F.regexp_replace(text, r"\D", "")
    return F.transform(F.regexp_extract_all(d, F.lit(r"(\d)"), F.lit(1)), lambda x: x.cast("long"))


def _longs(*xs: int) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in xs])


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order."""
    gaps = F.split(text, r"\d")
    return F.array_join(F.flatten(F.zip_with(gaps, digits, lambda g, d: F.array(
        F.coalesce(g, F.lit("")), F.coalesce(d.cast("string"), F.lit(""))))), "")


def _luhn(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a list of digits; ``double_last``: without check digit."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when(
        (n - i) % 2 == (1 if double_last else 0), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
        F.lit(0).cast("long"), lambda a, x: a + x)


def _email(m: Column, key: str, undo: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    codes = F.transform(F.split(local, ""), lambda c: F.ascii(c).cast("long"))

    def of(codes: Column) -> Column:
        base = F.transform(codes, lambda c: F.when(c.between(97, 122), 97).when(c.between(65, 90), 65)
                           .when(c.between(48, 57), 48).otherwise(c).cast("long"))
        size = F.transform(codes, lambda c: F.when(c.between(97, 122) | c.between(65, 90), 26)
                           .when(c.between(48, 57), 10).otherwise(1).cast("long"))

        def written(b: Column) -> Column:
            v = F.zip_with(codes, b, lambda c, x: c - x)
            return F.array_join(F.zip_with(feistel(v, size, key, "email", undo), b, lambda x, y: F.char(x + y)), "")

        return let(base, written)

    # a letter outside ASCII has no modulus here: such local parts keep it
    return F.concat(let(codes, of), F.substring(m, F.length(local) + 1, F.length(m)))


def _date(m: Column, key: str, undo: bool) -> Column:
    a, b = DATE_MODULI
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(EPOCH).cast("date")).cast("long")

    def of(d: Column) -> Column:
        v = feistel(F.array(F.floor(d / b).cast("long"), d % b), _longs(a, b), key, "date", undo)
        return let(v, lambda v: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (F.get(v, 0) * b + F.get(v, 1)).cast("int")), "yyyy-MM-dd"))

    return let(day, lambda d: F.when(d.between(0, a * b - 1), of(d)).otherwise(m))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.substring(m, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    v = feistel(F.array(index, group - 1, serial - 1), _longs(898, 99, 9999), key, "ssn", undo)

    def written(v: Column) -> Column:
        x = F.get(v, 0)
        return F.concat_ws("-", F.lpad((x + F.when(x > 664, 2).otherwise(1)).cast("string"), 3, "0"),
                           F.lpad((F.get(v, 1) + 1).cast("string"), 2, "0"), F.lpad((F.get(v, 2) + 1).cast("string"), 4, "0"))

    return F.when(valid, let(v, written)).otherwise(m)


def _ip(m: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def of(o: Column) -> Column:
        out = F.transform(feistel(o, _longs(256, 256, 256, 256), key, "ip", undo), lambda x: x.cast("string"))
        return F.when(F.forall(o, lambda x: x < 256), F.array_join(out, ".")).otherwise(m)

    return let(octets, of)


def _phone(m: Column, key: str, undo: bool) -> Column:
    country = F.when(m.startswith("+1"), "+1").otherwise("")
    rest = F.substring(m, F.length(country) + 1, F.length(m))

    # area and exchange keep a first digit of 2-9, or one of 0-1
    def of(d: Column) -> Column:
        first = F.transform(d, lambda x, i: F.when(i.isin(0, 3) & (x > 1), 2).otherwise(0).cast("long"))
        moduli = F.transform(d, lambda x, i: F.when(i.isin(0, 3), F.when(x > 1, 8).otherwise(2)).otherwise(10).cast("long"))
        moved = feistel(F.zip_with(d, first, lambda x, f: x - f), moduli, key, "phone", undo)
        return F.concat(country, _refill(rest, F.zip_with(moved, first, lambda x, f: x + f)))

    return let(_digits(rest), of)


def _card(m: Column, key: str, undo: bool) -> Column:
    def of(d: Column) -> Column:
        n = F.size(d)
        # the first digit (issuer) stays, the last one is the check digit
        body = feistel(F.slice(d, F.lit(2), F.greatest(n - 2, F.lit(0))),
                       F.transform(d, lambda x: F.lit(10).cast("long")), key, "card", undo)
        whole = let(F.concat(F.slice(d, 1, 1), body), lambda b: F.concat(
            b, F.array(F.pmod(-_luhn(b, True), F.lit(10)).cast("long"))))
        return F.when(_luhn(d, False) % 10 == 0, _refill(m, whole)).otherwise(m)

    return let(_digits(m), of)


_WRITE = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def _pseudonym(m: Column, key: str, undo: bool) -> Column:
    out = m
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), _WRITE[kind](m, key, undo)).otherwise(out)
    return out


def pseudonymise(df: DataFrame, key: str, undo: bool = False, count: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced (and its number as
    column ``count``)."""
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    new = let(found, lambda f: F.transform(f, lambda m: _pseudonym(m, key, undo)))

    def written(n: Column) -> Column:
        parts = F.zip_with(F.split(F.col("text"), ANY), n, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))
        return F.struct(F.array_join(F.flatten(parts), "").alias("text"),
                        F.size(F.filter(F.zip_with(found, n, lambda a, b: a != b), lambda x: x)).cast("long").alias("n"))

    nothing = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(F.coalesce(F.col("text").rlike(ANY), F.lit(False)), let(new, written)).otherwise(nothing)
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), done.alias("done"))
    # one evaluation per row: the struct is kept as a column of its own
    out = [(F.col("done.text") if c == "text" else F.col("row")[c]).alias(c) for c in df.columns]
    return packed.select(*out, *([F.col("done.n").alias(count)] if count else []))
