"""PII by format-preserving Feistel pseudonyms, in DataFrame expressions only.

A value that passes its kind's validation is permuted under a key within its format: digits stay digits, letters
letters of the same case, separators stay where they are, and the permuted value passes the same validation. Equal
values (whatever their separators) get equal pseudonyms, so they stay linked across documents; the permutation is a
bijection of the format, undone with `invert`. Slash dates are read month first; those that are valid only day first
are permuted among their like, and so aren't linked to the same day in other forms. The domain of an e-mail address stays. The rounds: a value is two halves of small numbers, each below a base;
every round adds to one half, each number modulo its base, a keyed SHA-512 of the other half, and swaps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Kinds in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of a month after the 28th, but for the 29th of February, as 100 * month + day.
LATE = [100 * m + d for m in range(1, 13) for d in (29, 30, 31) if m != 2 and (d < 31 or m not in (4, 6, 9, 11))]
#: Days of 1900-01-01 to 2099-12-31: 319 x 229.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1900-01-01", 319, 229


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once and named, which keeps the expression small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(values: Column, bases: Column, key: str, tweak: str, invert: bool = False) -> Column:
    """Permute array<int> values, each below its base. The bases must be the same for all values of a format."""

    def halves(v: Column) -> Column:
        half = F.floor(F.size(v["v"]) / 2).cast("int")
        return F.struct(F.slice(v["v"], F.lit(1), half).alias("a"), F.slice(v["m"], F.lit(1), half).alias("ab"), F.slice(v["v"], half + 1, F.size(v["v"])).alias("b"), F.slice(v["m"], half + 1, F.size(v["v"])).alias("bb"))

    state = let(F.struct(values.alias("v"), bases.alias("m")), halves)

    def mixed(own: Column, own_bases: Column, other: Column, nth: Column, sign: int) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), nth.cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        drawn = lambda d, i: F.conv(F.substr(d, F.pmod(i, F.lit(16)) * 8 + 1, F.lit(8)), 16, 10).cast("long")
        added = let(digest, lambda d: F.transform(own, lambda v, i: v.cast("long") + sign * drawn(d, i)))
        return F.zip_with(added, own_bases, lambda v, b: F.pmod(v, b).cast("int"))

    def there(s: Column, nth: Column) -> Column:
        return F.struct(s["b"].alias("a"), s["bb"].alias("ab"), mixed(s["a"], s["ab"], s["b"], nth, 1).alias("b"), s["ab"].alias("bb"))

    def back(s: Column, nth: Column) -> Column:
        return F.struct(mixed(s["b"], s["bb"], s["a"], nth, -1).alias("a"), s["bb"].alias("ab"), s["a"].alias("b"), s["ab"].alias("bb"))

    rounds = F.array(*(F.lit(i) for i in (range(ROUNDS, 0, -1) if invert else range(1, ROUNDS + 1))))
    return F.aggregate(rounds, state, back if invert else there, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _base(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1)


def _value(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).otherwise(0)


def _written(v: Column, c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.char(v + 48)).when(c.rlike("^[a-z]$"), F.char(v + 97)).when(c.rlike("^[A-Z]$"), F.char(v + 65)).otherwise(c)


def permuted_string(s: Column, key: str, tweak: str, invert: bool = False) -> Column:
    """Permute the letters and digits of s within their classes; what is neither is left out of the permutation."""
    moved = lambda cs: F.zip_with(feistel(F.transform(cs, _value), F.transform(cs, _base), key, tweak, invert), cs, _written)
    new = let(_chars(F.regexp_replace(s, "[^A-Za-z0-9]", "")), moved)
    return F.when(s.rlike("[A-Za-z0-9]"), _threaded(new, s, "[A-Za-z0-9]")).otherwise(s)


def _threaded(new: Column, s: Column, kind: str) -> Column:
    """The characters of `new` in place of those of s that are of the kind."""
    def threaded(chars: Column) -> Column:
        step = lambda st, c: F.struct((st["at"] + c.rlike(kind).cast("int")).alias("at"), F.concat(st["out"], F.when(c.rlike(kind), F.get(chars, st["at"])).otherwise(c)).alias("out"))
        return F.aggregate(_chars(s), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda st: st["out"])

    return let(new, threaded)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Of a string of digits, its last digit not doubled."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _mod97(s: Column) -> Column:
    """Of letters and digits, letters counting 10 to 35."""
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(s), F.lit(0), step)


def _octets(s: Column) -> Column:
    return F.transform(F.split(s, r"\."), lambda o: o.try_cast("int"))


def _day(s: Column) -> Column:
    form = F.when(F.contains(s, F.lit("-")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).when(F.contains(s, F.lit("/")), F.try_to_timestamp(s, F.lit("MM/dd/yyyy"))).otherwise(F.try_to_timestamp(s, F.lit("dd.MM.yyyy")))
    return F.datediff(form.cast("date"), F.lit(FIRST_DAY).cast("date"))


def _part(s: Column, nth: int) -> Column:
    return F.get(F.split(s, "/"), F.lit(nth)).try_cast("int")


def _day_first(s: Column) -> Column:
    """Whether a slash date is valid day first only, in 1900 to 2099."""
    day = F.try_to_timestamp(s, F.lit("dd/MM/yyyy")).isNotNull() & F.try_to_timestamp(s, F.lit("MM/dd/yyyy")).isNull()
    return F.contains(s, F.lit("/")) & F.coalesce(day & _part(s, 2).between(1900, 2099), F.lit(False))


def _day_first_moved(s: Column, key: str, invert: bool) -> Column:
    d, m, y = (_part(s, k) for k in range(3))
    pair = lambda v, i: F.get(v, F.lit(i))
    written = lambda d, m, y: F.format_string("%02d/%02d/%04d", d.cast("int"), m.cast("int"), y.cast("int"))
    late = F.array(*(F.lit(x) for x in LATE))
    early = let(feistel(F.array(y - 1900, m - 1, d - 13), F.array(F.lit(200), F.lit(12), F.lit(16)), key, "day1", invert), lambda v: written(pair(v, 2) + 13, pair(v, 1) + 1, pair(v, 0) + 1900))
    code = (F.array_position(late, m * 100 + d) - 1).cast("int")
    last = let(feistel(F.array(y - 1900, code), F.array(F.lit(200), F.lit(len(LATE))), key, "day2", invert), lambda v: let(F.get(late, pair(v, 1)), lambda c: written(c % 100, F.floor(c / 100), pair(v, 0) + 1900)))
    nth = F.floor((y - 1904) / 4).cast("int")
    leap = let(feistel(F.array(F.floor(nth / 7).cast("int"), nth % 7), F.array(F.lit(7), F.lit(7)), key, "day3", invert), lambda v: written(F.lit(29), F.lit(2), 1904 + 4 * (7 * pair(v, 0) + pair(v, 1))))
    return F.when(d <= 28, early).when(m == 2, leap).otherwise(last)


def valid(kind: str, s: Column) -> Column:
    """Whether a match of the kind's pattern is a value of that kind."""
    digits = _digits(s)
    if kind == "iban":
        return let(F.replace(s, F.lit(" "), F.lit("")), lambda c: (F.length(c) >= 15) & (_mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1))
    if kind == "ip":
        return F.forall(_octets(s), lambda o: F.coalesce(o <= 255, F.lit(False))) & ~s.rlike(r"(^|\.)0[0-9]")
    if kind == "date":
        return F.coalesce(_day(s).between(0, DAY_HIGH * DAY_LOW - 1), F.lit(False)) | _day_first(s)
    if kind == "ssn":
        return ~s.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        return let(digits, lambda d: (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"))
    return F.lit(True)


def replaced(kind: str, s: Column, key: str, invert: bool) -> Column:
    """The pseudonym of a valid value."""
    number = lambda d, at, n: F.substr(d, F.lit(at), F.lit(n)).try_cast("int")
    pair = lambda m, i: F.get(m, F.lit(i))
    if kind == "email":
        return F.concat(permuted_string(F.substring_index(s, "@", 1), key, kind, invert), F.lit("@"), F.substring_index(s, "@", -1))
    if kind == "iban":
        country = F.substr(s, F.lit(1), F.lit(2))
        check = lambda b: F.lpad((F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        body = permuted_string(F.replace(F.substr(s, F.lit(5)), F.lit(" "), F.lit("")), key, kind, invert)
        return _threaded(_chars(let(body, lambda b: F.concat(country, check(b), b))), s, "[A-Za-z0-9]")
    if kind == "ip":
        return F.array_join(feistel(_octets(s), F.array_repeat(F.lit(256), 4), key, kind, invert).cast("array<string>"), ".")
    if kind == "date":
        moved = let(_day(s), lambda d: feistel(F.array(F.floor(d / DAY_LOW).cast("int"), d % DAY_LOW), F.array(F.lit(DAY_HIGH), F.lit(DAY_LOW)), key, kind, invert))
        new = let(moved, lambda m: F.date_add(F.lit(FIRST_DAY).cast("date"), pair(m, 0) * DAY_LOW + pair(m, 1)))
        whole = let(new, lambda d: F.when(F.contains(s, F.lit("-")), F.date_format(d, "yyyy-MM-dd")).when(F.contains(s, F.lit("/")), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))
        return F.when(_day_first(s), _day_first_moved(s, key, invert)).otherwise(whole)
    if kind == "ssn":
        index = lambda d: F.array(number(d, 1, 3) - 1 - (number(d, 1, 3) > 666).cast("int"), number(d, 4, 2) - 1, number(d, 6, 4) - 1)
        moved = feistel(let(_digits(s), index), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, kind, invert)
        return let(moved, lambda m: F.format_string("%03d-%02d-%04d", pair(m, 0) + 1 + (pair(m, 0) >= 665).cast("int"), pair(m, 1) + 1, pair(m, 2) + 1))
    if kind == "phone":
        lead = F.regexp_extract(s, r"^\+(?:1[ .-]?(?=\(|[0-9]{3}[ .-])|[0-9]{1,3}[ .-]|[0-9]{2})", 0)
        return let(lead, lambda x: F.concat(x, permuted_string(F.substr(s, F.length(x) + 1), key, kind, invert)))
    stem = let(_digits(s), lambda d: permuted_string(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", invert))
    whole = let(stem, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return _threaded(_chars(whole), s, "[0-9]")


def pseudonym(s: Column, key: str, invert: bool = False) -> Column:
    """The pseudonym of a matched value, by the first kind whose pattern it has; itself where that kind's validation fails."""
    out = s
    for kind in reversed(PATTERNS):
        out = F.when(s.rlike(rf"\A(?:{PATTERNS[kind]})\z"), F.when(valid(kind, s), replaced(kind, s, key, invert)).otherwise(s)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, invert: bool = False) -> DataFrame:
    """docs with valid values in text_col replaced; other columns, null and empty texts stay as they are.

    Rows that repeat are replaced alike; an empty table stays empty. With a count_col that docs has already, it raises.
    count_col: adds how many values were replaced. No row is moved: the plan is one projection. Texts without a digit
    or an at sign aren't looked at further.
    """
    if count_col in docs.columns:
        raise ValueError(f"docs has a column {count_col} already")
    text = F.col(text_col)
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    both = F.transform(matches, lambda m: F.struct(m.alias("old"), pseudonym(m, key, invert).alias("new")))

    def rebuilt(m: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(text, ANY), F.transform(m, lambda p: p["new"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
        n = F.size(F.filter(m, lambda p: p["old"] != p["new"])).cast("long")
        return F.struct(joined.alias("text"), n.alias("n"))

    held = next(f"held{i}" for i in range(len(docs.columns) + 1) if f"held{i}" not in docs.columns)
    out = docs.withColumn(held, F.when(text.rlike("[0-9@]"), let(both, rebuilt)))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.col(held)["n"], F.lit(0).cast("long")))
    return out.withColumn(text_col, F.coalesce(F.col(held)["text"], text)).drop(held)
