import hashlib
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from cueweave.llm import pii

KEY = "k"


def brute_feistel(values, bases, tweak):
    h = len(values) // 2
    a, ab, b, bb = values[:h], bases[:h], values[h:], bases[h:]
    for nth in range(1, pii.ROUNDS + 1):
        d = hashlib.sha512("|".join([KEY, tweak, str(nth), ",".join(map(str, b))]).encode()).hexdigest()
        new = [(v + int(d[8 * (i % 16) : 8 * (i % 16) + 8], 16)) % m for i, (v, m) in enumerate(zip(a, ab))]
        a, ab, b, bb = b, bb, new, ab
    return a + b


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(x * 2 - 9 if x > 4 else x * 2 for x in d[1::2])) % 10 == 0


TEXT = "mail und.34@mail7.example.com or é.42@x.org, +1 (499) 555-6503 and 499-555-6503; card 4845168114407329 4845 1681 1440 7329 not 9807915762804490, ip 97.51.17.173 not 300.1.1.1 or 1.2.3.4.5, ssn 123-45-6789 not 000-12-3456, on 2024-02-29 and 02/28/2023 and 31.12.1999 not 2023-02-29, iban GB82WEST12345698765432 not GB83WEST12345698765432."


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    return [r["text"] for r in pii.pseudonymise(df, KEY, **how).orderBy("doc_id").collect()]


def test_values_keep_their_format_and_validity_and_are_linked(spark):
    (out,) = run(spark, [TEXT])
    shape = lambda t: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9.]+(?= not 300)", "IP", t))))
    assert shape(out) == shape(TEXT)
    for kept in ("9807915762804490", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "2023-02-29", "GB83WEST12345698765432", "@mail7.example.com"):
        assert kept in out
    for gone in ("und.34", "555-6503", "4845168114407329", "97.51.17.173", "123-45-6789", "2024-02-29", "02/28/2023", "31.12.1999", "GB82WEST12345698765432"):
        assert gone not in out
    card, spaced = re.search(r"card (\d{16}) (\d{4} \d{4} \d{4} \d{4})", out).groups()
    assert card == spaced.replace(" ", "") and luhn(card)
    assert re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) and (\S+);", out).expand(r"\1-\2") == re.search(r"and (\S+);", out).group(1)
    assert all(int(o) < 256 for o in re.search(r"ip (\S+) not", out).group(1).split("."))
    iban = re.search(r"iban (\S+) not", out).group(1)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    a, g, s = re.search(r"ssn (\d+)-(\d+)-(\d+)", out).groups()
    assert 1 <= int(a) < 900 and a != "666" and int(g) and int(s)
    assert run(spark, [out], invert=True) == [TEXT]
    assert run(spark, [TEXT, "tel 499-555-6503."])[1][4:16] == re.search(r"and (\S+);", out).group(1)


def test_pseudonyms_match_a_brute_force_feistel(spark):
    (out,) = run(spark, ["card 4845168114407329 day 2024-02-29 ip 9.8.7.6"])
    stem = "".join(map(str, brute_feistel([int(c) for c in "484516811440732"], [10] * 15, "card")))
    card = next(stem + str(k) for k in range(10) if luhn(stem + str(k)))
    n = (date(2024, 2, 29) - date(1900, 1, 1)).days
    hi, lo = brute_feistel([n // 229, n % 229], [319, 229], "date")
    ip = ".".join(map(str, brute_feistel([9, 8, 7, 6], [256] * 4, "ip")))
    assert out == f"card {card} day {date(1900, 1, 1) + timedelta(days=hi * 229 + lo)} ip {ip}"


def test_all_days_and_two_digit_values_are_permuted(spark):
    days = spark.range(319 * 229).select(F.col("id").cast("int").alias("d"))
    moved = days.select(pii.feistel(F.array(F.floor(F.col("d") / 229).cast("int"), F.col("d") % 229), F.array(F.lit(319), F.lit(229)), KEY, "date").alias("m"))
    assert moved.distinct().count() == 319 * 229


def test_edges(spark):
    texts = [None, "", "no values here", "@ 1", "5" * 100_000, "a" * 100_000 + "@", "word " * 40_000 + "7.7.7.7"]
    out = run(spark, texts, count_col="n_replaced")
    assert out[:6] == texts[:6] and out[6] != texts[6] and out[6].startswith("word ")
    df = spark.createDataFrame([(1, "9.9.9.9", 5)], "doc_id long, text string, __x int")
    assert pii.pseudonymise(df, KEY).columns == df.columns
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_day_first_dates_and_spaced_ibans(spark):
    text = "on 31/12/1999, 13/01/2024, 29/02/2000, 30/06/1950 and 12/31/1999 not 31/02/1999 or 45/12/1999; DE89 3704 0044 0532 0130 00 and DE89370400440532013000."
    (out,) = run(spark, [text])
    for gone in ("31/12/1999", "13/01/2024", "29/02/2000", "30/06/1950", "12/31/1999", "DE89 3704", "DE893704"):
        assert gone not in out
    assert "31/02/1999" in out and "45/12/1999" in out
    spaced, compact = re.search(r"; (DE\d\d(?: \d{4}){4} \d\d) and (DE\d{20})", out).groups()
    assert spaced.replace(" ", "") == compact and int(compact[4:] + "1314" + compact[2:4]) % 97 == 1
    assert run(spark, [out], invert=True) == [text]
    days = [date(1900, 1, 1) + timedelta(days=k) for k in range(0, 73049)]
    late = [d for d in days if d.day > 12]
    made = spark.createDataFrame([(d.strftime("%d/%m/") + str(d.year),) for d in late], "s string")
    moved = [r[0] for r in made.select(pii.pseudonym(F.col("s"), KEY)).collect()]
    assert len(set(moved)) == len(late) and set(moved) == {r[0] for r in made.collect()}
