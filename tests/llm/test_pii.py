import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from duesight.llm import pii

TEXTS = [
    ("call +1 (389) 555-5010, (389) 555-5010 or 389-555-5010.", {"phone": 3}),
    ("x 4539578763621486 y 4539 5787 6362 1486 z 4539578763621487", {"card": 2}),
    ("a 10.0.0.1, 256.1.1.1 and 10.0.0.1.", {"ip": 2}), ("on 2020-02-29, 31.12.1999, 12/31/1999, not 31/02/2000", {"date": 3}),
    ("ssn 123-45-6789 not 666-12-1234 nor 000-11-1111", {"ssn": 1}),
    ("IBAN DE89370400440532013000 GB82WEST12345698765432 not DE00370400440532013000", {"iban": 2}),
    ("mail Foo.Bar+1@mail8.example.com, x@y", {"email": 1}), ("tel +44 20 7946 0958 +4915112345678", {"phone": 2}),
    ("1 (456) 555-2186 4539578763621486 44.161.181.40 end", {"phone": 1, "card": 1, "ip": 1}),
    ("no data 12 345 6789", {}), ("4539578763621486" * 3, {}), ("", {}), (None, {}), ("a" * 300_000 + " 10.0.0.1", {"ip": 1}),
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(i, t, "m", 1) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string, _matches string, found int")
    out = pii.pseudonyms(df, counts=True)
    assert out.columns[:4] == df.columns
    return {r["doc_id"]: r.asDict() for r in out.collect()}


def test_kinds_are_found_and_formats_stay(done):
    for i, (text, kinds) in enumerate(TEXTS):
        assert {k: done[i][f"n_{k}"] for k in pii.KINDS if done[i][f"n_{k}"]} == kinds, text
        if not kinds:
            assert done[i]["text"] == text
        elif "email" not in kinds:
            shape = lambda s: re.sub(r"[0-9]", "9", s)
            if "ip" not in kinds:
                assert shape(done[i]["text"]) == shape(text)


def test_values_stay_valid_and_linked(done):
    a, b, c = re.findall(r"(?:\+1 )?\(?\d{3}\)?[ -]\d{3}-\d{4}", done[0]["text"])
    assert re.sub(r"\D", "", a)[-10:] == re.sub(r"\D", "", b) == re.sub(r"\D", "", c) != "3895555010"
    x, y, z = re.search(r"x (\d+) y ([\d ]+) z (\d+)", done[1]["text"]).groups()
    assert x == y.replace(" ", "") != "4539578763621486" and x[0] == "4" and luhn(x) % 10 == 0 and z == "4539578763621487"
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", done[2]["text"])
    assert ips[0] == ips[2] != "10.0.0.1" and ips[1] == "256.1.1.1" and max(map(int, ips[0].split("."))) < 256
    dates = re.findall(r"\d+[-./]\d+[-./]\d+", done[3]["text"])
    datetime.date.fromisoformat(dates[0])
    assert datetime.datetime.strptime(dates[1], "%d.%m.%Y") == datetime.datetime.strptime(dates[2], "%m/%d/%Y")
    assert dates[3] == "31/02/2000"
    for iban in re.findall(r"[A-Z]{2}\d{2}[A-Z0-9]+", done[5]["text"])[:2]:
        assert int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1
    assert "Foo" not in done[6]["text"] and done[6]["text"].endswith("@mail.invalid, x@y")


def test_permutations_join_nothing(spark):
    rows = [(f"{a}-{b:02}-{c:04}",) for a in (1, 664, 665, 667, 899) for b in (1, 99) for c in range(1, 40)]
    rows = [(f"{int(t.split('-')[0]):03}" + t[t.index("-"):],) for (t,) in rows]
    out = [r["text"] for r in pii.pseudonyms(spark.createDataFrame(rows, "text string")).collect()]
    assert len(set(out)) == len(rows)
    for t in out:
        a, b, c = map(int, t.split("-"))
        assert 1 <= a <= 899 and a != 666 and 1 <= b <= 99 and 1 <= c <= 9999
    short = [(f"{d:08}",) for d in range(0, 10**8, 10**5)]
    moved = spark.createDataFrame(short, "d string").select(pii.moved_digits(F.col("d"), "t", "k").alias("d"))
    assert len({r["d"] for r in moved.collect()}) == len(short)


def test_another_key_gives_other_values(spark):
    df = spark.createDataFrame([("4539578763621486",)], "text string")
    assert pii.pseudonyms(df, "a").first()["text"] != pii.pseudonyms(df, "b").first()["text"]


def test_dates_over_the_whole_range(spark):
    rng = random.Random(1)
    first = datetime.date(1900, 1, 1)
    days = rng.sample(range(73_000), 400) + [0, 72_999]
    rows = [((first + datetime.timedelta(d)).isoformat(),) for d in days]
    out = [r["text"] for r in pii.pseudonyms(spark.createDataFrame(rows, "text string")).collect()]
    assert len(set(out)) == len(set(rows)) and all(datetime.date.fromisoformat(t) >= first for t in out)


def test_odd_documents(spark, odd, empty):
    out = pii.pseudonyms(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonyms(empty).count() == 0
