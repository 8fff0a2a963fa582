"""Timestamps against a plain version with the standard library's zones, and in edge cases."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quarry.llm import stamps

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
TIME = r"(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(Z|[+-]\d\d:?\d\d))?)?"
EPOCH = datetime(1970, 1, 1)


def readings(raw):
    """(epoch in us, dates, seconds of the day, offset in seconds, is slashed); None if bad."""
    if raw is None:
        return None
    t = raw.strip("\t\n\x0b\x0c\r ")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", t):
        return int(t) * (1_000_000 if len(t) == 10 else 1000), None, None, None, False
    forms = [(r"(20\d\d)-(\d\d)-(\d\d)", ["ymd"]), (r"(20\d\d)(\d\d)(\d\d)", ["ymd"]), (r"(\d\d)\.(\d\d)\.(20\d\d)", ["dmy"]), (rf"(\d\d) ({'|'.join(MONTHS)}) (20\d\d)", ["dmy"]), (r"(\d\d)/(\d\d)/(20\d\d)", ["mdy", "dmy"])]
    for date, orders in forms:
        m = re.fullmatch(date + TIME, t, re.ASCII)
        if not m:
            continue
        dates = []
        for order in orders:
            x = dict(zip(order, m.groups()))
            month = MONTHS.index(x["m"]) + 1 if x["m"] in MONTHS else int(x["m"])
            try:
                dates.append(datetime(int(x["y"]), month, int(x["d"])))
            except ValueError:
                dates.append(None)
        h, mi, s, half, offset = m.groups()[3:]
        h, mi, s = int(h or 0), int(mi or 0), int(s or 0)
        if half:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + 12 * (half == "P")
        if h > 23 or mi > 59 or s > 59 or not any(dates):
            return None
        if offset and offset != "Z":
            oh, om = int(offset[1:3]), int(offset[-2:])
            if oh > 14 or om > 59:
                return None
            offset = (oh * 3600 + om * 60) * (-1 if offset[0] == "-" else 1)
        return None, dates, h * 3600 + mi * 60 + s, 0 if offset == "Z" else offset, len(dates) == 2
    return None


def plain(rows):
    """{stamp_id: (utc_us, rule, ambiguous)} of rows (stamp_id, source, zone, raw)."""
    read, votes, found = {}, Counter(), {}
    for i, source, zone, raw in rows:
        x = readings(raw)
        if x and x[0] is None and x[3] is None:
            try:
                ZoneInfo(zone or "?")
            except Exception:
                x = None
        read[i] = x
        if x and x[4] and None in x[1]:
            votes[source, x[1][0] is None] += 1
    for i, source, zone, raw in rows:
        x = read[i]
        if x is None or x[0] is not None:
            found[i] = (None, "bad", False) if x is None else (x[0], "epoch", False)
            continue
        dates, rule = [d for d in x[1] if d], "plain"
        day = dates[0]
        if len(set(dates)) == 2:
            a, b = votes[source, False], votes[source, True]
            rule = "votes" if a > 3 * b or b > 3 * a else "default"
            day = dates[1] if b > 3 * a else dates[0]
        wall = day + timedelta(seconds=x[2])
        odd = False
        if x[3] is None:
            both = [wall.replace(tzinfo=ZoneInfo(zone), fold=f).utcoffset() for f in (0, 1)]
            odd, offset = both[0] != both[1], both[0]
        else:
            offset = timedelta(seconds=x[3])
        found[i] = ((wall - offset - EPOCH) // timedelta(microseconds=1), rule, rule != "plain" or odd)
    return found


def check(spark, rows, **conf):
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    found = stamps.normalise(df).select("stamp_id", "_utc.*").collect()
    wanted = plain(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r["utc_us"], r["rule"], r["ambiguous"]) == wanted[r["stamp_id"]], (r, rows[r["stamp_id"]])
    return wanted


def test_random_stamps_of_many_zones(spark):
    rng, zones = random.Random(5), ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "America/Sao_Paulo", "Pacific/Apia", "Africa/Casablanca", None, "Nowhere/At_All"]
    rows = []
    for i in range(3000):
        d = datetime(rng.choice([2000, 2011, 2018, 2024, 2037, 2099]), rng.randint(1, 12), 1) + timedelta(days=rng.randint(0, 30), minutes=rng.randrange(0, 1440, 10))
        if rng.random() < 0.3:  # near a change
            d = datetime(2024, *rng.choice([(3, 10), (11, 3), (3, 31), (10, 27), (4, 7), (10, 6)]), rng.randint(0, 4), rng.choice([0, 29, 30, 59]))
        form = rng.choice(["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y%m%d", "%d.%m.%Y %H:%M", "%d %b %Y %I:%M %p", "%m/%d/%Y %H:%M", "%d/%m/%Y %I:%M%p", "%Y-%m-%d %H:%M Z", "%d/%m/%Y %H:%M+0530", "%Y-%m-%dT%H:%M:%S-08:00"])
        rows.append((i, rng.choice(["a", "b", "c", None, ""]), rng.choice(zones), rng.choice(["", " ", "\t\n"]) + d.strftime(form) + rng.choice(["", "\r "])))
    wanted = check(spark, rows)
    assert {r for _, r, _ in wanted.values()} >= {"plain", "bad"} and sum(a for *_, a in wanted.values()) > 100


ODD = [None, "", " ", "x", "2024-02-30", "2023-02-29", "2024-02-29", "31/02/2024", "2024-01-01 24:00", "2024-01-01 23:60", "2024-01-01 23:59:60", "2024-01-01 00:00 AM", "2024-01-01 12:00 AM", "2024-01-01 12:30PM", "2024-01-01 13:00 PM",
       "2024-01-01T10:00+15:00", "2024-01-01T10:00+14:59", "2024-01-01T10:00+1460", "2024-01-01 10", "2024-01-01T", "1999-01-01", "2100-01-01", "01 jan 2024", "1 Jan 2024", "01 Jan 2024", "29 Feb 2100", "١٢/٠١/2024", "1234567890", "1234567890123", "123456789", "12345678901",
       "-123456789", "2024-01-01\n", "2024-01-01 10:00\n\x0b", " 2024-01-01", "2024-1-1", "20240101T10:00", "05/05/2024", "13/13/2024", "12/13/2024", "2024-01-01 10:00Z", "2024-01-01 10:00  Z", "2024-01-01Z", " " * 50_000 + "x" + " " * 50_000, "9" * 100_000]


def test_odd_stamps(spark):
    check(spark, [(i, "s", "Europe/Berlin", raw) for i, raw in enumerate(ODD)])


def test_votes_decide_by_more_than_three_times(spark):
    def rows(months, days):
        return ["01/13/2024"] * months + ["13/01/2024"] * days + ["13/01/2024 24:00"] * 9 + ["02/03/2024", "03/03/2024", "02/03/2024Z", "02/03/2024 10:00Z"]

    cases = [(0, 0), (1, 0), (0, 1), (3, 1), (4, 1), (1, 3), (1, 4), (2, 2)]
    flat = [(f"{k}", "UTC", raw) for k, case in enumerate(cases) for raw in rows(*case)]
    wanted = check(spark, [(i, *r) for i, r in enumerate(flat)])
    assert Counter(rule for _, rule, _ in wanted.values())["votes"] == 2 * 4


def test_columns_of_any_name_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "s", "UTC", "2024-01-01", "x", "y", 1), (1, "s", "UTC", "2024-01-01", "x", "y", 1)], "stamp_id long, source string, zone string, raw string, _utc string, `row` string, wall int")
    found = stamps.normalise(df)
    assert found.columns == [*df.columns, "_utc_"]
    assert [r["_utc_"]["utc_us"] for r in found.collect()] == [1704067200000000] * 2
    assert stamps.normalise(df.where("false")).count() == 0


@pytest.mark.parametrize("partitions", [1, 13])
def test_hot_wall_times_over_any_number_of_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        raws = ["2024-03-10 02:30"] * 400 + ["2024-11-03 01:30"] * 400 + ["2024-07-01"] * 200
        check(spark, [(i, "s", ["America/New_York", "Europe/Berlin"][i % 2], raw) for i, raw in enumerate(raws)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_markers_say_where_wall_times_are_skipped_or_repeated(spark):
    zones = spark.createDataFrame([("America/New_York",), ("UTC",)], "zone string")
    found = {z: [(r["wall"], r["offset"], r["odd"]) for r in stamps.markers(zones).where(F.col("zone") == z).orderBy("wall").collect()] for z in ("America/New_York", "UTC")}
    assert [x[1:] for x in found["UTC"]] == [(0, False)]
    seconds = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp())
    at = [x for x in found["America/New_York"] if seconds(2024, 1, 1) < x[0] < seconds(2025, 1, 1)]
    assert at == [(seconds(2024, 3, 10, 2), -18000, True), (seconds(2024, 3, 10, 3), -14400, False), (seconds(2024, 11, 3, 1), -14400, True), (seconds(2024, 11, 3, 2), -18000, False)]
