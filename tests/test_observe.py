"""Daily volumes with long gaps."""

import datetime as dt
import random
import statistics

import pytest

from plumbline.operators import observe


def by_hand(days: list[dt.date], sigmas: float) -> dict[dt.date, tuple]:
    """Every day from the first to the last, one after another."""
    found, counts = {}, []
    for k in range((max(days) - min(days)).days + 1):
        day = min(days) + dt.timedelta(k)
        n, before = days.count(day), counts[-7:]
        change = n - counts[-1] if counts else None
        share = change / counts[-1] * 100 if counts and counts[-1] else None
        mean = statistics.fmean(before) if before else None
        sd = statistics.stdev(before) if len(before) > 1 else None
        low, high = (mean - sigmas * sd, mean + sigmas * sd) if sd is not None else (None, None)
        odd = sd is not None and not low <= n <= high
        found[day] = (n, change, share, low, high, odd)
        counts.append(n)
    return found


def same(got, want) -> bool:
    return all(g == w or (g is not None and w is not None and g == pytest.approx(w, abs=1e-9)) for g, w in zip(got, want))


VALUES = ["rows", "change", "change_pct", "expected_low", "expected_high", "anomaly"]


def test_gaps_of_all_lengths(spark):
    draw = random.Random(5)
    groups, start = {}, dt.date(2024, 1, 1)
    for g in range(6):
        days, at = [], start
        for gap in draw.sample(range(1, 40), 8) + [15, 16, 17, 18]:
            days += [at] * draw.randint(1, 4)
            at += dt.timedelta(gap if draw.random() < 0.8 else 1)
        groups[f"g{g}"] = days
    rows = [(g, dt.datetime.combine(d, dt.time(12))) for g, days in groups.items() for d in days] + [("g0", None), ("none", None)]
    df = spark.createDataFrame(rows, "kind string, at timestamp_ntz")
    got = {(r.kind, r.day): [r[v] for v in VALUES] for r in observe.daily_volume(df, "at", ["kind"], 1.5).collect()}
    want = {(g, d): v for g, days in groups.items() for d, v in by_hand(days, 1.5).items()}
    assert got.keys() == want.keys()
    assert all(same(got[k], want[k]) for k in want)


def test_one_odd_date_is_one_range(spark):
    days = ["1970-01-01", "2024-01-01", "2024-01-02", "9999-12-31"]
    df = spark.createDataFrame([(d,) for d in days], "at string").selectExpr("cast(at AS date) AS at")
    got = observe.daily_volume(df, "at", gaps_as_ranges=True).orderBy("day").collect()
    assert len(got) < 60
    assert sum((r.until - r.day).days + 1 for r in got) == (dt.date(9999, 12, 31) - dt.date(1970, 1, 1)).days + 1
    assert [str(r.day) for r in got if r.rows] == days
    long = [r for r in got if r.until > r.day]
    assert len(long) == 2 and all((r.rows, r.change, r.expected_low, r.anomaly) == (0, 0, 0.0, False) for r in long)
    assert str(got[-1].day) == "9999-12-31" and got[-1].anomaly


def test_no_rows(spark):
    df = spark.createDataFrame([], "kind string, at timestamp")
    assert observe.daily_volume(df, "at", ["kind"]).collect() == []
