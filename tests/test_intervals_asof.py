"""Periods, gaps and as-known answers against plain versions."""

import datetime as dt
import random

from conftest import rows

from mnemora.operators import asof, intervals

DAY = dt.timedelta(days=1)
D0 = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else D0 + n * DAY


def plain_periods(data):
    by, out = {}, []
    for c, f, u in data:
        f, u = -(10**6) if f is None else f, 10**6 if u is None else u
        if c is not None and f <= u:
            by.setdefault(c, []).append((f, u))
    for c, iv in by.items():
        merged = []
        for f, u in sorted(iv):
            if merged and f <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], u)
            else:
                merged.append([f, u])
        clean = lambda x: None if abs(x) == 10**6 else day(x)
        out += [("period", c, clean(f), clean(u)) for f, u in merged]
        out += [("gap", c, day(a[1] + 1), day(b[0] - 1)) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


def test_periods(spark):
    r = random.Random(5)
    data = [("hot", f := r.randrange(9000), f + r.randrange(-2, 4)) for _ in range(3000)]
    data += [(f"c{r.randrange(60)}", r.choice([None, *range(200)]), r.choice([None, *range(0, 200)])) for _ in range(300)]
    data += [(None, 1, 2), ("touch", 0, 3), ("touch", 4, 5), ("touch", 7, 7), ("touch", 7, 7)]
    df = spark.createDataFrame([(c, day(f), day(u), "x") for c, f, u in data], "chain string, f date, u date, _from string")
    assert rows(intervals.periods_and_gaps(df, "chain", "f", "u")) == plain_periods(data)
    assert rows(intervals.periods(df, "chain", "f", "u")) == sorted((x[1:] for x in plain_periods(data) if x[0] == "period"), key=str)
    open_end = spark.createDataFrame([("a", D0, dt.date(9999, 12, 31), "")], "chain string, f date, u date, kind string")
    assert rows(intervals.periods_and_gaps(open_end, "chain", "f", "u")) == [("period", "a", D0, None)]
    assert intervals.periods_and_gaps(df.limit(0), "chain", "f", "u").count() == 0


def test_as_known(spark):
    r = random.Random(7)
    keys = ["hot"] * 30 + [f"k{i}" for i in range(20)]
    items = []
    for i in range(1500):
        v = r.choice([None, *range(400)])
        rec = (v or 0) + r.choice([0, 0, 1, 40, 300]) + r.randrange(-3, 3)
        items.append((r.choice(keys), f"i{i:05}", v, rec * 24 + r.randrange(24)))
    items += [(k, i, v, h + 50) for k, i, v, h in items[::9]]
    events = [(r.choice(keys + ["none"]), i, r.choice([None, *range(-5, 800)])) for i in range(600)]
    at = lambda h: dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    first = {}
    for k, i, v, h in items:
        first[i] = (k, v, min(h, first.get(i, (0, 0, 10**9))[2]))
    want = []
    for k, e, d in events:
        ok = [((-(10**6) if v is None else v), h, i) for i, (kk, v, h) in first.items() if kk == k and d is not None and (v is None or v <= d) and h // 24 <= d]
        if ok:
            want.append((e, max(ok)[2]))
    idf = spark.createDataFrame([(k, i, day(v), at(h), "z") for k, i, v, h in items] + [(None, "n", D0, at(0), ""), ("hot", None, D0, at(0), ""), ("hot", "zz", D0, None, "")], "k string, id string, f date, rec timestamp, _day string")
    edf = spark.createDataFrame([(k, e, day(d)) for k, e, d in events], "k string, e bigint, d date")
    got = asof.as_known(edf, idf, ["k"], "e", "d", "id", "f", "rec")
    assert rows(got.select("event_id", "item_id")) == sorted(want, key=str)
    assert asof.as_known(edf.limit(0), idf, ["k"], "e", "d", "id", "f", "rec").count() == 0
    assert asof.as_known(edf, idf.limit(0), ["k"], "e", "d", "id", "f", "rec").count() == 0
    twice = asof.as_known(edf.union(edf), idf, ["k"], "e", "d", "id", "f", "rec")
    assert twice.count() == 2 * len(want)


def test_spellings(spark):
    df = spark.createDataFrame(
        [("2015-04-10",), (" 2015-04-10T23:59:59Z ",), ("2015/04/10",), ("20150410",), ("10 Apr 2015",), ("2015-04-10 07:00",), ("10 April 2015",), ("soon",), (None,), ("",)], "s string"
    )
    got = [r[0] for r in df.select(asof.parse_day("s")).collect()]
    assert got == [dt.date(2015, 4, 10)] * 7 + [None] * 3
    names = spark.createDataFrame([("The_Pet-the   speaker\tkeeps ",), (None,)], "a string")
    assert [r[0] for r in names.select(asof.spelling_key("a")).collect()] == ["the pet the speaker keeps", None]
