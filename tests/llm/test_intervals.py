"""The interval join against pairs made by loops: random intervals, sessions and sales, and rows that are broken."""

import collections
import datetime as dt
import random
import zlib

from lodestone.llm import interval_join as ij

DAY = dt.datetime(2024, 3, 1)
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, s int, e int"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, first int, open string"
LINES = "sale_id long, shipped_at timestamp_ntz, us long"


def micros(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def by_loops(sales, lines, clicks):
    times = collections.defaultdict(list)
    for _, ts, client, kind, *_ in clicks:
        if ts is not None and client is not None:
            times[client].append((micros(ts), kind == "error"))
    found = collections.defaultdict(list)
    for client, own in times.items():
        runs = []
        for t, error in sorted(own):
            if not runs or t - runs[-1][-1][0] > ij.GAP:
                runs.append([])
            runs[-1].append((t, error))
        for r in runs:
            error = any(e for t, e in r if t == r[-1][0])
            found[client].append((r[0][0] // ij.SLOT, ij.NEVER if error else r[-1][0] // ij.SLOT, zlib.crc32(str(r[0][0]).encode())))
    out = []
    for sale, client, status, sold, *_ in sales:
        if client is None or sold is None:
            continue
        ends = [micros(sold)] + [micros(at) for of, at, *_ in lines if of is not None and of == sale and at is not None]
        s, e = micros(sold) // ij.SLOT, ij.NEVER if status == "open" else max(ends) // ij.SLOT
        sums = {}
        for s2, e2, crc in found[client]:
            if s <= e2 and s2 <= e:
                name = ij.RELATIONS[(s > s2) - (s < s2) + 1][(e > e2) - (e < e2) + 1]
                n, shared, total = sums.get(name, (0, None, 0))
                if min(e, e2) < ij.NEVER:
                    shared = (shared or 0) + min(e, e2) - max(s, s2) + 1
                sums[name] = (n + 1, shared, total + crc)
        out += [(sale, name, *x) for name, x in sums.items()]
    return sorted(out, key=str)


def joined(spark, sales, lines, clicks):
    df = ij.join(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), spark.createDataFrame(clicks, CLICKS))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, df.collect()), key=str)


def test_sessions_and_sales_as_by_loops(spark):
    rng = random.Random(5)
    at = lambda days: DAY + dt.timedelta(minutes=rng.randint(0, days * 1440), microseconds=rng.randint(0, 10**6))
    client = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    clicks = [(i, rng.choice([at(9), at(9), at(1), None]), client(), rng.choice(["view", "error", None]), 0, 0) for i in range(700)]
    clicks += clicks[:50] + [(i, DAY + dt.timedelta(minutes=10 * i), 2, "view", 0, 0) for i in range(300)]
    sales = [(i if i % 9 else None, client(), rng.choice(["open", "done", None]), rng.choice([at(12), at(2), None]), 0, "") for i in range(80)] + [(7, 1, "done", DAY, 0, ""), (90, 2, "open", DAY + dt.timedelta(days=1), 0, ""), (91, 2, "done", DAY + dt.timedelta(days=1), 0, "")]
    lines = [(rng.choice([rng.randint(0, 79), None]), rng.choice([at(20), DAY - dt.timedelta(days=400), None]), 0) for _ in range(90)] + [(91, DAY + dt.timedelta(days=9), 0)]
    want = by_loops(sales, lines, clicks)
    assert len({r[1] for r in want}) == 9 and any(r[3] is None for r in want)
    assert joined(spark, sales, lines, clicks) == want


def test_pauses_at_the_very_limit_and_times_before_1970(spark):
    gap, old = dt.timedelta(microseconds=ij.GAP), dt.datetime(1969, 12, 31, 18, 0)
    one = dt.timedelta(microseconds=1)
    clicks = [(i, t, 5, k, 0, 0) for i, (t, k) in enumerate([(old - one, "view"), (old - one + gap, "view"), (old + gap + gap, "error"), (old + gap + gap, "view"), (old + gap * 3 + one, "view")])]
    sales = [(1, 5, "done", old - one, 0, ""), (2, 5, "open", old + gap * 4, 0, "")]
    assert joined(spark, sales, [], clicks) == by_loops(sales, [], clicks) != []


def test_no_rows(spark):
    one = [(1, 5, "done", DAY, 0, "")]
    assert joined(spark, [], [], []) == joined(spark, one, [], []) == joined(spark, [], [], [(1, DAY, 5, "view", 0, 0)]) == []


def test_a_session_in_another_zone_gives_the_same(spark):
    clicks, sales = [(1, DAY, 5, "view", 0, 0)], [(1, 5, "done", DAY, 0, "")]
    want = joined(spark, sales, [], clicks)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert joined(spark, sales, [], clicks) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_overlapping_pair_once(spark):
    rng = random.Random(6)

    def intervals(n):
        rows = set()
        while len(rows) < n:
            s = rng.randint(-70, 70)
            rows.add((rng.choice([1, 2]), s, rng.choice([s, s + rng.randint(0, 90), s + rng.randint(0, 3), ij.NEVER])))
        return sorted(rows)

    left, right = intervals(150), intervals(150)
    found = ij.overlapping(spark.createDataFrame(left, "client long, s long, e long"), spark.createDataFrame(right, "client long, s long, e long")).select("client", "s", "e", "s2", "e2")
    assert sorted(map(tuple, found.collect())) == sorted((c, s, e, s2, e2) for c, s, e in left for c2, s2, e2 in right if c == c2 and s <= e2 and s2 <= e)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
