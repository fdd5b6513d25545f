"""Domain ledger and stored day states, against plain definitions."""

import datetime
import random
import statistics

from pyspark.sql import functions as F

from nightjar.operators import archive, ledger

MONDAY = datetime.date(2024, 1, 1)


def _rows(spark, seen):
    at = lambda week: datetime.datetime.combine(MONDAY + datetime.timedelta(weeks=week, days=2), datetime.time(5))
    return spark.createDataFrame([(name, at(week)) for name, weeks in seen.items() for week in weeks], "query string, began timestamp")


def _days(spark, weeks):
    return spark.createDataFrame([(MONDAY + datetime.timedelta(days=d),) for d in range(7 * weeks)], "day date")


def _plain(seen, span):
    maturity = 4 if span <= 21 else 6 if span <= 28 else 8
    out = {}
    for name, weeks in seen.items():
        weeks = sorted({w for w in weeks if w < span})
        if not weeks:
            continue
        first, behind = weeks[0], span - 1 - weeks[0]
        share = len(weeks) / (behind + 1)
        kind = "early" if first < 2 else "censored" if behind < maturity else "single-week" if len(weeks) == 1 else "intermittent" if share < 0.75 else "regular"
        cohort = first >= 2 and behind >= 8
        out[name] = (first, kind, cohort, cohort and any(first < w <= first + 4 for w in weeks), cohort and weeks[-1] >= first + 8)
    return out


def test_domain_histories_against_definition(spark):
    draw = random.Random(3)
    for span in (12, 21, 22, 28, 29):
        seen = {f"n{i}.com": draw.choices(range(span + 2), k=draw.choice([1, 1, 2, 3, span, 3 * span])) for i in range(60)}
        seen["edge.com"] = list(range(2, 2 + -(-3 * (span - 2) // 4)))
        weeks = ledger.usable_weeks(_days(spark, span))
        got = ledger.domain_histories(ledger.week_presence(_rows(spark, seen)), weeks).collect()
        assert {r.domain: (r.arrival, r.presence, r.cohort, r.soon, r.late) for r in got} == _plain(seen, span)


def test_card_speaks_from_twelve_weeks_and_merges(spark):
    seen = {"a.com": [0, 5], "b.com": [3], "c.com": [3, 4, 5, 6, 7, 8, 9, 10, 11], "d.com": [11], "plain": [4], "10.0.0.1": [4, 5]}
    states = ledger.week_presence(_rows(spark, seen))
    one = ledger.domain_arrivals(states, ledger.usable_weeks(_days(spark, 12))).first()
    assert (one.maturity, one.early, one.single_week, one.regular, one.intermittent, one.censored, one.cohort, one.soon, one.late, one.excluded) == (4, 1, 1, 1, 0, 1, 2, 1, 1, 3)
    assert one.peak_week == MONDAY + datetime.timedelta(weeks=3) and one.peak_rate == 2 / 7 and one.median_rate == statistics.median([0, 2 / 7, 0, 0, 0, 0, 0, 0, 0, 1 / 7])
    short = ledger.domain_arrivals(states, ledger.usable_weeks(_days(spark, 11))).first()
    assert (short.span, short.maturity, short.early, short.peak_week) == (11, None, None, None)
    empty = ledger.domain_arrivals(states.limit(0), ledger.usable_weeks(_days(spark, 12))).first()
    assert (empty.early, empty.median_rate, empty.excluded) == (0, 0.0, 0)
    halves = [ledger.week_presence(_rows(spark, {k: v[i::2] for k, v in seen.items()})) for i in (0, 1)]
    assert sorted(ledger.merge_presence(halves[0].unionByName(halves[1])).collect(), key=str) == sorted(states.collect(), key=str)


def test_usable_weeks_ask_for_six_good_days(spark):
    days = _days(spark, 3).filter("day <> '2024-01-15'")
    observed = days.select("day", F.lit(True).alias("present"), F.expr("day not in ('2024-01-08', '2024-01-09')").alias("usable")).filter("day <> '2024-01-03'")
    got = ledger.usable_weeks(days, observed).collect()
    assert [(r.week, r.days, r["index"], r.span) for r in got] == [(MONDAY, 6, 0, 1)]


def test_stored_days_merge_and_are_replaced(spark, tmp_path):
    draw, base = random.Random(5), datetime.datetime(2024, 1, 1)
    make = lambda n, days: [(draw.randrange(40), base + datetime.timedelta(seconds=draw.randrange(days * 86400)), 443, draw.choice(["udp", "tcp"]), draw.choice([None, float("nan"), 90000.0, draw.random()])) for _ in range(n)]
    schema = "src int, began timestamp, port int, proto string, duration double"
    first = spark.createDataFrame(make(400, 10), schema).cache()
    cut = datetime.datetime(2024, 1, 8)
    late = spark.createDataFrame(make(300, 5), schema).withColumn("began", F.col("began") + F.expr("interval 7 days")).cache()
    rows = first.filter(F.col("began") < cut).unionByName(late)
    states, keys = f"{tmp_path}/states", f"{tmp_path}/keys"
    for part in (first, late, late):  # the last days are sent again, and again
        ledger.replace_days(ledger.day_states(part), states)
        ledger.replace_days(ledger.day_keys(part, "src"), keys)
    held = spark.read.parquet(states)
    assert sorted(ledger.merge_days(held).collect()) == sorted(ledger.merge_days(ledger.day_states(rows)).collect())
    one, direct = ledger.merge_days(held).first(), archive.longest_connection(rows).first()
    assert (one.longest, one.started, one.rows, one.measured, one.over_1d) == (direct.longest, direct.started, direct.rows, direct.measured, direct.over_1d)
    got = ledger.merge_keys(spark.read.parquet(keys), "src").first()
    assert (got["keys"], got.key_rows) == (rows.select("src").distinct().count(), rows.count())
