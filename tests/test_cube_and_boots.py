"""Trimming, attribution, measures and boot matching on planted rows."""

from pyspark.sql import functions as F

from nightjar.operators import cube
from nightjar.operators.events import match_boots

KEPT = "row_id long, ts double, duration double"


def _trimmed(spark, rows):
    return {r.row_id for r in cube.trim_sparse_edges(spark.createDataFrame(rows, KEPT), 10.0).collect()}


def test_trimming_of_ends(spark):
    body = [(i, 1000.0 + (i % 400), 0.0) for i in range(4000)]
    lead, long, tail = (9001, 0.0, 1.0), (9002, 5.0, 2000.0), (9003, 2000.0, 0.0)
    everything = {r[0] for r in body}
    assert _trimmed(spark, [*body, lead, long, tail]) == everything | {9002}
    assert _trimmed(spark, [*body, tail]) == everything  # one end
    assert _trimmed(spark, [*body, (9004, 950.0, 0.0)]) == everything | {9004}  # a short tail stays
    heavy = [(9100 + i, 0.0 + i, 0.0) for i in range(5)]
    assert _trimmed(spark, [*body, *heavy]) == everything | {r[0] for r in heavy}  # over a thousandth of the rows
    assert _trimmed(spark, body[:3] + [(9005, 90_000.0, 0.0)]) == {0, 1, 2, 9005}  # few bins


def test_attribution_keeps_mass(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "row_id long, domain string")
    handled = [("a", "x.a", "forwarded", 1.0), ("a", "x.a", "forwarded", 1.9), ("a", "y.a", "forwarded", 1.0), ("a", "x.a", "gravity_blocked", 1.0), ("a", "x.a", "query", 1.0), (None, "z", "cached", 1.0)]
    frame = spark.createDataFrame(handled, "domain string, query string, event string, ts double").withColumn("disposition", cube.disposition(F.col("event")))
    got = cube.attribute(asked, frame).collect()
    assert {(r.row_id, r.svc): round(r.metric, 6) for r in got if r.row_id in (1, 2, 3)} == {(1, "forwarded"): round(2 / 3, 6), (1, "blocked"): round(1 / 3, 6), (2, "(unattributed)"): 1.0, (3, "(unattributed)"): 1.0}
    assert abs(sum(r.metric for r in got) - 4) < 1e-9


def test_barycentre_order(spark):
    cells = spark.createDataFrame([("a", "y", "s", 0, 5.0, 1), ("b", "x", "s", 0, 9.0, 1), ("a", "x", "t", 1, 1.0, 1), ("c", "x", "t", 1, 0.0, 2)], "src string, dst string, svc string, bin long, metric double, rows long")
    answered = spark.createDataFrame([("b", "x", "s", 6.0, 2.0), ("c", "x", "t", 0.0, 0.0)], "src string, dst string, svc string, orig double, resp double")
    series, flows, places = cube.measures(cells, answered)
    assert {(r.src, r.bin): round(r.share, 6) for r in series.collect() if r.bin == 0} == {("a", 0): round(5 / 14, 6), ("b", 0): round(9 / 14, 6)}
    assert {(r.src, r.dst): (r.colour, r.response_share) for r in flows.collect()} == {("a", "y"): (1, None), ("b", "x"): (1, 0.25), ("a", "x"): (2, None), ("c", "x"): (2, None)}
    assert {r.identity: r.place for r in places.filter("side = 'src'").collect()} == {"b": 1, "a": 2, "c": 3}


def test_boots_claim_in_order(spark):
    """An earlier boot takes the burst that a later one is nearest to, which then takes the next; ties go to the earlier burst."""
    boots = [("h", 1, 100.0, 100.0), ("h", 2, 130.0, 131.0), ("h", 3, 140.0, 140.0), ("h", 4, None, None), ("g", 1, 100.0, 100.0), ("k", 1, 50.0, 50.0)]
    bursts = [("h", 7, 125.0, 128.0), ("h", 8, 180.0, 185.0), ("g", 1, 90.0, 95.0), ("g", 2, 110.0, 111.0), ("k", 1, 110.1, 120.0), ("m", 1, 0.0, 1.0)]
    got = match_boots(spark.createDataFrame(boots, "host string, event long, start double, end double"), spark.createDataFrame(bursts, "host string, session long, first_ts double, last_ts double"), 60.0)
    assert {(r.host, r.event): r.session for r in got.collect()} == {("h", 1): 7, ("h", 2): 8, ("h", 3): None, ("h", 4): None, ("g", 1): 1, ("k", 1): None}
