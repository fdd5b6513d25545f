"""The template tree against a sequential pass over whole leaves."""

import random

from nightjar.operators.mining import ANY, _merged, mine_templates


def planted(rng, size):
    kinds = ["accepted password for {w} from {h} port {n}", "accepted publickey for {w} from {h} port {n}", "session opened for user {w} by root", "session closed for user {w}", "job {n} done in {n} ms", "disk full on {w}"]
    words = [f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    return [rng.choice(kinds).format(w=rng.choice(words), h=rng.choice(["alpha.example", "beta.example", "gamma.example"]), n=rng.randrange(10**6)) for _ in range(size)]


def test_same_templates_as_a_sequential_pass(spark):
    rng = random.Random(6)
    lines = planted(rng, 3000)
    rows = spark.createDataFrame([(i, float(i), m) for i, m in enumerate(lines)], "row_id long, ts double, message string").repartition(7)
    got = {r.row_id: r.template for r in mine_templates(rows).select("row_id", "template").collect()}
    masked = [" ".join(ANY if t.isdigit() else t for t in m.split(" ")) for m in lines]
    leaves = {}
    for m in dict.fromkeys(masked):
        tokens = m.split(" ")
        leaves.setdefault((len(tokens), *(ANY if any(c.isdigit() for c in t) else t for t in tokens[:2])), []).append(tokens)
    want = {" ".join(t) for leaf in leaves.values() for t in _merged(leaf, 0.5)}
    assert set(got.values()) == want and len(want) == 6 and len(got) == 3000


def test_a_leaf_is_grown_in_many_tasks(spark):
    """One leaf with many messages: partial trees from several tasks, one template."""
    rows = spark.range(20_000).selectExpr("id AS row_id", "cast(id AS double) AS ts", "concat('user login ', translate(cast(id AS string), '0123456789', 'abcdefghij'), ' accepted now') AS message").repartition(8)
    assert {r.template for r in mine_templates(rows).select("template").distinct().collect()} == {f"user login {ANY} accepted now"}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, None), (2, None, ""), (3, 1.0, "one"), (4, 1.0, "one"), (5, None, "a  b")], "row_id long, ts double, message string")
    assert {r.row_id: r.template for r in mine_templates(rows).collect()} == {1: None, 2: "", 3: "one", 4: "one", 5: "a b"}
    assert mine_templates(rows.limit(0)).count() == 0
