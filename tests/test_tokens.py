"""Token lines against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from nightjar.operators import tokens


def _lay(words, length, most):
    out, line, held = [], "tokens: ", False
    for w in words:
        if len(out) == most:
            break
        joined = line + (" " if held else "") + w
        if len(joined) <= length:
            line, held = joined, True
            continue
        if held:
            out.append(line)
            line, held = "", False
            if len(out) == most:
                break
        if len(w) > length - len(line):
            out.append(line + w[: length - len(line) - 1] + "…")
            line = ""
        else:
            line, held = line + w, True
    return [*out, line] if held and len(out) < most else out


@pytest.mark.parametrize("length", [20, 31])
def test_lines_against_a_loop(spark, length):
    draw = random.Random(length)
    cases = [["x" * draw.choice([1, 3, 8, 12, 19, 22, 40]) for _ in range(draw.randint(0, 9))] for _ in range(150)]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, words array<string>")
    for r in frame.select("i", tokens.token_lines(F.col("words"), length).alias("got")).collect():
        assert r.got == _lay(cases[r.i], length, 2), cases[r.i]


def test_what_is_readable(spark):
    cases = {"deadbeef": False, "x-deadbeef9-y": False, "12345678": True, "deadbee": True, "7-12345678": False, "12-34": True, "1.2.3.4:123456789": True, "(1.2.3.4:123456789),": True, "300.2.3.4:123456789": False, "[fe80::1]:123456789": True, "gdeadbeefg": False, "user": True}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", tokens.readable(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == cases


def test_first_templates_and_trimmed_repeats(spark):
    rows = [("h", i, f"t{i % 8}", f"sshd[{i}]: word{i % 8} user, user (user) common#011tab") for i in range(30)] + [("h", 99, None, "lost"), ("g", 1, "a", None), ("k", 1, "a", "p: deadbeef01"), ("n", 1, "a", "no tag here: x")]
    got = {r.h: (r.tokens, r.lines) for r in tokens.distil(spark.createDataFrame(rows, "h string, n int, template string, message string"), ["h"], ["n"]).collect()}
    assert got["h"][0] == ["word0", "user,", "common", "tab", "word1", "word2", "word3", "word4", "word5"]
    assert got["h"][1] == ["tokens: word0 user, common tab word1 word2 word3 word4 word5"]
    assert got["k"] == ([], []) and got["n"][0] == ["no", "tag", "here:", "x"] and set(got) == {"h", "k", "n"}
