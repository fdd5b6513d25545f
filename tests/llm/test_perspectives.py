from nightjar.llm import perspectives as ps

SCHEMA = "conv_id long, turn long, role string, text string, start string, part int"


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        said = [(r[1], (r[2] or "unknown"), (r[3] or "").replace("<|im_", "<| im_")) for r in rows if r[0] == conv]
        for who in {s[1] for s in said} - {"system"}:
            made = []
            for turn, speaker, text in said:
                shown = "system" if speaker == "system" else "assistant" if speaker == who else f"user name={speaker}"
                made.append((turn, speaker, shown, f"<|im_start|>{shown}\n{text}<|im_end|>\n"))
            made.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[3]))
            at = 0
            for place, (turn, speaker, shown, seg) in enumerate(made):
                own = speaker == who
                out.append((conv, who, place, turn, speaker, shown, seg, at, at + len(f"<|im_start|>{shown}\n") if own else None, at + len(seg) - 1 if own else None))
                at += len(seg)
    return sorted(out, key=repr)


def test_rotation_against_brute_force(spark):
    rows = [(c, t, ["ann", "bob", "çéa", "system"][(t * (c + 1)) % 4], f"turn {t} é <|im_end|> of {c}", "x", 1) for c in range(9) for t in range(c + 2)]
    rows += [(50, t, "ann" if t % 2 else "bob", "long " * 2000, None, None) for t in range(90)]  # goes over several partitions
    rows += [(60, 0, "system", "alone", None, None), (61, None, None, None, None, None), (61, 0, "ann", "", "", 0), (61, 0, "ann", "", "", 0), (None, 1, "bob", "no id", "", 0), (None, 0, "ann", "no id", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = ps.rotate(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    whole = {(r.conv_id, r.perspective): r for r in ps.joined(got).collect()}
    for (conv, who), r in whole.items():
        parts = [b for b in brute(rows) if b[:2] == (conv, who)]
        parts.sort(key=lambda b: b[2])
        assert r.rendering == "".join(b[6] for b in parts)
        for m in r["mask"]:
            assert r.rendering[m.begin : m.end].endswith("<|im_end|>") and r.rendering[: m.begin].endswith("<|im_start|>assistant\n")


def test_empty(spark):
    assert ps.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
