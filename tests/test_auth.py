"""Findings of all five lenses on planted decisions."""

from nightjar.operators import auth


def test_five_lenses_with_missing_sources(spark):
    rows, at = [], 0

    def add(n, outcome, host, gate, source, space, actor):
        nonlocal at
        for _ in range(n):
            at += 1
            rows.append((float(at), outcome, host, gate, source, space, actor))

    add(8, "denied", "h1", "sudo", None, "unix", "ann")  # concentrated, then lands: the landing alone stays
    add(1, "granted", "h1", "sudo", None, "unix", "ann")
    add(9, "denied", "h1", "su", None, "unix", "bob")  # concentrated without a grant
    for host in ("h1", "h2", "h3"):  # a spread in one namespace takes the landings of that namespace alone
        add(4, "denied", host, "sshd", "s1", "unix", "cat")
    add(1, "granted", "h3", "sshd", "s1", "unix", "cat")
    add(4, "denied", "h4", "sshd", "s1", "ldap", "cat")
    add(1, "granted", "h4", "sshd", "s1", "ldap", "cat")
    frame = spark.createDataFrame(rows, "ts double, outcome string, host string, gate string, source string, actor_namespace string, actor string")
    got = {(r.signal, r.identity): (r.denials, r.landings, r.overlaps) for r in auth.findings(frame, concentration_least=8, landing_least=4, spread_least=3, volume_least=10).collect()}
    assert got == {
        ("landing", "h1 sudo ann"): (8, 0, 0),
        ("concentration", "h1 su bob"): (9, 0, 0),
        ("host_spread", "s1 unix cat"): (12, 1, 2),
        ("landing", "h4 sshd s1 cat"): (4, 0, 0),
        ("source_volume", "s1"): (16, 0, 1),
        ("account_volume", "unix cat"): (12, 0, 1),
    }


def test_rows_that_do_not_count_are_not_kept(spark, monkeypatch):
    """only counted rows are written where the lineage is cut."""
    from nightjar.plans.access import lines as said
    from nightjar.sources import access

    held, real = [], access.checkpointed
    monkeypatch.setattr(access, "checkpointed", lambda df: held.append(real(df)) or held[0])
    access.counted_decisions(access.access_decisions(said(spark, "/root/testdata/sf0.001")))
    assert {r.counted for r in held[0].select("counted").collect()} == {True}


def test_spread_and_volume_are_whole(spark):
    """rows without a source or an actor are no spread, a missing namespace is one, a tie is no landing, and a volume goes by day and by what a concentration covers."""
    rows, at = [], 0

    def add(n, outcome, host, source, space, actor, step=1):
        nonlocal at
        for _ in range(n):
            at += step
            rows.append((float(at), outcome, host, "sshd", source, space, actor))

    for host in ("h1", "H1", "h2", "h3"):
        add(2, "denied", host, None, "unix", "ann")
        add(2, "denied", host, "s1", None, None)
        add(2, "denied", host, "s2", None, "bob")
    add(9, "denied", "h4", "s3", "unix", "cat")  # covered by a concentration
    add(4, "denied", "h5", "s4", "unix", "dan")
    add(1, "granted", "h5", "s4", "unix", "dan")
    add(1, "denied", "h5", "s4", "unix", "dan", 0)  # at the instant of the grant
    add(1, "granted", "h9", "s9", "unix", "eve", 172_800)  # two days and some seconds
    frame = spark.createDataFrame(rows, "ts double, outcome string, host string, gate string, source string, actor_namespace string, actor string")
    assert [tuple(r) for r in auth.host_spread(frame).collect()] == [("s2", "unscoped", "bob", 3, 8)]
    limits = {"concentration_least": 9, "landing_least": 4, "volume_least": 3}
    got = {(r.signal, r.identity): (r.denials, r.landings, r.overlaps) for r in auth.findings(frame, **limits).collect()}
    volumes = {("source_volume", "s1"): (8, 0, 0), ("source_volume", "s2"): (8, 0, 1), ("account_volume", "unix ann"): (8, 0, 0), ("account_volume", "unscoped bob"): (8, 0, 1)}
    assert got == volumes | {("concentration", "h4 sshd s3 cat"): (9, 0, 0), ("host_spread", "s2 unscoped bob"): (8, 0, 2)}
