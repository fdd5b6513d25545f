"""Registered access-decision queries over system-log messages that Spark writes from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import auth
from nightjar.plans.projections import _events, with_lanes
from nightjar.registry import register
from nightjar.sources import access

_U, _A = "'u' || (user_id % 15)", "'198.51.100.' || (k % 8 + 1)"
#: program, message (SQL), and what is to be read from it: producer, kind, outcome, gate, actor, namespace, target, source, counted
FORMS = (
    ("sshd", f"'sshd[*]: Accepted publickey for ' || {_U} || ' from ' || {_A} || ' port 22 ssh2'", "sshd_text", "accepted", "granted", "sshd", _U, "unix_user", None, _A, True),
    ("sshd", f"'sshd[*]: Failed password for invalid user \"' || {_U} || '\" from ' || {_A} || ' port 22 ssh2'", "sshd_text", "failed-invalid-user", "denied", "sshd", _U, "preauth_username", None, _A, True),
    ("sshd-session", f"'sshd-session[*]: Failed password for ' || {_U} || ' from ' || {_A} || ' port 22'", "sshd_text", "failed-password", "denied", "sshd", _U, "unix_user", None, _A, True),
    ("sshd", f"'sshd[*]: Invalid user ' || {_U} || ' from ' || {_A} || ' port 22'", "sshd_text", "invalid-user", "indeterminate", "sshd", _U, "preauth_username", None, _A, False),
    ("sshd", f"'sshd[*]: Connection closed by ' || {_A} || ' port 22 [preauth]'", "sshd_text", "connection-closed", "indeterminate", "sshd", None, None, None, _A, False),
    ("dropbear", f"'dropbear[*]: Exit before auth from <' || {_A} || ':4711>: Exited normally'", "pam_text", "exit-before-auth", "indeterminate", "dropbear", None, None, None, _A, False),
    ("sudo", f"'sudo: ' || {_U} || ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls'", "pam_text", "sudo-grant", "granted", "sudo", _U, "unix_user", "'root'", None, True),
    ("sudo", f"'sudo: ' || {_U} || ' : user NOT in sudoers ; TTY=pts/0 ; USER=root ; COMMAND=/bin/ls'", "pam_text", "sudo-denial", "denied", "sudo", _U, "unix_user", None, None, False),
    ("sudo", f"'sudo[*]: pam_unix(sudo:session): session opened for user root(uid=0) by ' || {_U} || '(uid=1000)'", "pam_text", "session-opened", "granted", "sudo", _U, "unix_user", "'root'", None, False),
    ("su", f"'su[*]: FAILED SU (to root) ' || {_U} || ' on pts/1'", "pam_text", "failed-su", "denied", "su", _U, "unix_user", "'root'", None, True),
    ("sshd", f"'sshd[*]: pam_unix(sshd:auth): authentication failure; logname= uid=0 tty=ssh ruser= rhost=' || {_A} || '  user=' || {_U}", "pam_text", "authentication-failure", "denied", "sshd", _U, "unix_user", None, _A, True),
    ("--", f"'-- ' || {_U} || '[*]: ROOT LOGIN ON tty1'", "pam_text", "root-login-grant", "granted", "login", _U, "unix_user", None, None, True),
    ("audisp-syslog", f"'audisp-syslog[*]: type=USER_AUTH msg=audit(17.5:' || (k % 20) || '): pid=7 auid=4294967295 msg=''op=PAM acct=\"' || {_U} || '\" exe=\"/usr/sbin/sshd\" addr=' || {_A} || ' terminal=ssh res=failed'''", "audisp_type", "USER_AUTH", "denied", "audit", _U, "unix_user", None, _A, True),
    ("audit", f"'audit: AUDIT1100 msg=audit(17.5:' || (k % 20) || '): auid=1000 acct=\"' || {_U} || '\" exe=\"/usr/sbin/sshd\" addr=' || {_A} || ' res=failed'", "audit_typeless", "AUDIT1100", "denied", "audit", _U, "unix_user", None, _A, True),
    ("audit", "'audit: SYSCALL msg=audit(17.5:9): auid=1000 res=success'", "audit_typeless", "SYSCALL", "granted", "audit", "'1000'", "unix_auid", None, None, False),
    ("cron", "'cron[*]: Accepted password for root from 198.51.100.9 port 22'", "unclassified/non-auth", "other", None, None, None, None, None, None, False),
)
_N = len(FORMS)


def _case(at: int, quoted: bool = False) -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if quoted else str(x)
    return f"CASE event_id % {_N} " + " ".join(f"WHEN {i} THEN {value(f[at])}" for i, f in enumerate(FORMS)) + " END"


def lines(spark, sf_dir, host="user_id % 5"):
    e = _events(spark, sf_dir)
    return e.select(F.col("event_id").alias("row_id"), "ts", F.expr(f"if(event_id % 3 = 0, 'BOX', 'box') || ({host})").alias("host"), F.expr(_case(0, True)).alias("program"), F.expr(_case(1)).alias("message"))


_READ = f"""x AS (SELECT event_id AS row_id, ts, CASE WHEN event_id % 3 = 0 THEN 'BOX' ELSE 'box' END || (user_id % 5) AS host, {_case(2, True)} AS producer, {_case(3, True)} AS kind, {_case(4, True)} AS outcome, {_case(5, True)} AS gate, {_case(6)} AS actor,
  {_case(7, True)} AS actor_namespace, {_case(8)} AS target, {_case(9)} AS source, {_case(10)} AS counted, CASE WHEN event_id % {_N} IN (12, 13) THEN '17.5:' || (k % 20) WHEN event_id % {_N} = 14 THEN '17.5:9' END AS event_id FROM e0)"""


@register("auth_extract", with_lanes(f"{_READ} SELECT row_id, outcome, gate, actor, actor_namespace, target, source FROM x", "conn"))
def auth_extract(spark, sf_dir):
    return access.access_decisions(lines(spark, sf_dir)).select("row_id", "outcome", "gate", "actor", "actor_namespace", "target", "source")


@register("auth_structure", with_lanes(f"{_READ} SELECT producer, kind, counted, count(*) AS rows, count(event_id) AS with_event FROM x GROUP BY ALL", "conn"))
def auth_structure(spark, sf_dir):
    return access.access_decisions(lines(spark, sf_dir)).groupBy("producer", "kind", "counted").agg(F.count("*").alias("rows"), F.count("event_id").alias("with_event"))


_COUNTED = f"""{_READ}, c AS (SELECT * FROM x WHERE counted), a AS (SELECT *, lower(host) AS h FROM c WHERE producer LIKE 'audi%'),
  s AS (SELECT h, actor, source, count(DISTINCT event_id) FILTER (producer = 'audisp_type') AS n, count(DISTINCT event_id) FILTER (producer <> 'audisp_type') AS m FROM a GROUP BY ALL),
  w AS (SELECT a.*, row_number() OVER (PARTITION BY h, actor, source, event_id ORDER BY ts, row_id) AS r FROM a JOIN s USING (h, actor, source) WHERE (producer = 'audisp_type') = (n >= m)),
  d AS (SELECT row_id, ts, host, producer, outcome, actor, actor_namespace, source FROM c WHERE producer NOT LIKE 'audi%' UNION ALL SELECT row_id, ts, host, producer, outcome, actor, actor_namespace, source FROM w WHERE r = 1)"""


@register("auth_audit_reconcile", with_lanes(f"{_COUNTED} SELECT row_id, producer FROM d", "conn"))
def auth_audit_reconcile(spark, sf_dir):
    return access.counted_decisions(access.access_decisions(lines(spark, sf_dir))).select("row_id", "producer")


@register("endpoint_address", with_lanes(f"SELECT event_id AS row_id, {_A} AS plain, '2001:db8::' || (k % 8) AS bracketed, {_A} AS with_port, CASE WHEN k % 2 = 0 THEN 'name' END AS other FROM e0", "conn"))
def endpoint_address(spark, sf_dir):
    e = _events(spark, sf_dir)
    one = lambda sql: access.endpoint_address(F.expr(sql))
    return e.select(F.col("event_id").alias("row_id"), one(_A).alias("plain"), one("'[2001:db8::' || (k % 8) || ']:22'").alias("bracketed"), one(f"{_A} || ':22'").alias("with_port"), one("if(k % 2 = 0, '\"name\"', '?')").alias("other"))


@register("auth_findings", with_lanes(f"""{_COUNTED}, g AS (SELECT 'x' AS one, source, actor_namespace, actor, count(DISTINCT lower(host)) AS n, count(*) AS m FROM d WHERE outcome = 'denied' AND source IS NOT NULL AND actor IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lower(host)) >= 3),
  v AS (SELECT 'source_volume' AS signal, source AS identity, count(*) AS denials FROM d WHERE outcome = 'denied' AND source IS NOT NULL GROUP BY 2 HAVING count(*) >= 10),
  o AS (SELECT source, actor, (SELECT count(*) FROM v WHERE v.identity = g.source) AS overlaps FROM g)
  SELECT 'host_spread' AS signal, source || ' ' || actor_namespace || ' ' || actor AS identity, 'MEDIUM' AS severity, m AS denials, (SELECT count(*) FROM v WHERE v.identity = g.source) AS overlaps FROM g
  UNION ALL SELECT signal, identity, 'MEDIUM', denials, (SELECT count(*) FROM g WHERE g.source = v.identity) FROM v""", "conn"))
def auth_findings(spark, sf_dir):
    decisions = access.counted_decisions(access.access_decisions(lines(spark, sf_dir)))
    return auth.findings(decisions, concentration_least=10**9, spread_least=3, volume_least=10, signals=("host_spread", "source_volume"), by_day=False).select("signal", "identity", "severity", "denials", "overlaps")


_SAME = "l.host = c.host AND l.gate = c.gate AND l.source IS NOT DISTINCT FROM c.source AND l.actor IS NOT DISTINCT FROM c.actor AND l.ns IS NOT DISTINCT FROM c.ns"


@register("auth_findings_all", with_lanes(f"""{_COUNTED.replace("(user_id % 5)", "(event_id % 7 % 5)")}, q AS (SELECT d.ts, lower(d.host) AS host, x.gate, d.outcome, d.source, d.actor, CASE WHEN d.actor IS NOT NULL THEN coalesce(d.actor_namespace, 'unscoped') END AS ns FROM d JOIN x USING (row_id) WHERE d.source IS NOT NULL OR d.actor IS NOT NULL),
  n AS (SELECT * FROM q WHERE outcome = 'denied'), f AS (SELECT greatest(1, ceil(greatest(1, (max(ts) - min(ts)) / 86400))) AS least FROM d),
  con AS (SELECT host, gate, source, actor, ns, count(*) AS denials FROM n GROUP BY ALL HAVING count(*) >= 4),
  b AS (SELECT host, gate, source, actor, ns, ts, count(*) FILTER (outcome = 'denied') AS denied, count(*) FILTER (outcome = 'granted') AS granted FROM q GROUP BY ALL),
  i AS (SELECT *, coalesce(sum((granted > 0)::INTEGER) OVER (PARTITION BY host, gate, source, actor, ns ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM b),
  lan AS (SELECT host, gate, source, actor, ns, sum(denied)::BIGINT AS denials FROM i GROUP BY host, gate, source, actor, ns, island HAVING sum(denied) >= 1 AND max(granted) > 0 AND NOT max(granted > 0 AND denied > 0)),
  g AS (SELECT source, ns, actor, count(*) AS denials FROM n WHERE source IS NOT NULL AND actor IS NOT NULL GROUP BY ALL HAVING count(DISTINCT host) >= 2),
  sv AS (SELECT source, count(*) AS denials FROM n WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM con WHERE source IS NOT NULL) GROUP BY source HAVING count(*) >= (SELECT least FROM f)),
  av AS (SELECT ns, actor, count(*) AS denials FROM n WHERE actor IS NOT NULL AND (ns || ' ' || actor) NOT IN (SELECT ns || ' ' || actor FROM con WHERE actor IS NOT NULL) GROUP BY ALL HAVING count(*) >= (SELECT least FROM f))
  SELECT 'concentration' AS signal, concat_ws(' ', host, gate, source, actor) AS identity, 'MEDIUM' AS severity, denials, 0::BIGINT AS landings, 0::BIGINT AS overlaps FROM con AS c ANTI JOIN lan AS l ON {_SAME}
  UNION ALL SELECT 'landing', concat_ws(' ', host, gate, source, actor), 'MEDIUM', denials, 0, 0 FROM lan AS l ANTI JOIN g ON l.source = g.source AND l.ns = g.ns AND l.actor = g.actor
  UNION ALL SELECT 'host_spread', concat_ws(' ', source, ns, actor), 'MEDIUM', denials, (SELECT count(*) FROM lan AS l WHERE l.source = g.source AND l.ns = g.ns AND l.actor = g.actor),
    (SELECT count(*) FROM sv WHERE sv.source = g.source) + (SELECT count(*) FROM av WHERE av.ns = g.ns AND av.actor = g.actor) FROM g
  UNION ALL SELECT 'source_volume', source, 'MEDIUM', denials, 0, (SELECT count(*) FROM g WHERE g.source = sv.source) FROM sv
  UNION ALL SELECT 'account_volume', concat_ws(' ', ns, actor), 'MEDIUM', denials, 0, (SELECT count(*) FROM g WHERE g.ns = av.ns AND g.actor = av.actor) FROM av""", "conn"))
def auth_findings_all(spark, sf_dir):
    decisions = access.counted_decisions(access.access_decisions(lines(spark, sf_dir, "event_id % 7 % 5")))
    return auth.findings(decisions, concentration_least=4, landing_least=1, spread_least=2, volume_least=1)
