"""Addresses and names: parsed and classified once a distinct value, and joined back."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.functions.frames import counted

HOME_NET = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
NOT_ROUTABLE = ("224.0.0.0/4", "169.254.0.0/16", "127.0.0.0/8", "0.0.0.0/32", "255.255.255.255/32")
_V4 = r"^(?:::ffff:)?((?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3})$"


def distinct_addresses(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per distinct address of the columns: address, version (4 or 6, null if it is none), number (IPv4), wide (IPv6, 32 hex digits).

    IPv4 is parsed by columns, an IPv4 address in IPv6 form counts as IPv4; the other addresses go through a pandas UDF.
    """
    found = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("address")).filter("address IS NOT NULL").distinct()
    quads = F.split(F.regexp_extract(F.lower("address"), _V4, 1), r"\.")
    found = found.withColumn("quads", F.transform(quads, lambda q: q.try_cast("long")))
    number = F.when(F.size("quads") == 4, F.aggregate("quads", F.lit(0).cast("long"), lambda a, q: a * 256 + q))
    found = found.withColumn("number", number).drop("quads")

    @F.pandas_udf("string")
    def wide(addresses: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            try:
                return None if value is None else format(int(ipaddress.IPv6Address(value)), "032x")
            except ValueError:
                return None

        return addresses.map(one)

    found = found.withColumn("wide", wide(F.when(F.col("number").isNull() & F.col("address").contains(":"), F.col("address"))))
    return found.withColumn("version", F.when(F.col("number").isNotNull(), 4).when(F.col("wide").isNotNull(), 6))


def in_network(network: str) -> Column:
    """Whether a row of `distinct_addresses` lies in the network; never across the two versions."""
    net = ipaddress.ip_network(network, strict=False)
    low, high = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return F.coalesce(F.col("number").between(low, high), F.lit(False))
    return F.coalesce(F.col("wide").between(format(low, "032x"), format(high, "032x")), F.lit(False))


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def address_facts(df: DataFrame, columns: Iterable[str], home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """`distinct_addresses` with local, non_routable (multicast, link-local, loopback, unspecified or broadcast) and external; null for what is no address."""
    parsed = distinct_addresses(df, columns)
    local = _any(in_network(n) for n in home_net)
    odd = _any(in_network(n) for n in (*NOT_ROUTABLE, "ff00::/8", "fe80::/10", "::1/128", "::/128"))
    known = F.col("version").isNotNull()
    faced = parsed.withColumns({"local": F.when(known, local), "non_routable": F.when(known, odd)})
    return faced.withColumn("external", known & ~F.col("local") & ~F.col("non_routable"))


def with_dimension(df: DataFrame, dimension: DataFrame, column: str, facts: list[str], name: str) -> DataFrame:
    """df with struct `name` of the dimension's row for the column's address; null where there is none."""
    side = dimension.select(F.col("address").alias("_address"), F.struct(*facts).alias(name))
    return df.join(side, F.col(column) == F.col("_address"), "left").drop("_address")


def classify_addresses(df: DataFrame, columns: str | Iterable[str], home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """The frame with `<column>_facts` for every column: struct(parsed, local, non_routable, external).

    The distinct addresses of all columns are parsed once and joined back, by broadcast if they are counted to be few.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    facts = counted(address_facts(df, columns, home_net).withColumn("parsed", F.col("version").isNotNull()))
    none = F.struct(F.lit(False).alias("parsed"), *[F.lit(None).cast("boolean").alias(c) for c in ("local", "non_routable")], F.lit(False).alias("external"))
    for c in columns:
        df = with_dimension(df, facts, c, ["parsed", "local", "non_routable", "external"], f"{c}_facts")
    return df.withColumns({f"{c}_facts": F.coalesce(F.col(f"{c}_facts"), none) for c in columns})


def label_score(label: Column) -> Column:
    """Weighted lexical suspicion of a DNS label; 0 for the empty label.

    1.5 * entropy / log2(36) + 0.5 * distinct share + digit share - 0.5 * vowel share - 0.3 * longest run share.
    Letters are counted as the runs of the sorted label. The label, its length and its counts are bound by transform(),
    so that they are worked out once a label and not wherever the formula names them.
    """
    runs = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)

    def score(t: Column) -> Column:
        s, n, counts = t["s"], t["n"], t["counts"]
        entropy = F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))
        digits, vowels = F.regexp_count(s, F.lit(r"\d")), F.regexp_count(s, F.lit("[aeiou]"))
        return 1.5 * entropy / F.lit(5.169925001442312) + 0.5 * F.size(counts) / n + digits / n - 0.5 * vowels / n - 0.3 * F.array_max(runs(s)) / n

    s = F.lower(F.coalesce(label, F.lit("")))
    bound = F.transform(F.array(s), lambda x: F.struct(x.alias("s"), F.length(x).cast("double").alias("n"), runs(F.array_join(F.sort_array(F.split(x, "")), "")).alias("counts")))
    return F.when(s == "", F.lit(0.0)).otherwise(F.get(F.transform(bound, score), F.lit(0)))


# Common public suffixes, wildcard and exception rules among them; `suffix_rules` reads a full list.
SUFFIXES = tuple(
    """com net org edu gov mil int info biz name io co me tv cc ai app dev xyz online site club shop top
    ar at au be bg br ca ch cl cn co cz de dk ee es eu fi fr gr hk hu id ie il in ir is it jp ke kr lt lu lv mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za
    co.uk org.uk ac.uk gov.uk ltd.uk me.uk net.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz ac.nz govt.nz
    co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br edu.br co.in net.in org.in ac.in gov.in firm.in com.cn net.cn org.cn gov.cn edu.cn ac.cn com.tr net.tr org.tr gov.tr edu.tr
    com.mx org.mx gob.mx com.ar gob.ar com.tw org.tw edu.tw com.hk org.hk com.sg edu.sg com.my co.za org.za ac.za co.kr or.kr ac.kr co.il org.il ac.il com.ua com.pl net.pl org.pl co.th ac.th go.th com.vn com.ph com.pk com.sa com.pe com.ve com.uy com.ng co.ke co.id or.id ac.id
    *.ck !www.ck *.bd *.kw *.np *.er *.fk *.jm *.kh *.mm *.pg""".split()
)


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule, kind) of public suffix rules: those of a list in the usual text format (a rule a line, // comments), or SUFFIXES."""
    lines = spark.read.text(path).select(F.regexp_extract(F.trim("value"), r"^(?!//)(\S+)", 1).alias("line")).filter("line <> ''") if path else spark.createDataFrame([(s,) for s in SUFFIXES], "line string")
    kind = F.when(F.col("line").startswith("!"), "exception").when(F.col("line").startswith("*."), "wildcard").otherwise("plain")
    return lines.select(F.regexp_replace(F.lower("line"), r"^(!|\*\.)", "").alias("rule"), kind.alias("kind")).distinct()


def name_domains(names: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Distinct names (column name) -> (name, labels, domain, suffix_labels, null without a rule): the registrable domain, one label more than the longest suffix rule.

    Without a rule, and for a bare suffix, it is the last label, so that a private namespace is one family. An exception
    rule goes before others. Outer white space, trailing dots and empty labels don't count; a name without labels has none.
    """
    rules = counted(rules if rules is not None else suffix_rules(names.sparkSession))
    labels = F.filter(F.split(F.regexp_replace(F.lower(F.trim("name")), r"\.+$", ""), r"\."), lambda x: x != "")
    named = names.select("name", labels.alias("labels"))
    tails = named.select("name", "labels", F.explode_outer(F.when(F.size("labels") > 0, F.sequence(F.lit(1), F.size("labels")))).alias("k"))
    tails = tails.withColumn("rule", F.array_join(F.slice("labels", F.size("labels") - F.col("k") + 1, F.col("k")), "."))
    met = tails.join(rules, "rule", "left")
    size = F.when(F.col("kind") == "plain", F.col("k")).when((F.col("kind") == "wildcard") & (F.col("k") < F.size("labels")), F.col("k") + 1)
    best = met.groupBy("name").agg(F.first("labels").alias("labels"), F.max(F.when(F.col("kind") == "exception", F.col("k") - 1)).alias("_exception"), F.max(size).alias("_size"))
    held = best.withColumn("_size", F.coalesce("_exception", "_size"))
    own = F.when(F.col("_size") < F.size("labels"), F.col("_size") + 1).otherwise(1)
    domain = F.when(F.size("labels") > 0, F.array_join(F.slice("labels", -F.coalesce(own, F.lit(1)), F.coalesce(own, F.lit(1))), "."))
    return held.select("name", "labels", domain.alias("domain"), F.col("_size").alias("suffix_labels"))


def with_domain(df: DataFrame, column: str, name: str = "domain", rules: DataFrame | None = None) -> DataFrame:
    """df with the registrable domain of a column's names, worked out once a distinct name."""
    found = counted(name_domains(df.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct(), rules).select(F.col("name").alias("_name"), F.col("domain").alias(name)))
    return df.join(found, F.col(column) == F.col("_name"), "left").drop("_name")
