"""Readable tokens of a group's messages, in the order in which they are first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Templates looked at, characters of a line, lines, marks around an address, and the escapes that stand for white space.
TEMPLATES, LENGTH, LINES = 6, 200, 2
TRIMMED, ESCAPES = "()[]{}<>.,;:'\"", "#011|#012|#015"
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# An address alone has no run of eight digits or hex digits, so only one with a port needs to be told from an opaque token.
_WITH_PORT = rf"^[(){{}}<>.,;:'\"\[\]]*({_OCTET}(\.{_OCTET}){{3}}:\d+|\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]:\d+)[(){{}}<>.,;:'\"\[\]]*$"
_OPAQUE = r"(?<![0-9A-Fa-f])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{8,}(?![0-9A-Fa-f])"


def strip_program(body: Column) -> Column:
    """A body without its leading `program:` or `program[id]:`."""
    return F.regexp_replace(F.regexp_replace(body, r"^\s*[^\[:\s]+(\[[^\]]*\])?:", ""), r"^\s+|\s+$", "")


def readable(token: Column) -> Column:
    """Whether a token says something: an address, or neither an opaque hex run nor several numbers with one of eight digits or more."""
    composite = token.rlike("[0-9]{8,}") & token.rlike("[0-9][^0-9]+[0-9]")
    return token.rlike(_WITH_PORT) | ~(token.rlike(_OPAQUE) | composite)


def _once(tokens: Column) -> Column:
    """Tokens whose trimmed form hasn't been seen before, in order; one group has few."""
    bare = lambda t: F.btrim(t, F.lit(TRIMMED))
    keys = F.transform(tokens, bare)
    return F.filter(tokens, lambda t, i: F.array_position(keys, bare(t)) == i + 1)


def token_lines(tokens: Column, length: int = LENGTH, lines: int = LINES) -> Column:
    """Tokens laid in lines of at most `length` characters, the first headed `tokens: `; one that fits in no line is cut with an ellipsis."""
    text, no = F.lit("tokens: "), F.array().cast("array<string>")

    def step(s: Column, t: Column) -> Column:
        sep = F.when(s["has"], F.lit(" ")).otherwise(F.lit(""))
        fits = F.length(s["line"]) + F.length(sep) + F.length(t) <= length
        kept = F.when(s["has"], F.array_append(s["lines"], s["line"])).otherwise(s["lines"])
        rest = F.when(s["has"], F.lit("")).otherwise(s["line"])
        room = F.lit(length) - F.length(rest)
        full, cut = F.size(kept) >= lines, F.length(t) > room
        short = F.concat(rest, F.substr(t, F.lit(1), room - 1), F.lit("…"))
        state = lambda a, b, c: F.struct(a.alias("lines"), b.alias("line"), c.alias("has"))
        over = F.when(full, state(kept, F.lit(""), F.lit(False))).when(cut, state(F.array_append(kept, short), F.lit(""), F.lit(False))).otherwise(state(kept, F.concat(rest, t), F.lit(True)))
        return F.when(F.size(s["lines"]) >= lines, s).when(fits, state(s["lines"], F.concat(s["line"], sep, t), F.lit(True))).otherwise(over)

    start = F.struct(no.alias("lines"), text.alias("line"), F.lit(False).alias("has"))
    done = lambda s: F.when(s["has"] & (F.size(s["lines"]) < lines), F.array_append(s["lines"], s["line"])).otherwise(s["lines"])
    return F.aggregate(tokens, start, step, done)


def distil(rows: DataFrame, keys: list[str], order: list[str], template: str = "template", message: str = "message", most: int = TEMPLATES) -> DataFrame:
    """(keys, tokens, lines): distinct readable tokens of the first message of each of a group's first `most` templates.

    The first of a template is an aggregate, and only `most` messages of a group come together. Rows without template or message don't count;
    a group with no readable token has empty arrays. order: columns that decide what is first, ending with one that is unique.
    """
    said = rows.filter(F.col(template).isNotNull() & F.col(message).isNotNull())
    first = said.groupBy(*keys, template).agg(F.min(F.struct(*order, message)).alias("_f"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_f", template))
    few = first.withColumn("_r", place).filter(F.col("_r") <= most)
    held = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.col("_f")[message].alias("m")))).alias("_m"))  # at most `most` messages
    words = lambda m: F.split(strip_program(F.regexp_replace(m, ESCAPES, " ")), r"\s+")
    tokens = F.filter(F.flatten(F.transform("_m", lambda m: words(m["m"]))), lambda t: (t != "") & readable(t))
    return held.withColumn("tokens", _once(tokens)).withColumn("lines", token_lines(F.col("tokens"))).select(*keys, "tokens", "lines")
