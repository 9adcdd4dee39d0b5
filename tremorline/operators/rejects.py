"""Delimited rows that fail to parse, separated from the valid ones with the reason.

For every schema one anchored pattern for the whole row is generated from its fields. Rows that
match and whose values lie in range are valid. All others, and only they, pass through patterns of growing
prefixes of fields: first of fields that merely keep the rule of quotes, then of the fields of their schema.
The first prefix that fails gives the broken field and the reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks around a field, and the notations of a field.
BLANK = r"[ \t\r]*+"
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
STATION = r"[A-Za-z0-9]+\.[A-Za-z0-9]+"
DAY = r"[0-9]{4}/[0-9]{2}/[0-9]{2}"
#: The next field that keeps the rule of quotes, where the one before ended, and the comma behind it.
NEXT_FIELD = rf'\G((?:{BLANK}"[^"]*+(?:""[^"]*+)*+"{BLANK}|[^",]*+)),'


@dataclass(frozen=True)
class Field:
    """One field: its notation and, for numbers, its bounds (``above`` is exclusive)."""

    name: str
    pattern: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    above: float | None = None

    def parsed(self, text: str) -> str:
        """The value of the SQL expression ``text``, null if it is none."""
        if self.kind == "number":
            return f"try_cast({text} AS double)"
        return f"try_to_timestamp({text}, 'yyyy/MM/dd')" if self.kind == "day" else text

    def in_range(self, text: str) -> str:
        value = self.parsed(text)
        if self.kind == "text":
            return "true"
        bounds = [f"{value} {sign} {bound}" for bound, sign in ((self.low, ">="), (self.high, "<="), (self.above, ">")) if bound is not None]
        return f"coalesce({' AND '.join([f'{value} IS NOT NULL', *bounds])}, false)"


@dataclass(frozen=True)
class RowSchema:
    """Fields of one row format; ``ordered`` names pairs of fields of which the first must be less."""

    fields: tuple[Field, ...]
    ordered: tuple[tuple[str, str], ...] = ()

    def prefix(self, n: int) -> str:
        """The first ``n`` fields, anchored: up to a comma, or to the end for all fields."""
        one = [rf'{BLANK}(?:{f.pattern}|"(?:{f.pattern})"){BLANK}' for f in self.fields[:n]]
        return r"\A" + ",".join(one) + (r"\z" if n == len(self.fields) else r"(?=,)")


_NAME = Field("net_sta", STATION)
_PLACE = (Field("lat", NUMBER, "number", low=-90.0, high=90.0), Field("lon", NUMBER, "number", low=-180.0, high=180.0), Field("ele_m", NUMBER, "number"))
_THREE = tuple(Field(n, NUMBER, "number", above=0.0) for n in ("ge", "gn", "gz"))
#: The three station formats: one gain, three gains, three gains with their days.
STATION_ROWS = (
    RowSchema((_NAME, *_PLACE, Field("gain", NUMBER, "number", above=0.0))),
    RowSchema((_NAME, *_PLACE, *_THREE)),
    RowSchema((_NAME, *_PLACE, *_THREE, Field("t0", DAY, "day"), Field("t1", DAY, "day")), (("t0", "t1"),)),
)


def split_rows(lines: DataFrame, line_col: str, schemas: Sequence[RowSchema] = STATION_ROWS) -> DataFrame:
    """``lines`` with ``parts array<string>``, ``reason string`` and ``broken int``.

    Valid rows have a null reason and their unquoted fields in ``parts`` (null for failing rows). Failing rows have the reason:
    ``quoting`` if a field is neither free of double quotes nor stands wholly in them, else
    ``columns`` if no schema has so many fields, else ``value``; ``broken`` is the position (from 1) of
    the first broken field, for ``columns`` the first one missing or too many. Remarks (first
    non-blank character ``#``) are dropped. A null line is treated as an empty one: ``columns``.
    Other columns are kept as they are; columns of the added names are replaced.
    """
    rows = lines.withColumn("__line", F.coalesce(F.col(line_col), F.lit("")))
    rows = rows.where(~F.col("__line").rlike(r"\A\s*#"))
    # no notation of a field holds blanks, quotes or commas, so in a row that matches they can go
    rows = rows.withColumn("__cells", F.split(F.translate("__line", ' \t\r"', ""), ","))
    whole = [f"WHEN size(__cells) = {len(s.fields)} THEN {' AND '.join([_matches('__line', s.prefix(len(s.fields))), *[f.in_range(f'get(__cells, {i})') for i, f in enumerate(s.fields)], *_in_order(s, '__cells')])}" for s in schemas]
    valid = f"CASE {' '.join(whole)} ELSE false END" if schemas else "false"
    verdict = f"CASE WHEN coalesce({valid}, false) THEN {_why('NULL', 'NULL')} ELSE {_let('__line', 'l', _first_failure('l', schemas))} END"
    # a generated column, so that a filter on it does not make Spark evaluate it a second time
    rows = rows.select("*", F.explode(F.expr(f"array({verdict})")).alias("__why"))
    kept = [c for c in lines.columns if c not in ("parts", "reason", "broken")]
    return rows.select(*kept, F.when(F.col("__why.reason").isNull(), F.col("__cells")).alias("parts"), F.col("__why.reason").alias("reason"), F.col("__why.broken").alias("broken"))


def _part(i: int) -> Column:
    return F.get("parts", F.lit(i))


def _matches(text: str, pattern: str) -> str:
    return f"rlike({text}, r'{pattern}')"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _why(reason: str, broken: str) -> str:
    return f"named_struct('reason', CAST({reason} AS string), 'broken', CAST({broken} AS int))"


def _in_order(schema: RowSchema, cells: str) -> list[str]:
    at = {f.name: i for i, f in enumerate(schema.fields)}
    day = lambda name: schema.fields[at[name]].parsed(f"get({cells}, {at[name]})")
    return [f"coalesce({day(a)} < {day(b)}, false)" for a, b in schema.ordered]


def _first_failure(line: str, schemas: Sequence[RowSchema]) -> str:
    """Reason and broken field of a failing line, from the first prefix of fields that fails."""
    most = max((len(s.fields) for s in schemas), default=0)

    def by_schema(s: RowSchema) -> str:
        steps = [f"WHEN NOT {_matches(line, s.prefix(i + 1))} OR NOT {f.in_range(f'get(c, {i})')} THEN {_why(repr('value'), str(i + 1))}" for i, f in enumerate(s.fields)]
        return f"CASE {' '.join(steps)} ELSE {_why(repr('value'), str(len(s.fields)))} END"  # all prefixes match: the last field breaks the order

    # ``f``: the fields of the longest prefix that keeps the rule of quotes; it must be the whole line
    short = f"aggregate(f, size(f) - 1, (total, x) -> total + length(x)) < length({line})"
    plain = "transform(f, y -> translate(y, ' \\t\\r\"', ''))"
    cases = [f"WHEN {short} THEN {_why(repr('quoting'), 'size(f) + 1')}", *[f"WHEN size(f) = {len(s.fields)} THEN {_let(plain, 'c', by_schema(s))}" for s in schemas]]
    judged = f"CASE {' '.join(cases)} ELSE {_why(repr('columns'), f'least(size(f), {most}) + 1')} END"
    return _let(f"regexp_extract_all(concat({line}, ','), r'{NEXT_FIELD}', 1)", "f", judged)


def station_table(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """The valid rows of the three station formats: ``net_sta, lat, lon, ele_m, ge, gn, gz, t0, t1``.

    A single gain holds for all three channels; formats without dates have an open interval (null).
    Columns of ``lines`` are kept in front.
    """
    good = split_rows(lines, line_col).where("reason is null")
    n = F.size("parts")
    number = lambda i: _part(i).try_cast("double")
    day = lambda i: F.when(n == 9, F.try_to_timestamp(_part(i), F.lit("yyyy/MM/dd")))
    gain = lambda i: F.when(n == 5, number(4)).otherwise(number(i))
    return good.select(
        *[F.col(c) for c in lines.columns if c != line_col],
        F.upper(_part(0)).alias("net_sta"), number(1).alias("lat"), number(2).alias("lon"), number(3).alias("ele_m"),
        gain(4).alias("ge"), gain(5).alias("gn"), gain(6).alias("gz"), day(7).alias("t0"), day(8).alias("t1"),
    )
