"""A registered query, the SQL it must agree with, and the columns compared.

A column list names the output once for both engines, with a mark for how the
value is written so that equal results are equal text:
    name      as it is            name#    64-bit integer
    name@     ISO date string     name~k   double rounded to k digits
"""

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import functions as F

from .fixtures import Fixtures
from .oracle import with_clause

_RESERVED = re.compile(r'(?<!")\b(asof)\b(?!")')   # a column name, but a keyword in the oracle
_MARK = re.compile(r"^(\w+)(#|@|~(\d+))?$")


def _columns(spec: str):
    for word in spec.split():
        name, mark, digits = _MARK.match(word).groups()
        yield name, (mark or "")[:1], int(digits) if digits else 0


def shape_frame(df, spec):
    def shaped(name, mark, digits):
        c = F.col(name)
        if mark == "#":
            c = c.cast("long")
        elif mark == "@":
            c = c.cast("string")
        elif mark == "~":
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        return c.alias(name)
    return df.select(*[shaped(*c) for c in _columns(spec)])


def shape_sql(body, spec):
    def shaped(name, mark, digits):
        if mark == "#":
            return f"CAST({name} AS BIGINT) AS {name}"
        if mark == "@":
            return f"CAST({name} AS VARCHAR) AS {name}"
        if mark == "~":
            return f"ROUND(CAST({name} AS DOUBLE), {digits}) + 0.0 AS {name}"
        return name
    cols = ", ".join(shaped(*c) for c in _columns(spec))
    ctes = with_clause(body)
    lead = ctes + ",\n" if ctes else "WITH "
    text = f"{lead}answer AS (\n{body.strip()}\n)\nSELECT {cols} FROM answer"
    return _RESERVED.sub(r'"\1"', text)


@dataclass(frozen=True)
class Check:
    name: str
    spec: str
    build: Callable[[Fixtures], object]
    sql: str | None = None

    def frame(self, spark, sf_dir):
        return shape_frame(self.build(Fixtures(spark, sf_dir)), self.spec)

    def oracle(self):
        return None if self.sql is None else shape_sql(self.sql, self.spec)
