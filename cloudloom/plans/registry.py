"""All queries of this package by name, and SQL that says the same.

A query takes (spark, folder of the tables).  Floats are rounded to six digits
on both sides.  SQL reads the tables by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: The point views in SQL.
EMB = """WITH raw AS (
  SELECT vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS intensity,
    embedding[5]::DOUBLE AS a, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS c, label FROM embeddings
), p AS (
  SELECT idx, x, y, z, intensity, a / sqrt(a * a + b * b + c * c) AS nx, b / sqrt(a * a + b * b + c * c) AS ny, c / sqrt(a * a + b * b + c * c) AS nz, label FROM raw
)"""
EVT = """WITH p AS (
  SELECT event_id AS idx, event_id // 100 AS "row", event_id % 100 AS col, (event_id % 100)::DOUBLE AS x, (event_id // 100)::DOUBLE AS y, value AS z FROM events
)"""
LINE = "WITH p AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(column: Column | str, name: str | None = None) -> Column:
    """To six digits, without a negative zero."""
    out = F.round(column, 6) + F.lit(0.0)
    return out.alias(name or column) if name or isinstance(column, str) else out


def r6(sql: str, name: str) -> str:
    """The same in SQL."""
    return f"round({sql}, 6) + 0 AS {name}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def least_axis(table: str, entries: tuple[str, ...] = ("xx", "xy", "xz", "yy", "yz", "zz")) -> str:
    """CTEs up to `axis`: the table with v, the smallest eigenvalue of its symmetric matrices, and the eigenvector vx, vy, vz of no given sign or length.

    The root of the characteristic polynomial comes by Newton's steps from 0, below
    which a covariance matrix has none; the vector is the longest column of the adjugate.
    """
    xx, xy, xz, yy, yz, zz = entries
    c1, c0 = f"({xx} * {yy} - {xy} * {xy} + {xx} * {zz} - {xz} * {xz} + {yy} * {zz} - {yz} * {yz})", f"({xx} * ({yy} * {zz} - {yz} * {yz}) - {xy} * ({xy} * {zz} - {yz} * {xz}) + {xz} * ({xy} * {yz} - {yy} * {xz}))"
    slope = "(3 * v * v - 2 * c2 * v + c1)"
    crosses = {"a": ("({xx} - v)", "{xy}", "{xz}", "{xy}", "({yy} - v)", "{yz}"), "b": ("({xx} - v)", "{xy}", "{xz}", "{xz}", "{yz}", "({zz} - v)"), "c": ("{xy}", "({yy} - v)", "{yz}", "{xz}", "{yz}", "({zz} - v)")}
    names = dict(xx=xx, xy=xy, xz=xz, yy=yy, yz=yz, zz=zz)
    parts = []
    for k, (a, b, c, d, e, f) in crosses.items():
        a, b, c, d, e, f = (t.format(**names) for t in (a, b, c, d, e, f))
        parts += [f"{b} * {f} - {c} * {e} AS j{k}x", f"{c} * {d} - {a} * {f} AS j{k}y", f"{a} * {e} - {b} * {d} AS j{k}z"]
    size = {k: f"j{k}x * j{k}x + j{k}y * j{k}y + j{k}z * j{k}z" for k in "abc"}
    pick = ", ".join(f"CASE WHEN {size['a']} >= greatest({size['b']}, {size['c']}) THEN ja{k} WHEN {size['b']} >= {size['c']} THEN jb{k} ELSE jc{k} END AS v{k}" for k in "xyz")
    return f"""poly AS (SELECT *, {xx} + {yy} + {zz} AS c2, {c1} AS c1, {c0} AS c0 FROM {table}),
root AS (SELECT *, list_reduce(list_transform(range(61), lambda k: k * 0.0::DOUBLE), lambda v, k: CASE WHEN {slope} <= 0 THEN v ELSE v - (((v - c2) * v + c1) * v - c0) / {slope} END) AS v FROM poly),
adjugate AS (SELECT *, {', '.join(parts)} FROM root), axis AS (SELECT *, {pick} FROM adjugate)"""
