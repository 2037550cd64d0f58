"""Named queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigscreen.sources.tables import read_named


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The tables of one folder, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_named(self.spark, self.folder, f"{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; its result is rounded and widened for comparison."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(lambda spark, folder: _plain(fn(Tables(spark, folder))), sql)
        return fn
    return add


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded to 6 places, so that two engines can agree."""
    def fix(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(f.name)
        return c
    return df.select(*[fix(f) for f in df.schema.fields])


# ---- SQL parts shared by the checks -----------------------------------------------

def r6(expr: str, name: str) -> str:
    return f"round(({expr})::double, 6) + 0.0 AS {name}"


def md5_of(*parts: str, seed: str | int = 0) -> str:
    cols = ", ".join(f"({p})::varchar" for p in parts)
    return f"md5(concat_ws('|', {cols}, '{seed}'))"


def psi(n: str) -> str:
    """Digamma of a positive number."""
    z = f"(({n})::double + 6.0)"
    parts = " ".join(f"- 1/(({n})::double + {i}.0)" for i in range(6))
    return (f"(ln({z}) - 1/(2*{z}) - 1/(12*pow({z},2)) + 1/(120*pow({z},4)) - 1/(252*pow({z},6)) "
            f"+ 1/(240*pow({z},8)) - 1/(132*pow({z},10)) {parts})")


def modal_sql(counts: str, key: str, cat: str, top: str, frac: str, entropy: str,
              extra: str = "") -> str:
    """One row per key from a table of (key, category, n); ties go to the smallest category."""
    return f"""SELECT {key}, max(CASE WHEN rk = 1 THEN {cat} END) AS {top},
      max(n)::double / sum(n)::double AS {frac},
      greatest(0.0, ln(sum(n)::double) - sum(n * ln(n::double)) / sum(n)::double) AS {entropy}
      {extra}
      FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {cat}) AS rk
            FROM {counts}) GROUP BY {key}"""


def mi_sql(counts: str, keys: str = "feature") -> str:
    """Mutual information from a table of (keys, x, y, n)."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {cols}, greatest(0.0, hx + hy - hxy) AS mi FROM
      (SELECT {keys}, ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double AS hxy
         FROM {counts} GROUP BY {keys}) a
      JOIN (SELECT {keys}, ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double AS hx
         FROM (SELECT {keys}, x, sum(n) AS n FROM {counts} GROUP BY {keys}, x)
         GROUP BY {keys}) b ON {same}
      JOIN (SELECT {keys}, ln(sum(n)::double) - sum(n*ln(n::double))/sum(n)::double AS hy
         FROM (SELECT {keys}, y, sum(n) AS n FROM {counts} GROUP BY {keys}, y)
         GROUP BY {keys}) c ON {same.replace('b.', 'c.')}"""


def knn_mi_ctes(cells: str, keys: str = "feature", k: int = 3) -> str:
    """CTEs ending in ``knn(keys, mi)`` from a table of (keys, id, y, x)."""
    ks = [s.strip() for s in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ks)
    cols = lambda a: ", ".join(f"{a}.{c}" for c in ks)
    noise = f"(('0x' || substr({md5_of('c.feature', 'c.id', seed='jitter')}, 1, 13))::bigint"
    noise += "::double / 4503599627370496.0 * 2 - 1)"
    gaps = ", ".join([f"x - lag(x, {i}) OVER w" for i in range(1, k + 1)]
                     + [f"lead(x, {i}) OVER w - x" for i in range(1, k + 1)])
    return f"""
    spread AS (SELECT {keys}, greatest(stddev_pop(x), avg(abs(x))) AS s FROM {cells} GROUP BY {keys}),
    noisy AS (SELECT {cols('c')}, c.id, c.y, c.x + (CASE WHEN s > 0
        THEN pow(2.0, round(log2(s * 1e-10))) ELSE 1e-10 END) * {noise} AS x
      FROM {cells} c JOIN spread ON {on('c', 'spread')}),
    sizes AS (SELECT {keys}, y, count(*) AS ny FROM noisy GROUP BY {keys}, y HAVING count(*) > 1),
    pts AS (SELECT noisy.*, ny FROM noisy JOIN sizes ON {on('noisy', 'sizes')} AND noisy.y = sizes.y),
    near AS (SELECT *, [{gaps}] AS gaps FROM pts
      WINDOW w AS (PARTITION BY {keys}, y ORDER BY x, id)),
    radius AS (SELECT {keys}, id, x,
      list_sort(list_filter(gaps, lambda g: g IS NOT NULL))[least({k}, ny - 1)]
        * (1 - 1e-10::double) AS r FROM near),
    marks AS (SELECT {keys}, id, x - r AS v, 0 AS kind, 0 AS w FROM radius
      UNION ALL SELECT {keys}, id, x, 1, 1 FROM radius
      UNION ALL SELECT {keys}, id, x + r, 2, 0 FROM radius),
    seen AS (SELECT {keys}, id, kind, sum(w) OVER (PARTITION BY {keys} ORDER BY v, kind) AS upto
      FROM marks),
    ms AS (SELECT {keys}, id, sum(CASE WHEN kind = 2 THEN upto WHEN kind = 0 THEN -upto END) AS m
      FROM seen GROUP BY {keys}, id),
    psim AS (SELECT {keys}, avg({psi('greatest(m, 1)')}) AS pm FROM ms GROUP BY {keys}),
    psiy AS (SELECT {keys}, sum(ny) AS n, sum(ny * {psi('ny')}) / sum(ny) AS py,
      sum(ny * {psi(f'least({k}, ny - 1)')}) / sum(ny) AS pk FROM sizes GROUP BY {keys}),
    knn AS (SELECT {cols('psim')}, greatest(0.0, {psi('n')} + pk - py - pm) AS mi
      FROM psim JOIN psiy ON {on('psim', 'psiy')})"""


def unpivot_sql(source: str, cols: list[str], keep: str, cast: str) -> str:
    """Long (keep, feature, x) rows of a table."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, ({c})::{cast} AS x FROM {source}" for c in cols)
