"""Registry of the runnable queries: a Spark plan and, where SQL can say the same, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noonday.session import prepare

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    group: str


REGISTRY: dict[str, Query] = {}


def delivered(df: DataFrame, nullable: list[str]) -> DataFrame:
    """Result types both engines share: BIGINT, DOUBLE, STRING, BOOLEAN.

    Days and times leave as ISO text, doubles with six decimals, and whole numbers that may be missing as DOUBLE.
    """
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if field.name in nullable:
            c = c.cast("double")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "double":
            c = F.round(c, 6)
        out.append(c.alias(field.name))
    return df.select(*out)


def delivered_sql(sql: str, days: list[str], times: list[str], nullable: list[str], whole: list[str]) -> str:
    casts = [f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in days]
    casts += [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\"" for c in times]
    casts += [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in nullable]
    casts += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in whole]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n)" if casts else sql


def query(
    name: str, sql: str | None = None, days: str = "", times: str = "", nullable: str = "", whole: str = ""
) -> Callable[[Plan], Plan]:
    """Register ``plan`` under the operator name; ``sql`` is its DuckDB equivalent.

    ``days``, ``times``, ``nullable`` and ``whole`` name the result columns the SQL side has to cast.
    """

    def add(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return delivered(plan(prepare(spark), sf_dir), nullable.split())

        text = delivered_sql(sql, days.split(), times.split(), nullable.split(), whole.split()) if sql else None
        REGISTRY[name] = Query(name, run, text, plan.__module__.rsplit(".", 1)[-1])
        return plan

    return add
