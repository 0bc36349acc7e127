"""Registry of checked queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.plans.marts import Marts
from tallyloom.session import SETTINGS, ship_package
from tallyloom.sources.warehouse import Warehouse

CTES: dict[str, str] = {}


@dataclass(frozen=True)
class Case:
    build: Callable[[Marts], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def add_case(name: str, build: Callable[[Marts], DataFrame], sql: str | None = None) -> None:
    if name in CASES:
        raise ValueError(f"registered twice: {name}")
    CASES[name] = Case(build, sql)


def case(name: str, sql: str | None = None):
    def keep(build):
        add_case(name, build, sql)
        return build

    return keep


def with_ctes(sql: str) -> str:
    """Put the shared CTEs a check needs in front of it, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    need(sql)
    if not ordered:
        return sql
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    return f"WITH {heads}\n{sql}"


def present(df: DataFrame) -> DataFrame:
    """Result types every client reads the same way: DECIMAL as double, small integers as bigint."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        out.append(col.alias(f.name))
    return df.select(*out)


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def runner(one: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(one.build(Marts(Warehouse(prepared(spark), sf_dir))))

    return run
