"""Query registry: each query stands next to the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinlabel.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name, with its SQL if it has one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The white space class of twinlabel.constants, in the notation of the SQL engine.
SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_norm(expr: str) -> str:
    return (
        f"trim(regexp_replace(translate(lower(coalesce({expr}, '')), '-_×', '  x'), "
        f"'{SQL_SPACE}+', ' ', 'g'))"
    )


def sql_tokens(expr: str) -> str:
    return (
        f"list_distinct(list_filter(string_split({sql_norm(expr)}, ' '), lambda t: t <> ''))"
    )
