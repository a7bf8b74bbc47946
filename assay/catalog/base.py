"""How registered queries are declared: a table, an input expression that both engines read, an operator, and its meaning in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Key column of each table.
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def samples(*values: str | None, key: str = "c_custkey") -> str:
    """One of the values by key."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else quoted(v)}" for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


def either(a: str, b: str, key: str = "c_custkey") -> str:
    """``a`` for even keys, ``b`` for odd ones."""
    return f"CASE WHEN {key} % 2 = 0 THEN {a} ELSE {b} END"


def nines(width: int = 9, step: int = 7919, key: str = "c_custkey") -> str:
    """That many digits made from the key."""
    return f"lpad(cast(({key} * {step}) % {10**width} as string), {width}, '0')"


def shifted(text: str, key: str = "c_custkey") -> str:
    """``text`` by half of the key, so that ``either`` meets all values of a CASE over it."""
    return text.replace(f"CASE {key} %", f"CASE cast(floor({key} / 2) as bigint) %")


def sql(source: str, key: str, value: str, result: str, name: str) -> str:
    """The oracle's frame: x the input, t trimmed, u trimmed in capitals, d its digits."""
    return f"""
        SELECT k AS {key}, x AS input, {result} AS {name} FROM (
            SELECT k, x, trim(x) AS t, upper(trim(x)) AS u, regexp_replace(x, '[^0-9]', '', 'g') AS d
            FROM (SELECT {key} AS k, {value} AS x FROM {source}))
    """


def weighted(over: str, weights: list[int]) -> str:
    return " + ".join(f"{w} * cast(substr({over}, {k + 1}, 1) AS INT)" for k, w in enumerate(weights))


def full(over: str, pattern: str) -> str:
    return f"regexp_full_match({over}, {quoted(pattern)})"


def checked(test: str, then: str) -> str:
    """``then`` only where ``test`` holds, else false."""
    return f"coalesce(CASE WHEN {test} THEN {then} ELSE false END, false)"


def luhn(over: str) -> str:
    """The mod-10 sum over a text known to be digits."""
    part = f"cast(substr({over}, length({over}) - i, 1) AS INT)"
    return f"list_sum(list_transform(range(0, length({over})), lambda i: CASE WHEN i % 2 = 0 THEN {part} WHEN {part} > 4 THEN 2 * {part} - 9 ELSE 2 * {part} END)) % 10 = 0"


def one_of(over: str, values: list[str]) -> str:
    return f"coalesce({over} IN ({', '.join(map(quoted, values))}), false)"


def column_query(name: str, source: str, value: str, test: Callable, result: str, out: str = "ok") -> None:
    """Register ``test(input column)`` over a table under a name, with its SQL."""
    key = KEYS[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(F.col(key), F.expr(value).alias("input"))
        return rows.withColumn(out, test(F.col("input")))

    QUERIES[name] = run
    ORACLES[name] = sql(source, key, value, result, out)
