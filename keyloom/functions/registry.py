"""Functions by name, for SQL: the place where users add their own commands."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

_functions: dict[str, tuple[Callable, str]] = {}


def command(name: str, returns: str) -> Callable:
    """Registers a function of pandas Series, run on Arrow batches."""

    def keep(f: Callable) -> Callable:
        _functions[name] = (f, returns)
        return f

    return keep


def register_all(spark: SparkSession) -> list[str]:
    for name, (f, returns) in _functions.items():
        spark.udf.register(name, pandas_udf(f, returns))
    return sorted(_functions)


@command("reverse_key", "string")
def reverse_key(key: pd.Series) -> pd.Series:
    return key.str[::-1]
