"""Query catalog: a Spark callable and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views, with_views
from equilens.session import configure


@dataclass
class Query:
    spark: Callable[[Views], DataFrame]
    sql: str | None
    reads: tuple[str, ...] = ()
    digits: dict[str, int] = field(default_factory=dict)
    extra: dict | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.spark(Views(configure(spark), sf_dir))
        return df.select(
            *[(F.round(F.col(c), self.digits[c]) if c in self.digits else F.col(c)).alias(c) for c in df.columns]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        if self.digits:
            kept = ", ".join(f"round({c}, {n}) AS {c}" for c, n in self.digits.items())
            body = f"SELECT * REPLACE ({kept}) FROM ({body})"
        return f"{with_views(self.reads, self.extra)}\n{body}".strip()


CATALOG: dict[str, Query] = {}


def query(name: str, spark, sql: str | None, *reads: str, extra=None, **digits: int) -> None:
    if name in CATALOG:
        raise ValueError(name)
    CATALOG[name] = Query(spark, sql, reads, digits, extra)
