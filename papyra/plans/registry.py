"""Registered queries, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.operators.relate import latest
from papyra.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: The current rows of the tables that hold repeated and late ones.
CURRENT = {
    "p": "p as (select * from papers qualify row_number() over (partition by id order by ingested_at desc) = 1)",
    "q": "q as (select distinct * from questions)",
    "o": "o as (select distinct * from options)",
    "a": "a as (select distinct * from answers)",
    "b": "b as (select * from source_blocks qualify row_number() over (partition by id order by ingested_at desc) = 1)",
    "t": "t as (select * from translations qualify row_number() over (partition by path, paragraph_id, source_hash order by translated_at desc nulls last) = 1)",
}


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
        """Register a query; ``uses`` names the CURRENT tables its SQL reads."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                ctes = ", ".join(CURRENT[u] for u in uses)
                bare = sql.lstrip()
                head = next((x for x in ("with recursive ", "with ") if bare.startswith(x)), "")
                self.sql[f.__name__] = f"{head or 'with '}{ctes}{', ' if head else ' '}{bare[len(head):]}" if uses else sql
            return f

        return add


def current(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A corpus table without repeated rows; of late versions the last.

    Rows of one key are copies but for their arrival time (``conflicting_copies`` lists keys for which
    that does not hold), so one row a key is taken, by key alone: columns that a query does not use are
    pruned down to the scan and never shuffled.
    """
    df = table(spark, sf, name)
    if name in ("papers", "source_blocks"):
        return latest(df, ["id"], ["ingested_at"], same_ties=True)
    if name == "translations":
        return latest(df, ["path", "paragraph_id", "source_hash"], ["translated_at"], same_ties=True)
    return df.dropDuplicates(["question_id" if name == "answers" else "id"])
