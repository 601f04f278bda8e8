"""Counting tables while their rows pass, without a scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Named metrics of tables, taken by the first job that reads them.

    Metrics in the last stage of a job are exact. In an earlier stage, tasks
    that run again because an executor was lost are counted again: where that
    matters, count the written table instead.
    """

    def __init__(self):
        self._seen: dict[str, tuple[Observation, DataFrame, dict[str, Column]]] = {}

    def __call__(self, name: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` with ``rows`` and the given aggregates attached."""
        if name in self._seen:
            raise ValueError(f"{name} is watched already")
        metrics = {"rows": F.count(F.lit(1)), **metrics}
        observation = Observation(f"starloom_{name}_{id(self)}")
        self._seen[name] = observation, df, metrics
        return df.observe(observation, *[metric.alias(alias) for alias, metric in metrics.items()])

    def result(self, name: str) -> dict:
        """The metrics of one table, to be asked for after a job that reads it has ended.

        Where the optimizer left the read out, as it does beside an empty
        table, the table is counted now.
        """
        observation, df, metrics = self._seen[name]
        if observation._jo.getRow().schema() is None:
            return df.agg(*[metric.alias(alias) for alias, metric in metrics.items()]).first().asDict()
        return observation.get


def digest_metrics(df: DataFrame) -> dict[str, Column]:
    """An order-free digest of all columns: equal tables, in any order and layout of files, have the same.

    The sum of a 64-bit hash of each row; nulls are told apart by their place. With
    the row count it shows loss, doubling or change of rows, not forgery.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    row = F.xxhash64(*names, *[c.isNull() for c in names])
    return {"digest": F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string")}
