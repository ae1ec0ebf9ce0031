"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry wires the garage views of one driver folder into an operator with
the parameters used by the correctness check. Oracles live in oracle_sql.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parkops.sources.views import Garage

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# the same queries over any Garage (derived views or stored tables)
RAW: dict[str, Callable[[Garage], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[Garage], DataFrame]) -> Callable[[Garage], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Garage(spark, sf_dir))
        RAW[name] = fn
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from parkops.plans import q_boards, q_quality, q_reports, q_transforms  # noqa: F401


_load_all()
