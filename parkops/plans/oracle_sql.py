"""Oracle SQL (DuckDB dialect) for every registered query that SQL can state.

Written from the semantics in SURVEY §2, independently of the DataFrame code.
Rules: sums of money as DECIMAL(18,2); conditional counts as BIGINT; every
computed column aliased to the engine's name.
"""

from __future__ import annotations

from parkops.plans import oracle_inputs  # noqa: F401  (registers input CTEs)
from parkops.plans.oracle_views import with_views

SQL: dict[str, str] = {}


def oracle(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    SQL[name] = with_views(sql.strip(), extra)


def _load_all() -> None:
    from parkops.plans import o_boards, o_quality, o_reports, o_transforms  # noqa: F401


_load_all()
