"""Column-name grammar shared by the feature builders and the models.

``<target>_t+<steps>`` is a future target, ``<col>_lag<n>`` a lagged value and
``<col>_roll<w>_<stat>`` a trailing statistic.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUTURE_TOKEN = "_t+"
GAP_COLUMN = "gap"
_LAG = re.compile(r"_lag\d+$")


def target_column(target: str, steps: int) -> str:
    return f"{target}{FUTURE_TOKEN}{steps}"


def lag_column(column: str, steps: int) -> str:
    return f"{column}_lag{steps}"


def rolling_column(column: str, window: int, stat: str) -> str:
    return f"{column}_roll{window}_{stat}"


def is_lag(name: str) -> bool:
    return _LAG.search(name) is not None


def is_future(name: str) -> bool:
    return FUTURE_TOKEN in name


def ref(name: str) -> Column:
    """Reference a column whose name may hold ``+`` or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def rolling_mean_windows(columns: Iterable[str], target: str) -> list[int]:
    """Window sizes of the ``<target>_roll<w>_mean`` columns present, ascending."""
    pattern = re.compile(re.escape(target) + r"_roll([+-]?\d+)_mean")
    return sorted(int(m.group(1)) for m in map(pattern.fullmatch, columns) if m)


def lag_columns_of(columns: Iterable[str], target: str) -> list[str]:
    """Lag columns of the target, nearest lag first; unnumbered ones last."""
    prefix = f"{target}_lag"
    found = [c for c in columns if c.startswith(prefix)]

    def number(name: str) -> int:
        tail = name[len(prefix):]
        return int(tail) if tail.isdigit() else 10**9

    return sorted(found, key=number)
