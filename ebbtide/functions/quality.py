"""Range and pattern checks as columns: which rules does a row break?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lower bound, lower is open, upper bound, upper is open) per parameter
RANGES: dict[str, tuple[float | None, bool, float | None, bool]] = {
    "temperature": (0.0, False, 2.0, False),
    "top_k": (1, False, None, False),
    "top_p": (0.0, False, 1.0, False),
    "max_new_tokens": (1, False, None, False),
}
BENCHMARK_RANGES: dict[str, tuple[float | None, bool, float | None, bool]] = {
    "sample_count": (1, False, 200, False),
    "max_new_tokens": (1, False, 512, False),
    "temperature": (0.0, False, 2.0, False),
    "num_beams": (1, False, 10, False),
    "max_tokens": (1000, False, 200000, False),
    "top_k": (5, False, 100, False),
    "rare_percentile": (0.0, True, 1.0, True),
}
THRESHOLD_RANGES: dict[str, tuple[float | None, bool, float | None, bool]] = {
    "persistence_count": (1, False, None, False),
    "persistence_window_minutes": (0, False, None, False),
}
MAX_LENGTHS = {"name": 255, "metric_name": 100, "group_key": 100}
OPERATORS = [">", "<", ">=", "<=", "=="]


def outside(column: Column, bounds: tuple[float | None, bool, float | None, bool]) -> Column:
    """True where a value is present and outside its range."""
    low, low_open, high, high_open = bounds
    broken = F.lit(False)
    if low is not None:
        broken = broken | ((column <= low) if low_open else (column < low))
    if high is not None:
        broken = broken | ((column >= high) if high_open else (column > high))
    return F.coalesce(broken, F.lit(False))


def broken_rules(ranges: dict[str, tuple], columns: dict[str, Column], extra: dict[str, Column] | None = None) -> Column:
    """Array of the names of all broken rules of a row."""
    checks = [F.when(outside(columns[name], bounds), F.lit(name)) for name, bounds in ranges.items()]
    checks += [F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in (extra or {}).items()]
    return F.array_compact(F.array(*checks))


def unknown_operator(column: Column) -> Column:
    return ~column.isin(OPERATORS)


def too_long(columns: dict[str, Column]) -> dict[str, Column]:
    """Checks of the text lengths that have a limit, by column name."""
    return {name: F.length(columns[name]) > limit for name, limit in MAX_LENGTHS.items() if name in columns}


def broken_generation_rules(columns: dict[str, Column]) -> Column:
    """Rules that the parameters of a generation break."""
    return broken_rules(RANGES, columns)


def broken_benchmark_rules(columns: dict[str, Column]) -> Column:
    """Rules that the parameters of a benchmark job break."""
    return broken_rules(BENCHMARK_RANGES, columns)


def broken_threshold_rules(columns: dict[str, Column]) -> Column:
    """Rules that an alert threshold breaks: ranges, text lengths, required texts, a known operator."""
    missing = {f"{name} required": columns[name].isNull() for name in ("name", "metric_name", "comparison_operator")}
    operator = {"comparison_operator": unknown_operator(columns["comparison_operator"])}
    return broken_rules(THRESHOLD_RANGES, columns, too_long(columns) | missing | operator)
