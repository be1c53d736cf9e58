"""Outcome horizons: a primary one, whose outcomes must be there, and diagnostic ones, whose outcomes may be."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_columns(horizon: int) -> dict[str, str]:
    """The names of a horizon's columns in the wide outcome table."""
    if horizon < 1:
        raise ValueError(f"a horizon has at least one trading day, not {horizon}")
    return {
        "price": f"price_{horizon}d",
        "stock_return": f"return_{horizon}d",
        "spy_return": f"spy_{horizon}d_return",
        "beat_spy": f"beat_spy_{horizon}d",
        "eval_date": f"eval_date_{horizon}d",
        "log_alpha": f"log_alpha_{horizon}d",
    }


@dataclass(frozen=True)
class Horizons:
    """The primary horizon, first, and the diagnostic ones, ascending."""

    primary: int = 21
    diagnostics: tuple[int, ...] = (5,)

    def __post_init__(self) -> None:
        own = tuple(sorted(set(self.diagnostics)))
        if min((self.primary, *own)) < 1:
            raise ValueError("a horizon has at least one trading day")
        if self.primary in own:
            raise ValueError("the primary horizon is no diagnostic")
        object.__setattr__(self, "diagnostics", own)

    @property
    def all(self) -> tuple[int, ...]:
        return (self.primary, *self.diagnostics)

    def skill_target(self, horizon: int) -> str:
        """The column a skill model is fitted to: log alpha for the primary horizon, the return for others."""
        return outcome_columns(horizon)["log_alpha" if horizon == self.primary else "stock_return"]

    def gate(self) -> str:
        """The column that tells whether the primary outcome is resolved."""
        return outcome_columns(self.primary)["beat_spy"]

    def long(self, wide: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, horizon, is_primary, target): one row per resolved outcome of a wide table; horizons it has no columns of give none."""
        have = [h for h in self.all if self.skill_target(h) in wide.columns]
        parts = [wide.select(*keys, F.lit(h).alias("horizon"), F.lit(h == self.primary).alias("is_primary"), F.col(self.skill_target(h)).cast("double").alias("target")) for h in have]
        return reduce(DataFrame.unionByName, parts).filter("target is not null")

    def require_primary(self, outcomes: DataFrame, horizon: str = "horizon") -> None:
        """Fails if no row of ``outcomes`` is of the primary horizon."""
        if outcomes.filter(F.col(horizon) == self.primary).isEmpty():
            raise ValueError(f"no outcome of the primary horizon of {self.primary} days")
