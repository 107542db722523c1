"""Which column of a frame plays which part in an experiment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Experiment:
    """Column names by role. `key` identifies a unit; it is needed for reproducible resampling and folds."""

    treatment: str = "treatment"
    outcome: str = "outcome"
    benefit: str = "benefit"
    cost: str = "cost"
    bucket: str = "bucket"
    score: str = "score"
    propensity: str | None = None
    key: tuple[str, ...] = ()
    features: tuple[str, ...] = field(default=())
    treated: int | str = 1
    control: int | str = 0

    def with_(self, **changes: object) -> Experiment:
        return replace(self, **changes)

    def check(self, df: DataFrame, *roles: str) -> None:
        """Raises if a role's column isn't there or the arm values don't fit the treatment column."""
        for role in roles:
            if getattr(self, role) not in df.columns:
                raise ValueError(f"no column {getattr(self, role)!r} for the {role}")
        kind = df.schema[self.treatment].dataType.simpleString()
        if isinstance(self.treated, str) != (kind == "string"):
            raise ValueError(f"treatment column {self.treatment!r} is {kind}, its values are given as {type(self.treated).__name__}")

    @property
    def is_treated(self) -> Column:
        return F.col(self.treatment) == F.lit(self.treated)

    @property
    def is_control(self) -> Column:
        return F.col(self.treatment) == F.lit(self.control)

    def arms(self, df: DataFrame) -> DataFrame:
        """The rows of the two arms; other arms and nulls are left out."""
        return df.where(self.is_treated | self.is_control)
