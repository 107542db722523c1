"""Treatment-effect estimators over Spark ML. An estimator's fit returns a model; predict adds one column."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaplane.functions.draws import fold
from deltaplane.operators.roles import Experiment

FEATURES, LABEL, WEIGHT, HELD = "__features", "__label", "__weight", "__held"


@dataclass(frozen=True)
class Base:
    """A Spark ML estimator class with its parameters; columns are set by the learner."""

    kind: type[Estimator]
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, label: Column, weight: Column | None = None):
        named = {**self.params, "featuresCol": FEATURES, "labelCol": LABEL}
        rows = df.withColumn(LABEL, label.cast("double"))
        if weight is not None:
            rows, named = rows.withColumn(WEIGHT, weight), {**named, "weightCol": WEIGHT}
        if HELD in df.columns:
            # Boosted trees stop by the validation rows; other estimators have no use for them.
            if hasattr(self.kind, "validationIndicatorCol"):
                named["validationIndicatorCol"] = HELD
            else:
                rows = rows.where(~F.col(HELD))
        return self.kind(**named).fit(rows)


def applied(model, df: DataFrame, name: str) -> DataFrame:
    """df with the model's P(class 1), or its prediction, as `name`; all else that the model adds is left out."""
    out = model.transform(df)
    if "probability" in set(out.columns) - set(df.columns):
        # One class in training gives a vector of one element.
        value = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    else:
        value = F.col("prediction")
    return out.withColumn(name, value).select(*dict.fromkeys([*df.columns, name]))


def assembled(df: DataFrame, features: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """df with its features (one vector column, or several columns) as one vector."""
    return VectorAssembler(inputCols=[*features, *extra], outputCol=FEATURES, handleInvalid="keep").transform(df)


def parallel(*jobs):
    """The jobs' results; fits on one stored frame run side by side."""
    with ThreadPool(len(jobs)) as pool:
        return [r.get() for r in [pool.apply_async(j) for j in jobs]]


@dataclass(frozen=True)
class Learner:
    """What all learners have: the roles and the name of the score."""

    base: Base
    e: Experiment
    output: str = "score"

    def rows(self, df: DataFrame, validation: DataFrame | None = None) -> DataFrame:
        """The two arms with features and a 0/1 treatment `__t`; with validation rows also the flag `__held`."""
        e = self.e
        if validation is not None:
            df = df.withColumn(HELD, F.lit(False)).unionByName(validation.select(*df.columns).withColumn(HELD, F.lit(True)))
        return assembled(e.arms(df), e.features).withColumn("__t", F.when(e.is_treated, 1.0).otherwise(0.0))

    def kept(self, df: DataFrame, validation: DataFrame | None = None, features: tuple[str, ...] = (), bases: tuple[Base, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """What fits read of the rows, stored: features, outcome, `__t` and what the bases name, as plain columns; and the
        same rows with the features as one vector, which takes several times the room and is made anew in each pass."""
        rows = self.rows(df, validation).drop(FEATURES)
        named = [x for b in (self.base, *bases) for x in b.params.values() if isinstance(x, str) and x in rows.columns]
        stored = rows.select(*dict.fromkeys([*self.e.features, *features, self.e.outcome, "__t", *([HELD] if HELD in rows.columns else []), *named])).persist()
        return stored, assembled(stored, self.e.features)

    def finish(self, df: DataFrame, out: DataFrame, score: Column) -> DataFrame:
        return out.withColumn(self.output, score).select(*dict.fromkeys([*df.columns, self.output]))


@dataclass(frozen=True)
class Fitted:
    """A learner with its trained parts."""

    learner: Learner
    parts: tuple

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the score; only features are read, and the rows and other columns stay as they are."""
        return self.learner.score(df, self.parts)


class SLearner(Learner):
    """One model on features and treatment; the score is its difference between the arms."""

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        rows = self.rows(df, validation).drop(FEATURES)
        return Fitted(self, (self.base.fit(assembled(rows, self.e.features, ("__t",)), F.col(self.e.outcome)),))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        out = df
        for t in (1.0, 0.0):
            out = applied(parts[0], assembled(out.withColumn("__t", F.lit(t)), self.e.features, ("__t",)), f"__{t:.0f}").drop(FEATURES, "__t")
        return self.finish(df, out, F.col("__1") - F.col("__0"))


class TLearner(Learner):
    """A model for each arm."""

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        stored, rows = self.kept(df, validation)
        try:
            return Fitted(self, tuple(parallel(*[lambda t=t: self.base.fit(rows.where(F.col("__t") == t), F.col(self.e.outcome)) for t in (1.0, 0.0)])))
        finally:
            stored.unpersist()

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        out = applied(parts[1], applied(parts[0], assembled(df, self.e.features), "__1"), "__0")
        return self.finish(df, out, F.col("__1") - F.col("__0"))


@dataclass(frozen=True)
class XLearner(Learner):
    """A model for each arm, then one for each arm's imputed effects; the score is the mean of the latter."""

    second: Base | None = None
    second_features: tuple[str, ...] = ()

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        e = self.e
        stored, rows = self.kept(df, validation, self.second_features, (self.second,) if self.second else ())
        try:
            first = parallel(*[lambda t=t: self.base.fit(rows.where(F.col("__t") == t), F.col(e.outcome)) for t in (1.0, 0.0)])
            both = applied(first[1], applied(first[0], rows, "__1"), "__0")
            y = F.col(e.outcome).cast("double")
            effects = both.withColumn("__d", F.when(F.col("__t") == 1, y - F.col("__0")).otherwise(F.col("__1") - y)).drop(FEATURES)
            effects = assembled(effects, self.second_features or e.features)
            second = parallel(*[lambda t=t: (self.second or self.base).fit(effects.where(F.col("__t") == t), F.col("__d")) for t in (1.0, 0.0)])
        finally:
            stored.unpersist()
        return Fitted(self, tuple(second))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        out = applied(parts[1], applied(parts[0], assembled(df, self.second_features or self.e.features), "__1"), "__0")
        return self.finish(df, out, (F.col("__1") + F.col("__0")) / 2)


class ClassTransformation(Learner):
    """A classifier of `treatment equals outcome`; the score is 2 P - 1. For even, randomised arms."""

    def label(self) -> Column:
        return F.when(F.when(self.e.is_treated, 1.0).otherwise(0.0) == F.col(self.e.outcome).cast("double"), 1.0).otherwise(0.0)

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        return Fitted(self, (self.base.fit(self.rows(df, validation), self.label()),))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        return self.finish(df, applied(parts[0], assembled(df, self.e.features), "__p"), 2 * F.col("__p") - 1)


@dataclass(frozen=True)
class Propensity:
    """P(treated): by a classifier, or without one the share of the treated in training, the same for all rows.

    own_arm_share: without a classifier, each row gets the share of its own arm among the rows that are scored.
    """

    e: Experiment
    base: Base | None = None
    output: str = "propensity"
    own_arm_share: bool = False

    def fit(self, df: DataFrame) -> Fitted:
        arms = self.e.arms(df)
        if self.base is None:
            return Fitted(self, (arms.agg(F.avg(F.when(self.e.is_treated, 1.0).otherwise(0.0))).first()[0],))
        return Fitted(self, (self.base.fit(assembled(arms, self.e.features), F.when(self.e.is_treated, 1.0).otherwise(0.0)),))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        if self.base is None and self.own_arm_share:
            share = F.lit(self.fit(df).parts[0]).cast("double")
            return df.withColumn(self.output, F.when(self.e.is_treated, share).when(self.e.is_control, 1 - share))
        if self.base is None:
            return df.withColumn(self.output, F.lit(parts[0]).cast("double"))
        out = applied(parts[0], assembled(df, self.e.features), "__p").withColumn(self.output, F.col("__p"))
        return out.select(*dict.fromkeys([*df.columns, self.output]))


@dataclass(frozen=True)
class TransformedOutcome(Learner):
    """A regression on outcome / p for the treated and -outcome / (1 - p) for the control rows."""

    propensity: Base | None = None

    def label(self, p: Column) -> Column:
        y = F.col(self.e.outcome).cast("double")
        return F.when(self.e.is_treated, F.try_divide(y, p)).otherwise(F.try_divide(-y, 1 - p))

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        p = Propensity(self.e, self.propensity, "__propensity").fit(df)
        held = None if validation is None else p.predict(self.e.arms(validation))
        return Fitted(self, (self.base.fit(self.rows(p.predict(self.e.arms(df)), held), self.label(F.col("__propensity"))),))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        return self.finish(df, applied(parts[0], assembled(df, self.e.features), "__p"), F.col("__p"))


@dataclass(frozen=True)
class Retrospective(Learner):
    """P(treated) among the rows with a positive outcome."""

    positive: float = 1.0

    def positives(self, df: DataFrame, validation: DataFrame | None = None) -> DataFrame:
        """The rows that it learns from."""
        return self.rows(df, validation).where(F.col(self.e.outcome) == self.positive)

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        return Fitted(self, (self.base.fit(self.positives(df, validation), F.col("__t")),))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        return self.finish(df, applied(parts[0], assembled(df, self.e.features), "__p"), F.col("__p"))


@dataclass(frozen=True)
class RLearner(Learner):
    """Cross-fitted residuals: the final model regresses (y - m) / (t - p) with weights (t - p)^2. base fits m.

    Validation rows are one more fold, so they count in the final model too.
    """

    final: Base | None = None
    propensity: Base | None = None
    folds: int = 2
    fold_column: str | None = None
    seed: int = 42

    def fold_of(self) -> Column:
        if self.fold_column:
            return F.col(self.fold_column)
        if not self.e.key:
            raise ValueError("folds need the key of the units or a fold column")
        return fold(self.folds, self.seed, *[F.col(c) for c in self.e.key])

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> Fitted:
        e = self.e
        read = [*dict.fromkeys([*e.features, e.outcome]), "__t", "__fold"]
        rows = self.rows(df).withColumn("__fold", self.fold_of()).select(*read)
        if validation is not None:
            last = (rows.agg(F.max("__fold")).first()[0] or 0) + 1
            rows = rows.unionByName(self.rows(validation).withColumn("__fold", F.lit(last)).select(*read))
        # Stored as plain columns: vectors take several times the room.
        stored = rows.persist()
        rows = assembled(stored, e.features)
        try:
            numbers = [r[0] for r in rows.select("__fold").distinct().orderBy("__fold").collect()]
            parts = parallel(*[lambda k=k: self._residuals(rows, k) for k in numbers])
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            t, y = F.col("__t") - F.col("__p"), F.col(e.outcome).cast("double") - F.col("__m")
            out = out.where(F.abs(t) > 1e-9)
            return Fitted(self, ((self.final or self.base).fit(out, y / t, t * t),))
        finally:
            stored.unpersist()

    def _residuals(self, rows: DataFrame, k: object) -> DataFrame:
        rest, own = rows.where(F.col("__fold") != k), rows.where(F.col("__fold") == k)
        m = self.base.fit(rest, F.col(self.e.outcome))
        out = applied(m, own, "__m")
        if self.propensity:
            return applied(self.propensity.fit(rest, F.col("__t")), out, "__p")
        return out.withColumn("__p", F.lit(rest.agg(F.avg("__t")).first()[0]))

    def score(self, df: DataFrame, parts: tuple) -> DataFrame:
        return self.finish(df, applied(parts[0], assembled(df, self.e.features), "__p"), F.col("__p"))
