"""Uplift random forest: binned, grown level by level for all trees at once; and permutation importance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaplane.functions.draws import fast_uniform
from deltaplane.functions.storage import stored
from deltaplane.operators.buckets import bucket_of, near_splits, ranks
from deltaplane.operators.evaluate import auuc, cate_lift, qini, qini_coefficient
from deltaplane.operators.roles import Experiment


def rate_divergence(p: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of two arms' outcome rates."""
    if metric == "kl":
        p, q = (np.clip(x, 1e-6, 1 - 1e-6) for x in (p, q))
        return p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))
    if metric == "euclidean":
        return 2 * (p - q) ** 2
    if metric == "chi_squared":
        return (p - q) ** 2 / np.maximum(q, 1e-6) + (p - q) ** 2 / np.maximum(1 - q, 1e-6)
    raise ValueError(f"metric must be kl, euclidean or chi_squared, not {metric!r}")


def divergence_column(p: Column, q: Column, metric: str) -> Column:
    """rate_divergence of columns."""
    if metric == "kl":
        p, q = (F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6)) for x in (p, q))
        return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
    if metric == "euclidean":
        return 2 * (p - q) * (p - q)
    return (p - q) * (p - q) / F.greatest(q, F.lit(1e-6)) + (p - q) * (p - q) / F.greatest(1 - q, F.lit(1e-6))


@dataclass
class Tree:
    """Nodes as arrays: the feature and last bin of the left child (feature -1: a leaf), first child, uplift."""

    feature: list[int]
    bin: list[int]
    child: list[int]
    uplift: list[float]


@dataclass(frozen=True)
class UpliftForest:
    """Parameters of the forest. Outcomes are 0/1; units are drawn into trees by a hash of their key."""

    e: Experiment
    trees: int = 10
    max_depth: int = 5
    bins: int = 20
    min_rows: int = 10
    sample_rate: float = 0.63
    feature_rate: float = 1.0
    #: The rate for a whole tree, and the number of features that a node may try.
    tree_feature_rate: float = 1.0
    features_per_split: int | None = None
    #: Sample rates of control and treated rows, in place of sample_rate.
    arm_rates: tuple[float, float] | None = None
    metric: str = "kl"
    seed: int = 0
    output: str = "uplift"
    #: Bins at the root, halved with each level down to `bins`; none: `bins` at all levels.
    top_bins: int | None = None
    #: Constant features are no candidates; else they take part in the draws and never split.
    ignore_constant: bool = True

    def fit(self, df: DataFrame) -> ForestModel:
        """A few aggregates for each level; the best split of each node is found on the executors, and one row a node
        reaches the driver, whatever the features and bins."""
        e = self.e
        if not e.key:
            raise ValueError("a forest needs the key of the units")
        rate_divergence(np.zeros(1), np.zeros(1), self.metric)
        features = list(e.features)
        inner = near_splits(df, features, max(self.bins, self.top_bins or 0), 10_000)
        sample = self.sample(df, inner).persist()
        try:
            if not sample.where(F.col("y") < 0).isEmpty():
                raise ValueError(f"a forest needs outcomes 0 and 1; {e.outcome!r} has others")
            trees = self._grow(sample, [i for i, f in enumerate(features) if inner[f] or not self.ignore_constant])
        finally:
            sample.unpersist()
        return ForestModel(self, inner, trees)

    def sample(self, df: DataFrame, inner: dict[str, list[float]]) -> DataFrame:
        """t, y (-1: neither 0 nor 1), x (the features' bins) and w (for each tree how many such rows it draws).

        A forest learns from these counts alone: there are no more than combinations of bins, whatever the rows.
        """
        e = self.e
        rows = e.arms(df).where(F.col(e.outcome).isNotNull())
        y = F.when(F.col(e.outcome).isin(0, 1), F.col(e.outcome).cast("int")).otherwise(-1)
        binned = rows.select(F.when(e.is_treated, 1).otherwise(0).alias("t"), y.alias("y"), F.array(*binned_features(e.features, inner)).alias("x"), F.struct(*e.key).alias("key"))
        rate = F.when(F.col("t") == 1, self.arm_rates[1]).otherwise(self.arm_rates[0]) if self.arm_rates else F.lit(self.sample_rate)
        drawn = [F.sum((fast_uniform(self.seed, F.col("key"), F.lit(k)) < rate).cast("int")) for k in range(self.trees)]
        return binned.groupBy("t", "y", "x").agg(F.array(*drawn).alias("w"))

    def _grow(self, sample: DataFrame, candidates: list[int]) -> list[Tree]:
        trees = [Tree([-1], [0], [0], [0.0]) for _ in range(self.trees)]
        level = [0] * self.trees  # the first node of the level in each tree; leaves above are settled
        for depth in range(self.max_depth + 1):
            node = _nodes_udf(trees)(*_apart(F.col("x"), len(self.e.features))) if depth else F.array(*[F.lit(0)] * self.trees)
            pairs = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(self.trees - 1)).alias("tree"), F.col("node"), F.col("w")))
            at = sample.withColumn("node", node).select("t", "y", "x", pairs.alias("p")).select("t", "y", "x", "p.tree", "p.node", "p.w")
            at = at.where((F.col("w") > 0) & (F.col("node") >= F.get(F.lit(level), F.col("tree"))))
            found = self._best_splits(at, candidates, depth).collect()
            level = [len(t.feature) for t in trees]
            any_split = False
            for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
                tree, n = trees[r["tree"]], r["node"]
                tree.uplift[n] = r["uplift"]
                if r["best"] is None:
                    continue
                any_split = True
                tree.feature[n], tree.bin[n], tree.child[n] = -r["best"]["f"], -r["best"]["b"], len(tree.feature)
                for _ in range(2):
                    tree.feature.append(-1)
                    tree.bin.append(0)
                    tree.child.append(0)
                    tree.uplift.append(tree.uplift[n])
            if not any_split:
                break
        return trees

    def _best_splits(self, at: DataFrame, candidates: list[int], depth: int) -> DataFrame:
        """tree, node, uplift and best (gain, -f, -b; null: no split) of each open node."""
        sums = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0).cast("long"))
        cell = {f"n{t}{y}": (F.col("t") == t) & (F.col("y") == y) for t in (0, 1) for y in (0, 1)}
        rate = lambda one, zero: F.coalesce(F.try_divide(one.cast("double"), one + zero), F.lit(0.0))
        totals = at.groupBy("tree", "node").agg(*[sums(c).alias("w" + k[1:]) for k, c in cell.items()])
        p1, p0 = rate(F.col("w11"), F.col("w10")), rate(F.col("w01"), F.col("w00"))
        nodes = totals.select("tree", "node", (p1 - p0).alias("uplift"))
        if depth == self.max_depth or not candidates:
            return nodes.withColumn("best", F.lit(None).cast("struct<gain:double,f:int,b:int>"))
        draw = lambda *x: F.crc32(F.concat_ws(":", F.lit(str(self.seed)), *[c.cast("string") for c in x]).cast("binary")) / F.lit(2.0**32)
        pairs = at.select("tree", "node", "t", "y", "w", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.get("x", F.lit(f)).alias("b")) for f in candidates])).alias("c")).select("tree", "node", "t", "y", "w", "c.f", "c.b")
        if self.feature_rate < 1:
            pairs = pairs.where(draw(F.col("tree"), F.col("node"), F.col("f")) < self.feature_rate)
        if self.tree_feature_rate < 1:
            pairs = pairs.where(draw(F.col("tree"), F.lit("tree"), F.col("f")) < self.tree_feature_rate)
        cells = pairs.groupBy("tree", "node", "f", "b").agg(*[sums(c).alias(k) for k, c in cell.items()])
        if self.features_per_split:
            tried = draw(F.col("tree"), F.col("node"), F.lit("try"), F.col("f"))
            order = F.dense_rank().over(Window.partitionBy("tree", "node").orderBy(tried, "f"))
            cells = cells.withColumn("__order", order).where(F.col("__order") <= self.features_per_split).drop("__order")
        step = 1
        if self.top_bins and self.top_bins > self.bins:
            step = min(2**depth, -(-self.top_bins // self.bins))
        of, up = Window.partitionBy("tree", "node", "f"), Window.partitionBy("tree", "node", "f").orderBy("b")
        both = cells.select("tree", "node", "f", "b", *[F.sum(k).over(up).alias("l" + k[1:]) for k in cell], *[F.sum(k).over(of).alias("w" + k[1:]) for k in cell])
        left = {k: F.col("l" + k) for k in ("00", "01", "10", "11")}
        right = {k: F.col("w" + k) - F.col("l" + k) for k in left}
        gain_of = lambda c: sum(c.values(), F.lit(0)) * divergence_column(rate(c["11"], c["10"]), rate(c["01"], c["00"]), self.metric)
        whole = {k: F.col("w" + k) for k in left}
        gain = (gain_of(left) + gain_of(right)) / sum(whole.values(), F.lit(0)) - divergence_column(rate(whole["11"], whole["10"]), rate(whole["01"], whole["00"]), self.metric)
        sizes = [c[a + "0"] + c[a + "1"] for c in (left, right) for a in "01"]
        good = (F.least(*sizes) >= self.min_rows) & (F.pmod(F.col("b") + 1, F.lit(step)) == 0)
        best = both.where(good).select("tree", "node", F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b")).alias("s")).where("s.gain > 1e-12").groupBy("tree", "node").agg(F.max("s").alias("best"))
        return nodes.join(best, ["tree", "node"], "left")


def _walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    feature, cut, child = np.array(tree.feature), np.array(tree.bin), np.array(tree.child)
    node = np.zeros(len(x), int)
    while (go := feature[node] >= 0).any():
        own = node[go]
        node[go] = child[own] + (x[go, feature[own]] > cut[own])
    return node


def binned_features(features: tuple[str, ...], inner: dict[str, list[float]], values: dict[str, Column] | None = None) -> list[Column]:
    """The bin of each feature, -1 for null and NaN; values: in place of the columns of these names."""
    return [F.coalesce(bucket_of((values[f] if values else F.col(f)).cast("double"), inner[f]), F.lit(-1.0)).cast("int") for f in features]


def _apart(x: Column, features: int) -> list[Column]:
    """The bins as columns, which reach Python as numbers, not as one list a row; one at least."""
    return [F.get(x, F.lit(i)) for i in range(features)] or [F.lit(-1)]


def _nodes_udf(trees: list[Tree]):
    @F.pandas_udf("array<int>")
    def nodes(*x: pd.Series) -> pd.Series:
        bins = np.column_stack(x)
        return pd.Series(list(np.column_stack([_walk(t, bins) for t in trees]).astype(np.int32)))

    return nodes


@dataclass(frozen=True)
class ForestModel:
    """Splits of the features and the trees."""

    forest: UpliftForest
    inner: dict[str, list[float]]
    trees: list[Tree]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the trees' mean uplift."""
        return df.withColumn(self.forest.output, self.score({f: F.col(f) for f in self.forest.e.features}))

    def score(self, values: dict[str, Column]) -> Column:
        """The trees' mean uplift for given values of the features."""
        return self.score_bins(binned_features(self.forest.e.features, self.inner, values))

    def score_bins(self, bins: list[Column]) -> Column:
        """The trees' mean uplift for given bins of the features."""
        trees = self.trees

        @F.pandas_udf("double")
        def score(*x: pd.Series) -> pd.Series:
            own = np.column_stack(x)
            return pd.Series(sum(np.array(t.uplift)[_walk(t, own)] for t in trees) / len(trees))

        return score(*(bins or [F.lit(-1)]))

    def auuc(self, df: DataFrame, kind: str = "qini", bins: int = 30) -> float:
        """Area under the uplift curve of df with so many bins: `qini` (effect times share), `lift` (effect) or `gain`
        (effect times treated and control rows, per row: as qini, but in rows)."""
        scored = self.forest.e.with_(score=self.forest.output)
        rows = self.predict(df)
        if kind == "lift":
            return auuc(cate_lift(rows, scored, bins), y="cum_cate").first()[0]
        if kind not in ("qini", "gain"):
            raise ValueError(f"kind must be qini, lift or gain, not {kind!r}")
        curve = qini(rows, scored, bins)
        if kind == "gain":
            curve = curve.withColumn("ate", F.col("ate") * F.lit(curve.agg(F.max("count")).first()[0] or 0))
        return auuc(curve).first()[0]


def _ranked(frame: DataFrame, by: list[Column], kept: list[Column]) -> DataFrame:
    """The kept columns of the frame's rows in stored order, with their rank by the columns as `__rank`.

    Ranks are counted in range partitions of a stored frame, so no task holds all rows and a lost executor moves none.
    """
    # The id holds partition and place; only a count for each partition reaches the driver.
    order = {f"__by{i}": c for i, c in enumerate(by)}
    at = stored(frame.withColumns(order).repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("__id")))
    part, place = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["count"] for r in at.groupBy(part.alias("p")).count().collect()}
    before = _offsets(counts, max(counts, default=0) + 1)
    return at.withColumn("__rank", F.get(before, part) + place).drop("__id")


def _offsets(counts: dict[int, int], cells: int) -> Column:
    """For each cell the rows in those before it, as an array."""
    before = [0, *accumulate(counts.get(i, 0) for i in range(cells - 1))]
    return F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")


def shuffled(df: DataFrame, column: str | list[str], key: Column, seed: int) -> DataFrame:
    """df with the values of the column, or of several together, moved between rows: the row of key rank r gets those of
    hash rank r."""
    names = [column] if isinstance(column, str) else list(column)
    moved = [f"__value{i}" for i in range(len(names))]
    named = df.select(*[F.col(c).alias(v) for c, v in zip(names, moved, strict=True)], key.alias("__k"))
    values = _ranked(named, [F.xxhash64(F.lit(seed), "__k"), F.col("__k")], [F.col(v) for v in moved])
    return _ranked(df, [key], [F.col(c) for c in df.columns]).join(values, "__rank").withColumns({c: F.col(v) for c, v in zip(names, moved, strict=True)}).drop("__rank", *moved)


@dataclass(frozen=True)
class _Code:
    """Numbers below fixed sizes as the digits of a few longs."""

    sizes: tuple[int, ...]

    @property
    def places(self) -> list[tuple[int, int]]:
        """Of each number its long and what it counts times there."""
        out, which, times = [], 0, 1
        for n in self.sizes:
            if times * n > 1 << 62:
                which, times = which + 1, 1
            out.append((which, times))
            times *= n
        return out

    @property
    def longs(self) -> int:
        return self.places[-1][0] + 1

    def of(self, numbers: list[Column]) -> list[Column]:
        placed = list(zip(numbers, self.places, strict=True))
        return [reduce(add, [x.cast("long") * F.lit(t).cast("long") for x, (w, t) in placed if w == k]) for k in range(self.longs)]

    def number(self, i: int, prefix: str) -> Column:
        """The i-th number of the longs that are named so."""
        which, times = self.places[i]
        return F.expr(f"({prefix}{which} div {times}L) % {self.sizes[i]}L")


#: Cells of a 64-bit hash, and of a score from -1 to 1.
HASH_CELLS, SCORE_CELLS = 4096, 1024


def permutation_importance(df: DataFrame, forest: UpliftForest, repeats: int = 3, buckets: int = 30, samples: int | None = None) -> DataFrame:
    """feature, score: what the Qini coefficient of the forest loses when the feature is shuffled; the mean of repeats.

    The forest is fitted on all rows; samples: it is measured on so many of them, chosen by a hash of the key. Key,
    treatment and outcome stay the row's own, even if they are features too. A repeat moves all features in one pass, as
    `shuffled` does: the row of key rank r gets those of hash rank r; each is then put in the place of the row's own.

    A row is its bins, arm and outcome, packed in a few numbers. Keys are sorted and stored once; ranks by hash are counted
    in cells of the hash. Equal rows are counted before they are scored, so Python sees combinations of bins, not rows.
    """
    e, model = forest.e, forest.fit(df)
    e.check(df, "treatment", "outcome")
    if samples is not None:
        df = df.orderBy(F.xxhash64(F.lit(forest.seed), *e.key), *e.key).limit(samples)
    arm = F.when(e.is_treated, 2).when(e.is_control, 1).otherwise(0)
    positive = F.when((arm > 0) & (F.col(e.outcome).cast("double") == 1), 1).otherwise(0)
    code = _Code((6, *[len(model.inner[f]) + 2 for f in e.features]))
    own, moved = ([f"{x}{k}" for k in range(code.longs)] for x in ("__own", "__moved"))
    packed = code.of([2 * arm + positive, *[b + 1 for b in binned_features(e.features, model.inner)]])
    hashes = [F.xxhash64(F.lit(forest.seed + 1 + r), "__key").alias(f"__hash{r}") for r in range(repeats)]
    keyed = df.select(F.struct(*e.key).alias("__key"), *[c.alias(n) for c, n in zip(packed, own, strict=True)])
    rows = _ranked(keyed, [F.col("__key")], [*map(F.col, own), *hashes])
    cell = [(F.shiftright(f"__hash{r}", 52) + HASH_CELLS // 2).cast("int") for r in range(repeats)]
    counts: list[dict[int, int]] = [{} for _ in range(repeats)]
    if repeats:
        for x in rows.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), c.alias("c")) for r, c in enumerate(cell)])).alias("x")).groupBy("x.r", "x.c").count().collect():
            counts[x["r"]][x["c"]] = x["count"]
    # Variant 0: the rows as they are; then for each repeat each feature moved.
    parts = [rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("variant"), *own, "n")]
    for r in range(repeats):
        place = F.row_number().over(Window.partitionBy(cell[r]).orderBy(f"__hash{r}", "__rank")) - 1
        values = rows.select((F.get(_offsets(counts[r], HASH_CELLS), cell[r]) + place).alias("__rank"), *[F.col(o).alias(m) for o, m in zip(own, moved, strict=True)])
        variants = []
        for i in range(1, len(code.sizes)):
            which, times = code.places[i]
            change = (code.number(i, "__moved") - code.number(i, "__own")) * F.lit(times).cast("long")
            variants.append(F.struct(F.lit(1 + r * len(e.features) + i - 1).alias("variant"), *[(F.col(o) + change if k == which else F.col(o)).alias(o) for k, o in enumerate(own)]))
        both = rows.select("__rank", *own).join(values, "__rank").select(F.explode(F.array(*variants)).alias("x")).select("x.*")
        parts.append(both.groupBy("variant", *own).agg(F.count(F.lit(1)).alias("n")))
    score = model.score_bins([(code.number(i, "__own") - 1).cast("int") for i in range(1, len(code.sizes))])
    scored = reduce(DataFrame.unionByName, parts).withColumn("score", score)
    number = code.number(0, "__own")
    of = lambda *kinds: F.sum(F.when(number.isin(*kinds), F.col("n")).otherwise(0))
    scores = scored.groupBy("variant", "score").agg(F.sum("n").alias("n"), of(4, 5).alias("n_t"), of(2, 3).alias("n_c"), of(5).alias("y_t"), of(3).alias("y_c")).persist()
    try:
        areas = _qini_coefficients(scores, buckets)
    finally:
        scores.unpersist()
    found = [(f, float(np.mean([areas[0] - areas[1 + r * len(e.features) + i] for r in range(repeats)]))) for i, f in enumerate(e.features)]
    return df.sparkSession.createDataFrame(found, "feature string, score double").orderBy(F.desc("score"), "feature")


def _qini_coefficients(scores: DataFrame, buckets: int) -> dict[int, float]:
    """Of each variant what qini_coefficient says of qini; scores: how many rows have a score from -1 to 1, by arm.

    Running counts are taken within cells of the score; sums by bucket reach the driver.
    """
    cells = scores.withColumn("cell", F.floor((F.col("score") + 1) * (SCORE_CELLS // 2)))
    before = Window.partitionBy("variant").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("variant", "cell").agg(F.sum("n").alias("__n")).select("variant", "cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("before"))
    up = Window.partitionBy("variant", "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.withColumn("upto", F.sum("n").over(up)).join(F.broadcast(totals), ["variant", "cell"]).withColumn("upto", F.col("upto") + F.col("before"))
    places = ranks(scores.where("variant = 0").agg(F.sum("n")).first()[0] or 0, buckets)
    bucket = F.lit(0)
    if places:
        holds = F.exists(F.lit(places).cast("array<bigint>"), lambda r: (r > F.col("upto") - F.col("n")) & (r <= F.col("upto")))
        inner: dict[int, list[float]] = {}
        for r in upto.where(holds).select("variant", "score").collect():
            inner.setdefault(r["variant"], []).append(r["score"])
        cuts = F.lit([inner[v] for v in range(len(inner))])
        bucket = F.size(F.filter(F.get(cuts, F.col("variant")), lambda x: x <= F.col("score")))
    sums = scores.groupBy("variant", bucket.alias("bucket")).agg(*[F.sum(c).alias(c) for c in ("n", "n_t", "n_c", "y_t", "y_c")]).collect()
    return {v: _qini_coefficient(sorted((r for r in sums if r["variant"] == v), key=lambda r: -r["bucket"])) for v in {r["variant"] for r in sums}}


def _qini_coefficient(rows: list) -> float:
    """Of a few rows of sums, highest scores first; points without an arm have no part in the area."""
    whole, fraction, points = sum(r["n"] for r in rows), 0.0, [(0.0, 0.0)]
    n_t = n_c = y_t = y_c = 0
    for r in rows:
        fraction += r["n"] / whole
        n_t, n_c, y_t, y_c = n_t + r["n_t"], n_c + r["n_c"], y_t + r["y_t"], y_c + r["y_c"]
        points.append((fraction, (y_t / n_t - y_c / n_c) * fraction if n_t and n_c else None))
    # One by one, as Spark adds: Python's sum compensates.
    area = reduce(add, [(x - a) * (y + b) / 2 for (a, b), (x, y) in zip(points, points[1:], strict=False) if b is not None and y is not None], 0.0)
    return area - (points[-1][0] - points[0][0]) * (points[-1][1] + points[0][1]) / 2
