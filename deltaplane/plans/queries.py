"""The library's operators as queries over the sample tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaplane import plots
from deltaplane.functions.draws import POISSON_CDF, poisson, portable_uniform
from deltaplane.functions.features import feature_pipeline
from deltaplane.operators import evaluate as ev
from deltaplane.operators import learners as le
from deltaplane.operators import selection as se
from deltaplane.operators.buckets import label_of, quantile_buckets, threshold_of
from deltaplane.operators.forest import UpliftForest, permutation_importance
from deltaplane.operators.roles import Experiment
from deltaplane.sources.simulate import randomised_trial
from deltaplane.sources.views import SQL, experiment, view
from deltaplane.streaming.monitor import effect_by_window

Query = Callable[[SparkSession, str], DataFrame]
BUCKETS, DRAWS = 10, 20
BOOT = ev.Bootstrap(draws=DRAWS, low=0.1, high=0.9, portable=True)
#: The defaults of the library: 30 buckets, 100 draws.
FULL = ev.Bootstrap(draws=100, low=0.1, high=0.9, portable=True)
FEATURES = ["l_tax", "l_linenumber", "l_quantity"]
OLS = le.Base(LinearRegression, {"solver": "normal", "regParam": 0.0})


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, unbounded ones as null, so that other engines' sums compare."""
    unbounded = lambda c: F.abs(F.col(c)) == float("inf")
    return df.select(*[F.when(~unbounded(c), F.round(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- evaluation ---

METRIC_SQL = {
    "ate": "yt / nullif(nt, 0) - yc / nullif(nc, 0)",
    "target_rate": "y / nullif(n, 0)",
    "roi": "b / nullif(k, 0)",
    "iroi": "(bt - bc * nt / nullif(nc, 0)) / nullif(kt - kc * nt / nullif(nc, 0), 0)",
}
SUMS = {
    "n": "w", "nt": "CASE WHEN treatment = 1 THEN w ELSE 0 END", "nc": "CASE WHEN treatment = 0 THEN w ELSE 0 END",
    "yt": "CASE WHEN treatment = 1 THEN outcome * w ELSE 0 END", "yc": "CASE WHEN treatment = 0 THEN outcome * w ELSE 0 END", "y": "outcome * w",
    "bt": "CASE WHEN treatment = 1 THEN benefit * w ELSE 0 END", "bc": "CASE WHEN treatment = 0 THEN benefit * w ELSE 0 END", "b": "benefit * w",
    "kt": "CASE WHEN treatment = 1 THEN cost * w ELSE 0 END", "kc": "CASE WHEN treatment = 0 THEN cost * w ELSE 0 END", "k": "cost * w",
}


def evaluation_sql(name: str, columns: dict[str, str], bucket: str | None = None, cumulative: bool = False, draws: int = 0, threshold: bool = False, zero: bool = False, low: float = 0.1, high: float = 0.9, buckets: int = BUCKETS) -> str:
    """SQL for an evaluation of view `name`; columns: result column -> expression of the sums and of the fraction f."""
    parts = [f"v AS ({SQL[name][0]})"]
    if bucket == "quantile":
        shares = ", ".join(repr(i / buckets) for i in range(1, buckets))
        parts.append(f"q AS (SELECT list_sort(list_distinct(quantile_disc(score, [{shares}]))) AS cuts FROM v)")
        parts.append("u AS (SELECT v.* EXCLUDE (bucket), CAST(len(list_filter(cuts, lambda c: c <= score)) AS DOUBLE) AS bucket FROM v, q)")
    else:
        parts.append("u AS (SELECT * FROM v)")
    if draws:
        uniform = "CAST('0x' || substr(md5(CAST(unit AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"
        weight = " + ".join(f"CASE WHEN x >= CAST({p!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON_CDF)
        parts.append(f"x AS (SELECT u.*, d, CAST({uniform} AS DOUBLE) AS x FROM u, range(0, {draws}) AS r(d))")
        parts.append(f"w AS (SELECT *, CASE WHEN d = 0 THEN 1 ELSE {weight} END AS w FROM x)")
    else:
        parts.append("w AS (SELECT *, 0 AS d, 1 AS w FROM u)")
    key = "bucket, d" if bucket else "d"
    parts.append(f"s AS (SELECT {key}, {', '.join(f'CAST(sum({x}) AS DOUBLE) AS {c}' for c, x in SUMS.items())} FROM w GROUP BY {key})")
    parts.append("f AS (SELECT *, n / sum(n) OVER (PARTITION BY d) AS f FROM s)")
    if cumulative:
        over = "OVER (PARTITION BY d ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)"
        parts.append(f"c AS (SELECT {key}, {', '.join(f'sum({c}) {over} AS {c}' for c in [*SUMS, 'f'])} FROM f)")
    else:
        parts.append("c AS (SELECT * FROM f)")
    parts.append(f"m AS (SELECT {key}, n, f, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM c)")
    shown = ["bucket", "CAST(n AS BIGINT) AS count", "round(f, 6) AS fraction"] if bucket else []
    if threshold:
        shown.append("round(CASE WHEN bucket > 0 THEN (SELECT cuts FROM q)[CAST(bucket AS INT)] END, 6) AS threshold")
    if draws:
        group = "PARTITION BY bucket" if bucket else ""
        firsts = ", ".join(f"max(CASE WHEN d = 0 THEN {c} END) OVER ({group}) AS z_{c}" for c in columns)
        parts.append(f"z AS (SELECT *, {firsts} FROM m)")
        out = []
        for c in columns:
            q = f"quantile_disc(CASE WHEN d > 0 THEN {c} - z_{c} END, {{}})"
            out += [f"max(z_{c}) AS {c}", f"max(z_{c}) - {q.format(high)} AS {c}_lower", f"max(z_{c}) - {q.format(low)} AS {c}_upper", f"sqrt(avg(CASE WHEN d > 0 THEN ({c} - z_{c}) * ({c} - z_{c}) END)) AS {c}_std_error"]
        lead = "bucket, max(CASE WHEN d = 0 THEN n END) AS n, max(CASE WHEN d = 0 THEN f END) AS f, " if bucket else ""
        parts.append(f"r AS (SELECT {lead}{', '.join(out)} FROM z {'GROUP BY bucket' if bucket else ''})")
        names = [c + s for c in columns for s in ("", "_lower", "_upper", "_std_error")]
    else:
        parts.append("r AS (SELECT * FROM m)")
        names = list(columns)
    body = f"SELECT {', '.join([*shown, *[f'round({c}, 6) AS {c}' for c in names]])} FROM r"
    if zero:
        body += f" UNION ALL SELECT CAST(NULL AS DOUBLE), 0, 0.0, CAST(NULL AS DOUBLE), {', '.join('0.0' for _ in names)}"
    return f"WITH {', '.join(parts)} {body}"


ATE, RATES = {"ate": METRIC_SQL["ate"]}, {"ate": METRIC_SQL["ate"], "target_rate_treated": "yt / nullif(nt, 0)", "target_rate_control": "yc / nullif(nc, 0)"}
IROI = {"iroi": METRIC_SQL["iroi"], "incremental_benefit": "bt - bc * nt / nullif(nc, 0)", "incremental_cost": "kt - kc * nt / nullif(nc, 0)"}


def _curve_sql(inner: str, what: str) -> str:
    area = "sum((fraction - x) * (ate + y) / 2)"
    line = "(max(fraction) - min(fraction)) * (arg_max(ate, fraction) + arg_min(ate, fraction)) / 2"
    return f"SELECT round({area if what == 'auuc' else f'{area} - {line}'}, 4) AS {what} FROM (SELECT fraction, ate, lag(fraction) OVER (ORDER BY fraction) AS x, lag(ate) OVER (ORDER BY fraction) AS y FROM ({inner}))"


def _draws_sql() -> str:
    uniform = "CAST('0x' || substr(md5(CAST(unit AS VARCHAR) || ':' || CAST(d AS VARCHAR)), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE)"
    times = " + ".join(f"CASE WHEN x >= CAST({p!r} AS DOUBLE) THEN 1 ELSE 0 END" for p in POISSON_CDF)
    return f"WITH v AS ({SQL['orders'][0]}), x AS (SELECT CAST(d AS INT) AS draw, {uniform} AS x FROM v, range(1, 6) AS r(d)) SELECT draw, CAST({times} AS INT) AS times, count(*) AS n FROM x GROUP BY 1, 2"


def _quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, lower split and label of each quantile bucket of the orders' score."""
    rows, inner = quantile_buckets(view(spark, folder, "orders"), "score", BUCKETS)
    by = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return tidy(by.withColumns({"threshold": threshold_of(F.col("bucket"), inner), "label": label_of(F.col("bucket"), inner)}))


def _quantiles_sql() -> str:
    shares = ", ".join(repr(i / BUCKETS) for i in range(1, BUCKETS))
    low, high = "CASE WHEN bucket > 0 THEN cuts[CAST(bucket AS INT)] END", "CASE WHEN bucket < len(cuts) THEN cuts[CAST(bucket AS INT) + 1] END"
    text = lambda x, other: f"coalesce(printf('%.2f', {x}), '{other}')"
    return f"WITH v AS ({SQL['orders'][0]}), q AS (SELECT list_sort(list_distinct(quantile_disc(score, [{shares}]))) AS cuts FROM v), u AS (SELECT CAST(len(list_filter(cuts, lambda c: c <= score)) AS DOUBLE) AS bucket, cuts FROM v, q) SELECT bucket, count(*) AS n, round({low}, 6) AS threshold, '[' || {text(low, '-inf')} || ', ' || {text(high, 'inf')} || ')' AS label FROM u GROUP BY bucket, cuts"


def _evaluations() -> dict[str, tuple[Query, str | None]]:
    q, i1 = "quantile", {"iroi": METRIC_SQL["iroi"]}
    rate = {"target_rate": METRIC_SQL["target_rate"]}

    def on(name: str, f) -> Query:
        return lambda spark, folder: tidy(f(view(spark, folder, name), experiment(name)))

    qini_sql = evaluation_sql("orders", {"ate": f"({METRIC_SQL['ate']}) * f"}, q, True, threshold=True, zero=True)
    return {
        "ate": (on("orders", ev.ate), evaluation_sql("orders", RATES)),
        "roi": (on("orders", ev.roi), evaluation_sql("orders", {"roi": METRIC_SQL["roi"]})),
        "iroi": (on("orders", lambda d, e: ev.iroi(d, e).withColumns({c: F.round(c, 2) for c in ("incremental_benefit", "incremental_cost")})), evaluation_sql("orders", IROI).replace("round(incremental_benefit, 6)", "round(incremental_benefit, 2)").replace("round(incremental_cost, 6)", "round(incremental_cost, 2)")),
        "target_rate_per_bucket": (on("lines", ev.target_rate), evaluation_sql("lines", rate, "bucket")),
        "cate_per_bucket": (on("orders", ev.cate), evaluation_sql("orders", {"cate": METRIC_SQL["ate"]}, "bucket")),
        "iroi_per_bucket": (on("events", lambda d, e: ev.iroi(d, e, per_bucket=True)), evaluation_sql("events", i1, "bucket")),
        "target_rate_per_quantile": (on("lines", lambda d, e: ev.target_rate(d, e, BUCKETS)), evaluation_sql("lines", rate, q)),
        "cate_per_quantile": (on("orders", lambda d, e: ev.cate(d, e, BUCKETS)), evaluation_sql("orders", {"cate": METRIC_SQL["ate"]}, q)),
        "iroi_per_quantile": (on("lines", lambda d, e: ev.iroi(d, e, BUCKETS)), evaluation_sql("lines", i1, q)),
        "cate_lift": (on("lines", lambda d, e: ev.cate_lift(d, e, BUCKETS)), evaluation_sql("lines", {"cum_cate": METRIC_SQL["ate"]}, q, True)),
        "qini": (on("orders", lambda d, e: ev.qini(d, e, BUCKETS)), qini_sql),
        "cum_iroi": (on("orders", lambda d, e: ev.cum_iroi(d, e, BUCKETS)), evaluation_sql("orders", i1, q, True, threshold=True)),
        "auuc": (lambda s, f: tidy(ev.auuc(tidy(ev.qini(view(s, f, "orders"), experiment("orders"), BUCKETS))), 4), _curve_sql(qini_sql, "auuc")),
        "qini_coefficient": (lambda s, f: tidy(ev.qini_coefficient(tidy(ev.qini(view(s, f, "orders"), experiment("orders"), BUCKETS))), 4), _curve_sql(qini_sql, "qini_coefficient")),
        "ate_ci": (on("orders", lambda d, e: ev.ate(d, e, BOOT)), evaluation_sql("orders", RATES, draws=DRAWS)),
        "roi_ci": (on("orders", lambda d, e: ev.roi(d, e, BOOT)), evaluation_sql("orders", {"roi": METRIC_SQL["roi"]}, draws=DRAWS)),
        "iroi_ci": (on("events", lambda d, e: ev.iroi(d, e, bootstrap=BOOT).select("iroi", "iroi_lower", "iroi_upper", "iroi_std_error")), evaluation_sql("events", i1, draws=DRAWS)),
        "iroi_details_ci": (on("events", lambda d, e: ev.iroi(d, e, bootstrap=BOOT, details=True)), f"SELECT *, incremental_cost < 0 AS negative_cost FROM ({evaluation_sql('events', IROI, draws=DRAWS)})"),
        "iroi_details_per_bucket": (on("events", lambda d, e: ev.iroi(d, e, per_bucket=True, details=True)), f"SELECT *, incremental_cost < 0 AS negative_cost FROM ({evaluation_sql('events', IROI, 'bucket')})"),
        "iroi_details_per_quantile": (on("lines", lambda d, e: tidy(ev.iroi(d, e, BUCKETS, details=True), 2)), f"SELECT bucket, count, round(fraction, 2) AS fraction, round(iroi, 2) AS iroi, round(incremental_benefit, 2) AS incremental_benefit, round(incremental_cost, 2) AS incremental_cost, incremental_cost < 0 AS negative_cost FROM ({evaluation_sql('lines', IROI, q).replace(', 6) AS i', ', 12) AS i')})"),
        "cum_iroi_details": (on("events", lambda d, e: ev.cum_iroi(d, e, BUCKETS, details=True)), f"SELECT *, incremental_cost < 0 AS negative_cost FROM ({evaluation_sql('events', IROI, q, True, threshold=True)})"),
        "cate_per_bucket_ci": (on("orders", lambda d, e: ev.cate(d, e, bootstrap=BOOT)), evaluation_sql("orders", {"cate": METRIC_SQL["ate"]}, "bucket", draws=DRAWS)),
        "cate_per_quantile_ci": (on("orders", lambda d, e: ev.cate(d, e, BUCKETS, bootstrap=BOOT)), evaluation_sql("orders", {"cate": METRIC_SQL["ate"]}, q, draws=DRAWS)),
        "target_rate_per_quantile_ci": (on("events", lambda d, e: ev.target_rate(d, e, BUCKETS, bootstrap=BOOT)), evaluation_sql("events", rate, q, draws=DRAWS)),
        "cate_lift_ci": (on("orders", lambda d, e: ev.cate_lift(d, e, BUCKETS, BOOT)), evaluation_sql("orders", {"cum_cate": METRIC_SQL["ate"]}, q, True, draws=DRAWS)),
        "qini_ci": (on("orders", lambda d, e: ev.qini(d, e, BUCKETS, BOOT)), evaluation_sql("orders", {"ate": f"({METRIC_SQL['ate']}) * f"}, q, True, DRAWS, True, True)),
        "qini_ci_full": (on("orders", lambda d, e: ev.qini(d, e, 30, FULL)), evaluation_sql("orders", {"ate": f"({METRIC_SQL['ate']}) * f"}, q, True, 100, True, True, buckets=30)),
        "cate_per_quantile_ci_full": (on("orders", lambda d, e: ev.cate(d, e, 30, bootstrap=FULL)), evaluation_sql("orders", {"cate": METRIC_SQL["ate"]}, q, draws=100, buckets=30)),
        "cum_iroi_ci": (on("events", lambda d, e: ev.cum_iroi(d, e, BUCKETS, BOOT)), evaluation_sql("events", i1, q, True, DRAWS, True)),
        "target_rate_per_bucket_ci": (on("events", lambda d, e: ev.target_rate(d, e, bootstrap=BOOT)), evaluation_sql("events", rate, "bucket", draws=DRAWS)),
        "iroi_per_bucket_ci": (on("events", lambda d, e: ev.iroi(d, e, per_bucket=True, bootstrap=BOOT)), evaluation_sql("events", i1, "bucket", draws=DRAWS)),
        "iroi_per_quantile_ci": (on("events", lambda d, e: ev.iroi(d, e, BUCKETS, bootstrap=BOOT)), evaluation_sql("events", i1, q, draws=DRAWS)),
        "poisson_draws": (lambda s, f: view(s, f, "orders").select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("draw"), "unit").select("draw", poisson(portable_uniform(F.col("unit"), F.col("draw"))).alias("times")).groupBy("draw", "times").agg(F.count(F.lit(1)).alias("n")), _draws_sql()),
        "quantile_buckets": (_quantiles, _quantiles_sql()),
        "bar_plot_data": (lambda s, f: tidy(plots.bar_data(ev.cate(view(s, f, "orders"), experiment("orders")), "cate")), f"SELECT bucket AS x, cate AS y FROM ({evaluation_sql('orders', {'cate': METRIC_SQL['ate']}, 'bucket')})"),
        "curve_plot_data": (lambda s, f: tidy(plots.curve_data(tidy(ev.cate_lift(view(s, f, "orders"), experiment("orders"), BUCKETS)), "cum_cate")), f"WITH k AS ({evaluation_sql('orders', {'cum_cate': METRIC_SQL['ate']}, q, True)}), o AS (SELECT arg_max(cum_cate, fraction) AS overall FROM k) SELECT fraction AS x, cum_cate AS y, overall, round(fraction * overall, 6) AS diagonal FROM k, o"),
        "effect_by_window": (lambda s, f: tidy(effect_by_window(s.read.parquet(f"{f}/events.parquet").withColumn("treatment", (F.col("user_id") % 2).cast("int")).withColumn("outcome", (F.col("event_type") == "purchase").cast("int")), Experiment(), "ts", "1 day").select("n", "ate", F.col("start").cast("string").alias("start"))), "SELECT count(*) AS n, round(sum(CASE WHEN user_id % 2 = 1 AND event_type = 'purchase' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END), 0)::DOUBLE - sum(CASE WHEN user_id % 2 = 0 AND event_type = 'purchase' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END), 0)::DOUBLE, 6) AS ate, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start FROM events GROUP BY date_trunc('day', ts)"),
    }


# --- selection ---


def _binned_sql() -> str:
    shares = ", ".join(repr(i / 10) for i in range(1, 10))
    return f"v AS ({SQL['lines'][0]}), q AS (SELECT list_sort(list_distinct(quantile_disc(l_quantity, [{shares}]))) AS cuts FROM v), d AS (SELECT treatment, outcome, l_tax, l_linenumber, CAST(len(list_filter(cuts, lambda c: c <= l_quantity)) AS DOUBLE) AS l_quantity FROM v, q), " + "p AS (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS bin, treatment AS t, outcome AS y FROM d" for x in FEATURES) + ")"


_CELLS = "sum(CASE WHEN t = 1 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS t1, sum(CASE WHEN t = 1 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS t0, sum(CASE WHEN t = 0 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS c1, sum(CASE WHEN t = 0 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS c0"


def _rates_sql(table: str) -> str:
    """Smoothed rates: an empty cell of an arm and outcome that occur in the bin counts 1."""
    cell = lambda a, y, other: f"CASE WHEN {a}{y} > 0 OR {a}1 + {a}0 = 0 THEN {a}{y} WHEN {other}{y} > 0 THEN 1 ELSE 0 END"
    return f"SELECT *, ({cell('t', 1, 'c')}) / nullif(({cell('t', 1, 'c')}) + ({cell('t', 0, 'c')}), 0) AS pt, ({cell('c', 1, 't')}) / nullif(({cell('c', 1, 't')}) + ({cell('c', 0, 't')}), 0) AS pc FROM {table}"


def _distance_sql(method: str) -> str:
    if method == "KL":
        p, q = "least(greatest(pt, 1e-6), 1 - 1e-6)", "least(greatest(pc, 1e-6), 1 - 1e-6)"
        d = f"({p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q})))"
    elif method == "ED":
        d = "(2 * (pt - pc) * (pt - pc))"
    else:
        d = "((pt - pc) * (pt - pc) / greatest(1e-6, pc) + (pt - pc) * (pt - pc) / greatest(1e-6, 1 - pc))"
    return f"CASE WHEN pt IS NULL OR pc IS NULL THEN 0 ELSE {d} END"


def _divergence_sql(method: str) -> str:
    return f"WITH {_binned_sql()}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), r AS ({_rates_sql('g')}), a AS (SELECT 'x' AS feature, {_CELLS} FROM (SELECT treatment AS t, outcome AS y FROM d)), ra AS ({_rates_sql('a')}) SELECT feature, round(sum({_distance_sql(method)} * (t1 + t0 + c1 + c0)) / sum(t1 + t0 + c1 + c0) - (SELECT {_distance_sql(method)} FROM ra), 6) AS score FROM r GROUP BY feature"


_CURVE_BINS = "(coalesce(t1 / nullif(t1 + t0, 0), 0) - coalesce(c1 / nullif(c1 + c0, 0), 0)) * (t1 + t0 + c1 + c0) / sum(t1 + t0 + c1 + c0) OVER (PARTITION BY feature)"


def _niv_bins_sql(rows: str) -> str:
    share = {(y, t): f"coalesce({a}{y} / nullif(sum({a}{y}) OVER (PARTITION BY feature), 0), 0)" for t, a in ((1, "t"), (0, "c")) for y in (1, 0)}
    shares = ", ".join(f"{x} AS e{y}{t}" for (y, t), x in share.items())
    woe = lambda t: f"(CASE WHEN e0{t} = 0 THEN -10.0 WHEN e1{t} = 0 THEN 10.0 ELSE log10(e1{t} / nullif(e0{t}, 0)) END)"
    return f"WITH {rows}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), e AS (SELECT feature, bin, {shares} FROM g) SELECT feature, bin, ({woe(1)} - {woe(0)}) * (e11 * e00 - e01 * e10) AS contribution FROM e"


def _niv_sql(rows: str) -> str:
    return f"SELECT feature, round(sum(contribution) / count(*), 6) AS score FROM ({_niv_bins_sql(rows)}) GROUP BY feature"


#: Few rows, so that cells of a bin, arm and outcome are empty.
FEW = f"SELECT CAST(unit % 11 AS DOUBLE) AS f, treatment, outcome FROM ({SQL['orders'][0]}) AS o WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-01-10'"


def _few(spark: SparkSession, folder: str) -> DataFrame:
    rows = se.date_range(view(spark, folder, "orders"), "o_orderdate", F.lit("1995-01-01").cast("timestamp"), F.lit("1995-01-10").cast("timestamp"))
    return rows.select((F.col("unit") % 11).cast("double").alias("f"), "treatment", "outcome")


def _one_feature_sql(rows: str, feature: str, column: str) -> str:
    """The parts of _binned_sql for one feature that is its own bin."""
    return f"d AS (SELECT * FROM ({rows})), p AS (SELECT '{feature}' AS feature, {column} AS bin, treatment AS t, outcome AS y FROM d)"


def _bins_sql(method: str, rows: str) -> str:
    return f"WITH {rows}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), r AS ({_rates_sql('g')}) SELECT feature, bin, round({_distance_sql(method)} * (t1 + t0 + c1 + c0) / sum(t1 + t0 + c1 + c0) OVER (PARTITION BY feature), 6) AS contribution FROM r"


def _selections() -> dict[str, tuple[Query, str | None]]:
    e = Experiment()

    def lines(f) -> Query:
        return lambda spark, folder: tidy(f(view(spark, folder, "lines")))

    out = {f"divergence_{m.lower()}": (lines(lambda d, m=m: se.divergence_filter(d, e, FEATURES, method=m)), _divergence_sql(m)) for m in ("KL", "ED", "Chi")}
    parts = "SELECT o_orderpriority AS feature, sum(o_totalprice) AS a, max(o_totalprice) AS b, count(*)::DOUBLE AS c FROM orders GROUP BY 1"

    def scores(spark: SparkSession, folder: str) -> DataFrame:
        o = spark.read.parquet(f"{folder}/orders.parquet")
        return o.groupBy(F.col("o_orderpriority").alias("feature")).agg(F.sum("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))

    return out | {
        "uplift_curve_filter": (lines(lambda d: se.uplift_curve_filter(d, e, FEATURES)), f"WITH {_binned_sql()}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), b AS (SELECT feature, {_CURVE_BINS} AS x FROM g) SELECT feature, round(sum(x), 6) AS score FROM b GROUP BY feature"),
        "uplift_curve_bins": (lines(lambda d: se.uplift_curve_bins(d, e, FEATURES)), f"WITH {_binned_sql()}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin) SELECT feature, round(bin, 6) AS bin, round({_CURVE_BINS}, 6) AS contribution FROM g"),
        "divergence_bins": (lines(lambda d: se.divergence_bins(d, e, FEATURES, method="ED")), f"WITH {_binned_sql()}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), r AS ({_rates_sql('g')}) SELECT feature, round(bin, 6) AS bin, round({_distance_sql('ED')} * (t1 + t0 + c1 + c0) / sum(t1 + t0 + c1 + c0) OVER (PARTITION BY feature), 6) AS contribution FROM r"),
        "divergence_bins_kl": (lines(lambda d: se.divergence_bins(d, e, FEATURES)), _bins_sql("KL", _binned_sql())),
        "divergence_bins_chi": (lines(lambda d: se.divergence_bins(d, e, FEATURES, method="Chi")), _bins_sql("Chi", _binned_sql())),
        "niv_filter": (lines(lambda d: se.niv_filter(d, e, FEATURES)), _niv_sql(_binned_sql())),
        "niv_bins": (lines(lambda d: se.niv_bins(d, e, FEATURES)), f"SELECT feature, bin, round(contribution, 6) AS contribution FROM ({_niv_bins_sql(_binned_sql())})"),
        "divergence_empty_cells": (lambda s, f: tidy(se.divergence_bins(_few(s, f), e, ["f"], bins=20)), _bins_sql("KL", _one_feature_sql(FEW, "f", "f"))),
        "niv_empty_cells": (lambda s, f: tidy(se.niv_bins(_few(s, f), e, ["f"], bins=20)), f"SELECT feature, bin, round(contribution, 6) AS contribution FROM ({_niv_bins_sql(_one_feature_sql(FEW, 'f', 'f'))})"),
        "niv_double_arms": (lines(lambda d: se.niv_filter(d.withColumn("treatment", F.col("treatment").cast("double")), e, FEATURES)), _niv_sql(_binned_sql())),
        "uplift_curve_text_arms": (lines(lambda d: se.uplift_curve_filter(d.withColumn("treatment", F.when(F.col("treatment") == 1, "offer").otherwise("none")), Experiment(treated="offer", control="none"), FEATURES)), f"WITH {_binned_sql()}, g AS (SELECT feature, bin, {_CELLS} FROM p GROUP BY feature, bin), b AS (SELECT feature, {_CURVE_BINS} AS x FROM g) SELECT feature, round(sum(x), 6) AS score FROM b GROUP BY feature"),
        "divergence_text_feature": (lambda s, f: tidy(se.divergence_bins(view(s, f, "orders"), e, ["bucket"])), _bins_sql("KL", _one_feature_sql(SQL["orders"][0], "bucket", "bucket"))),
        "importance_plot_data": (lines(lambda d: plots.importance_data(se.niv_filter(d, e, FEATURES))), f"SELECT feature AS x, score AS y FROM ({_niv_sql(_binned_sql())})"),
        "contribution_plot_data": (lines(lambda d: plots.contribution_data(se.niv_bins(d, e, FEATURES), "l_quantity")), f"SELECT feature, bin AS x, round(contribution, 6) AS y FROM ({_niv_bins_sql(_binned_sql())}) WHERE feature = 'l_quantity'"),
        "discretise": (lines(lambda d: se.discretise(d, FEATURES, exact=True).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"))), f"WITH {_binned_sql()} SELECT l_tax, l_linenumber, l_quantity, count(*) AS n FROM d GROUP BY 1, 2, 3"),
        "min_max": (lambda s, f: tidy(se.min_max(scores(s, f), ["a", "b", "c"])), f"SELECT {', '.join(f'round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) AS {c}' for c in 'abc')} FROM ({parts})"),
        "linear_weighting": (lambda s, f: tidy(se.linear_weighting(scores(s, f), ["a", "b", "c"]), 2), f"SELECT feature, round(a, 2) AS a, round(b, 2) AS b, round(c, 2) AS c, round(a * (1.0::DOUBLE / 3) + b * (2.0::DOUBLE / 3) + c, 2) AS weighted_score FROM ({parts})"),
        "date_range": (lambda s, f: se.date_range(view(s, f, "orders"), "o_orderdate", F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")).select("unit", "treatment", "outcome"), f"WITH v AS ({SQL['orders'][0]}) SELECT unit, treatment, outcome FROM v WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    }


# --- learners ---


def _learners() -> dict[str, tuple[Query, str | None]]:
    e = Experiment(outcome="l_extendedprice", features=("l_quantity",), key=("l_linenumber",))

    def linear(make) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            d = view(spark, folder, "lines").drop("score")
            return tidy(make().fit(d).predict(d).groupBy("l_quantity").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")), 3)

        return run

    v = f"v AS (SELECT treatment AS t, l_quantity AS x, l_extendedprice AS y, l_linenumber FROM ({SQL['lines'][0]}))"
    tail = "SELECT x AS l_quantity, round({}, 3) AS score, count(*) AS n FROM v, m GROUP BY x, {}"
    per_arm = f"WITH {v}, m AS (SELECT regr_slope(y, x) FILTER (t = 1) - regr_slope(y, x) FILTER (t = 0) AS s, regr_intercept(y, x) FILTER (t = 1) - regr_intercept(y, x) FILTER (t = 0) AS i FROM v) " + tail.format("i + s * x", "i, s")
    s_sql = f"WITH {v}, m AS (SELECT (var_pop(x) * covar_pop(t, y) - covar_pop(x, t) * covar_pop(x, y)) / (var_pop(x) * var_pop(t) - covar_pop(x, t) * covar_pop(x, t)) AS s FROM v) " + tail.format("s", "s")
    to_sql = f"WITH {v}, p AS (SELECT avg(t) AS p FROM v), d AS (SELECT x, CASE WHEN t = 1 THEN y / p ELSE -y / (1 - p) END AS d FROM v, p), m AS (SELECT regr_slope(d, x) AS s, regr_intercept(d, x) AS i FROM d) " + tail.format("i + s * x", "i, s")
    r_sql = f"WITH {v}, f AS (SELECT unnest([0, 1]) AS k), o AS (SELECT k, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(t) AS p FROM v, f WHERE l_linenumber % 2 <> k GROUP BY k), r AS (SELECT x, (y - i - s * x) / (t - p) AS d, (t - p) * (t - p) AS w FROM v JOIN o ON l_linenumber % 2 = k), c AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * d) AS wd, sum(w * x * x) AS wxx, sum(w * x * d) AS wxd FROM r), m AS (SELECT (w * wxd - wx * wd) / (w * wxx - wx * wx) AS s, (wd - (w * wxd - wx * wd) / (w * wxx - wx * wx) * wx) / w AS i FROM c) " + tail.format("i + s * x", "i, s")

    def r_learner(spark: SparkSession, folder: str, validated: bool = False) -> DataFrame:
        d = view(spark, folder, "lines").drop("score").withColumn("half", F.col("l_linenumber").cast("int") % 2)
        learner, held = le.RLearner(OLS, e, fold_column="half"), F.col("l_linenumber") > 5
        m = learner.fit(d.where(~held), d.where(held)) if validated else learner.fit(d)
        return tidy(m.predict(d).groupBy("l_quantity").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")), 3)

    def categories(spark: SparkSession, folder: str) -> DataFrame:
        o = spark.read.parquet(f"{folder}/orders.parquet")
        out = feature_pipeline(["o_orderpriority"], ["o_totalprice"], one_hot=False).fit(o).transform(o)
        return out.groupBy("o_orderpriority", F.col("o_orderpriority_index").alias("category")).agg(F.count(F.lit(1)).alias("n"))

    logistic, tree = le.Base(LogisticRegression, {"maxIter": 10}), le.Base(DecisionTreeRegressor, {"maxDepth": 5})
    labels = lambda: le.ClassTransformation(OLS, Experiment()).label()
    orders = SQL["orders"][0]
    unit = Experiment(features=("o_totalprice", "score"), key=("unit",))
    line = Experiment(features=("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice"), key=experiment("lines").key)

    def learned(make, name: str = "orders") -> Query:
        """Of each row of the view its key and what the learner says."""

        def run(spark: SparkSession, folder: str) -> DataFrame:
            d, x = view(spark, folder, name), unit if name == "orders" else line
            return make(x).fit(d).predict(d).select(*x.key, "learned")

        return run

    forest = lambda x: UpliftForest(x, trees=10, max_depth=5, bins=20, output="learned")
    benefit = lambda x: x.with_(outcome="benefit")

    def importance(spark: SparkSession, folder: str) -> DataFrame:
        return permutation_importance(view(spark, folder, "lines"), UpliftForest(line, trees=5, max_depth=3, bins=10), buckets=10)

    def retrospective(spark: SparkSession, folder: str) -> DataFrame:
        rows = le.Retrospective(OLS, unit).positives(view(spark, folder, "orders"))
        return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("__t").cast("long").alias("treated"))

    def folds(spark: SparkSession, folder: str) -> DataFrame:
        """Folds that other engines can draw, given to the learner as a column."""
        d = view(spark, folder, "orders").withColumn("part", F.floor(2 * portable_uniform(F.col("unit"), F.lit("fold"))).cast("int"))
        return d.groupBy(le.RLearner(OLS, unit, fold_column="part").fold_of().alias("fold")).agg(F.count(F.lit(1)).alias("n"))

    return {
        "t_learner_linear": (linear(lambda: le.TLearner(OLS, e)), per_arm),
        "x_learner_linear": (linear(lambda: le.XLearner(OLS, e)), per_arm),
        "s_learner_linear": (linear(lambda: le.SLearner(OLS, e)), s_sql),
        "transformed_outcome_linear": (linear(lambda: le.TransformedOutcome(OLS, e)), to_sql),
        "r_learner_linear": (r_learner, r_sql),
        "r_learner_validation": (lambda s, f: r_learner(s, f, True), r_sql.replace("[0, 1]", "[0, 1, 2]").replace("l_linenumber % 2", "(CASE WHEN l_linenumber > 5 THEN 2 ELSE l_linenumber % 2 END)")),
        "propensity_own_arm": (lambda s, f: tidy((lambda d: le.Propensity(Experiment(), own_arm_share=True).fit(d).predict(d))(view(s, f, "orders")).select("unit", "propensity")), f"WITH v AS ({orders}), p AS (SELECT avg(treatment) AS p FROM v) SELECT unit, round(CASE WHEN treatment = 1 THEN p ELSE 1 - p END, 6) AS propensity FROM v, p"),
        "category_index": (categories, "WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS DOUBLE) AS category, n FROM c"),
        "propensity_share": (lambda s, f: tidy((lambda d: le.Propensity(Experiment()).fit(d).predict(d))(view(s, f, "orders")).select("unit", "propensity")), f"WITH v AS ({orders}) SELECT unit, round(avg(treatment) OVER (), 6) AS propensity FROM v"),
        "cvt_label": (lambda s, f: view(s, f, "orders").select("unit", labels().cast("int").alias("label")), f"WITH v AS ({orders}) SELECT unit, CASE WHEN treatment = outcome THEN 1 ELSE 0 END AS label FROM v"),
        "transformed_outcome_label": (lambda s, f: tidy(view(s, f, "orders").select("unit", le.TransformedOutcome(OLS, Experiment()).label(F.lit(0.25)).alias("label"))), f"WITH v AS ({orders}) SELECT unit, CASE WHEN treatment = 1 THEN outcome / 0.25 ELSE -outcome / 0.75 END::DOUBLE AS label FROM v".replace("-outcome / 0.75", "round(-outcome / 0.75, 6)")),
        "retrospective_filter": (retrospective, f"WITH v AS ({orders}) SELECT bucket, count(*) AS n, sum(treatment)::BIGINT AS treated FROM v WHERE outcome = 1 GROUP BY bucket"),
        "r_learner_folds": (folds, f"WITH v AS ({orders}) SELECT CAST(floor(2 * (CAST('0x' || substr(md5(CAST(unit AS VARCHAR) || ':fold'), 1, 8) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))) AS INT) AS fold, count(*) AS n FROM v GROUP BY 1"),
        "t_learner_logistic": (learned(lambda x: le.TLearner(logistic, x, "learned")), None),
        "s_learner_tree": (learned(lambda x: le.SLearner(tree, benefit(x), "learned"), "lines"), None),
        "x_learner_tree": (learned(lambda x: le.XLearner(tree, benefit(x), "learned"), "lines"), None),
        "cvt_logistic": (learned(lambda x: le.ClassTransformation(logistic, x, "learned")), None),
        "propensity_logistic": (learned(lambda x: le.Propensity(x, logistic, "learned")), None),
        "retrospective_logistic": (learned(lambda x: le.Retrospective(logistic, x, "learned")), None),
        "uplift_forest": (learned(forest, "lines"), None),
        "permutation_importance": (importance, None),
        "simulate_rct": (lambda s, f: randomised_trial(s, 1000, 6, binary=True, cost_benefit=True), None),
    }


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """Name -> query and its SQL, if there is one."""
    return {**_evaluations(), **_selections(), **_learners()}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in all_queries().items() if s}
