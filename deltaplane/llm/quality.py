"""Document quality rules with host-level verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._shared import BLANKS, blank_words, join_checked, materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text, without the text.

    Repeated windows are found within the row: windows are compared by their XXH64, and only texts in which some window
    repeats go on to sort (hash, position) pairs. A null text counts as empty: all measures are 0.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    a = docs.select(
        *rest,
        blank_words(t).alias("__words"),
        lines.alias("__lines"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        *rest, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("__windows"),
    )
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    c = b.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("__windows")
    beside = lambda x, i: F.coalesce(F.get(F.col("__sorted"), i)["h"] == x["h"], F.lit(False))
    d = c.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["i"]))).drop("__sorted")
    covered = F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), i + 1), p + WINDOW) - p))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("__at")


def verdicts(measured: DataFrame, host: str, least_words: int = 20, repeat_percent: int = 30, symbol_percent: int = 10, dup_line_percent: int = 30, reject_rate: float = 0.5) -> DataFrame:
    """measured with base_failed, rule_failed, host_rate and kept.

    A document fails a rule if it is too short, repeats itself, has too many symbols or repeated lines for its words, or
    words of unusual mean length. Failures are summed by host with map-side sums (a hot host costs one row for each
    task). A beta prior is fitted to all hosts by moments: mean m of all documents, concentration from the spread of the
    hosts' rates beyond the binomial; two numbers reach the driver. A host whose posterior mean failure rate is
    `reject_rate` or more is rejected with all its documents. Documents without a host are judged by their own base
    rules alone.
    """
    n, r = F.col("n_words"), F.col("n_repeat_words")
    base = (n < least_words) | (100 * r > repeat_percent * n)
    odd = (100 * F.col("n_symbols") > symbol_percent * n) | (100 * F.col("n_dup_lines") > dup_line_percent * n) | (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)
    judged = materialise(measured.withColumn("base_failed", base).withColumn("rule_failed", base | odd), "quality")
    hosts = materialise(judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("__docs"), F.sum(F.col("rule_failed").cast("long")).alias("__failed")), "hosts")
    m, k = beta_prior(hosts)
    rate = (F.col("__failed") + F.lit(m * k)) / (F.col("__docs") + F.lit(k))
    host_rates = hosts.select("__host", rate.alias("host_rate"))
    out = join_checked(judged.withColumn("__host", F.col(host)), host_rates, ["__host"], "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) < reject_rate))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and concentration of the hosts' failure rates: hosts(__docs, __failed)."""
    d, f = F.col("__docs").cast("double"), F.col("__failed").cast("double")
    x = hosts.agg(F.sum(d).alias("n"), F.sum(f).alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(f * f / d).alias("q")).first()
    if not x["n"] or not x["f"] or x["f"] == x["n"]:
        return (x["f"] or 0.0) / (x["n"] or 1.0), 1.0
    m = x["f"] / x["n"]
    between = (x["q"] - x["n"] * m * m) / x["n"] - m * (1 - m) * x["hosts"] / x["n"]
    return m, min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6


def host_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **rules: object) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, base_failed, rule_failed, host_rate, kept.

    Null text: no words, so it fails. Null host: no host verdict. Repeated rows each count and are each returned; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host"))
    return verdicts(measures(narrow), "host", **rules).drop("host")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", **rules: object) -> DataFrame:
    """The rows of docs that host_quality keeps. Each row is judged by its own text and host, whatever its doc_id.

    The rows travel with their measures, so that nothing is joined but the hosts' rates.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"), F.col(host).alias("__own"))
    judged = verdicts(measures(rows, "__text"), "__own", **rules)
    return judged.where("kept").select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
