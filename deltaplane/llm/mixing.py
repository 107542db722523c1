"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions but for the running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._shared import blank_words, join_checked, materialise, running_sums

#: A source may be repeated so often.
MOST_PASSES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> source, source_size, weight, target.

    Targets share all sizes by weight; one above MOST_PASSES times its source's size stops there and the excess is
    shared anew among the others, until none is above. Sources stop in the order of cap over weight, so running sums of
    caps and weights in that order give the final unit as a maximum; two passes over the sources, and three numbers
    reach the driver. Null is a source, last in order.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(by, ["source"], ["one"], name="sources", nulls_last=True)
    rank = F.pmod(F.col("before_one"), F.lit(len(WEIGHTS))).cast("int")
    sources = materialise(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1).cast("long").alias("weight")), "targets")
    cap = MOST_PASSES * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")).first()
    if not whole["weights"]:
        return sources.withColumn("target", F.lit(0.0))
    stops = running_sums(sources.select("source", "weight", cap.alias("cap"), (cap / F.col("weight")).alias("ratio")), ["ratio", "source"], ["cap", "weight"], name="stops")
    unit = stops.agg(F.max((F.lit(whole["all"]) - F.col("before_cap")) / (F.lit(whole["weights"]) - F.col("before_weight"))).alias("u")).first()["u"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(unit))))


def demand_time(share: Column, slope: Column) -> Column:
    """The training time in [0, 1] at which a source of weight schedule 1 + slope * (2t - 1) has met `share` of its demand.

    Its integral is (1 - slope) * t + slope * t^2; this is the inverse.
    """
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise((F.sqrt(F.greatest(b * b + 4 * slope * share, F.lit(0.0))) - b) / (2 * slope))


def curriculum(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, weight, target, taken, before and the carried columns.

    A source's documents lie one behind another on a tape, in an order drawn from the md5 of their doc_id; the mix takes
    the first `target` words of the tape repeated MOST_PASSES times. `before`: words of the source before the document.
    Null and blank texts have size 0 and nothing taken. Rows that share a doc_id, null ones too, are rows of their own,
    in the order of their size and the hash of their text, so that reruns agree; wholly equal rows are alike in either
    order. An empty table gives an empty result; columns that aren't carried are ignored, whatever their names. The
    words of a text of any length are counted whole.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("text_hash"), F.size(blank_words(F.col(text))).cast("long").alias("size"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(carry or [])])
    narrow = materialise(own, "sizes")
    targets = source_targets(narrow.select("source", "size"))
    laid = running_sums(narrow.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), ["draw", "doc_id", "size", "text_hash"], ["size"], by=["source"], name="tape")
    laid = laid.withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), "source_size", "weight", "target")
    met = join_checked(laid, targets, ["__source"]).withColumnRenamed("before_size", "before")
    tape = F.least(F.round("target").cast("long"), MOST_PASSES * F.col("source_size"))
    taken = sum((take(tape, p) for p in range(MOST_PASSES)), F.lit(0).cast("long"))
    return met.select("doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"), "before", tape.alias("tape"), *[F.col(f"__{i}") for i in range(len(carry or []))])


def take(tape: Column, p: int | Column) -> Column:
    """Words that pass p of the tape takes of a document."""
    return F.least(F.greatest(tape - p * F.col("source_size") - F.col("before"), F.lit(0).cast("long")), F.col("size"))


def training_order(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row for each document and pass that is taken: doc_id, source, pass, position in [0, 1], n_take and the carried
    columns, range-sorted by position.

    Each source's weight schedule (weight 1 fades, 2 stays, 3 grows) is integrated; a document starts where its source's
    cumulative demand reaches the words before it.
    """
    return ordered(curriculum(docs, doc_id, text, source, carry))


def ordered(mixed: DataFrame) -> DataFrame:
    """The rows of training_order for those of curriculum."""
    each = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1)))).withColumn("n_take", take(F.col("tape"), F.col("pass"))).where("n_take > 0")
    share = (F.col("pass") * F.col("source_size") + F.col("before")) / F.col("tape")
    placed = each.withColumn("position", demand_time(share.cast("double"), (F.col("weight") - 2) / F.lit(2.0)))
    return placed.repartitionByRange("position", F.xxhash64("doc_id", "pass")).sortWithinPartitions("position", "doc_id", "pass")


def taken_in_order(docs: DataFrame) -> DataFrame:
    """The rows of curriculum for columns doc_id, text and source, with taken summed over the rows of their stored training order."""
    mixed = materialise(curriculum(docs).drop("taken").withColumn("row", F.monotonically_increasing_id()), "mixed")
    placed = materialise(ordered(mixed).select("row", "doc_id", "pass", "position", "n_take"), "order")
    sums = placed.groupBy("row").agg(F.sum("n_take").alias("taken"))
    return mixed.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("row")


def mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """docs as the mix trains on them: a row for each pass, in training order, with texts cut where the tape ends.

    n_chars, if there, follows the text. The columns are those of docs.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", source)]
    placed = training_order(docs, source=source, carry=carried)
    back = {c: F.col(f"__{i}") for i, c in enumerate(carried)}
    # At the end of the tape the first words of a text are taken, joined by single spaces.
    head = F.array_join(F.slice(blank_words(back["text"]), F.lit(1), F.col("n_take").cast("int")), " ")
    text = F.when(F.col("n_take") < F.col("size"), head).otherwise(back["text"])
    own = {"doc_id": F.col("doc_id"), source: F.col("source"), **back, "text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return placed.select(*[own[c].alias(c) for c in docs.columns])
