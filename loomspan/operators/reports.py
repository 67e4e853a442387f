"""Reports over call logs, probes and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arm_report(calls: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm: calls, good calls, cost over the calls that have one, tokens of good calls, cost of a good call."""
    good = F.col("ok")
    return calls.groupBy(arm).agg(
        F.count("*").alias("calls"),
        F.count_if(good).alias("good"),
        F.count("cost_usd").alias("costed"),
        F.round(F.sum("cost_usd"), 2).alias("cost"),
        F.sum(F.when(good, F.col("tokens"))).alias("tokens"),
        F.round(F.sum(F.when(good, F.col("tokens"))) / F.greatest(F.count_if(good), F.lit(1)), 6).alias("tokens_per_good"),
    )


def ranked_values(calls: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Per key the number of values, those at places int(n * share) of the sorted values, and the largest.

    Exact, by counts of distinct values. Of a key with more than ``accuracy`` values only a narrow band is put in order: a sketch whose error in rank
    is known bounds each place from both sides, what lies below the band is counted, and ranks go on within it. So a window
    holds some thousandths of a key's values.
    """
    counts = calls.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    spare = 3.0 / accuracy
    ends = [x for s in shares.values() for x in (max(0.0, s - spare), min(1.0, s + spare))]
    sketch = calls.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("_least"), F.max(value).alias("max"), F.percentile_approx(value, ends, accuracy).alias("_q"))
    large = F.col("n") > accuracy
    sketch = sketch.withColumns({f"_{side}{k}": F.when(large, F.col("_q")[2 * k + j]).otherwise(F.col(rest)) for k in range(len(shares)) for j, (side, rest) in enumerate((("low", "_least"), ("high", "max")))})
    # a key's bounds meet its values by name, nulls included
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    bounds = sketch.select(*[F.col(k).alias(n) for k, n in names.items()], "n", *[f"_{side}{k}" for k in range(len(shares)) for side in ("low", "high")])
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    c = counts.join(bounds, on).drop(*names.values())
    below = c.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_v") < F.col(f"_low{k}"), F.col("_n"))), F.lit(0)).alias(f"_below{k}") for k in range(len(shares))])
    each = F.array(*[F.when(F.col("_v").between(F.col(f"_low{k}"), F.col(f"_high{k}")), F.lit(k)) for k in range(len(shares))])
    band = c.select(*keys, "n", "_v", "_n", F.explode(F.array_compact(each)).alias("_k"))
    band = band.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_k").orderBy("_v")))
    below = below.select(*[F.col(k).alias(n) for k, n in names.items()], *[f"_below{k}" for k in range(len(shares))])
    band = band.join(below, on).drop(*names.values())
    picks = [F.min(F.when((F.col("_k") == k) & (F.col(f"_below{k}") + F.col("_upto") > F.floor(F.col("n") * s)), F.col("_v"))).alias(name) for k, (name, s) in enumerate(shares.items())]
    found = band.groupBy(*keys).agg(*picks)
    most = sketch.select(*[F.col(k).alias(n) for k, n in names.items()], "n", "max")
    return found.join(most, on).select(*keys, "n", *shares, "max")


def error_classes(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Counts of failed calls by the part of the error before its colon."""
    out = calls.where("not ok").groupBy(F.substring_index("error", ":", 1).alias("error_class")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "error_class").limit(most) if most else out


def deadline_what_if(calls: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Per deadline the calls that it would lose and the wall of the rest: deadlines are a few rows and meet counts
    of distinct latencies."""
    counts = calls.groupBy("latency_s").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(deadlines)).groupBy("deadline").agg(F.sum(F.when(F.col("latency_s") > F.col("deadline"), F.col("n")).otherwise(0)).alias("lost"), F.max(F.when(F.col("latency_s") <= F.col("deadline"), F.col("latency_s"))).alias("wall"))


def catalogue_rank(models: DataFrame, tokens_in: float, tokens_out: float, budget: float, least_output: int = 8000) -> DataFrame:
    """Models that can be used within the budget, by cost: no negative price, structured output, enough output."""
    ok = models.where("in_per_m >= 0 and out_per_m >= 0 and structured").where(F.coalesce("max_output", F.lit(0)) >= least_output)
    cost = F.col("in_per_m") * tokens_in / 1e6 + F.col("out_per_m") * tokens_out / 1e6
    return ok.withColumn("cost", cost).where(F.col("cost") <= budget)


def rotated_arms(frames: DataFrame, arms: DataFrame, n_arms: int) -> DataFrame:
    """Every arm on every frame, in an order that is rotated by the frame's place so that no arm always goes first.
    frames: frame, i; arms: arm, j (a few rows)."""
    return frames.join(F.broadcast(arms)).withColumn("slot", F.pmod(F.col("j") - F.col("i"), F.lit(n_arms)))


def parsed_spec(rows: DataFrame, spec: str, versions: list[str], default_effort: str = "low", refuse: bool = False) -> DataFrame:
    """``model:version:effort:overlay`` with defaults for what is missing; ``problem`` says what is wrong, and with ``refuse``
    the first problem ends the query with an error."""
    parts = F.split(spec, ":")
    part = lambda k: F.nullif(F.trim(F.try_element_at(parts, F.lit(k))), F.lit(""))
    out = rows.withColumns({"model": part(1), "version": F.coalesce(part(2), F.lit(versions[0])), "effort": F.coalesce(part(3), F.lit(default_effort)), "overlay": F.coalesce(part(4), F.lit("none"))})
    out = out.withColumn("problem", F.when(F.size(parts) > 4, "too many parts").when(F.col("model").isNull(), "no model").when(~F.col("version").isin(versions), "unknown version"))
    if refuse:
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("arm "), F.col(spec), F.lit(": "), F.col("problem")))))
    return out


def unpinned(used: DataFrame, pinned: DataFrame, on: str) -> DataFrame:
    """Rows whose model has no entry."""
    return used.join(pinned.select(on).distinct(), on, "left_anti")


def all_pinned(used: DataFrame, pinned: DataFrame, on: str) -> DataFrame:
    """``used`` as it is; a model without an entry ends the query with an error, as no convention is ever guessed."""
    known = pinned.select(F.col(on).alias("_pinned")).distinct()
    j = used.join(known, F.col(on).eqNullSafe(F.col("_pinned")), "left")
    checked = F.when(F.col("_pinned").isNull(), F.raise_error(F.concat(F.coalesce(F.col(on).cast("string"), F.lit("null")), F.lit(" has no pinned coordinate convention")))).otherwise(F.col(on))
    return j.withColumn(on, checked).select(*used.columns)


def submission_places(calls: DataFrame, keys: list[str], submitted: list[str], landed: list[str]) -> DataFrame:
    """``calls`` with ``place`` (from 0, by the order in which calls were submitted, in which results are handed on) and
    ``landed_place`` (by the order in which they came back), within the pool that ``keys`` name."""
    w = Window.partitionBy(*keys)
    return calls.withColumns({"place": F.row_number().over(w.orderBy(*submitted)) - 1, "landed_place": F.row_number().over(w.orderBy(*landed)) - 1})


def flattened(models: DataFrame) -> DataFrame:
    """One flat row a model from a provider's nested catalogue: modalities, sizes, prices a million tokens (a price that
    can't be read is 0, of an image null), and what the supported parameters say."""
    price = lambda c: F.col(f"pricing.{c}").try_cast("double")
    has = lambda *names: F.arrays_overlap(F.coalesce("supported_parameters", F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    none = F.array().cast("array<string>")
    return models.select(
        "id", "name", "created",
        F.coalesce("architecture.input_modalities", none).alias("modalities"),
        F.coalesce("architecture.output_modalities", none).alias("output_modalities"),
        F.coalesce(F.nullif("context_length", F.lit(0)), "top_provider.context_length").alias("context"),
        F.col("top_provider.max_completion_tokens").alias("max_output"),
        (F.coalesce(price("prompt"), F.lit(0.0)) * 1e6).alias("in_per_m"),
        (F.coalesce(price("completion"), F.lit(0.0)) * 1e6).alias("out_per_m"),
        price("image").alias("per_image"),
        has("structured_outputs").alias("structured"),
        has("response_format").alias("response_format"),
        has("reasoning", "include_reasoning").alias("reasoning"),
        has("tools").alias("tools"),
        has("temperature").alias("temperature"),
        F.coalesce("top_provider.is_moderated", F.lit(False)).alias("moderated"),
    )


def ledger(*sources: DataFrame) -> DataFrame:
    """Calls, calls without a cost, and cost of each source: sources may lack columns that others have."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    return every.groupBy("source").agg(F.count("*").alias("calls"), F.count_if(F.col("cost_usd").isNull()).alias("uncosted"), F.round(F.sum("cost_usd"), 2).alias("cost"))


def blind_spells(frames: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """The longest gap between frames that came back."""
    gap = F.lead(frame).over(Window.partitionBy(key).orderBy(frame)) - F.col(frame)
    return frames.select(key, gap.alias("gap")).groupBy(key).agg(F.max("gap").alias("worst_gap"))


def first_last_slope(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope between the rows with the smallest and the largest x (and y, where x ties)."""
    g = rows.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min_by(y, F.struct(x, y)).alias("y0"), F.max_by(y, F.struct(x, y)).alias("y1"))
    return g.select(*keys, F.when(F.col("x1") > F.col("x0"), (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))
