"""Statistics of evidence tables: ranges, coverage, histograms, quality of time, metrics.

Everything is one partial aggregation per result, so no group is gathered. Sums of doubles
are sums of whole thousandths, so that results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.numbers import finite, quantised, scaled


#: Chance that a Poisson(1) number is 0.
POISSON_0 = 0.36787944117144233


def range_statistics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, field, count, minimum, maximum, average)`` of finite values, in long form;
    a field without values has count 0 and nulls."""
    aggs = []
    for c in columns:
        x = finite(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}_n"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.sum(scaled(F.col(c).cast("double"))).alias(f"{c}_sum")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.col(f"{c}_n").alias("count"), F.col(f"{c}_min").alias("minimum"), F.col(f"{c}_max").alias("maximum"),
            F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum") / F.col(f"{c}_n") / 1000.0).alias("average"),
        )
        for c in columns
    ])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def histogram(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, field, value, records)``: how often each value of each column occurs; nulls
    are left out."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*keys, long.alias("r")).where("r.value is not null").groupBy(*keys, "r.field", "r.value").agg(F.count(F.lit(1)).alias("records"))


def coverage(tables: dict[str, DataFrame], known: list[str]) -> DataFrame:
    """``(category, field, records, populated)``: for each column of each table how many
    records have it. Categories of ``known`` without a table have one row with null field."""
    out = None
    for category, df in tables.items():
        names = df.columns
        wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names])
        rows = wide.select(F.explode(F.array(*[F.struct(F.lit(category).alias("category"), F.lit(c).alias("field"), F.col("_n").alias("records"), F.col(c).alias("populated")) for c in names])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    missing = [(c, None, 0, 0) for c in known if c not in tables]
    if missing and out is not None:
        out = out.unionByName(out.sparkSession.createDataFrame(missing, "category string, field string, records bigint, populated bigint"))
    return out


def prefix_category(name: Column, prefixes: tuple[str, ...]) -> Column:
    """The first of the prefixes, in their order, that the name begins with, else OTHER."""
    out = F.lit("OTHER")
    for p in reversed(prefixes):
        out = F.when(F.startswith(name, F.lit(p)), p).otherwise(out)
    return F.when(name.isNotNull(), out)


def confusion(expected: DataFrame, detected: DataFrame, keys: list[str], universe: DataFrame | None = None) -> DataFrame:
    """One row: true and false positives, false and true negatives, precision, recall, F1 and
    rate of false positives of two sets of keys; ratios without a denominator are 0. True
    negatives need the ``universe`` of keys; without it there are none."""
    both = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(detected.select(*keys).distinct().withColumn("_d", F.lit(1)), keys, "full_outer")
    both = both.withColumn("_u", F.lit(None).cast("int")) if universe is None else both.join(universe.select(*keys).distinct().withColumn("_u", F.lit(1)), keys, "full_outer")
    e, d = F.col("_e").isNotNull(), F.col("_d").isNotNull()
    n = both.agg(F.count_if(e & d).alias("true_positives"), F.count_if(d & ~e).alias("false_positives"), F.count_if(e & ~d).alias("false_negatives"), F.count_if(F.col("_u").isNotNull() & ~e & ~d).alias("true_negatives"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives", "true_negatives"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("false_positive_rate"))


def first_and_last(df: DataFrame, keys: list[str], order: list[str], first: int, last: int = 0) -> DataFrame:
    """The first and last so many rows of each group, with ``place`` from 1 on, or from -1 back;
    a row may be both. Ranks are limited before the shuffle, so a hot group sends few rows."""
    parts = []
    for n, sign in ((first, 1), (last, -1)):
        if n:
            line = Window.partitionBy(*keys).orderBy(*[F.col(c) if sign > 0 else F.col(c).desc() for c in order])
            parts.append(df.withColumn("place", F.row_number().over(line)).where(F.col("place") <= n).withColumn("place", F.col("place") * sign))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def standardizer(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, mean, deviation)`` over finite values, in whole thousandths; a deviation
    below 1e-8 is 1."""
    aggs = []
    for c in columns:
        x = scaled(F.col(c).cast("double")).cast("decimal(38,0)")
        aggs += [F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum((x * x).cast("decimal(38,0)")).alias(f"{c}_q")]
    wide = df.agg(*aggs)
    rows = []
    for c in columns:
        n, s, q = F.col(f"{c}_n").cast("double"), F.col(f"{c}_s").cast("double"), F.col(f"{c}_q").cast("double")
        sd = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))) / 1000.0
        rows.append(F.struct(F.lit(c).alias("field"), (s / n / 1000.0).alias("mean"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("deviation")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bootstrap_interval(per_group: DataFrame, value: str, samples: int = 2_000, seed: int = 42) -> DataFrame:
    """``(groups, mean, low, high)``: the mean over groups and the 2.5 and 97.5 percentiles of
    resampled means, of values in whole millionths. Resampling is spread by sample: each group
    adds a Poisson(1) number of copies to each sample, drawn from a hash of group and sample,
    which needs no collecting. Fewer than two groups give null bounds. ``per_group`` has ``id``
    and the value."""
    rows = per_group.where(F.col(value).isNotNull()).select(F.col("id").cast("string").alias("id"), F.floor(F.col(value) * 1e6 + 0.5).cast("bigint").alias("v"))
    name = F.concat_ws("/", "id", F.col("sample").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    # the inverse of the Poisson distribution, by its first eight steps
    copies, p, total = F.lit(0), POISSON_0, POISSON_0
    for k in range(1, 9):
        copies = copies + F.when(F.col("u") >= total, 1).otherwise(0)
        p /= k
        total += p
    drawn = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).select("v", "sample", u.alias("u")).withColumn("n", copies)
    means = drawn.groupBy("sample").agg((F.try_divide(F.sum(F.col("v") * F.col("n")), F.sum("n")) / 1e6).alias("m"))
    bounds = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("b")).withColumn("_one", F.lit(1))
    # one row each
    whole = rows.agg(F.count(F.lit(1)).alias("groups"), (F.sum("v") / F.count("v") / 1e6).alias("mean")).withColumn("_one", F.lit(1))
    several = F.col("groups") > 1
    return whole.join(bounds, "_one").select("groups", quantised(F.col("mean"), 9).alias("mean"), *[F.when(several, quantised(F.col("b")[k], 9)).alias(n) for k, n in enumerate(("low", "high"))])


def over_runs(metrics: DataFrame) -> DataFrame:
    """``(model, flights, runs, macro_m, deviation_m)`` of ``(run, model, flight, value)``: the
    mean over flights of their means over runs, and how much the runs' own means over flights
    differ (sample deviation, null for one run). Values in whole millionths."""
    rows = metrics.where("value is not null").select("run", "model", "flight", F.floor(F.col("value") * 1e6 + 0.5).cast("bigint").alias("v"))
    whole = lambda c: F.floor(F.sum(c) / F.count(c) + 0.5).cast("bigint")
    flights = rows.groupBy("model", "flight").agg(whole("v").alias("m")).groupBy("model").agg(F.count(F.lit(1)).alias("flights"), (F.sum("m") / F.count("m") / 1e6).alias("macro_m"))
    runs = rows.groupBy("model", "run").agg(whole("v").alias("m")).groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.sum("m").alias("_s"), F.sum((F.col("m").cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("_q"))
    n, s, q = F.col("runs").cast("double"), F.col("_s").cast("double"), F.col("_q").cast("double")
    spread = F.when(F.col("runs") > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))) / 1e6)
    return flights.join(runs.select("model", "runs", quantised(spread, 6).alias("deviation_m")), "model").select("model", "flights", "runs", "macro_m", "deviation_m")


def paired(metrics: DataFrame, one: str, other: str) -> DataFrame:
    """``(id, difference_m)``: per flight the mean over runs of one model minus that of the
    other, of ``(run, model, flight, value)``, where both have one."""
    per = metrics.where("value is not null").groupBy("flight").agg(*[F.avg(F.when(F.col("model") == m, F.floor(F.col("value") * 1e6 + 0.5))).alias(n) for m, n in ((one, "a"), (other, "b"))])
    return per.where("a is not null and b is not null").select(F.col("flight").alias("id"), ((F.col("a") - F.col("b")) / 1e6).alias("difference_m"))
