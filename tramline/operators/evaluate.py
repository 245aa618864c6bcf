"""Evaluation of forecasts: losses by day, bootstrap over days, tests, class metrics; and small Spark ML models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions.scalars import normal_cdf, stable_number
from tramline.operators.quantiles import exact_quantiles


def daily_losses(df: DataFrame, axes: dict[str, Column], truth: str, base: str, model: str, target: str = "target", date: str = "date") -> DataFrame:
    """(date, axis, group): rows with all three numbers, squared and absolute errors of base and model. Rows are laid out
    once for each axis; everything later works on these sums and never on rows again."""
    ok = F.col(truth).isNotNull() & ~F.isnan(truth) & F.col(base).isNotNull() & ~F.isnan(base) & F.col(model).isNotNull() & ~F.isnan(model)
    laid = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), g.cast("string").alias("group")) for a, g in axes.items()]))
    e, m = F.col(base) - F.col(truth), F.col(model) - F.col(truth)
    rows = df.where(ok).select(date, laid.alias("_a"), e.alias("_e"), m.alias("_m"))
    return rows.groupBy(date, F.col("_a.axis").alias("axis"), F.col("_a.group").alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("sse_base"), F.sum(F.abs("_e")).alias("sae_base"), F.sum(F.col("_m") * F.col("_m")).alias("sse_model"), F.sum(F.abs("_m")).alias("sae_model")
    )


def improvement(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cent of the base's RMSE and MAE that the model saves, over all days."""
    s = losses.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sse_base", "sae_base", "sse_model", "sae_model")])
    return s.select(*keys, "n", (100 * (1 - F.sqrt(F.col("sse_model") / F.nullif(F.col("sse_base"), F.lit(0.0))))).alias("rmse_gain"), (100 * (1 - F.col("sae_model") / F.nullif(F.col("sae_base"), F.lit(0.0)))).alias("mae_gain"))


def draws(losses: DataFrame, keys: Sequence[str], n: int, seed: int, date: str = "date") -> DataFrame:
    """(draw, keys, sums): each draw takes as many days as there are, with replacement. Days are picked by a hash of draw,
    place and seed, so reruns and two loss tables over the same days get the same draws."""
    days = losses.select(date).distinct()
    numbered = days.withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1)
    size = days.agg(F.count(F.lit(1)).alias("_size"))
    grid = losses.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size)).withColumn("_place", F.explode(F.sequence(F.lit(1), F.col("_size"))))
    picks = grid.select("draw", F.pmod(stable_number(F.lit(seed), F.col("draw"), F.col("_place")), F.col("_size")).alias("_i"))
    times = picks.join(numbered, "_i").groupBy("draw", date).agg(F.count(F.lit(1)).alias("_k"))
    return times.join(losses, date).groupBy("draw", *keys).agg(*[F.sum(F.col(c) * F.col("_k")).alias(c) for c in ("n", "sse_base", "sae_base", "sse_model", "sae_model")])


def block_bootstrap(losses: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 7) -> DataFrame:
    """Point estimate of the gain and its 95 per cent interval over resampled days."""
    d = improvement(draws(losses, keys, n, seed), ["draw", *keys])
    q = d.groupBy(*keys).agg(F.percentile("rmse_gain", F.array(F.lit(0.025), F.lit(0.975))).alias("_r"), F.percentile("mae_gain", F.array(F.lit(0.025), F.lit(0.975))).alias("_m"))
    return improvement(losses, keys).join(q, list(keys)).select(*keys, "n", "rmse_gain", F.col("_r")[0].alias("rmse_low"), F.col("_r")[1].alias("rmse_high"), "mae_gain", F.col("_m")[0].alias("mae_low"), F.col("_m")[1].alias("mae_high"))


def window_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int = 1000, seed: int = 7) -> DataFrame:
    """Difference of the gains of two runs on the same draws of the days that both have."""
    common = a.select("date").intersect(b.select("date"))
    a, b = a.join(common, "date", "left_semi"), b.join(common, "date", "left_semi")
    x = improvement(draws(a, keys, n, seed), ["draw", *keys]).select("draw", *keys, F.col("rmse_gain").alias("_x"))
    y = improvement(draws(b, keys, n, seed), ["draw", *keys]).select("draw", *keys, F.col("rmse_gain").alias("_y"))
    q = x.join(y, ["draw", *keys]).groupBy(*keys).agg(F.percentile(F.col("_y") - F.col("_x"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_q"))
    return q.select(*keys, F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"))


def diebold_mariano(losses: DataFrame, keys: Sequence[str], a: str = "sse_base", b: str = "sse_model", date: str = "date") -> DataFrame:
    """The statistic of equal accuracy on daily mean differences, with a Newey-West variance of lag
    floor(4 (T / 100)^(2/9)); null under 3 days."""
    w = Window.partitionBy(*keys)
    d = losses.select(*keys, date, ((F.col(a) - F.col(b)) / F.col("n")).alias("_d"))
    d = d.withColumns({"_i": F.row_number().over(w.orderBy(date)), "_t": F.count(F.lit(1)).over(w), "_mean": F.avg("_d").over(w)}).withColumn("_c", F.col("_d") - F.col("_mean"))
    lag = F.floor(4 * F.pow(F.col("_t") / 100, 2 / 9)).cast("int")
    shifted = d.withColumn("_k", F.explode(F.sequence(F.lit(0), lag)))
    other = d.select(*keys, F.col("_i").alias("_j"), F.col("_c").alias("_c2"))
    pairs = shifted.withColumn("_j", F.col("_i") - F.col("_k")).join(other, [*keys, "_j"])
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (lag + 1)))
    v = pairs.groupBy(*keys).agg((F.sum(weight * F.col("_c") * F.col("_c2")) / F.max("_t")).alias("_v"), F.max("_t").alias("days"), F.max("_mean").alias("mean_diff"))
    dm = F.when((F.col("days") >= 3) & (F.col("_v") > 0), F.col("mean_diff") / F.sqrt(F.col("_v") / F.col("days")))
    return v.select(*keys, "days", "mean_diff", dm.alias("dm"), (2 * (1 - normal_cdf(F.abs(dm)))).alias("p_value"))


def cell_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, grade) -> DataFrame:
    e = F.col(pred) - F.col(truth)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(truth, pred).alias("corr"), F.avg((grade(F.col(truth)) == grade(F.col(pred))).cast("int")).alias("agreement"))


def grade_agreement(df: DataFrame, keys: Sequence[str], truth: Column, old: Column, new: Column) -> DataFrame:
    """Share of right grades before and after, what is gained, and how many grades changed."""
    r = lambda c: F.avg(c.cast("int"))
    g = df.groupBy(*keys).agg(r(truth == old).alias("before"), r(truth == new).alias("after"), r(old != new).alias("changed"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("gain", F.col("after") - F.col("before"))


def informative_cells(df: DataFrame, truth: Column, usual: Column, pred: Column) -> DataFrame:
    """Hit rate where the truth differs from the slot's usual grade."""
    return df.where(truth != usual).agg(F.count(F.lit(1)).alias("n"), F.avg((truth == pred).cast("int")).alias("hit_rate"))


def class_metrics(df: DataFrame, keys: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    tp, fp, fn = (F.sum(c.cast("long")) for c in (truth & pred, ~truth & pred, truth & ~pred))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return g.withColumns({"precision": p, "recall": r, "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))})


def change_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """WAPE, share of right directions (where the truth moves), and R^2."""
    t, p = F.col(truth), F.col(pred)
    g = df.groupBy(*keys).agg((F.sum(F.abs(p - t)) / F.nullif(F.sum(F.abs(t)), F.lit(0.0))).alias("wape"), F.avg(F.when(t != 0, (F.signum(t) == F.signum(p)).cast("int"))).alias("direction"), F.sum((p - t) * (p - t)).alias("_e"), (F.var_pop(truth) * F.count(truth)).alias("_v"))
    return g.select(*keys, "wape", "direction", (1 - F.col("_e") / F.nullif(F.col("_v"), F.lit(0.0))).alias("r2"))


def brier(df: DataFrame, truth: Column, prob: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(prob) - truth.cast("double"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration_table(df: DataFrame, truth: Column, prob: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed share by quantile bins of the probability."""
    edges = exact_quantiles(df, [], prob, [i / bins for i in range(1, bins)], "_e")
    b = F.size(F.filter("_e", lambda e: F.col(prob) > e))
    return df.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_prob"), F.avg(truth.cast("int")).alias("observed"), F.count(F.lit(1)).alias("n"))


def status_distribution(df: DataFrame, key: str, status: str, values: Sequence[str], nullable: str) -> DataFrame:
    counts = df.groupBy(key).pivot(status, list(values)).agg(F.count(F.lit(1))).fillna(0)
    return counts.join(df.groupBy(key).agg(F.count_if(F.col(nullable).isNull()).alias("nulls")), key)


def late_share(a: DataFrame, b: DataFrame, keys: Sequence[str], share: str) -> DataFrame:
    """How far half-hour shares of a holdout are from those fitted."""
    j = a.select(*keys, F.col(share).alias("_a")).join(b.select(*keys, F.col(share).alias("_b")), list(keys))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mae"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"))


def divergence_bounds(df: DataFrame, train: DataFrame, keys: Sequence[str], pred: str, value: str, fallback: str, factor: float = 2.0) -> DataFrame:
    """Predictions outside [least - spread, most + spread] of the training (spread x factor) take the fallback; below 0
    is cut to 0."""
    r = train.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = (F.col("_hi") - F.col("_lo")) * (factor - 1)
    bad = (F.col(pred) < F.col("_lo") - spread) | (F.col(pred) > F.col("_hi") + spread)
    out = df.join(r, list(keys), "left").withColumn("diverged", F.coalesce(bad, F.lit(False)))
    return out.withColumn("bounded", F.greatest(F.when(F.col("diverged"), F.col(fallback)).otherwise(F.col(pred)), F.lit(0.0))).drop("_lo", "_hi")


def stratified_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int = 1) -> DataFrame:
    """``per_stratum`` rows of each stratum, the same ones on every run."""
    w = Window.partitionBy(stratum).orderBy(stable_number(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_stratum).drop("_r")


def isotonic_calibrate(train: DataFrame, test: DataFrame, prob: str, truth: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=prob, labelCol=truth, predictionCol="calibrated").fit(train)
    return model.transform(test)


def cluster_profiles(df: DataFrame, key: str, values: Sequence[str], k: int, seed: int = 3) -> DataFrame:
    """K-means on rows scaled by their own mean and deviation; constant rows go."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    row = F.array(*values)
    n = float(len(values))
    mean = F.aggregate(row, F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("_mean", mean)
    sd = F.sqrt(F.aggregate(row, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n)
    scaled = df.withColumn("_sd", sd).where("_sd > 0").select(key, *[((F.col(v) - F.col("_mean")) / F.col("_sd")).alias(v) for v in values])
    vectors = VectorAssembler(inputCols=list(values), outputCol="_v").transform(scaled)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors).transform(vectors).select(key, "cluster")


def residual_model(train: DataFrame, test: DataFrame, features: Sequence[str], truth: str, lookup: str, seed: int = 5, iterations: int = 20, tasks: int | None = None) -> DataFrame:
    """Look-up plus boosted trees on its residuals; rows without a look-up or a feature get no prediction.

    Each round reads the rows that the trainer keeps, by the partitions they came in; ``tasks`` is their number, which should
    grow with the rows (the optimizer would put small shuffles together to a few, each then kept as one)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    a = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip")
    rows = train.withColumn("_y", F.col(truth) - F.col(lookup)).where("_y IS NOT NULL").select(*features, "_y")
    if tasks:
        rows = rows.repartition(tasks, *features, "_y")
    model = GBTRegressor(featuresCol="_v", labelCol="_y", predictionCol="_r", seed=seed, maxIter=iterations, maxDepth=4).fit(a.transform(rows))
    return model.transform(a.transform(test)).withColumn("prediction", F.col(lookup) + F.col("_r")).drop("_v", "_r")
