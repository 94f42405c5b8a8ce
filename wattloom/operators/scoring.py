"""Metrics of weighted scores, rule baselines, folds, stacking, calibration and boosted trees."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import exprs as X
from wattloom.session import settled


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y", w: str = "w") -> DataFrame:
    """(by, roc_auc): weighted share of (positive, negative) pairs in order, ties half; null with one class.

    Weights are summed for each distinct score first, so the running sum is over scores, not rows.
    """
    at = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("below", below).groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).cast("double"), (F.sum("p") * F.sum("q")).cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", y: str = "y", w: str = "w") -> DataFrame:
    """(by, average_precision): precision at each distinct score times the step in recall."""
    at = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0)).alias("p"), F.sum(w).alias("a"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = at.withColumn("cp", F.sum("p").over(run)).withColumn("ca", F.sum("a").over(run))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("p").cast("double") * F.col("cp").cast("double") / F.col("ca").cast("double")), F.sum("p").cast("double")).alias("average_precision"))


def threshold_metrics(df: DataFrame, by: list[str], thresholds: tuple[float, ...] = (0.5, 0.8), score: str = "score", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted Brier score, and precision and recall at thresholds."""
    one = lambda c: F.sum(F.when(c, F.col(w)).otherwise(0)).cast("double")
    cols = [F.try_divide(F.sum(F.col(w) * (F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).cast("double"), F.sum(w).cast("double")).alias("brier")]
    for t in thresholds:
        hit, name = (F.col(score) >= t), f"{round(t * 100)}"
        cols += [F.try_divide(one(hit & (F.col(y) == 1)), one(hit)).alias(f"precision_{name}"), F.try_divide(one(hit & (F.col(y) == 1)), one(F.col(y) == 1)).alias(f"recall_{name}")]
    return df.groupBy(*by).agg(*cols)


#: Thresholds and scores of the rule baselines.
BASELINE = {
    "export_days_ratio": 0.05, "radiation_corr": -0.4, "ev_sessions_per_week": 1.0, "ev_session_kw": 3.0, "hp_night_ratio": 2.0, "hp_temperature_corr": -0.3, "battery_evening_near_zero": 0.15,
    "pv_with_export": 0.9, "pv_without_export": 0.2, "pv_radiation_bonus": 0.5, "ev_yes": 0.85, "ev_no": 0.15, "hp_yes": 0.8, "hp_no": 0.15, "battery_yes": 0.7, "battery_no": 0.1,
}


def baseline_scores(features: DataFrame, c: dict[str, float] = BASELINE) -> DataFrame:
    """(gp_nr, base_pv, base_battery, base_heat_pump, base_ev) from the feature table by fixed rules.

    A rule with a missing column or a null doesn't hold.
    """
    x = lambda name: F.col(name).cast("double") if name in features.columns else F.lit(None).cast("double")
    holds = lambda rule: F.coalesce(rule, F.lit(False))
    pick = lambda rule, yes, no: F.when(rule, F.lit(c[yes])).otherwise(F.lit(c[no]))
    exports = holds(x("days_with_export_ratio") > c["export_days_ratio"])
    like_pv = holds((x("correlation_solar_radiation_consumption") < c["radiation_corr"]) & (x("sunny_day_midday_mean") < x("cloudy_day_midday_mean")))
    like_ev = holds((x("sessions_per_week") >= c["ev_sessions_per_week"]) & (x("session_median") >= c["ev_session_kw"]))
    like_hp = holds((x("winter_night_mean_consumption") > x("summer_night_mean_consumption") * c["hp_night_ratio"]) & (x("correlation_outside_temperature_consumption") < c["hp_temperature_corr"]))
    like_battery = exports & holds(x("evening_near_zero_ratio") > c["battery_evening_near_zero"])
    without = F.when(like_pv, F.lit(min(1.0, c["pv_without_export"] + c["pv_radiation_bonus"]))).otherwise(F.lit(c["pv_without_export"]))
    return features.select(
        "gp_nr", F.when(exports, F.lit(c["pv_with_export"])).otherwise(without).alias("base_pv"), pick(like_battery, "battery_yes", "battery_no").alias("base_battery"),
        pick(like_hp, "hp_yes", "hp_no").alias("base_heat_pump"), pick(like_ev, "ev_yes", "ev_no").alias("base_ev"),
    )


def stratified_folds(df: DataFrame, y: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """Adds fold 0..k-1: each class dealt evenly in seeded order.

    Rows are ranked within parts of a class, by leading bits of the hash that orders them, and parts begin where
    the one before ended: the ranks are those of the whole class, but no task has one whole.
    """
    h = F.xxhash64(F.lit(seed), key)
    rows = df.withColumn("_w_h", h).withColumn("_w_part", F.shiftright("_w_h", 52))
    parts = rows.groupBy(F.col(y).alias("_w_y"), F.col("_w_part").alias("_w_p")).agg(F.count(F.lit(1)).alias("_w_n"))
    before = F.sum("_w_n").over(Window.partitionBy("_w_y").orderBy("_w_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_w_y", "_w_p", F.coalesce(before, F.lit(0)).alias("_w_before"))
    ranked = rows.withColumn("_w_rank", F.row_number().over(Window.partitionBy(y, "_w_part").orderBy("_w_h", key)) - 1)
    met = ranked.join(parts, F.col(y).eqNullSafe(F.col("_w_y")) & (F.col("_w_part") == F.col("_w_p")))
    return met.withColumn("fold", ((F.col("_w_rank") + F.col("_w_before")) % k).cast("int")).select(*df.columns, "fold")


def fold_count(df: DataFrame, y: str, most: int = 5) -> int:
    least = df.groupBy(y).count().agg(F.min("count")).first()[0]
    return max(2, min(most, least or 0))


def class_weight(df: DataFrame, y: str = "label", w: str = "weight") -> DataFrame:
    """One row: weight of negatives over weight of positives."""
    return df.agg(F.try_divide(F.sum(F.when(F.col(y) == 0, F.col(w))), F.sum(F.when(F.col(y) == 1, F.col(w)))).alias("scale_pos_weight"))


def usable_features(df: DataFrame, excluded: list[str]) -> list[str]:
    """Numeric columns that aren't all null or NaN, by one aggregation."""
    names = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") and c not in excluded]
    if not names:
        return []
    kinds = dict(df.dtypes)
    known = df.agg(*[F.count(F.when(F.col(c).isNotNull() & ~F.isnan(c), 1) if kinds[c] in ("float", "double") else F.col(c)).alias(c) for c in names]).first()
    return [c for c in names if known[c]]


@dataclass
class Boosted:
    """Out-of-fold scores (key, fold, label, weight, score), the model on all rows, its scorer, and rounds: the best of
    each fold and the final model's."""

    oof: DataFrame
    model: object
    score: Callable[[object, DataFrame], DataFrame]
    best: list[int]
    rounds: int


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the column of features; nulls become -999, which no feature reaches, so trees can set them apart."""
    from pyspark.ml.feature import VectorAssembler

    names = [f"_x{i}" for i in range(len(features))]
    filled = df.select("*", *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(-999.0)).alias(n) for c, n in zip(features, names, strict=True)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled).drop(*names)


def train_boosted(df: DataFrame, features: list[str], label: str = "label", weight: str = "weight", key: str = "gp_nr", folds: int = 3, rounds: int = 20, seed: int = 0) -> Boosted:
    """Class-weighted boosted trees with early stopping.

    The model of a fold stops when its loss on that fold no longer falls, after ``rounds`` at most; the final model
    has the mean number of rounds.  ``folds`` of 0: no out-of-fold scores, all rounds.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    scale = class_weight(df, label, weight).first()[0] or 1.0
    data = df.select(key, label, weight, *[F.col(f"`{c}`") for c in features]).withColumn("_w", F.when(F.col(label) == 1, F.col(weight) * scale).otherwise(F.col(weight)).cast("double"))
    data = vectors(stratified_folds(data, label, max(folds, 1), key, seed), features).select(key, "fold", label, weight, "_w", "features")
    data = settled(data, "train")
    gbt = GBTClassifier(labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=4, seed=seed)
    score = lambda model, rows: model.transform(rows).select(key, "fold", label, weight, vector_to_array("probability")[1].alias("score"))
    oof, best = data.select(key, "fold", label, weight, F.lit(None).cast("double").alias("score")).limit(0), []
    for f in range(folds):
        model = gbt.copy({gbt.validationIndicatorCol: "_late"}).fit(data.withColumn("_late", F.col("fold") == f))
        best.append(model.getNumTrees)
        oof = oof.unionByName(score(model, data.filter(F.col("fold") == f)))
    final = max(1, round(sum(best) / len(best))) if best else rounds
    return Boosted(oof, gbt.copy({gbt.maxIter: final}).fit(data), score, best, final)


def calibrate(scored: DataFrame, label: str = "label", weight: str = "weight", source: str | None = None):
    """Isotonic curve from scores to labels; apply with ``calibrated``.

    With ``source`` only rows of the registry are fitted, if these have both labels; else all rows; without both
    labels at all the curve is the score itself.
    """
    from pyspark.ml.regression import IsotonicRegression

    rows = scored.filter("score is not null").select("score", F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), (F.col(source) != "unlabeled" if source else F.lit(True)).alias("_clean"))
    both = lambda c: F.count_distinct(F.when(c, F.col("_y"))) == 2
    clean, every = rows.agg(both(F.col("_clean")), both(F.lit(True))).first()
    if clean:
        rows = rows.filter("_clean")
    elif not every:
        rows = scored.sparkSession.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "score double, _y double, _w double")
    return IsotonicRegression(featuresCol="score", labelCol="_y", weightCol="_w").fit(rows)


def calibrated(model, scored: DataFrame) -> DataFrame:
    return model.transform(scored).withColumn("prob", X.clip("prediction", 0.0, 1.0)).drop("prediction")


def stack(scored: DataFrame, final: DataFrame, key: str, name: str) -> DataFrame:
    """Out-of-fold score where there is one, else the final model's."""
    return final.select(key, F.col("score").alias("_w_final")).join(scored.select(key, F.col("score").alias("_w_oof")), key, "left").select(key, F.coalesce("_w_oof", "_w_final").alias(name))


def subset_metrics(scored: DataFrame, asset: str, scorer: str) -> DataFrame:
    """Metrics of rows (score, y, w, source), for all and for those of the registry; rows without a score stay out."""
    rows = scored.filter("score is not null")
    rows = rows.withColumn("subset", F.lit("all")).unionByName(rows.filter("source <> 'unlabeled'").withColumn("subset", F.lit("registry")))
    counts = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))
    out = counts.join(roc_auc(rows, ["subset"]), "subset").join(average_precision(rows, ["subset"]), "subset").join(threshold_metrics(rows, ["subset"]), "subset")
    return out.select(F.lit(asset).alias("asset"), F.lit(scorer).alias("scorer"), *out.columns)


#: Order of training, and the names of the rule baselines.
TRAIN_ORDER = {"pv": "base_pv", "heatpump": "base_heat_pump", "ev": "base_ev", "battery": "base_battery"}
SECOND_STAGE = "pv_prob"


def train_assets(table: DataFrame, labels: DataFrame, features: list[str], folds: int = 5, rounds: int = 20, seed: int = 0, top: int = 6, key: str = "gp_nr") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trains all assets on (asset, key, label, weight, source) and scores every row of ``table``.

    Returns predictions (key; raw_, prob_ and shap_ of each asset), metrics (asset, scorer: model, calibrated or
    baseline, subset, ...) and importances (asset, feature, gain).  PV is first: its calibrated probability, out of
    fold where a label is known, is a feature of the battery model.  An asset without both labels has no model: its
    scores are null.
    """
    from wattloom.operators.explain import explain

    spark, base = table.sparkSession, baseline_scores(table)
    x, out = table, table.select(key)
    parts, gains = [], []
    for asset, rule in TRAIN_ORDER.items():
        names = features + [SECOND_STAGE] * (asset == "battery" and SECOND_STAGE in x.columns)
        rows = x.join(labels.filter(F.col("asset") == asset).select(key, "label", "weight", "source"), key)
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        truth = rows.select(key, F.col("label").alias("y"), F.col("weight").alias("w"), "source")
        parts.append(subset_metrics(truth.join(base.select(key, F.col(rule).alias("score")), key), asset, "baseline"))
        if len(counts) < 2:
            out = out.select("*", *[F.lit(None).cast("double").alias(f"{c}_{asset}") for c in ("raw", "prob")], F.lit(None).cast("array<struct<feature:string,contribution:double>>").alias(f"shap_{asset}"))
            continue
        fitted = train_boosted(rows, names, folds=min(folds, *counts.values()) if min(counts.values()) > 1 else 0, rounds=rounds, seed=seed, key=key)
        oof = settled(fitted.oof.join(truth.select(key, "source"), key), f"oof-{asset}")
        curve = calibrate(oof, source="source")
        ready = vectors(x.withColumns({"fold": F.lit(0), "label": F.lit(0), "weight": F.lit(1.0)}), names)
        final = calibrated(curve, fitted.score(fitted.model, ready)).select(key, F.col("score").alias(f"raw_{asset}"), F.col("prob").alias(f"prob_{asset}"))
        shares = explain(x, fitted.model, names, key=key, top=top).withColumnRenamed("contributions", f"shap_{asset}")
        out = settled(out.join(final, key, "left").join(shares, key, "left"), f"predictions-{asset}")
        held = calibrated(curve, oof).select(key, "score", "prob", F.col("label").alias("y"), F.col("weight").alias("w"), "source")
        parts += [subset_metrics(held, asset, "model"), subset_metrics(held.withColumn("score", F.col("prob")), asset, "calibrated")]
        gains += [(asset, n, float(g)) for n, g in importance(fitted.model, names)]
        if asset == "pv":
            known = held.select(key, F.col("prob").alias("score"))
            x = settled(x.join(stack(known, out.select(key, F.col(f"prob_{asset}").alias("score")), key, SECOND_STAGE), key, "left"), "second-stage")
    return out, reduce(DataFrame.unionByName, parts), spark.createDataFrame(gains, "asset string, feature string, gain double")


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
