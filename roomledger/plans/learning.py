"""Fitted models: inference, benchmarks, segments, and the dashboard bundle."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.exact import no_negative_zero
from roomledger.operators import bookings as b
from roomledger.operators import evaluation, features, inference, models, segmentation, stats, trees
from roomledger.plans import bundle
from roomledger.plans.evaluation import KEPT_COLUMNS, LOGIT_COLUMNS, MATRIX_COLUMNS, REVENUE_COLUMNS
from roomledger.plans.guests import agg_guest_features
from roomledger.plans.registry import plan
from roomledger.session import once, training_rows
from roomledger.sources.testdata import load_bookings as load

KEY = "reservation_id"


# --- inference ---------------------------------------------------------------


def _full(spark, path):
    return features.logit_design(load(spark, path, *LOGIT_COLUMNS), keep=[KEY])


def _kept(spark, path):
    return features.logit_kept_design(load(spark, path, *KEPT_COLUMNS), keep=[KEY])


@plan("st_logit_fit")
def st_logit_fit(spark, path):
    rows, names = _full(spark, path)
    return inference.coefficients(spark, inference.fit_logit(rows, names), names)


@plan("st_logit_fit_parsimonious")
def st_logit_fit_parsimonious(spark, path):
    rows, names = _kept(spark, path)
    return inference.coefficients(spark, inference.fit_logit(rows, names), names)


@plan("st_logit_fit_quality")
def st_logit_fit_quality(spark, path):
    parts = []
    designs = {"full": (LOGIT_COLUMNS, features.logit_design), "parsimonious": (KEPT_COLUMNS, features.logit_kept_design)}
    for kind, (columns, design) in designs.items():
        # Each design has its own rows: a table that only one of them joins may hold a key twice.
        with once(load(spark, path, *columns)) as loaded:
            rows, names = design(loaded, keep=[KEY])
            quality = inference.fit_quality(spark, inference.fit_logit(rows, names))
            parts.append(quality.select(F.lit(kind).alias("model"), "*"))
    return parts[0].unionByName(parts[1])


@plan("srt_abs_key")
def srt_abs_key(spark, path):
    return inference.by_strength(st_logit_fit(spark, path))


@plan("st_vif")
def st_vif(spark, path):
    rows, names = _full(spark, path)
    products = inference.cross_products(rows, names)
    plain = inference.vif(spark, rows, names, products=products)
    centred = inference.vif(spark, rows, names, centred=True, products=products)
    return plain.join(centred.select("variable", F.col("vif").alias("vif_centred")), "variable")


@plan("st_select_significant")
def st_select_significant(spark, path):
    return inference.significant(st_logit_fit_parsimonious(spark, path))


@plan("st_select_variables")
def st_select_variables(spark, path):
    rows, names = _full(spark, path)
    # The fit and the inflation factors read the same rows, so the joins run once.
    stored = training_rows(rows.select(*[f"`{n}`" for n in names], "is_cancelled"))
    products = inference.cross_products(stored, names)
    table = inference.coefficients(spark, inference.fit_logit(stored, names), names)
    stored.unpersist()
    return inference.select_variables(table, inference.vif(spark, stored, names, products=products))


def logit_holdout(spark, path) -> DataFrame:
    """Parsimonious logit fitted on 75% and scored on the stratified rest."""
    rows, names = _kept(spark, path)
    split = features.holdout(rows, strata=["is_cancelled"])
    model = inference.fit_logit(split.filter("is_test = 0"), names)
    scored = inference.predict(model, split.filter("is_test = 1"), names, [KEY, "is_cancelled"])
    return scored.withColumnRenamed("is_cancelled", "label")


@plan("st_logit_predict")
def st_logit_predict(spark, path):
    return logit_holdout(spark, path)


@plan("st_logit_validation")
def st_logit_validation(spark, path):
    scored = logit_holdout(spark, path)
    sweep = evaluation.threshold_sweep(scored)
    area = evaluation.auc(scored).select(F.round("auc", 4).alias("validation_auc"))
    return evaluation.best_row(sweep, "f1", "threshold").join(F.broadcast(area))


@plan("rg_interaction_logit")
def rg_interaction_logit(spark, path):
    rows = load(spark, path, "booking_source", "lead_time_days", "is_cancelled")
    sources = features.levels(rows, ["booking_source"])["booking_source"][1:]
    lead = F.col("lead_time_days").cast("double")
    own = features.dummies({"booking_source": sources})
    mixed = [
        ((F.col("booking_source") == s).cast("double") * lead).alias(f"lead_x_{s}") for s in sources
    ]
    design = rows.select(lead.alias("lead_time_days"), *own, *mixed, "is_cancelled")
    names = design.columns[:-1]
    return inference.coefficients(spark, inference.fit_logit(design, names), names)


@plan("rg_interaction")
def rg_interaction(spark, path):
    cols = ("booking_source", "avg_price_per_room", "competitor_avg_rate", "nights_booked", "is_cancelled")
    rows = b.honoured(load(spark, path, *cols)).filter("avg_price_per_room > 0")
    sources = features.levels(rows, ["booking_source"])["booking_source"][1:]
    ratio = F.ln(F.col("avg_price_per_room") / F.greatest("competitor_avg_rate", F.lit(1.0)))
    target = F.ln(F.greatest("nights_booked", F.lit(1)).cast("double"))
    own = features.dummies({"booking_source": sources})
    mixed = [((F.col("booking_source") == s).cast("double") * ratio).alias(f"ratio_x_{s}") for s in sources]
    design = rows.select(ratio.alias("log_price_ratio"), *own, *mixed, target.alias("label"))
    names = design.columns[:-1]
    model = LinearRegression(solver="normal").fit(inference.assemble(design, names, ["label"]))
    return models.linear_table(spark, model, names)


# --- benchmarks --------------------------------------------------------------


def cancellation_split(spark, path) -> models.Split:
    with once(load(spark, path, *MATRIX_COLUMNS)) as rows:
        matrix, names = features.cancellation_matrix(rows, keep=[KEY])
        return models.make_split(matrix, names, "is_cancelled", stratify=True)


def revenue_split(spark, path) -> models.Split:
    with once(load(spark, path, *REVENUE_COLUMNS)) as rows:
        matrix, names = features.revenue_matrix(rows, keep=[KEY])
        return models.make_split(matrix, names, "total_amount", stratify=False)


def _benchmark(split: models.Split, fit, names=None) -> DataFrame:
    """The metrics table; scores are stored by then, so the split is released."""
    table, _ = fit(split, names)
    split.release()
    return table


def _classifier(query: str, model: str) -> None:
    @plan(query)
    def run(spark, path):
        return _benchmark(cancellation_split(spark, path), models.classifier_benchmark, [model])


for _query, _model in {
    "ml_logreg": "Logistic Regression",
    "ml_nb": "Naive Bayes",
    "ml_knn": "KNN (k=15)",
    "ml_dt": "Decision Tree",
    "ml_svm": "Linear SVM",
    "ml_rf": "Random Forest",
    "ml_gbt": "Gradient Boosting",
    "ml_gbt_leafy": "Boosting, leafy",
    "ml_gbt_sub": "Boosting, subsampled",
}.items():
    _classifier(_query, _model)


def _regressor(query: str, model: str) -> None:
    @plan(query)
    def run(spark, path):
        return _benchmark(revenue_split(spark, path), models.regressor_benchmark, [model])


for _query, _model in {
    "rg_linear": "Linear Regression",
    "rg_ridge": "Ridge",
    "rg_lasso": "Lasso",
    "rg_rf": "Random Forest",
    "rg_gbt_leafy": "Boosting, leafy",
    "rg_gbt_sub": "Boosting, subsampled",
}.items():
    _regressor(_query, _model)


@plan("ml_benchmark")
def ml_benchmark(spark, path):
    return _benchmark(cancellation_split(spark, path), models.classifier_benchmark)


@plan("rg_benchmark")
def rg_benchmark(spark, path):
    return _benchmark(revenue_split(spark, path), models.regressor_benchmark)


@plan("ml_importances")
def ml_importances(spark, path):
    """Of the model with the best AUC; empty if that has no importances."""
    split = cancellation_split(spark, path)
    table, fitted = models.classifier_benchmark(split)
    best = evaluation.best_row(table, "auc", "model").first()["model"]
    out = models.importances(spark, fitted.get(best), split.names)
    split.release()
    return out


_STAY_COLUMNS = ("booking_source", "room_no", "room_type_assigned", "pax", "stayed_room_nights")
# The attributes of a stay that are no amounts; a booking without a company has an empty one.
_STAY_FACTORS = ("booking_source", "corporate_name", "room_no", "room_type_assigned", "pax")


def _stay_design(rows: DataFrame, factors=_STAY_FACTORS) -> tuple[DataFrame, list[str]]:
    """Key, label, nights and the dummies of the factors, and the names of the predictors."""
    named = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in factors})
    kinds = features.drop_first(features.levels(named, list(factors)))
    coded = named.select(KEY, "label", F.col("stayed_room_nights").cast("double"), *features.dummies(kinds))
    return coded, [c for c in coded.columns if c not in (KEY, "label")]


def _pruned_tree(rows: DataFrame, names: list[str], depth: int, min_split: int, complexity: float = 0.01):
    """A 0/1 tree on the rows with ``is_test = 0``, pruned; the tree and the binned rows."""
    assembled = inference.assemble(rows, names, [KEY, "label", "is_test"])
    cuts = trees.cut_points(assembled.filter("is_test = 0"))
    stored = training_rows(trees.binned(assembled, cuts, KEY))
    growth = trees.Growth(depth=depth, min_split=min_split, min_rows=round(min_split / 3))
    return trees.prune(trees.grow_tree(stored, len(names), growth), complexity), cuts, stored


def _majority(stored: DataFrame, tree) -> DataFrame:
    scored = trees.predict_trees(stored, [tree])
    return scored.select(F.col("label").cast("int").alias("label"), (F.col("raw") > 0.5).cast("int").alias("prediction"))


def _stay_rows(spark, path) -> DataFrame:
    return load(spark, path, KEY, *_STAY_COLUMNS, "corporate_name", "total_amount")


def _stayed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    design, names = _stay_design(rows.withColumn("label", features.stayed_flag()))
    return features.holdout(design, share=0.4), names


def _stayed_tree(spark, path, depth: int, min_split: int) -> DataFrame:
    with once(_stay_rows(spark, path)) as loaded:
        rows, names = _stayed(loaded)
        tree, _, stored = _pruned_tree(rows, names, depth, min_split)
    return evaluation.sensitivity(_majority(stored.filter("is_test = 1"), tree)).withColumn(
        "leaves", F.lit(sum(f < 0 for f in tree.feature))
    )


@plan("ml_dt_stayed")
def ml_dt_stayed(spark, path):
    """Stayed or not from the stay attributes, 60/40; depth 5, splits of 10 rows or more, pruned at .01."""
    return _stayed_tree(spark, path, 5, 10)


@plan("ml_dt_stayed_default")
def ml_dt_stayed_default(spark, path):
    """The same with default limits: depth 30, splits of 20 rows or more, pruned at .01."""
    return _stayed_tree(spark, path, 30, 20)


@plan("ml_logit_stayed")
def ml_logit_stayed(spark, path):
    """Unpenalised logit on the stay attributes, 60/40, strict cut at .5: confusion, accuracy, AUC."""
    with once(_stay_rows(spark, path)) as loaded:
        rows, names = _stayed(loaded)
        stored = training_rows(inference.assemble(rows, names, [KEY, "label", "is_test"]))
    # Nights alone separate the classes, so the fit is stopped by its number of steps.
    model = LogisticRegression(labelCol="label", maxIter=25, standardization=True).fit(stored.filter("is_test = 0"))
    score = vector_to_array("probability")[1]
    scored = model.transform(stored.filter("is_test = 1")).select("label", score.alias("score"))
    scored = evaluation.with_prediction(scored, "score", 0.5, strict=True)
    area = evaluation.auc(scored).select(F.round("auc", 4).alias("auc"))
    summary = evaluation.sensitivity(scored).join(F.broadcast(area))
    return evaluation.confusion(scored).join(F.broadcast(summary))


def _tier_tree(spark, path):
    """High or low amount from four terms, on all honoured stays; depth 4, splits of 20 rows or more, pruned at .01."""
    with once(b.honoured(load(spark, path, KEY, *_STAY_COLUMNS, "total_amount", "is_cancelled"))) as rows:
        tiers = stats.above_median(rows, "total_amount", "tier").withColumn("label", (F.col("tier") == "High").cast("int"))
        design, names = _stay_design(tiers, ("booking_source", "room_type_assigned", "pax"))
        return names, *_pruned_tree(design.withColumn("is_test", F.lit(0)), names, 4, 20)


@plan("rg_tier_tree")
def rg_tier_tree(spark, path):
    _, tree, _, stored = _tier_tree(spark, path)
    return evaluation.class_report(_majority(stored, tree))


@plan("rg_tier_tree_rules")
def rg_tier_tree_rules(spark, path):
    """The tree's nodes: rows, share of high amounts, and the condition that leads to the left child."""
    names, tree, cuts, _ = _tier_tree(spark, path)
    rows = []
    for k, f in enumerate(tree.feature):
        inner = f >= 0
        at = float(cuts[f][tree.cut[k]]) if inner else None
        rows.append((
            k, tree.n[k], float(tree.total[k]) / tree.n[k], names[f] if inner else None, at,
            tree.left[k] if inner else None, tree.right[k] if inner else None,
        ))
    schema = "node int, n long, share_high double, variable string, at_most double, left int, right int"
    return spark.createDataFrame(rows, schema).withColumn("share_high", F.round("share_high", 4))


def _amounts(spark, path) -> tuple[DataFrame, list[str]]:
    rows = b.honoured(load(spark, path, KEY, *_STAY_COLUMNS, "corporate_name", "total_amount", "is_cancelled"))
    design, names = _stay_design(rows.withColumn("label", F.col("total_amount").cast("double")))
    return features.holdout(design, share=0.4), names


@plan("rg_linear_summary")
def rg_linear_summary(spark, path):
    """Coefficients with SE, t and p of the amount on all stay attributes, on 60% of the honoured stays."""
    rows, names = _amounts(spark, path)
    table, _ = inference.ols_summary(spark, rows.filter("is_test = 0"), names, "label")
    kept = [no_negative_zero(F.bround(c, 4)).alias(c) for c in ("coefficient", "se", "t", "p_value")]
    return table.select("variable", *kept, "sig", "aliased")


@plan("rg_linear_fit")
def rg_linear_fit(spark, path):
    """R squared, F and sigma of that fit, and its RMSE and squared correlation on the other 40%."""
    rows, names = _amounts(spark, path)
    stored = training_rows(rows)
    table, fit = inference.ols_summary(spark, stored.filter("is_test = 0"), names, "label")
    tested = inference.linear_score(stored.filter("is_test = 1"), table.filter("NOT aliased"))
    metrics = evaluation.regression_metrics(tested).select(F.col("rmse").alias("valid_rmse"), F.col("r2_corr").alias("valid_r2"))
    return fit.join(F.broadcast(metrics))


@plan("rg_stepwise")
def rg_stepwise(spark, path):
    """Backward elimination on 60% of the honoured stays, metrics on the rest."""
    rows = b.honoured(load(spark, path, KEY, *_STAY_COLUMNS, "total_amount", "is_cancelled"))
    kinds = features.drop_first(features.levels(rows, ["booking_source", "room_type_assigned", "pax"]))
    coded = rows.select(
        KEY, "total_amount", F.col("room_no").cast("double"), F.col("stayed_room_nights").cast("double"), *features.dummies(kinds)
    )
    split = features.holdout(coded, share=0.6, name="in_train")
    terms = {
        **{c: [f"{c}_{v}" for v in values] for c, values in kinds.items()},
        "room_no": ["room_no"],
        "stayed_room_nights": ["stayed_room_nights"],
    }
    _, chosen = inference.backward_selection(spark, split.filter("in_train = 1"), terms, "total_amount")
    tested = inference.linear_score(split.filter("in_train = 0"), chosen)
    metrics = evaluation.regression_metrics(tested, "total_amount", "prediction")
    return chosen.join(F.broadcast(metrics))


# --- segments ----------------------------------------------------------------


def _guest_vectors(spark, path) -> DataFrame:
    return segmentation.scaled_vectors(agg_guest_features(spark, path), segmentation.GUEST_FEATURES)


def _booking_vectors(spark, path) -> DataFrame:
    rows = load(spark, path, KEY, *segmentation.BOOKING_FEATURES).filter("total_lodging_amount <> 0")
    return segmentation.scaled_vectors(
        features.complete(rows, segmentation.BOOKING_FEATURES), segmentation.BOOKING_FEATURES, population=False
    )


@plan("seg_kmeans")
def seg_kmeans(spark, path):
    vectors = _guest_vectors(spark, path)
    assigned = segmentation.best_kmeans(vectors).transform(vectors)
    return assigned.select("primary_guest_name", *segmentation.GUEST_FEATURES, "segment")


@plan("agg_segment_profile")
def agg_segment_profile(spark, path):
    return segmentation.profile(seg_kmeans(spark, path), segmentation.GUEST_FEATURES)


@plan("seg_kmeans_bookings")
def seg_kmeans_bookings(spark, path):
    """Four segments of stays, best of 25 starts, and their profile."""
    vectors = _booking_vectors(spark, path)
    found = segmentation.best_kmeans(vectors, segmentation.SEGMENTS, segmentation.BOOKING_RESTARTS)
    return segmentation.booking_profile(found.transform(vectors)).withColumn("wss", F.lit(round(found.cost, 4)))


@plan("seg_elbow")
def seg_elbow(spark, path):
    return segmentation.elbow(spark, _booking_vectors(spark, path))


@plan("seg_pca")
def seg_pca(spark, path):
    projected, explained = segmentation.project(_guest_vectors(spark, path), ["primary_guest_name"])
    return projected.withColumn("explained_variance", F.lit(round(sum(explained), 4)))


@plan("seg_hier")
def seg_hier(spark, path):
    grouped = segmentation.divisive(_booking_vectors(spark, path))
    return segmentation.profile(grouped, segmentation.BOOKING_FEATURES, "hc_cluster").withColumnRenamed("n_guests", "n").withColumnRenamed(
        "share_of_guests", "share"
    )


# --- dashboard ---------------------------------------------------------------


@plan("bi_dashboard_bundle")
def bi_dashboard_bundle(spark, path):
    return bundle.dashboard(load(spark, path), snapshot=bundle.SNAPSHOT)
