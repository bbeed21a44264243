"""Checks of the model jobs over whole listing tables.

The models are stumps: one iteration, one split, two columns with few values. SQL finds the split of least squared error itself, for
each fold where there are folds, and predicts the mean logarithm of each side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import models, projections, search, splits
from estatespark.operators.target_statistics import count_categories, count_rows, fit_target_statistics
from estatespark.plans import saved_runs, training
from estatespark.plans.search import search_runs
from estatespark.schema import IS_TEST, KEY, TARGET
from estatespark.session import as_table, fresh_path
from estatespark.verification.registry import check, rounded
from estatespark.verification.tabular import HASH, HOLDOUT
from estatespark.verification.views import view

FEATURES = ("property_type", "nb_bathrooms")
STUMP = RunConfig(iterations=1, max_depth=1, features=FEATURES, columns_to_add=(), early_stopping=False, size_backfill=False)
FOLD = HASH.format(seed=1)

ROWS = f"""f as (select listing_id, coalesce(property_type,'-1') as pt, coalesce(nb_bathrooms,0) as nb, ln(price) as y, {FOLD} % 3 as fold,
  ({HOLDOUT}) as valid from listing where not is_test and price>0),
 everyone as (select *, coalesce(property_type,'-1') as pt, coalesce(nb_bathrooms,0) as nb,
  case when is_test then 'test' when {HOLDOUT} then 'valid' else 'train' end as split from listing)"""


def _stump(rows: str = "f", folds: int = 0, tag: str = "") -> str:
    """SQL of `best{tag}`: the split of each member, and `scored{tag}`: the mean price over the members."""
    members = f"select unnest(range({max(folds, 1)})) as m"
    used = "not valid and fold<>m" if folds else "not valid"
    return f"""used{tag} as (select m, r.* from {rows} r, ({members}) where {used}),
 cuts{tag} as (select distinct 'property_type' as feature, pt as spot from {rows} union all select 'nb_bathrooms', '1.5'),
 sides{tag} as (select m, feature, spot, (case when feature='property_type' then pt=spot else nb>1.5 end) as side, count(*) as n, sum(y) as s
  from used{tag}, cuts{tag} group by all),
 gains{tag} as (select m, feature, spot, sum(s*s/n) as gain, max(case when side then s/n end) as inside, max(case when not side then s/n end) as outside
  from sides{tag} group by all having count(*)=2),
 best{tag} as (select * from gains{tag} qualify row_number() over (partition by m order by gain desc)=1),
 scored{tag} as (select listing_id, any_value(split) as split, any_value(price) as price, any_value(postal_code) as postal_code,
  any_value(is_test) as is_test, any_value(pt) as pt, any_value(nb) as nb,
  avg(exp(case when (case when feature='property_type' then pt=spot else nb>1.5 end) then inside else outside end)) as prediction
  from everyone, best{tag} group by listing_id)"""


_ALL_FIT = ROWS.replace(f"({HOLDOUT}) as valid", "false as valid")
_SCORED = "select listing_id, split, round(prediction,6) as prediction from scored"


def _validation():
    return splits.is_holdout() & ~F.col(IS_TEST)


def _prepared(spark, sf):
    rows = projections.prepare(view(spark, sf, "listing")).select(KEY, IS_TEST, TARGET, *FEATURES)
    return as_table(rows, "prepared")


def _fit(function, rows, validation=None):
    return function(rows.where(f"not {IS_TEST}"), FEATURES[1:], STUMP, validation, FEATURES[:1])


def _scored(model, rows):
    return rounded(models.score_splits(model, rows).select(KEY, "split", "prediction"), 6)


@check("gbt_fit_score", f"with {_ALL_FIT}, {_stump()} {_SCORED}")
def gbt_fit_score(spark, sf):
    rows = _prepared(spark, sf)
    return _scored(_fit(models.fit_price_model, rows), rows)


@check("cv_ensemble", f"with {_ALL_FIT}, {_stump(folds=3)} {_SCORED}")
def cv_ensemble(spark, sf):
    """Three fitted folds, averaged as prices."""
    rows = _prepared(spark, sf)
    return _scored(_fit(models.fit_fold_ensemble, rows), rows)


@check("batch_score", f"with {ROWS}, {_stump(folds=3)} {_SCORED}")
def batch_score(spark, sf):
    """The ensemble's folds leave the validation rows out as well."""
    rows = _prepared(spark, sf)
    return _scored(_fit(models.fit_fold_ensemble, rows, _validation()), rows)


_SIDE = "case when feature='property_type' then pt=spot else nb>1.5 end"
_MEDIAN_STUMP = RunConfig(**{**vars(STUMP), "leaf_values": "median"})
_MEDIANS = f"""{_stump()}, mids as (select {_SIDE} as side, quantile_cont(y, 0.5) as mid from used cross join (select feature, spot from best) group by 1),
 halves as (select e.listing_id, e.split, exp(mid) as prediction from everyone e cross join (select feature, spot from best) join mids on mids.side = ({_SIDE}))"""


@check("leaf_medians", f"with {_ALL_FIT}, {_MEDIANS} select listing_id, split, round(prediction,6) as prediction from halves")
def leaf_medians(spark, sf):
    """The stump's split, with the median log price of each side."""
    rows = _prepared(spark, sf)
    return _scored(models.fit_price_model(rows.where(f"not {IS_TEST}"), FEATURES[1:], _MEDIAN_STUMP, None, FEATURES[:1]), rows)


_WEIGHTED = f"""weighed as (select *, 1/greatest(abs(y),1) as w from f),
 cuts as (select distinct 'property_type' as feature, pt as spot from weighed union all select 'nb_bathrooms', '1.5'),
 sides as (select feature, spot, {_SIDE} as side, sum(w) as n, sum(w*y) as s from weighed, cuts group by all),
 gains as (select feature, spot, sum(s*s/n) as gain from sides group by all having count(*)=2),
 best as (select * from gains qualify row_number() over (order by gain desc)=1),
 values_of as (select {_SIDE} as side, y, sum(w) as w from weighed cross join best group by 1, 2),
 below as (select *, sum(w) over (partition by side order by y) - w as below, sum(w) over (partition by side) as total from values_of),
 mids as (select side, max(y) as mid from below where below <= total/2 group by 1),
 halves as (select e.listing_id, e.split, exp(mid) as prediction from everyone e cross join best join mids on mids.side = ({_SIDE}))"""


@check("leaf_weighted_medians", f"with {_ALL_FIT}, {_WEIGHTED} select listing_id, split, round(prediction,6) as prediction from halves")
def leaf_weighted_medians(spark, sf):
    """Split and medians with weights of one over the log price, for percentage errors."""
    rows, config = _prepared(spark, sf), RunConfig(**{**vars(_MEDIAN_STUMP), "loss": "percentage"})
    return _scored(models.fit_price_model(rows.where(f"not {IS_TEST}"), FEATURES[1:], config, None, FEATURES[:1]), rows)


@check("saved_run_score", f"with {ROWS}, {_stump(folds=3)} select listing_id, round(prediction,6) as prediction from scored")
def saved_run_score(spark, sf):
    """A run saved and loaded again, scoring the listings as new ones."""
    listings, path = view(spark, sf, "listing"), fresh_path(spark, "saved-run")
    saved_runs.save_run(training.run_trees(listings, STUMP), path)
    new = listings.drop(TARGET, IS_TEST)
    return rounded(saved_runs.load_run(spark, path).transform(new).select(KEY, "prediction"), 6)


_SLOTS = "(select unnest(['property_type','nb_bathrooms']) as feature)"


@check(
    "importances",
    f"with {ROWS}, {_stump(folds=3)} select k.feature, count(m)/3.0e0 as importance from {_SLOTS} k left join best using (feature) group by 1",
)
def importances(spark, sf):
    """A stump's only column has importance 1; the folds are averaged."""
    return rounded(_fit(models.fit_fold_ensemble, _prepared(spark, sf), _validation()).importances(spark))


@check(
    "importance_sorted",
    f"""with {_ALL_FIT}, {_stump()}, i as (select k.feature, cast(count(m) as double) as importance from {_SLOTS} k left join best using (feature) group by 1)
 select row_number() over (order by importance desc, feature) as place, * from i""",
)
def importance_sorted(spark, sf):
    ordered = _fit(models.fit_price_model, _prepared(spark, sf)).importances(spark).orderBy(F.desc("importance"), "feature")
    return spark.createDataFrame([(i + 1, *row) for i, row in enumerate(ordered.collect())], "place bigint, feature string, importance double")


_MAPES = """select '{run}' as run, 'MAPE_'||split as metric, round(avg(abs(price-prediction)/greatest(abs(price),2.220446049250313e-16)),9) as value
 from {scored} where not is_test and price is not null group by split"""


@check("tree_run", f"with {ROWS}, {_stump(folds=3)} {_MAPES.format(run='run', scored='scored')}")
def tree_run(spark, sf):
    """The whole tree pipeline, enrichment included; train and validation error."""
    return rounded(training.run_trees(view(spark, sf, "listing"), STUMP).metrics)


@check(
    "random_search",
    f"with {ROWS}, {_stump(folds=3)}, {_stump(rows='f', folds=2, tag='_two').replace('fold<>m', 'fold_two<>m')} "
    f"{_MAPES.format(run='trial_0000', scored='scored')} union all {_MAPES.format(run='trial_0001', scored='scored_two')}".replace(
        "% 3 as fold,", f"% 3 as fold, {FOLD} % 2 as fold_two,"
    ),
)
def random_search(spark, sf):
    """Trials that differ in the number of folds, by their errors."""
    settings = search.sample_settings({"n_folds": {"value": 3}, "max_depth": {"value": 1}}, 1)
    settings += search.sample_settings({"n_folds": {"value": 2}, "one_hot_max_size": {"value": 6}}, 1)
    return rounded(search_runs(view(spark, sf, "listing"), settings, STUMP))


LEVEL = 0.9


@check(
    "pseudo_label_loop",
    f"""with {ROWS}, {_stump(folds=3)},
 areas as (select postal_code, avg(abs(price-prediction)/greatest(abs(price),2.220446049250313e-16)) as uncertainty from scored
  where not is_test and price is not null and postal_code is not null group by 1),
 more as (select listing_id, pt, nb, y, fold, valid from f union all
  select listing_id, pt, nb, ln(prediction), {FOLD} % 3, false from scored join areas using (postal_code) where is_test and uncertainty<{LEVEL}),
 {_stump(rows='more', folds=3, tag='_again')} {_SCORED}_again""",
)
def pseudo_label_loop(spark, sf):
    """Scored rows after a second run, on the test rows whose area the first run predicts well."""
    config = RunConfig(**{**vars(STUMP), "uncertainty_level": LEVEL})
    result = training.pseudo_label_rounds(view(spark, sf, "listing"), config)
    return rounded(result.scored.select(KEY, "split", "prediction"), 6)


@check(
    "pseudo_label_loop_out_of_fold",
    f"""with {ROWS}, {_stump(folds=3)},
 priced as (select e.*, m, exp(case when ({_SIDE}) then inside else outside end) as pred, {FOLD} % 3 as fold from everyone e, best),
 outside as (select listing_id, any_value(postal_code) as postal_code, any_value(price) as price, any_value(is_test) as is_test,
  case when any_value(split)='train' then max(case when m=fold then pred end) else avg(pred) end as pred from priced group by listing_id),
 areas as (select postal_code, avg(abs(price-pred)/greatest(abs(price),2.220446049250313e-16)) as uncertainty from outside
  where not is_test and price is not null and postal_code is not null group by 1),
 more as (select listing_id, pt, nb, y, fold, valid from f union all
  select listing_id, pt, nb, ln(prediction), {FOLD} % 3, false from scored join areas using (postal_code) where is_test and uncertainty<{LEVEL}),
 {_stump(rows='more', folds=3, tag='_again')} {_SCORED}_again""",
)
def pseudo_label_loop_out_of_fold(spark, sf):
    """As before, with the errors of the member that left a row out."""
    config = RunConfig(**{**vars(STUMP), "uncertainty_level": LEVEL})
    result = training.pseudo_label_rounds(view(spark, sf, "listing"), config, out_of_fold=True)
    return rounded(result.scored.select(KEY, "split", "prediction"), 6)


PATIENCE = 3
_CURVE = "curve as (select cast(l_quantity as bigint) as step, round(avg(l_tax),9) as error from lineitem group by 1)"


@check(
    "early_stop",
    f"""with {_CURVE}, numbered as (select row_number() over (order by step) as i, error from curve),
 low as (select *, min(error) over (order by i rows between unbounded preceding and 1 preceding) as before from numbered),
 news as (select i, error from low where before is null or error<before),
 gaps as (select i, lead(i) over (order by i) as following, (select max(i) from numbered) as last from news)
 select 'all' as rule, max(i) as kept from news
 union all select 'patience', min(i) from gaps where coalesce(following, last+{PATIENCE}+1)-i>{PATIENCE}""",
    views=(),
)
def early_stop(spark, sf):
    """Iterations kept of an error curve: the first lowest error of all, and with patience."""
    from estatespark.verification.views import table

    lines = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("step"))
    rows = lines.agg(F.round(F.avg("l_tax").cast("double"), 9).alias("error")).orderBy("step").collect()
    errors = [r["error"] for r in rows]
    kept = [("all", models.best_prefix(errors)), ("patience", models.best_prefix(errors, PATIENCE))]
    return spark.createDataFrame(kept, "rule string, kept bigint")


# Whole runs without SQL: tests hold them to properties.

CURVE = RunConfig(
    iterations=12, learning_rate=0.5, max_depth=2, features=(*FEATURES, "size", "postal_code", "nb_rooms"), columns_to_add=(), size_backfill=False,
    early_stopping_rounds=3, leaf_values="median",
)


@check("early_stop_curve")
def early_stop_curve(spark, sf):
    """Validation error after each fitted tree, and whether the tree is kept. Fitting ends when patience runs out."""
    table, continuous, categorical = training.model_table(view(spark, sf, "listing"), CURVE)
    kept, errors = models.fit_curve(as_table(table, "prepared").where(~F.col(IS_TEST)), continuous, CURVE, _validation(), categorical)
    rows = [(i + 1, float(e), i < kept.trees.getNumTrees) for i, e in enumerate(errors)]
    return spark.createDataFrame(rows, "tree bigint, error double, kept boolean")


# The reference's real runs have up to so many trees; its default of two only tries a run out. Fitting ends when patience runs out.
BOOSTED = RunConfig(iterations=10_000, early_stopping_rounds=20)


@check("gbt_default")
def gbt_default(spark, sf):
    """One model on all columns, with default settings but for its trees: boosted until the validation error no longer falls."""
    config = BOOSTED
    table, continuous, categorical = training.model_table(view(spark, sf, "listing"), config)
    table = as_table(table, "prepared")
    model = models.fit_price_model(table.where(~F.col(IS_TEST)), continuous, config, _validation(), categorical)
    return models.score_splits(model, table, config).select(KEY, "split", "prediction")


@check("tree_run_default")
def tree_run_default(spark, sf):
    """The whole run with default settings: every row's score, as the submission and the errors need it."""
    return training.run_trees(view(spark, sf, "listing"), RunConfig()).scored.select(KEY, "split", TARGET, "prediction")


SEARCH_SPACE = {
    "learning_rate": {"min": 0.02, "max": 0.06, "distribution": "log_uniform_values"},
    "max_depth": {"values": [3, 4, 5]},
    "subsample": {"min": 0.8, "max": 1.0},
    "iterations": {"value": 2},
}


@check("random_search_range")
def random_search_range(spark, sf):
    """Trials drawn from ranges, by their errors."""
    config = RunConfig(n_folds=2, features=CURVE.features, columns_to_add=(), size_backfill=False)
    return search_runs(view(spark, sf, "listing"), search.sample_settings(SEARCH_SPACE, 2, seed=3), config)


_PART = f"({HASH.format(seed=1)} % 2)*4+{HASH.format(seed=3)} % 4"


@check(
    "target_statistics",
    f"""with g as (select *, ln(price) as y, {_PART} as part, not is_test and price>0 as fit from listing),
 f as (select * from g where fit),
 parts as (select part, count(*) as n, sum(y) as s from f group by 1),
 whole as (select count(*) as n, sum(y) as s from f),
 city as (select city, count(*) as n, sum(y) as s from f group by 1), city_part as (select city, part, count(*) as n, sum(y) as s from f group by 1,2),
 post as (select postal_code, count(*) as n, sum(y) as s from f group by 1), post_part as (select postal_code, part, count(*) as n, sum(y) as s from f group by 1,2),
 rest as (select g.listing_id, (w.s-coalesce(p.s,0))/(w.n-coalesce(p.n,0)) as prior, coalesce(c.n,0)-coalesce(cp.n,0) as cn, coalesce(c.s,0)-coalesce(cp.s,0) as cs,
  coalesce(q.n,0)-coalesce(qp.n,0) as qn, coalesce(q.s,0)-coalesce(qp.s,0) as qs
  from g cross join whole w left join parts p on g.fit and g.part=p.part
  left join city c on c.city=g.city left join city_part cp on g.fit and cp.city=g.city and cp.part=g.part
  left join post q on q.postal_code=g.postal_code left join post_part qp on g.fit and qp.postal_code=g.postal_code and qp.part=g.part)
 select listing_id, round((cs+prior*10)/(cn+10),9) as city, round((qs+prior*10)/(qn+10),9) as postal_code from rest""",
)
def target_statistics(spark, sf):
    """Smoothed mean log price of cities and postal codes; fit rows leave their own part out."""
    rows = projections.log_target(view(spark, sf, "listing"), TARGET, "label")
    fit_rows = rows.where(~F.col(IS_TEST) & F.col("label").isNotNull())
    part, columns = models.part_of(2, 0), ["city", "postal_code"]
    counts = as_table(count_categories(fit_rows, columns, "label", part), "category-counts")
    fitted = fit_target_statistics(counts, columns, *count_rows(fit_rows, "label", part, 2 * models.FOLD_PARTS))
    own = F.when(~F.col(IS_TEST) & F.col("label").isNotNull(), part).otherwise(-1)
    means = [fitted.mean(c, own=own).alias(c) for c in columns]
    return rounded(fitted.attach(rows).select(KEY, *means))
