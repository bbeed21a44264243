"""Checks of sources, projections, joins, set operations, aggregations and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatespark.operators import area_stats, metrics, projections, pseudo_labels, sequences, splits, vectors
from estatespark.plans.enrichment import base_features, enrich
from estatespark.schema import CATEGORICAL, CONTINUOUS, KEY, LISTING, enrichment_columns, image_feature_columns
from estatespark.session import as_table, fresh_path, joinable
from estatespark.sources import sinks, tables
from estatespark.verification.registry import check, exploded, rounded
from estatespark.verification.views import view

HASH = "('0x'||substr(md5(concat('{seed}:',cast(listing_id as varchar))),1,8))::bigint"
HOLDOUT = HASH.format(seed=0) + " % 1000 < 200"
IS_FIT = f"(not is_test and {HASH.format(seed=0)} % 1000 >= 200)"
BASE = f"""with base as (
 select *, substr(lpad(cast(postal_code as varchar),5,'0'),1,2) as department,
  case when property_type in ('appartement','maison') and size>1000 then null else size end as size_clean,
  size/nullif(land_size,0) as size_ratio, {IS_FIT} as is_fit from listing),
pm as (select *, price/nullif(size_clean,0) as price_m2 from base)
"""


def _r(*columns: str) -> str:
    return ", ".join(f"round({c},9) as {c}" for c in columns)


def _listing(spark, sf):
    return view(spark, sf, "listing")


def _base(spark, sf):
    return base_features(_listing(spark, sf))


# ---- sources and sinks -------------------------------------------------------------------------------------------

_DOUBLES = [f.name for f in LISTING.fields if f.dataType.typeName() == "double"]
_OTHERS = [f.name for f in LISTING.fields if f.dataType.typeName() != "double"]


@check("src_listings", f"select {', '.join(_OTHERS)}, {_r(*_DOUBLES)} from listing")
def src_listings(spark, sf):
    """Listings written as CSV with a header and read back under the declared schema."""
    path = fresh_path(spark, "listings") + ".csv"
    _listing(spark, sf).select(*LISTING.fieldNames()).write.option("header", True).csv(path)
    return rounded(tables.read_table(spark, path, LISTING))


@check(
    "src_keyed_features",
    """select vec_id, cast(label as bigint) as label, cast(p as bigint) as position, round(cast(embedding[p+1] as double),5) as value
 from embeddings, (select unnest(range(64)) as p)""",
    views=(),
)
def src_keyed_features(spark, sf):
    """Vectors written wide as CSV, read under the schema that the header asks for, and packed again."""
    stored = tables.read_keyed(spark, f"{sf}/embeddings.parquet", None, "vec_id")
    path = fresh_path(spark, "features") + ".csv"
    wide = vectors.widen(stored.select(F.col("vec_id").alias(KEY), "embedding"), "embedding", 64)
    wide.write.option("header", True).csv(path)
    back = vectors.pack(tables.read_image_features(spark, path), image_feature_columns(64), "embedding")
    labels = stored.select(F.col("vec_id").alias(KEY), F.col("label").cast("bigint").alias("label"))
    flat = exploded(back.join(labels, KEY).select(F.col(KEY).alias("vec_id"), "label", "embedding"), "embedding")
    return rounded(flat.withColumn("value", F.col("value").cast("double")), 5)


_TEMPLATE = """select t.listing_id, round(p.price,9) as price from (select listing_id from prediction where is_test) t
 left join (select listing_id, pred_a as price from prediction where is_test) p using (listing_id)"""


def _filled_template(spark, sf):
    predictions = view(spark, sf, "prediction").where("is_test")
    template = predictions.select("listing_id", F.lit(0.0).alias("price"))
    return sinks.fill_template(template, predictions, "pred_a")


@check("sink_submission", _TEMPLATE, views=("prediction",))
def sink_submission(spark, sf):
    path = fresh_path(spark, "submission") + ".csv"
    filled = _filled_template(spark, sf)
    sinks.write_submission(filled, path)
    return rounded(tables.read_table(spark, path, filled.schema))


@check("join_predictions", _TEMPLATE, views=("prediction",))
def join_predictions(spark, sf):
    return rounded(_filled_template(spark, sf))


_SPLIT_MAPES = """select case when {holdout} then 'MAPE_valid' else 'MAPE_train' end as metric,
 round(avg(abs(price-{pred})/greatest(abs(price),2.220446049250313e-16)),9) as value from prediction where not is_test group by 1"""


def _split_mapes(spark, sf, predicted):
    labelled = view(spark, sf, "prediction").where("not is_test").withColumn("split", splits.split_name())
    return metrics.metrics_by_split(labelled, "split", "price", predicted)


@check(
    "sink_metrics",
    f"""select 'a' as run, * from ({_SPLIT_MAPES.format(holdout=HOLDOUT, pred='pred_a')})
 union all select 'b' as run, * from ({_SPLIT_MAPES.format(holdout=HOLDOUT, pred='pred_b')})""",
    views=("prediction",),
)
def sink_metrics(spark, sf):
    path = fresh_path(spark, "metrics")
    for run in ("a", "b"):
        sinks.append_metrics(metrics.metric_rows(_split_mapes(spark, sf, f"pred_{run}"), run), path)
    return rounded(spark.read.parquet(path))


# ---- projections -------------------------------------------------------------------------------------------------


@check("department", "select listing_id, substr(lpad(cast(postal_code as varchar),5,'0'),1,2) as department from listing")
def department(spark, sf):
    return projections.add_department(_listing(spark, sf)).select("listing_id", "department")


@check(
    "size_clean",
    "select listing_id, case when property_type in ('appartement','maison') and size>1000 then null else size end as size_clean from listing",
)
def size_clean(spark, sf):
    return projections.add_size_clean(_listing(spark, sf)).select("listing_id", "size_clean")


@check(
    "ratios",
    BASE + f"select listing_id, {_r('size_ratio', 'price_m2')}, round(size_clean/nullif(land_size,0),9) as size_ratio_clean from pm",
)
def ratios(spark, sf):
    df = projections.add_size_ratio_clean(_base(spark, sf))
    return rounded(df.select("listing_id", "size_ratio", "price_m2", "size_ratio_clean"))


@check(
    "photo_cap",
    "select listing_id, case when nb_photos is not null then least(nb_photos,6) end as nb_photos_clean from listing",
)
def photo_cap(spark, sf):
    return projections.add_nb_photos_clean(_listing(spark, sf)).select("listing_id", "nb_photos_clean")


@check("rooms_from_bedrooms", "select listing_id, coalesce(nb_rooms, nb_bedrooms+1) as nb_rooms from listing")
def rooms_from_bedrooms(spark, sf):
    return projections.fill_rooms(_listing(spark, sf)).select("listing_id", "nb_rooms")


_FILLED = ", ".join(
    [f"coalesce({c}, {projections.ENERGY_FILL.get(c, 0.0)}) as {c}" for c in CONTINUOUS]
    + [f"coalesce(cast({c} as varchar),'-1') as {c}" for c in CATEGORICAL]
)


@check("fill_defaults", BASE + f"select listing_id, {_FILLED} from base")
def fill_defaults(spark, sf):
    df = projections.fill_defaults(projections.add_department(_listing(spark, sf)))
    return df.select("listing_id", *CONTINUOUS, *CATEGORICAL)


@check(
    "clip",
    """select listing_id, case when nb_rooms is not null then least(greatest(nb_rooms,2),5) end as nb_rooms,
 case when nb_bedrooms is not null then greatest(nb_bedrooms,2) end as nb_bedrooms from listing""",
)
def clip(spark, sf):
    df = projections.clip_columns(_listing(spark, sf), ["nb_rooms"], 2, 5)
    return projections.clip_columns(df, ["nb_bedrooms"], lower=2).select("listing_id", "nb_rooms", "nb_bedrooms")


@check("log_target", "select listing_id, round(ln(price),9) as label from listing where price>0")
def log_target(spark, sf):
    df = projections.log_target(_listing(spark, sf)).where(F.col("label").isNotNull())
    return rounded(df.select("listing_id", "label"))


@check("exp_prediction", "select listing_id, round(exp(ln(pred_a)),6) as price from prediction", views=("prediction",))
def exp_prediction(spark, sf):
    df = view(spark, sf, "prediction").select("listing_id", F.log("pred_a").alias("prediction"))
    return rounded(projections.exp_prediction(df).select("listing_id", "price"), 6)


@check(
    "select_features",
    BASE
    + "select listing_id, "
    + ", ".join(c for c in CATEGORICAL)
    + ", "
    + _r(*[c for c in CONTINUOUS if c != "size"], "size_ratio", "size_clean")
    + " from base",
)
def select_features(spark, sf):
    continuous, categorical = projections.model_columns(["size_ratio", "size_clean"], dont_use_size=True)
    return rounded(projections.select_features(_base(spark, sf), ["listing_id"], continuous, categorical))


_PREPARED = (
    "prepared as (select listing_id, is_test, is_fit, "
    + ", ".join(
        [
            ("coalesce(nb_rooms, nb_bedrooms+1, 0.0) as nb_rooms" if c == "nb_rooms"
             else f"coalesce({c}, {projections.ENERGY_FILL.get(c, 0.0)}) as {c}")
            for c in CONTINUOUS
        ]
        + [f"coalesce(cast({c} as varchar),'-1') as {c}" for c in CATEGORICAL]
    )
    + " from base)"
)


@check("prepare_datasets", BASE + f", {_PREPARED} select * exclude (is_test, is_fit) from prepared")
def prepare_datasets(spark, sf):
    """The whole cleaning sequence without a quantile map."""
    return projections.prepare(_listing(spark, sf)).select("listing_id", *CONTINUOUS, *CATEGORICAL)


_AREA_ERRORS = """errors as (select postal_code, avg(abs(price-pred_a)/greatest(abs(price),2.220446049250313e-16)) as uncertainty
 from prediction where not is_test and postal_code is not null group by 1),
labels as (select p.listing_id, p.pred_a as price, e.uncertainty from prediction p left join errors e using (postal_code) where p.is_test)"""


def _pseudo_labels(spark, sf):
    scored = view(spark, sf, "prediction").withColumn("prediction", F.col("pred_a"))
    return pseudo_labels.pseudo_labels(scored)


@check("area_uncertainty", f"with {_AREA_ERRORS} select listing_id, {_r('price', 'uncertainty')} from labels", views=("prediction",))
def area_uncertainty(spark, sf):
    return rounded(_pseudo_labels(spark, sf))


@check(
    "uncertainty_filter",
    f"with {_AREA_ERRORS} select listing_id, {_r('price', 'uncertainty')} from labels where uncertainty<0.9",
    views=("prediction",),
)
def uncertainty_filter(spark, sf):
    return rounded(projections.uncertainty_filter(_pseudo_labels(spark, sf), 0.9))


@check(
    "pseudo_label_append",
    f"""with {_AREA_ERRORS} select listing_id, postal_code, size, round(price,9) as price from listing where not is_test
 union all select l.listing_id, l.postal_code, l.size, round(a.price,9) from listing l join labels a using (listing_id) where l.is_test and a.uncertainty<0.9""",
    views=("listing", "prediction"),
)
def pseudo_label_append(spark, sf):
    rows = _listing(spark, sf).select("listing_id", "postal_code", "size", "price", "is_test")
    fit, test = rows.where("not is_test"), rows.where("is_test")
    return rounded(pseudo_labels.append_pseudo_labels(fit, test, _pseudo_labels(spark, sf), 0.9).drop("is_test"))


@check("photo_dims_filter", "select photo_no, width, height from photo_dims where width=743", views=("photo_dims",))
def photo_dims_filter(spark, sf):
    return projections.width_filter(view(spark, sf, "photo_dims"), 743)


@check(
    "aspect_ratio", "select photo_no, round(cast(width as double)/nullif(height,0),9) as aspect_ratio from photo_dims", views=("photo_dims",)
)
def aspect_ratio(spark, sf):
    return rounded(projections.add_aspect_ratio(view(spark, sf, "photo_dims")).select("photo_no", "aspect_ratio"))


# ---- area statistics and enrichment ------------------------------------------------------------------------------


@check("density_postal", "select postal_code, count(*) as density from listing where postal_code is not null group by 1")
def density_postal(spark, sf):
    return area_stats.postal_density(_listing(spark, sf))


@check("density_department", BASE + "select department, count(*) as density_department from base where department is not null group by 1")
def density_department(spark, sf):
    return area_stats.department_density(projections.add_department(_listing(spark, sf)))


_DENSITIES = """d1 as (select postal_code, count(*) as density from base group by 1),
d2 as (select department, count(*) as density_department from base group by 1)"""


@check(
    "density_ratio",
    BASE
    + f""", {_DENSITIES} select listing_id, density, density_department, round(density/density_department,9) as density_ratio
 from base left join d1 using (postal_code) left join d2 using (department)""",
)
def density_ratio(spark, sf):
    df = projections.add_department(_listing(spark, sf))
    postal = joinable(as_table(area_stats.postal_density(df), "density"))
    departments = joinable(as_table(area_stats.department_density(df), "density-department"))
    joined = area_stats.join_densities(df, postal, departments)
    return rounded(joined.select("listing_id", "density", "density_department", "density_ratio"))


_LEVELS = {"zipcode": "postal_code", "deptcode": "department", "city": "city"}
_GROUPED = " union all ".join(
    f"select '{level}' as level, cast({column} as varchar) as area, property_type, price_m2 from pm where is_fit and price_m2 is not null and {column} is not null"
    for level, column in _LEVELS.items()
)


def _price_rows(spark, sf):
    return area_stats.price_rows(_base(spark, sf), splits.is_fit())


def _written_price_rows(spark, sf):
    """For queries that read the rows several times: the columns they come from are written before they are stacked by level."""
    price = F.when(splits.is_fit(), F.col("price_m2")).alias("price_m2")
    narrow = _base(spark, sf).select(*area_stats.AREA_LEVELS.values(), "property_type", price)
    return area_stats.price_rows(as_table(narrow.dropna(subset=["property_type", "price_m2"]), "area-prices"), F.lit(True))


@check(
    "price_m2_mean",
    BASE + f"select level, area, property_type, count(*) as n, round(avg(price_m2),9) as mean from ({_GROUPED}) group by 1,2,3",
)
def price_m2_mean(spark, sf):
    return rounded(area_stats.price_moments(_price_rows(spark, sf)).drop("std", "listings"))


@check(
    "price_m2_std",
    BASE + f"select level, area, property_type, round(stddev_samp(price_m2),9) as std from ({_GROUPED}) group by 1,2,3",
)
def price_m2_std(spark, sf):
    return rounded(area_stats.price_moments(_price_rows(spark, sf)).drop("mean", "n", "listings"))


_QUARTILES = ", ".join(f"round(quantile_cont(price_m2,{p}),9) as p{int(100 * p)}" for p in area_stats.QUARTILES)


@check("price_m2_quantiles", BASE + f"select level, area, property_type, {_QUARTILES} from ({_GROUPED}) group by 1,2,3")
def price_m2_quantiles(spark, sf):
    rows = _written_price_rows(spark, sf)
    sizes = as_table(rows.groupBy(*area_stats.GROUP).agg(F.count("*").alias("n")), "group-sizes")
    return rounded(area_stats.price_quantiles(rows, sizes))


@check("price_m2_quantiles_large", BASE + f"select level, area, property_type, {_QUARTILES} from ({_GROUPED}) group by 1,2,3")
def price_m2_quantiles_large(spark, sf):
    """The same with groups above 20 rows taking the way for areas of unbounded size."""
    rows = _written_price_rows(spark, sf)
    sizes = as_table(rows.groupBy(*area_stats.GROUP).agg(F.count("*").alias("n")), "group-sizes")
    return rounded(area_stats.price_quantiles(rows, sizes, direct_rows=20))


def _statistics(level: str) -> str:
    column = _LEVELS[level]
    return f"""s_{level} as (select {column}, property_type, avg(price_m2) as price_m2_type_{level},
 quantile_cont(price_m2,0.25) as price_m2_type_{level}25, quantile_cont(price_m2,0.5) as price_m2_type_{level}50,
 quantile_cont(price_m2,0.75) as price_m2_type_{level}75, stddev_samp(price_m2) as price_m2_type_{level}_std
 from pm where is_fit group by 1,2)"""


_JOINED = (
    BASE
    + ", "
    + _DENSITIES
    + ", "
    + ", ".join(_statistics(level) for level in _LEVELS)
    + """, joined as (select pm.*, density, density_department, density/density_department as density_ratio,
 s_zipcode.* exclude (postal_code, property_type), s_deptcode.* exclude (department, property_type), s_city.* exclude (city, property_type)
 from pm left join d1 on pm.postal_code=d1.postal_code left join d2 on pm.department=d2.department
 left join s_zipcode on pm.postal_code=s_zipcode.postal_code and pm.property_type=s_zipcode.property_type
 left join s_deptcode on pm.department=s_deptcode.department and pm.property_type=s_deptcode.property_type
 left join s_city on pm.city=s_city.city and pm.property_type=s_city.property_type)"""
)
_STAT_COLUMNS = [c for c in enrichment_columns() if c.startswith("price_m2_type")]


@check("join_group_stats", _JOINED + f" select listing_id, {_r(*_STAT_COLUMNS)} from joined")
def join_group_stats(spark, sf):
    base = _base(spark, sf)
    fitted = area_stats.fit_area_statistics(base, splits.is_fit())
    return rounded(fitted.transform(base).select("listing_id", *_STAT_COLUMNS))


_FILLED_SIZE = "case when is_fit and size_clean is null then price/nullif(price_m2_type_zipcode,0) else size_clean end"


@check("size_backfill", _JOINED + f" select listing_id, round({_FILLED_SIZE},9) as size_clean from joined")
def size_backfill(spark, sf):
    base = _base(spark, sf)
    means = as_table(
        base.where(splits.is_fit())
        .groupBy("postal_code", "property_type")
        .agg(F.avg("price_m2").alias("price_m2_type_zipcode")),
        "area-means",
    )
    joined = base.join(joinable(means), ["postal_code", "property_type"], "left")
    return rounded(projections.backfill_size(joined, splits.is_fit()).select("listing_id", "size_clean"))


_ENRICHED = (
    _JOINED
    + f""", filled as (select * replace ({_FILLED_SIZE} as size_clean) from joined)
 select listing_id, density, density_department, round(price_m2,9) as price_m2,
 {_r('density_ratio', 'size_ratio', 'size_clean', *_STAT_COLUMNS)}, round(size_clean/nullif(land_size,0),9) as size_ratio_clean,
 case when nb_photos is not null then least(nb_photos,6) end as nb_photos_clean from filled"""
)


@check("enrichment", _ENRICHED)
def enrichment(spark, sf):
    return rounded(enrich(_listing(spark, sf)).select("listing_id", "price_m2", *enrichment_columns()))


# ---- joins, set operations ---------------------------------------------------------------------------------------


@check(
    "join_labels",
    "select listing_id, is_test, price from listing",
)
def join_labels(spark, sf):
    rows = _listing(spark, sf)
    labels = rows.where("not is_test").select("listing_id", "price")
    return splits.join_labels(rows.select("listing_id", "is_test"), labels)


@check(
    "aligned_sample",
    f"select listing_id, size, price from listing where not is_test and {HASH.format(seed=2)} % 1000 < 10",
)
def aligned_sample(spark, sf):
    train = _listing(spark, sf).where("not is_test")
    features, labels = splits.aligned_sample(train.select("listing_id", "size"), train.select("listing_id", "price"))
    return features.join(labels, "listing_id")


@check(
    "photo_fallback",
    """select listing_id, photo_no, split, round(brightness,9) as brightness from photo where split='train'
 or (split='test' and listing_id not in (select listing_id from photo where split='train'))""",
    views=("photo",),
)
def photo_fallback(spark, sf):
    return rounded(sequences.photo_fallback(view(spark, sf, "photo"), "train"))


@check(
    "photo_cap_sequence",
    """select listing_id, photo_no, position from (select listing_id, photo_no,
 row_number() over (partition by listing_id order by photo_no)-1 as position from photo) where position<6""",
    views=("photo",),
)
def photo_cap_sequence(spark, sf):
    first = sequences.first_photos(view(spark, sf, "photo"), "photo_no")
    return first.select("listing_id", "photo_no", F.col("position").cast("bigint").alias("position"))


@check(
    "pad_sequence",
    """with n as (select listing_id, brightness, row_number() over (partition by listing_id order by photo_no)-1 as position from photo),
 k as (select distinct listing_id from photo)
 select k.listing_id, cast(p as bigint) as position, round(coalesce(n.brightness,0.0),9) as value, cast(case when n.position is null then 0 else 1 end as bigint) as mask
 from k cross join (select unnest(range(6)) as p) left join n on n.listing_id=k.listing_id and n.position=p""",
    views=("photo",),
)
def pad_sequence(spark, sf):
    first = sequences.first_photos(view(spark, sf, "photo"), "photo_no")
    padded = sequences.pad_sequences(first, "brightness", F.lit(0.0))
    flat = padded.select("listing_id", F.posexplode(F.arrays_zip("sequence", "mask")).alias("position", "entry"))
    return rounded(
        flat.select(
            "listing_id",
            F.col("position").cast("bigint").alias("position"),
            F.col("entry.sequence").alias("value"),
            F.col("entry.mask").cast("bigint").alias("mask"),
        )
    )


@check("union_splits", "select listing_id, size, is_test from listing")
def union_splits(spark, sf):
    rows = _listing(spark, sf).select("listing_id", "size", "is_test")
    train, test = splits.cut_splits(rows)
    return splits.union_splits(train, test)


@check(
    "best_model",
    """with t as (select postal_code, 'a' as run, avg(abs(price-pred_a)/price) as mape from prediction where not is_test group by 1
 union all select postal_code, 'b', avg(abs(price-pred_b)/price) from prediction where not is_test group by 1
 union all select postal_code, 'c', avg(abs(price-pred_c)/price) from prediction where not is_test group by 1)
 select postal_code, arg_min(run, mape) as run, round(min(mape),9) as mape from t group by 1""",
    views=("prediction",),
)
def best_model(spark, sf):
    """For every postal code the predictor with the lowest error."""
    labelled = view(spark, sf, "prediction").where("not is_test")
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"pred_{r}").alias("prediction")) for r in "abc"])
    stacked = labelled.select("postal_code", "price", F.inline(runs))
    trials = metrics.mape(stacked, "price", "prediction", ["postal_code", "run"])
    return rounded(metrics.best_run(trials, "mape", ["postal_code"]))


# ---- metrics -----------------------------------------------------------------------------------------------------


def _describe(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(x) as n, round(avg(x),9) as mean, round(stddev_samp(x),9) as std, round(min(x),9) as min,
 round(quantile_cont(x,0.25),9) as p25, round(quantile_cont(x,0.5),9) as p50, round(quantile_cont(x,0.75),9) as p75, round(max(x),9) as max
 from (select cast({c} as double) as x from {table})"""
        for c in columns
    )


@check(
    "describe",
    "with dims as (select *, cast(width as double)/nullif(height,0) as aspect_ratio from photo_dims) "
    + _describe("dims", ["width", "height", "aspect_ratio"]),
    views=("photo_dims",),
)
def describe(spark, sf):
    dims = projections.add_aspect_ratio(view(spark, sf, "photo_dims"))
    return rounded(metrics.describe(dims, ["width", "height", "aspect_ratio"]))


@check(
    "mape",
    """select postal_code, round(avg(abs(price-pred_a)/greatest(abs(price),2.220446049250313e-16)),9) as mape
 from prediction where price is not null group by 1""",
    views=("prediction",),
)
def mape(spark, sf):
    return rounded(metrics.mape(view(spark, sf, "prediction"), "price", "pred_a", ["postal_code"]))


@check(
    "mape_unguarded",
    "select round(avg(abs(price-pred_b)/nullif(abs(price),0)),9) as mape from prediction where price is not null",
    views=("prediction",),
)
def mape_unguarded(spark, sf):
    return rounded(metrics.mape(view(spark, sf, "prediction"), "price", "pred_b", guarded=False))


@check(
    "mae_mse",
    """select cast(is_test as varchar) as part, round(avg(abs(ln(price)-ln(pred_a))),9) as mae, round(avg((ln(price)-ln(pred_a))*(ln(price)-ln(pred_a))),9) as mse
 from prediction where price is not null group by 1
 union all select 'price', round(avg(abs(price-pred_a)),4), round(avg((price-pred_a)*(price-pred_a)),1) from prediction where price is not null""",
    views=("prediction",),
)
def mae_mse(spark, sf):
    scored = view(spark, sf, "prediction").withColumn("part", F.col("is_test").cast("string"))
    logs = rounded(metrics.mae_mse(scored, "price", "pred_a", ["part"], log_scale=True))
    prices = metrics.mae_mse(scored, "price", "pred_a")
    return logs.unionByName(prices.select(F.lit("price").alias("part"), F.round("mae", 4).alias("mae"), F.round("mse", 1).alias("mse")))


@check("metrics_by_split", _SPLIT_MAPES.format(holdout=HOLDOUT, pred="pred_c"), views=("prediction",))
def metrics_by_split(spark, sf):
    return rounded(_split_mapes(spark, sf, "pred_c"))


# ---- splits ------------------------------------------------------------------------------------------------------


@check("holdout_split", f"select listing_id, case when is_test then 'test' when {HOLDOUT} then 'valid' else 'train' end as split from listing")
def holdout_split(spark, sf):
    return _listing(spark, sf).select("listing_id", splits.split_name().alias("split"))


@check("kfold", f"select listing_id, {HASH.format(seed=1)} % 3 as fold from listing where {IS_FIT}")
def kfold(spark, sf):
    return _listing(spark, sf).where(splits.is_fit()).select("listing_id", splits.fold(3).alias("fold"))


@check("hash_sample", f"select listing_id from listing where {HASH.format(seed=2)} % 1000 < 10")
def hash_sample(spark, sf):
    return splits.hash_sample(_listing(spark, sf)).select("listing_id")
