"""Checks of fitted transforms: scaling, codes, quantile maps, vectors, components."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from estatespark.functions import numeric
from estatespark.operators import encoding, projections, quantile_map, splits, vectors
from estatespark.plans.network_inputs import network_inputs, photo_inputs
from estatespark.schema import CATEGORICAL, CONTINUOUS, QUANTILE_COLUMNS
from estatespark.session import as_table, fresh_path
from estatespark.sources import sinks
from estatespark.verification.registry import check, exploded, rounded
from estatespark.verification.tabular import _PREPARED, BASE
from estatespark.verification.views import table, view

PREPARED = BASE + ", " + _PREPARED


def _prepared(spark, sf):
    return projections.prepare(view(spark, sf, "listing"))


# ---- scaling and codes -------------------------------------------------------------------------------------------

_SCALED = ", ".join(
    f"round((coalesce({c},0)-m_{c})/(case when d_{c}=0 then 1 else d_{c} end),9) as {c}" for c in CONTINUOUS
)
_SCALES = "scales as (select " + ", ".join(
    f"avg(coalesce({c},0)) as m_{c}, stddev_pop(coalesce({c},0)) as d_{c}" for c in CONTINUOUS
)


@check("standard_scale", BASE + f", {_SCALES} from base where is_fit) select listing_id, {_SCALED} from base, scales")
def standard_scale(spark, sf):
    listings = view(spark, sf, "listing")
    scaling = encoding.fit_scaling(listings.where(splits.is_fit()))
    return rounded(scaling.transform(listings).select("listing_id", *CONTINUOUS))


def _codes(rows: str, unknown: str) -> str:
    """Dictionary, sizes and codes of every categorical column, as SQL."""
    parts, joins, outputs = [], [], []
    for c in CATEGORICAL:
        parts.append(
            f"""k_{c} as (select v, row_number() over (order by v)-1 as code from
 (select distinct cast({c} as varchar) as v from {rows} where is_fit and {c} is not null))"""
        )
        joins.append(f"left join k_{c} on cast({rows}.{c} as varchar)=k_{c}.v")
        missing = "-1" if unknown == "minus_one" else f"(select count(*) from k_{c})"
        outputs.append(f"cast(coalesce(k_{c}.code,{missing}) as bigint) as {c}")
    return f", {', '.join(parts)} select listing_id, {', '.join(outputs)} from {rows} {' '.join(joins)}"


@check("ordinal_encode_minus1", BASE + _codes("base", "minus_one"))
def ordinal_encode_minus1(spark, sf):
    df = projections.add_department(view(spark, sf, "listing"))
    return encoding.fit_ordinal(df.where(splits.is_fit())).transform(df).select("listing_id", *CATEGORICAL)


@check("ordinal_encode_k", BASE + _codes("base", "count"))
def ordinal_encode_k(spark, sf):
    df = projections.add_department(view(spark, sf, "listing"))
    codes = encoding.fit_ordinal(df.where(splits.is_fit()), unknown="count")
    return codes.transform(df).select("listing_id", *CATEGORICAL)


@check(
    "preprocessor",
    PREPARED
    + f", {_SCALES} from prepared where is_fit), scaled as (select listing_id, {_SCALED} from prepared, scales), coded as ("
    + "with x as (select 1)"
    + _codes("prepared", "minus_one")
    + ") select * from scaled join coded using (listing_id)",
)
def preprocessor(spark, sf):
    """Scaling and codes fitted on the cleaned fit rows, applied to all rows."""
    # Two fits and the transform read the rows, so those are joined and cleaned once.
    rows = _prepared(spark, sf).select("listing_id", splits.is_fit().alias("is_fit"), *CONTINUOUS, *CATEGORICAL)
    prepared = as_table(rows, "prepared")
    fitted = encoding.fit_preprocessor(prepared.where("is_fit"))
    return rounded(fitted.transform(prepared).select("listing_id", *CONTINUOUS, *CATEGORICAL))


def _cardinalities() -> str:
    return " union all ".join(
        f"""select '{c}' as "column", count(distinct cast({c} as varchar))+1 as cardinality from prepared where is_fit"""
        for c in CATEGORICAL
    )


@check("category_cardinality", PREPARED + " " + _cardinalities())
def category_cardinality(spark, sf):
    return encoding.category_cardinality(_prepared(spark, sf).where(splits.is_fit()))


@check(
    "embedding_widths",
    PREPARED
    + f""", n as ({_cardinalities()}) select "column", cardinality, cast(greatest(1, floor(cardinality/10.0)) as bigint) as width from n""",
)
def embedding_widths(spark, sf):
    return encoding.embedding_widths(encoding.category_cardinality(_prepared(spark, sf).where(splits.is_fit())), 10)


# ---- quantile map ------------------------------------------------------------------------------------------------


def _knots(columns, n: int = 100) -> str:
    points = ", ".join(f"{i / (n - 1)!r}e0" if "e" not in repr(i / (n - 1)) else repr(i / (n - 1)) for i in range(n))
    return "knots as (select " + ", ".join(f"quantile_cont({c},[{points}]) as q_{c}" for c in columns) + " from base where not is_test)"


def _rank(c: str, n: int = 100, tolerance: str = "") -> str:
    low = f"{c}<=q_{c}[1]" + (f" or {c}-1e-7<q_{c}[1]" if tolerance else "")
    high = f"{c}>=q_{c}[{n}]" + (f" or {c}+1e-7>q_{c}[{n}]" if tolerance else "")
    lo, hi = f"len(list_filter(q_{c}, lambda k: k<{c}))", f"len(list_filter(q_{c}, lambda k: k<={c}))"
    return f"""case when {c} is null then null when {low} then 0.0 when {high} then 1.0
 when {hi}>{lo} then ({lo}/{n - 1}.0e0 + ({hi}-1)/{n - 1}.0e0)/2
 else ({lo}-1)/{n - 1}.0e0 + ({c}-q_{c}[{lo}])/(q_{c}[{lo}+1]-q_{c}[{lo}])*({lo}/{n - 1}.0e0-({lo}-1)/{n - 1}.0e0) end"""


def _polynomial_sql(coefficients, x: str) -> str:
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text}*{x}+{c!r})"
    return text


def _normal(p: str) -> str:
    """AS 241 on a column `p`, as SQL."""

    def ratio(pair, x):
        return f"({_polynomial_sql(pair[0], x)}/{_polynomial_sql(pair[1], x)})"

    q = f"({p}-0.5)"
    r = f"sqrt(-ln(greatest(case when {q}<0 then {p} else 1.0-{p} end, 1e-300)))"
    near, far = ratio(numeric.AS241_NEAR_TAIL, f"({r}-1.6)"), ratio(numeric.AS241_FAR_TAIL, f"({r}-5.0)")
    tail = f"(case when {r}<=5.0 then {near} else {far} end)"
    centre = f"{q}*{ratio(numeric.AS241_CENTRE, f'(0.180625-{q}*{q})')}"
    value = f"(case when abs({q})<=0.425 then {centre} when {q}<0 then -{tail} else {tail} end)"
    bound = repr(numeric.NORMAL_BOUND)
    return f"case when {p} is not null then least(greatest({value},-{bound}),{bound}) end"


def _fitted_map(spark, sf, output, **options):
    # The fit and the transform read the rows, so those are joined once.
    rows = projections.add_department(view(spark, sf, "listing")).select("listing_id", "is_test", *QUANTILE_COLUMNS)
    listings = as_table(rows, "listings")
    return listings, quantile_map.fit_quantile_map(listings.where("not is_test"), output=output, **options)


@check(
    "quantile_uniform",
    BASE + f", {_knots(QUANTILE_COLUMNS)} select listing_id, " + ", ".join(f"round({_rank(c)},9) as {c}" for c in QUANTILE_COLUMNS) + " from base, knots",
)
def quantile_uniform(spark, sf):
    listings, fitted = _fitted_map(spark, sf, "uniform")
    return rounded(fitted.transform(listings, fill=False).select("listing_id", *QUANTILE_COLUMNS))


_NORMAL = (
    BASE
    + f", {_knots(QUANTILE_COLUMNS)}, ranks as (select listing_id, is_test, "
    + ", ".join(f"{_rank(c, tolerance='1e-7')} as {c}" for c in QUANTILE_COLUMNS)
    + " from base, knots), mapped as (select listing_id, is_test, "
    + ", ".join(f"{_normal(c)} as {c}" for c in QUANTILE_COLUMNS)
    + " from ranks)"
)


@check("quantile_normal", _NORMAL + " select listing_id, " + ", ".join(f"round({c},9) as {c}" for c in QUANTILE_COLUMNS) + " from mapped")
def quantile_normal(spark, sf):
    """Knots found by counting, the way for columns of unbounded size."""
    listings, fitted = _fitted_map(spark, sf, "normal", direct_rows=0)
    return rounded(fitted.transform(listings, fill=False).select("listing_id", *QUANTILE_COLUMNS))


@check(
    "quantile_sentinel_fill",
    _NORMAL
    + ", fills as (select "
    + ", ".join(f"min({c})-stddev_samp({c}) as f_{c}" for c in QUANTILE_COLUMNS)
    + " from mapped where not is_test) select listing_id, "
    + ", ".join(f"round(coalesce({c},f_{c}),9) as {c}" for c in QUANTILE_COLUMNS)
    + " from mapped, fills",
)
def quantile_sentinel_fill(spark, sf):
    listings, fitted = _fitted_map(spark, sf, "normal")
    return rounded(fitted.transform(listings).select("listing_id", *QUANTILE_COLUMNS))


@check(
    "quantile_sentinel_refill",
    _NORMAL
    + ", fills as (select "
    + ", ".join(f"min({c})-stddev_samp({c}) as f_{c}" for c in QUANTILE_COLUMNS)
    + " from mapped where not is_test), refills as (select "
    + ", ".join(f"min(coalesce({c},f_{c}))-stddev_samp(coalesce({c},f_{c})) as t_{c}" for c in QUANTILE_COLUMNS)
    + " from mapped, fills where not is_test) select listing_id, "
    + ", ".join(f"round(coalesce({c},case when is_test then t_{c} else f_{c} end),9) as {c}" for c in QUANTILE_COLUMNS)
    + " from mapped, fills, refills",
)
def quantile_sentinel_refill(spark, sf):
    """Test rows filled from the statistics of the already filled fit rows."""
    listings, fitted = _fitted_map(spark, sf, "normal", refill=True)
    filled = fitted.transform(listings, is_test=F.col("is_test"))
    return rounded(filled.select("listing_id", *QUANTILE_COLUMNS))


# ---- vectors -----------------------------------------------------------------------------------------------------

_FLAT = "flat as (select vec_id, label, p as position, cast(embedding[p+1] as double) as value from embeddings, (select unnest(range(64)) as p))"


def _means(spark, sf):
    return vectors.vector_mean(table(spark, sf, "embeddings"), "label", "embedding")


@check(
    "vector_mean",
    f"with {_FLAT} select cast(label as bigint) as label, cast(position as bigint) as position, round(avg(value),5) as value from flat group by 1,2",
    views=(),
)
def vector_mean(spark, sf):
    return rounded(exploded(_means(spark, sf).withColumn("label", F.col("label").cast("bigint")), "embedding"), 5)


# Every listing owns a vector, and every vector of the table is owned.
_OWNED = "select listing_id, listing_id%(select max(vec_id)+1 from embeddings) as vec_id, coalesce(size,0) as size, nb_bathrooms from listing"


def _owners(spark, sf):
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    owned = (F.col("listing_id") % (last + 1)).alias("vec_id")
    return view(spark, sf, "listing").select("listing_id", owned, "size", "nb_bathrooms")


def _weighed(entries: Column) -> Column:
    """One number that all entries of an array go into, each with its place."""
    placed = F.transform(entries, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(placed, F.lit(0.0), lambda s, x: s + x)



@check(
    "join_image_features",
    f"with {_FLAT}, o as ({_OWNED}), w as (select vec_id, sum(value*(position+1)) as weighed from flat group by 1) select listing_id, round(weighed,5) as weighed from o left join w using (vec_id)",
)
def join_image_features(spark, sf):
    stored = table(spark, sf, "embeddings").select("vec_id", "embedding")
    joined = vectors.join_image_features(_owners(spark, sf), stored, "vec_id")
    return rounded(joined.select("listing_id", _weighed(F.col("embedding")).alias("weighed")), 5)


@check(
    "union_vectors",
    f"with {_FLAT} select vec_id, cast(position as bigint) as position, round(value,5) as value from flat",
    views=(),
)
def union_vectors(spark, sf):
    stored = table(spark, sf, "embeddings")
    both = vectors.union_vectors(stored.where("vec_id % 5 <> 0"), stored.where("vec_id % 5 = 0"))
    flat = exploded(both.select("vec_id", "embedding"), "embedding")
    return rounded(flat.withColumn("value", F.col("value").cast("double")), 5)


@check(
    "widen_vector",
    "select vec_id, " + ", ".join(f"round(cast(embedding[{i + 1}] as double),5) as image_feature_{i}" for i in range(64)) + " from embeddings",
    views=(),
)
def widen_vector(spark, sf):
    """Packed, widened, packed and widened again."""
    wide = vectors.widen(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 64)
    names = [c for c in wide.columns if c != "vec_id"]
    again = vectors.widen(vectors.pack(wide, names, "v"), "v", 64)
    return again.select("vec_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in names])


@check(
    "assemble_input",
    f"""with {_FLAT}, o as ({_OWNED}), w as (select vec_id, sum(value*(position+3)) as weighed from flat group by 1)
 select listing_id, cast(66 as bigint) as entries, round(size+2*nb_bathrooms+weighed,5) as weighed from o join w using (vec_id)""",
)
def assemble_input(spark, sf):
    """Tabular columns and a photo vector as one model input."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    stored = table(spark, sf, "embeddings").select("vec_id", vectors.array_to_vector(doubles).alias("image"))
    rows = vectors.assemble(_owners(spark, sf).join(stored, "vec_id"), ["size", "nb_bathrooms", "image"], {"image": 64})
    entries = vector_to_array("features")
    return rounded(rows.select("listing_id", F.size(entries).cast("bigint").alias("entries"), _weighed(entries).alias("weighed")), 5)


_SPLIT = "case when vec_id%5=0 then 'test' else 'train' end"


@check(
    "sink_features",
    f"""with {_FLAT} select {_SPLIT} as split, cast(position as bigint) as position, count(*) as n_rows, cast(64 as bigint) as n_features,
 round(avg(value),5) as mean from flat group by 1,2""",
    views=(),
)
def sink_features(spark, sf):
    stored = table(spark, sf, "embeddings").withColumn("split", F.expr(_SPLIT))
    path = fresh_path(spark, "features")
    wide = vectors.widen(stored.select("vec_id", "split", "embedding"), "embedding", 64)
    count = sinks.write_features(wide, path, key="vec_id")
    back = spark.read.parquet(path)
    packed = vectors.pack(back, [f"image_feature_{i}" for i in range(64)], "v")
    flat = exploded(packed.select("split", "v"), "v").withColumn("value", F.col("value").cast("double"))
    means = flat.groupBy("split", "position").agg(F.count("*").alias("n_rows"), F.avg("value").alias("mean"))
    return rounded(means.withColumn("n_features", F.lit(count).cast("bigint")), 5)


@check(
    "pca",
    f"""with {_FLAT}, centre as (select position, avg(value) as m from flat group by 1)
 select vec_id, cast(64 as bigint) as components, round(sum((value-m)*(value-m)),5) as squared from flat join centre using (position) group by 1""",
    views=(),
)
def pca(spark, sf):
    """All components of all vectors: together they keep each vector's distance to the mean, whatever their signs."""
    stored = table(spark, sf, "embeddings").select("vec_id", "embedding")
    projected = vectors.fit_components(stored, "embedding", 64).transform(stored, "embedding")
    squared = F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(projected.select("vec_id", F.size("pca").cast("bigint").alias("components"), squared.alias("squared")), 5)


# ---- network inputs ----------------------------------------------------------------------------------------------

_NET = (
    PREPARED
    + f", {_SCALES} from prepared where is_fit), scaled as (select listing_id, {_SCALED} from prepared, scales), coded as ("
    + "with x as (select 1)"
    + _codes("prepared", "count")
    + f""") select * exclude (price), round(case when price>0 then ln(price) end,9) as log_price from scaled join coded using (listing_id)
 join (select listing_id, price, case when is_test then 'test' when is_fit then 'train' else 'valid' end as split from base) using (listing_id)"""
)


@check("network_inputs", _NET)
def network_rows(spark, sf):
    return rounded(network_inputs(view(spark, sf, "listing")).rows)


@check(
    "photo_inputs",
    """with c as (select * from photo where split='train' or (split='test' and listing_id not in (select listing_id from photo where split='train'))),
 n as (select listing_id, brightness, row_number() over (partition by listing_id order by photo_no)-1 as position from c),
 k as (select distinct listing_id from c)
 select k.listing_id, cast(p as bigint) as position, round(coalesce(n.brightness,0.0),9) as value
 from k cross join (select unnest(range(6)) as p) left join n on n.listing_id=k.listing_id and n.position=p""",
    views=("photo",),
)
def photo_sequences(spark, sf):
    rows = photo_inputs(view(spark, sf, "photo"), "train", "photo_no", "brightness", F.lit(0.0))
    return rounded(exploded(rows.select("listing_id", "sequence"), "sequence"))
