"""Checks of photo operators, on photos that Spark draws from the rows of `part` and paths made from `events`."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import pixels
from estatespark.plans import image_features, network_inputs
from estatespark.session import fresh_path
from estatespark.sources import photos, sinks
from estatespark.verification.registry import check, exploded, rounded
from estatespark.verification.views import table, view

# Tasks receive these functions by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = 8
# Height, width and pixel of the drawn photos; the same rule as DRAWN.
DRAWN = """drawn as (select p_partkey as photo_no, p_partkey%500 as listing_id, case when p_partkey%5=0 then 'test' else 'train' end as split,
 cast(8+p_size%23 as bigint) as width, cast(8+p_partkey%17 as bigint) as height from part)"""
# Colour c is red, green, blue for 0, 1, 2.
PIXEL = "((photo_no*7+{x}*3+{y}*5+(2-c)*11)%256)"


# Photos that one task draws.
DRAWN_AT_ONCE = 20_000


def drawn_photos(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    # A small file is one task's, but the photos drawn from it are much work. They are drawn where `data` is wanted.
    rows = parts.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(parts.count() / DRAWN_AT_ONCE))).select(
        F.col("p_partkey").alias("photo_no"),
        (F.col("p_partkey") % 500).alias("listing_id"),
        F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"),
        (8 + F.col("p_partkey") % 17).cast("int").alias("height"),
        (8 + F.col("p_size") % 23).cast("int").alias("width"),
        F.lit(3).alias("n_channels"),
    )

    def draw(number: pa.Array, height: pa.Array, width: pa.Array) -> pa.Array:
        y, x, c = np.ogrid[: pc.max(height).as_py() or 0, : pc.max(width).as_py() or 0, :3]
        # Bytes overflow as the rest modulo 256 does.
        shades, drawn = (x * 3 + y * 5 + c * 11).astype(np.uint8), []
        for n, h, w in zip(number.to_pylist(), height.to_pylist(), width.to_pylist()):
            drawn.append((shades[:h, :w] + np.uint8(n * 7 % 256)).tobytes())
        return pa.array(drawn, pa.binary())

    return rows.withColumn("data", F.arrow_udf(draw, "binary")("photo_no", "height", "width"))


_PATHS = """paths as (select photo_no, '/photos/'||split||case when photo_no%17=0 then '/' else '/ann_'||cast(listing_id as varchar)||'/' end
 ||cast(photo_no as varchar)||case when photo_no%10=0 then '.png' else '.jpg' end as path from photo)"""


@check(
    "src_photos",
    f"""with {_PATHS} select cast(regexp_extract(path,'ann_([0-9]+)/',1) as bigint) as listing_id, split_part(path,'/',3) as split,
 split_part(path,'/',5) as name from paths where path like '%/ann_%' and path like '%.jpg'""",
    views=("photo",),
)
def src_photos(spark, sf):
    """Listing, split and name from photo paths; other endings and files outside a listing's folder are dropped."""
    rows = view(spark, sf, "photo")
    folder = F.when(F.col("photo_no") % 17 == 0, "/").otherwise(F.concat(F.lit("/ann_"), F.col("listing_id").cast("string"), F.lit("/")))
    ending = F.when(F.col("photo_no") % 10 == 0, ".png").otherwise(".jpg")
    path = F.concat(F.lit("/photos/"), "split", folder, F.col("photo_no").cast("string"), ending)
    return photos.parse_photo_paths(rows.select(path.alias("path"))).select("listing_id", "split", "name")


@check("photo_dims_projection", f"with {DRAWN} select photo_no, width, height, cast(3 as bigint) as n_channels from drawn", views=())
def photo_dims_projection(spark, sf):
    """Width, height and channels of decoded photos. Decoding itself is tested on files."""
    dims = photos.photo_dims(drawn_photos(spark, sf)).select("photo_no", "width", "height", "n_channels")
    return dims.select(*[F.col(c).cast("bigint").alias(c) for c in dims.columns])


_GEOMETRY = """case when cast(width as double)/height>1 then cast(floor({t}*(cast(width as double)/height)) as bigint) else {t} end as new_width,
 case when cast(width as double)/height>1 then {t} else cast(floor({t}/(cast(width as double)/height)) as bigint) end as new_height"""
_MARGINS = """cast(floor(({t}-new_width)/2.0) as bigint) as pad_left, cast(floor(({t}-new_height)/2.0) as bigint) as pad_top"""


@check(
    "resize_geometry",
    f"""with g as (select photo_no, {_GEOMETRY.format(t=128)} from photo_dims), m as (select *, {_MARGINS.format(t=128)} from g)
 select photo_no, cast(new_width as bigint) as new_width, cast(new_height as bigint) as new_height, pad_left, pad_top,
 cast(128-new_width-pad_left as bigint) as pad_right, cast(128-new_height-pad_top as bigint) as pad_bottom from m""",
    views=("photo_dims",),
)
def resize_geometry(spark, sf):
    return pixels.with_geometry(view(spark, sf, "photo_dims"), 128).drop("width", "height")


_RESIZED = f"""with {DRAWN}, g as (select *, {_GEOMETRY.format(t=TARGET)} from drawn), m as (select *, {_MARGINS.format(t=TARGET)} from g),
 spots as (select photo_no, listing_id, split, height, width, c, y, x,
  least(greatest((y-pad_top+0.5e0)*(cast(height as double)/new_height)-0.5e0,0),height-1) as sy,
  least(greatest((x-pad_left+0.5e0)*(cast(width as double)/new_width)-0.5e0,0),width-1) as sx
  from m, (select unnest(range({TARGET})) as y), (select unnest(range({TARGET})) as x), (select unnest(range(3)) as c)),
 near as (select *, cast(floor(sy) as bigint) as y0, cast(floor(sx) as bigint) as x0 from spots),
 edge as (select *, least(y0+1,height-1) as y1, least(x0+1,width-1) as x1, sy-y0 as ay, sx-x0 as ax from near),
 resized as (select photo_no, listing_id, split, c, (y*{TARGET}+x)*3+c as position,
  floor(({PIXEL.format(x='x0', y='y0')}*(1-ax)+{PIXEL.format(x='x1', y='y0')}*ax)*(1-ay)
   +({PIXEL.format(x='x0', y='y1')}*(1-ax)+{PIXEL.format(x='x1', y='y1')}*ax)*ay+0.5e0) as value from edge)"""


@check(
    "resize_pixels",
    _RESIZED + " select photo_no, cast(position as bigint) as position, cast(value as bigint) as value from resized",
    views=(),
)
def resize_pixels(spark, sf):
    rows = pixels.resize_photos(drawn_photos(spark, sf).drop("listing_id", "split"), TARGET).drop("height", "width")
    return exploded(rows, "pixels").withColumn("value", F.col("value").cast("bigint"))


@check(
    "photo_pixel_inputs",
    _RESIZED
    + """, c as (select * from drawn where split='train' or (split='test' and listing_id not in (select listing_id from drawn where split='train'))),
 n as (select photo_no, listing_id, row_number() over (partition by listing_id order by photo_no)-1 as place from c),
 w as (select photo_no, sum((position+1)*value) as weighed from resized group by 1)
 select k.listing_id, cast(p as bigint) as place, cast(coalesce(w.weighed,0) as bigint) as weighed, cast(case when n.photo_no is null then 0 else 1 end as bigint) as mask
 from (select distinct listing_id from c) k cross join (select unnest(range(6)) as p) left join n on n.listing_id=k.listing_id and n.place=p
 left join w on w.photo_no=n.photo_no""",
    views=(),
)
def photo_pixel_inputs(spark, sf):
    """The first six photos of each listing, resized and padded; all pixels of a photo go into one number."""
    config = RunConfig(target_size=TARGET, norm_image=False)
    rows = network_inputs.photo_pixel_inputs(drawn_photos(spark, sf), "train", config, "photo_no")
    both = rows.select("listing_id", F.posexplode(F.arrays_zip("sequence", "mask")).alias("place", "entry"))
    placed = F.transform("entry.sequence", lambda v, i: v.cast("bigint") * (i + 1))
    return both.select(
        "listing_id",
        F.col("place").cast("bigint").alias("place"),
        F.aggregate(placed, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("weighed"),
        F.col("entry.mask").cast("bigint").alias("mask"),
    )


_MEAN = "case c when 0 then 0.485e0 when 1 then 0.456e0 else 0.406e0 end"
_STD = "case c when 0 then 0.229e0 when 1 then 0.224e0 else 0.225e0 end"


@check(
    "pixel_normalize",
    _RESIZED + f" select photo_no, cast(position as bigint) as position, round(cast(cast((value/255.0e0-{_MEAN})/{_STD} as float) as double),5) as value from resized",
    views=(),
)
def pixel_normalize(spark, sf):
    images = drawn_photos(spark, sf).drop("listing_id", "split")
    flat = exploded(pixels.resize_photos(images, TARGET, norm_image=True).drop("height", "width"), "pixels")
    return rounded(flat.withColumn("value", F.col("value").cast("double")), 5)


@check(
    "sink_resized_photos",
    _RESIZED + " select split, listing_id, photo_no, cast(count(*) as bigint) as entries, cast(sum(value) as bigint) as total from resized group by 1,2,3",
    views=(),
)
def sink_resized_photos(spark, sf):
    path = fresh_path(spark, "resized")
    sinks.write_resized_photos(pixels.resize_photos(drawn_photos(spark, sf), TARGET), path)
    back = spark.read.parquet(path)
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select(
        "split", "listing_id", "photo_no", F.size("pixels").cast("bigint").alias("entries"), total.alias("total")
    )


@check(
    "image_embed",
    f"""with {DRAWN}, dots as (select photo_no, listing_id, split, c, {PIXEL.format(x='x', y='y')} as v
  from drawn, (select unnest(range(30)) as x), (select unnest(range(24)) as y), (select unnest(range(3)) as c) where x<width and y<height),
 k as (select photo_no, listing_id, split, c as position, avg(v/255.0e0) as value from dots group by 1,2,3,4
  union all select photo_no, listing_id, split, 3+c, stddev_pop(v/255.0e0) from dots group by 1,2,3,4
  union all select photo_no, listing_id, split, 6+c*8+b, avg(case when least(v//32,7)=b then 1.0e0 else 0.0e0 end)
   from dots, (select unnest(range(8)) as b) group by 1,2,3,4)
 select split, listing_id, cast(position as bigint) as position, round(avg(value),9) as value from k group by 1,2,3""",
    views=(),
)
def image_embed(spark, sf):
    """Default photo vector, averaged per listing."""
    return rounded(exploded(image_features.listing_vectors(drawn_photos(spark, sf)), "vector"))
