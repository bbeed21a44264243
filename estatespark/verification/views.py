"""Listing-shaped views of the given tables. The same text runs in Spark and in the checking database; the latter stops at
listing numbers of more than 64 bits."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from estatespark.sources.tables import read_table

LISTING = """
select (((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey)*100+cast(l_quantity as bigint) as listing_id,
 case substr(o_orderpriority,1,1) when '1' then 'appartement' when '2' then 'maison' when '3' then 'terrain' when '4' then 'parking' else 'divers' end as property_type,
 n_name as city,
 1000+(l_partkey*37)%96000 as postal_code,
 case when p_size%5=0 then null else substr('ABCDEFG',1+p_size%7,1) end as energy_performance_category,
 case when p_size%6=0 then null else substr('ABCDEFG',1+p_size%6,1) end as ghg_category,
 case o_orderstatus when 'F' then 'Sud' when 'O' then 'Nord' end as exposition,
 cast(case when l_returnflag='R' then 1 else 0 end as double) as has_a_balcony,
 cast(case when l_linestatus='F' then 1 else 0 end as double) as has_a_cellar,
 cast(l_linenumber%2 as double) as has_a_garage,
 cast(case when l_tax>=0.05 then 1 else 0 end as double) as has_air_conditioning,
 cast(case when l_linenumber=7 then 1 when l_linenumber=1 then null else 0 end as double) as last_floor,
 cast(case when l_linenumber>=3 then 1 when l_linenumber=1 then null else 0 end as double) as upper_floors,
 42+cast(l_suppkey%90 as double)/10 as approximate_latitude,
 -4+cast(l_partkey%120 as double)/10 as approximate_longitude,
 case when l_linenumber=6 then null else l_quantity*25 end as size,
 cast(case when l_linestatus='O' then null else l_linenumber-1 end as double) as floor,
 case cast(round(l_tax*100) as int) when 0 then null when 1 then cast(0 as double) else round(l_tax*100)*100 end as land_size,
 cast(case when p_size%5=0 then null else p_size*10 end as double) as energy_performance_value,
 cast(case when p_size%6=0 then null else p_size*2 end as double) as ghg_value,
 cast(case when l_linenumber in (2,5) then null else l_linenumber end as double) as nb_rooms,
 cast(case when l_linenumber=5 then null else l_linenumber-1 end as double) as nb_bedrooms,
 cast(1+l_linenumber%2 as double) as nb_bathrooms,
 cast(l_partkey%3 as double) as nb_parking_places,
 cast(l_suppkey%2 as double) as nb_boxes,
 cast(case when cast(l_quantity as int)%9=8 then null else cast(l_quantity as int)%9 end as double) as nb_photos,
 cast(l_suppkey%4 as double) as nb_terraces,
 case when l_shipdate>=timestamp '2000-07-01 00:00:00' then null else l_extendedprice end as price,
 l_shipdate>=timestamp '2000-07-01 00:00:00' as is_test
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey
 join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
"""

PREDICTION = """
select listing_id, postal_code, price, coalesce(size,100)*40+1000 as pred_a, coalesce(size,100)*44+500 as pred_b,
 coalesce(size,100)*38+2000 as pred_c, is_test from listing
"""

PHOTO = """
select user_id*20+(event_id*event_id)%20 as listing_id, event_id as photo_no, value as brightness,
 case when ts<timestamp '2024-01-16 00:00:00' then 'train' else 'test' end as split from events
"""

PHOTO_DIMS = """
select p_partkey as photo_no, 3+p_size*37 as width, 200+p_partkey%900 as height from part
"""

VIEWS = {"listing": LISTING, "prediction": PREDICTION, "photo": PHOTO, "photo_dims": PHOTO_DIMS}
NEEDS = {
    "listing": ("lineitem", "orders", "part", "supplier", "nation"),
    "prediction": ("listing",),
    "photo": ("events",),
    "photo_dims": ("part",),
}

_NUMBER = "(((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey)*100+cast(l_quantity as bigint)"
_WHOLE = "(((cast(l_orderkey as decimal(20,0))*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey)*100+cast(l_quantity as bigint)"
_HIGH = "try_add(try_multiply(l_orderkey,10),l_linenumber)"
_LOW = "try_add(try_multiply(try_add(try_multiply(l_partkey,10000),l_suppkey),100),cast(l_quantity as bigint))"
# Orders beyond some nine million make numbers that no bigint holds; those go round modulo 2^64, as 64-bit arithmetic does. The number is
# _HIGH * 10^11 + _LOW, and 10^11 is 5^11 * 2^11: shifted by 11 bits it goes round by itself. Where even the unshifted part is too large,
# decimals take over.
_WRAPPED = f"""coalesce(
 shiftleft(try_add(try_multiply({_HIGH},48828125),shiftright({_LOW},11)),11) | ({_LOW} & 2047),
 cast(pmod({_WHOLE}+9223372036854775808, 18446744073709551616)-9223372036854775808 as bigint))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {
        need: view(spark, sf_dir, need) if need in VIEWS else table(spark, sf_dir, need) for need in NEEDS[name]
    }
    text = VIEWS[name].replace(_NUMBER, _WRAPPED)
    for need in sorted(sources, key=len, reverse=True):
        text = text.replace(f"from {need}", f"from {{{need}}}").replace(f"join {need} ", f"join {{{need}}} ")
    return spark.sql(text, **sources)


def with_views(sql: str, *names: str) -> str:
    """`sql` for the checking database, preceded by the views it reads."""
    if not names:
        return sql.strip()
    wanted: list[str] = []
    for name in names:
        for need in (*[n for n in NEEDS[name] if n in VIEWS], name):
            if need not in wanted:
                wanted.append(need)
    parts = [f"{name} as ({VIEWS[name]})" for name in wanted]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:]
    return "with " + ",\n".join(parts) + "\n" + body
