"""Views of tables whose keys go further than those of the given ones."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from estatespark.verification import views
from estatespark.verification.catalog import CHECKS


@pytest.fixture
def far_orders(spark, tmp_path):
    """Tables with orders on both sides of what a listing number of 64 bits takes, each with one line of three pieces."""
    orders = [*range(1, 200), *range(9_223_300, 9_223_450), *range(53_999_000, 53_999_200)]
    half = [n % 2 for n in range(len(orders))]
    day = spark.sql("select timestamp '2000-01-01 00:00:00' as a, timestamp '2000-08-01 00:00:00' as b").first()
    lines = {
        "l_orderkey": pa.array(orders, pa.int64()), "l_partkey": pa.array([7 + n for n in half], pa.int64()), "l_suppkey": pa.array([5] * len(orders), pa.int64()),
        "l_linenumber": pa.array([3] * len(orders), pa.int32()), "l_quantity": [2.0 + n for n in half], "l_extendedprice": [100.0 + 900 * n for n in half],
        "l_tax": [0.02] * len(orders), "l_returnflag": ["R"] * len(orders), "l_linestatus": ["F"] * len(orders),
        "l_shipdate": [day.a if o % 10 else day.b for o in orders],
    }
    tables = {
        "lineitem": lines,
        "orders": {"o_orderkey": pa.array(orders, pa.int64()), "o_orderstatus": ["F"] * len(orders), "o_orderpriority": [f"{1 + n}-X" for n in half]},
        "part": {"p_partkey": pa.array([7, 8], pa.int64()), "p_size": pa.array([1, 2], pa.int32())},
        "supplier": {"s_suppkey": pa.array([5], pa.int64()), "s_nationkey": pa.array([1], pa.int32())},
        "nation": {"n_nationkey": pa.array([1], pa.int32()), "n_name": ["N"]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), str(tmp_path / f"{name}.parquet"))
    return str(tmp_path), orders, half


def test_listing_numbers_beyond_64_bits_go_round(spark, far_orders):
    path, orders, half = far_orders
    numbers = [(((o * 10 + 3) * 100_000 + 7 + n) * 10_000 + 5) * 100 + 2 + n for o, n in zip(orders, half)]
    assert min(numbers) < 2**63 <= max(numbers)
    found = views.view(spark, path, "listing")
    assert found.schema["listing_id"].dataType.typeName() == "long"
    assert sorted(r["listing_id"] for r in found.collect()) == sorted((n + 2**63) % 2**64 - 2**63 for n in numbers)
    # Numbers that fit are those of the SQL.
    reader = duckdb.connect()
    for name in views.NEEDS["listing"]:
        reader.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    near = views.LISTING.strip() + " where l_orderkey < 9000000"
    wanted = [r[0] for r in reader.execute(f"select listing_id from ({near})").fetchall()]
    assert sorted(wanted) == sorted(r["listing_id"] for r in found.where(F.col("listing_id").between(0, 9 * 10**18)).collect() if r["listing_id"] in wanted)
    assert len(wanted) == 199


@pytest.mark.parametrize("name", ["gbt_fit_score", "price_m2_quantiles_large"])
def test_queries_take_orders_of_any_number(spark, far_orders, name):
    path, orders, _ = far_orders
    rows = CHECKS[name].run(spark, path).collect()
    assert len(rows) == (len(orders) if name == "gbt_fit_score" else 6)
    if name == "gbt_fit_score":
        assert {r["split"] for r in rows} == {"train", "valid", "test"} and all(r["prediction"] > 0 for r in rows)
