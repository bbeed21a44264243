"""Fitted runs on disk: saved once, loaded later to score new listings, in another session or on another cluster.

A saved run is a folder. What grows with the data is tables: area densities, price statistics, the dictionaries of the target
statistics, and the nodes of the trees. Components are saved by the learner's own writers. Everything else, from the run's
settings to the knots of the quantile map, is one manifest, written last, so that a folder without one is no run.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import models
from estatespark.operators.area_stats import AreaStatistics
from estatespark.operators.boosting import BoostedTrees, Tree
from estatespark.operators.quantile_map import QuantileMap
from estatespark.operators.target_statistics import TargetStatistics
from estatespark.operators.vectors import Components
from estatespark.plans.training import Preparation, TreeRun
from estatespark.schema import IS_TEST, TARGET
from estatespark.session import BroadcastBudget, joinable, value_bytes

FORMAT = 1
NODES = "member int, tree int, node int, feature int, threshold double, `left` int, `right` int, value double"


@dataclass(frozen=True)
class SavedRun:
    preparation: Preparation
    model: models.FoldEnsemble

    def transform(self, listings: DataFrame, image_features: DataFrame | None = None, output: str = "prediction") -> DataFrame:
        """New listings with the predicted price, all other columns as they come. Prices and a split flag are not needed.

        Areas and categories that the fit has not seen have no statistics, as in the run itself. Listings are matched with their
        photo features by key.
        """
        keys = [c for c in listings.columns if c != output]
        # A new listing has no price that its features could use, and is in no split that the model was fitted on.
        new = {IS_TEST: F.lit(True), TARGET: F.lit(None).cast("double")}
        packed = listings.withColumn("as_given", F.struct(*keys)).withColumns(new)
        scored = self.model.transform(self.preparation.transform(packed, image_features, keep=("as_given",)), output)
        return scored.select(*[F.col("as_given").getField(c).alias(c) for c in keys], output)


def save_run(run: TreeRun, path: str) -> None:
    """Writes a run as `training.run_trees` returns it to a folder that does not exist yet."""
    if run.model is None or run.preparation is None:
        raise ValueError("only a run with its model and preparation can be saved")
    fitted, members = run.preparation, run.model.members
    encoder = members[0].encoder
    spark = run.scored.sparkSession
    statistics = fitted.statistics
    tables = {"postal": statistics.postal, "departments": statistics.departments}
    tables |= {f"prices/{level}": table for level, table in statistics.prices.items()}
    tables |= {f"dictionaries/{column}": table for column, table in encoder.statistics.tables.items()}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    nodes = [
        (m, t, n, *node)
        for m, member in enumerate(members)
        for t, tree in enumerate(member.trees.trees)
        for n, node in enumerate(zip(tree.feature, tree.threshold, tree.left, tree.right, tree.value))
    ]
    spark.createDataFrame(nodes, NODES).write.parquet(f"{path}/nodes")
    if fitted.components is not None:
        fitted.components.centre.write().save(f"{path}/components/centre")
        fitted.components.model.write().save(f"{path}/components/model")
    manifest = {
        "format": FORMAT,
        "config": asdict(fitted.config),
        "continuous": fitted.continuous,
        "categorical": fitted.categorical,
        "levels": list(statistics.prices),
        "quantile_map": asdict(fitted.quantile_map) if fitted.quantile_map else None,
        "n_images": fitted.n_images,
        "signs": list(fitted.components.signs) if fitted.components else None,
        "one_hot": encoder.one_hot,
        "encoded": encoder.continuous,
        "dictionaries": list(encoder.statistics.tables),
        "statistics": {name: getattr(encoder.statistics, name) for name in ("n", "total", "members", "prior_rows")},
        "members": [{"member": m.member, "scales": m.trees.scales, "importance": m.trees.importance} for m in members],
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_run(spark: SparkSession, path: str) -> SavedRun:
    """A saved run, ready to score. Its tables are read where they lie and broadcast by their measured size."""
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    if manifest["format"] != FORMAT:
        raise ValueError(f"a run of format {manifest['format']} can't be read, only {FORMAT}")
    areas, categories = BroadcastBudget(), BroadcastBudget()

    def table(name: str, budget: BroadcastBudget) -> DataFrame:
        return joinable(spark.read.parquet(f"{path}/{name}"), None, budget)

    statistics = AreaStatistics(
        table("postal", areas), table("departments", areas), {level: table(f"prices/{level}", areas) for level in manifest["levels"]}
    )
    components = None
    if manifest["signs"] is not None:
        centre, model = StandardScalerModel.load(f"{path}/components/centre"), PCAModel.load(f"{path}/components/model")
        components = Components(centre, model, manifest["signs"])
    quantile_map = QuantileMap(**manifest["quantile_map"]) if manifest["quantile_map"] else None
    preparation = Preparation(
        _config(manifest["config"]), statistics, quantile_map, manifest["n_images"], components,
        tuple(manifest["continuous"]), tuple(manifest["categorical"]),
    )
    own = manifest["statistics"]
    entries = len(own["n"]) + len(own["members"])
    dictionaries = {c: _dictionary(spark.read.parquet(f"{path}/dictionaries/{c}"), entries, categories) for c in manifest["dictionaries"]}
    encoder = models.Encoder(
        tuple((column, tuple(labels)) for column, labels in manifest["one_hot"]),
        TargetStatistics(dictionaries, own["n"], own["total"], tuple(map(tuple, own["members"])), own["prior_rows"]),
        tuple(manifest["encoded"]),
    )
    # A model of a few thousand trees, which the tasks hold anyway.
    nodes: dict[tuple[int, int], list] = {}
    for row in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("member", "tree", "node").toLocalIterator():
        nodes.setdefault((row["member"], row["tree"]), []).append(tuple(row)[3:])
    members = []
    for m, described in enumerate(manifest["members"]):
        trees = tuple(Tree(*map(tuple, zip(*nodes[m, t]))) for t in range(len(described["scales"])))
        ensemble = BoostedTrees(trees, tuple(described["scales"]), tuple(map(tuple, described["importance"])))
        members.append(models.PriceModel(encoder, ensemble, described["member"]))
    return SavedRun(preparation, models.FoldEnsemble(tuple(members)))


def _dictionary(table: DataFrame, entries: int, budget: BroadcastBudget) -> DataFrame:
    """A dictionary (value, n, total) with arrays of known length, by its size."""
    size = table.agg(F.sum(value_bytes(table.select("value")) + 16 * entries + 48)).first()[0] or 0
    return joinable(table, size, budget)


def _config(values: dict) -> RunConfig:
    lists = {k: tuple(v) for k, v in values.items() if isinstance(v, list)}
    return RunConfig(**{**values, **lists})
