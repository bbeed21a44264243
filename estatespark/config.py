"""Run settings, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from estatespark.schema import enrichment_columns


@dataclass(frozen=True)
class RunConfig:
    # Defaults of the tree run.
    size_cutoff: float = 1000.0
    valid_size: float = 0.2
    n_folds: int = 3
    dont_use_size: bool = False
    columns_to_add: tuple[str, ...] = field(default_factory=lambda: tuple(enrichment_columns()))
    use_image_features: bool = False
    n_pca_features: int | None = None
    clip_rooms: tuple[float | None, float | None] | None = None
    quantile_transform: str | None = None
    n_quantiles: int = 100
    # Where pseudo labels are, or a flag beside `pseudo_labels_path`.
    pseudo_labels: str | bool | None = None
    pseudo_labels_path: str | None = None
    uncertainty_level: float = 0.5
    size_backfill: bool = True
    seed: int = 0
    # tree model
    iterations: int = 2
    learning_rate: float = 0.01
    max_depth: int = 6
    one_hot_max_size: int = 8
    random_seed: int = 0
    early_stopping: bool = True
    early_stopping_rounds: int | None = None
    border_count: int = 64
    subsample: float = 1.0
    # What errors of the log price count ("absolute", or "percentage" of it), and what a leaf holds ("mean" of the gradients, or
    # "median" of the residuals).
    loss: str = "absolute"
    leaf_values: str = "mean"
    # The model's columns, where not all of them are wanted.
    features: tuple[str, ...] | None = None
    # network inputs
    embed_scale: float = -1.0
    embed_dims: dict[str, int] = field(default_factory=dict)
    target_size: int = 128
    im_size: tuple[int, int] = (128, 128)
    norm_image: bool = True
    debug: bool = False

    def __post_init__(self):
        if self.quantile_transform not in (None, "uniform", "normal"):
            raise ValueError(f"quantile_transform must be 'uniform', 'normal' or null, not {self.quantile_transform!r}")
        if self.loss not in ("absolute", "percentage") or self.leaf_values not in ("mean", "median"):
            raise ValueError("loss is 'absolute' or 'percentage', leaf_values 'mean' or 'median'")
        if not 0.0 < self.valid_size < 1.0:
            raise ValueError("valid_size must lie between 0 and 1")
        if self.n_folds < 2:
            raise ValueError("each model leaves one fold out, so n_folds is 2 at least")
        if self.pseudo_labels is True and not self.pseudo_labels_path:
            raise ValueError("pseudo_labels: true needs pseudo_labels_path")

    @property
    def pseudo_label_source(self) -> str | None:
        return self.pseudo_labels_path if self.pseudo_labels is True else (self.pseudo_labels or None)


# Names of loss functions in run files. Leaves of these fits hold medians.
LOSSES = {"MAE": "absolute", "MAPE": "percentage"}


def config_from_mapping(values: dict) -> RunConfig:
    """Nested `model_params` are merged into the top level; settings of parts that are not built are left out."""
    flat = {k: v for k, v in values.items() if k != "model_params"}
    flat.update(values.get("model_params") or {})
    known = {f.name for f in fields(RunConfig)}
    chosen = {k: v for k, v in flat.items() if k in known and v is not None}
    if "columns_to_add" in flat and flat["columns_to_add"] is None:
        chosen["columns_to_add"] = ()
    for name in ("columns_to_add", "im_size", "clip_rooms", "features"):
        if isinstance(chosen.get(name), list):
            chosen[name] = tuple(chosen[name])
    if "clip_rooms" in chosen and not isinstance(chosen["clip_rooms"], tuple):
        chosen["clip_rooms"] = (chosen["clip_rooms"], None)
    named = flat.get("loss_function")
    if named is not None:
        if named not in LOSSES:
            raise ValueError(f"loss_function is one of {sorted(LOSSES)}, not {named!r}")
        chosen = {"loss": LOSSES[named], "leaf_values": "median"} | chosen
    suffix = "_embed_dim"
    if "embed_dims" in chosen:
        chosen["embed_dims"] = {k.removesuffix(suffix): v for k, v in chosen["embed_dims"].items()}
    return RunConfig(**chosen)


def load_config(path: str) -> RunConfig:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: tuple(loader.construct_sequence(node)))
    with open(path) as handle:
        return config_from_mapping(yaml.load(handle, Loader=Loader))
