"""Feature modes: named, ordered sequences of transforms in front of a learner.

``fit`` learns every step from training rows only. ``transform_train`` differs
from ``transform`` where a step must treat its own fit rows specially (target
encoding feeds the next step out-of-fold values); a plain ML pipeline has no such
hook. Columns that are not features pass through untouched.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.encoders import (
    CrossFitTargetEncoder,
    FeatureSmoothing,
    FittedBinner,
    FittedSmoothing,
    FittedStandardizer,
    FittedTargetEncoder,
    QuantileBinner,
)
from ..operators.features import FeatureEngineer, FittedEngineer, add_interactions, interaction_pairs
from ..operators.latent import (
    FittedBottleneck,
    FittedDenoiser,
    FittedEmbedding,
    HiddenLayerEmbedding,
    LinearBottleneck,
    LinearDenoiser,
)
from ..operators.repeats import COUNT, packed
from ..operators.splits import assign_folds
from ..operators.woe import FittedWOE, OptimalBinningWOE
from ..schema import LABEL, ROW_ID
from ..session import drop_stage, spread, stage_table
from ..sources.textfiles import read_text, write_text

# The selectable modes.
FEATURE_MODES = [
    "raw",
    "binned_woe",
    "quantile",
    "target",
    "autoencoder",
    "engineered",
    "engineered_noemail",
    "engineered_binned_woe",
    "engineered_quantile",
    "engineered_target",
    "engineered_autoencoder",
    "engineered_nnembed",
    "engineered_smooth",
    "engineered_denoise",
    "ix_raw",
    "ix_engineered",
]

_LAST_STEPS = {
    "binned_woe": "woe",
    "quantile": "bins",
    "target": "target",
    "autoencoder": "bottleneck",
    "nnembed": "embedding",
    "smooth": "smoothing",
    "denoise": "denoiser",
}


# Steps that are fitted on distinct rows with counts.
_COUNTED = {"embedding", "smoothing", "denoiser"}
# Steps that take distinct rows with counts for all rows.
_TAKE_COUNTS = {"engineer", "engineer_noemail", "interactions", *_COUNTED}


def mode_steps(mode: str) -> list[str]:
    """Step names of a mode: engineer, then interactions, then at most one encoder."""
    if mode not in FEATURE_MODES:
        raise ValueError(f"unknown feature mode: {mode!r}")
    interactions = mode.startswith("ix_")
    rest = mode.removeprefix("ix_")
    steps = []
    if rest.startswith("engineered"):
        steps.append("engineer_noemail" if rest == "engineered_noemail" else "engineer")
        rest = rest.removeprefix("engineered").removeprefix("_noemail").removeprefix("_")
    if interactions:
        steps.append("interactions")
    if rest in _LAST_STEPS:
        steps.append(_LAST_STEPS[rest])
    return steps


@dataclass
class Interactions:
    columns: list[str]
    max_features: int = 8

    def transform(self, df: DataFrame) -> DataFrame:
        return add_interactions(df, self.columns, True, self.max_features)

    def output_columns(self) -> list[str]:
        return self.columns + [n for n, _, _ in interaction_pairs(self.columns, self.max_features)]


@dataclass
class FeatureRecipe:
    """An unfitted feature mode; ``embedding`` overrides settings of the net."""

    mode: str = "raw"
    embedding: dict = field(default_factory=dict)
    label: str = LABEL
    row_id: str = ROW_ID
    seed: int = 42
    #: How many of the first columns are crossed by the modes with interactions.
    interaction_width: int = 8

    def learns_nothing(self) -> bool:
        """Whether the features of a row depend on that row alone."""
        return set(mode_steps(self.mode)) <= {"interactions"}

    def takes_counts(self) -> bool:
        """Whether distinct rows with a ``COUNT`` may stand for all rows in ``fit_transform``."""
        return set(mode_steps(self.mode)) <= _TAKE_COUNTS

    def fit(self, train: DataFrame, columns: list[str]) -> "FittedRecipe":
        return self.fit_transform(train, columns)[0]

    def fit_transform(
        self, train: DataFrame, columns: list[str]
    ) -> tuple["FittedRecipe", DataFrame]:
        """The fitted recipe and the training rows as the learner should see them."""
        steps, rows, current = [], train, list(columns)
        for name in mode_steps(self.mode):
            if name == "target" and "fold" not in rows.columns:
                rows = assign_folds(rows, 5, self.label, self.row_id, self.seed)
            if name in _COUNTED and len(steps) == len(mode_steps(self.mode)) - 1:
                # Equal rows stay equal through the steps before, so these see the distinct ones.
                seen = [self.label, *columns] if name == "embedding" else columns
                count = [COUNT] if COUNT in train.columns else []
                distinct = stage_table(packed(train.select(*seen, *count)), "distinct")
                counted = distinct
                for _, before in steps:
                    counted = before.transform(counted)
                step = self._fit_step(name, stage_table(spread(counted), "counted"), current)
                drop_stage(distinct)
            else:
                step = self._fit_step(name, rows, current)
            rows = step.transform_train(rows) if name == "target" else step.transform(rows)
            current = _columns_after(step, current)
            steps.append((name, step))
        return FittedRecipe(self.mode, list(columns), current, steps), rows

    def _fit_step(self, name: str, rows: DataFrame, columns: list[str]):
        if name == "engineer":
            return FeatureEngineer().fit(rows)
        if name == "engineer_noemail":
            return FeatureEngineer(add_logz_email=False).fit(rows)
        if name == "interactions":
            return Interactions(columns, self.interaction_width)
        if name == "woe":
            return OptimalBinningWOE(label=self.label).fit(rows, columns)
        if name == "bins":
            return QuantileBinner().fit(rows, columns)
        if name == "target":
            return CrossFitTargetEncoder(label=self.label).fit(rows, columns)
        if name == "bottleneck":
            return LinearBottleneck().fit(rows, columns)
        if name == "denoiser":
            return LinearDenoiser().fit(rows, columns)
        if name == "embedding":
            return HiddenLayerEmbedding(label=self.label, **self.embedding).fit(rows, columns)
        if name == "smoothing":
            return FeatureSmoothing().fit(rows, columns)
        raise ValueError(name)


def _columns_after(step, before: list[str]) -> list[str]:
    if isinstance(step, FittedEngineer):
        return step.output_columns(before)
    if isinstance(step, FittedSmoothing):
        return before
    return step.output_columns()


@dataclass
class FittedRecipe:
    mode: str
    inputs: list[str]
    columns: list[str]
    steps: list[tuple[str, object]]

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def woe_step(self) -> FittedWOE | None:
        return next((s for n, s in self.steps if n == "woe"), None)

    def save(self, spark: SparkSession, path: str) -> None:
        steps = []
        for i, (name, step) in enumerate(self.steps):
            state = dict(vars(step))
            if isinstance(step, FittedTargetEncoder):
                # The map that scoring applies belongs to the model, so that no batch builds it again.
                state.pop("maps")
                state.pop("stats").write.parquet(f"{path}/step-{i}-stats")
                table, state["map_sizes"] = step.applied("full", step.full_map)
                table.write.partitionBy("feature").parquet(f"{path}/step-{i}-map")
            if "scaler" in state:
                state["scaler"] = state["scaler"].moments
            steps.append({"name": name, "state": state})
        body = {"mode": self.mode, "inputs": self.inputs, "columns": self.columns, "steps": steps}
        write_text(spark, f"{path}/recipe.json", json.dumps(body))


_STEP_TYPES = {
    "engineer": FittedEngineer,
    "engineer_noemail": FittedEngineer,
    "interactions": Interactions,
    "woe": FittedWOE,
    "bins": FittedBinner,
    "target": FittedTargetEncoder,
    "bottleneck": FittedBottleneck,
    "denoiser": FittedDenoiser,
    "embedding": FittedEmbedding,
    "smoothing": FittedSmoothing,
}


def load_recipe(spark: SparkSession, path: str) -> FittedRecipe:
    body = json.loads(read_text(spark, f"{path}/recipe.json"))
    steps = []
    for i, entry in enumerate(body["steps"]):
        state = entry["state"]
        if "scaler" in state:
            moments = {c: tuple(m) for c, m in state["scaler"].items()}
            state["scaler"] = FittedStandardizer(moments)
        if entry["name"] == "target":
            state["stats"] = spark.read.parquet(f"{path}/step-{i}-stats")
            typed = "value string, n long, te double, feature string"
            table = spark.read.schema(typed).parquet(f"{path}/step-{i}-map")
            state["maps"] = {"full": (table, state.pop("map_sizes"))}
        steps.append((entry["name"], _STEP_TYPES[entry["name"]](**state)))
    return FittedRecipe(body["mode"], body["inputs"], body["columns"], steps)
