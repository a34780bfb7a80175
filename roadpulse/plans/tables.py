"""The tables one query run works with, each built once from the given data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions import labels
from roadpulse.operators import evaluate, features, links, panel, runs, trajectories
from roadpulse.plans import bindings as b
from roadpulse.session import stage

GRID, MINUTES = b.GRID, b.MINUTES
FINE = 5
MIN_LENGTH = 500.0
CPT = features.lag_columns(3, 1, 1)
#: External columns of the tree queries.
TREE_EXTERNALS = ["is_weekday", "holiday", "rain_small"]


class Tables:
    """Lazy tables over ``sf_dir``. The cell panel and what is read often from it are stored."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return b.table(self.spark, self.sf_dir, name)

    @cached_property
    def edge(self) -> DataFrame:
        return b.road_edge(self.spark, self.sf_dir)

    @cached_property
    def vertex(self) -> DataFrame:
        return b.road_vertex(self.spark, self.sf_dir)

    @cached_property
    def edge_geo(self) -> DataFrame:
        return b.edge_geo(self.spark, self.sf_dir)

    @cached_property
    def subnet(self) -> DataFrame:
        return b.subnet(self.spark, self.sf_dir)

    @cached_property
    def traversal(self) -> DataFrame:
        return b.traversal(self.spark, self.sf_dir)

    @cached_property
    def trajectory(self) -> DataFrame:
        return b.trajectory(self.spark, self.sf_dir)

    @cached_property
    def trajectory_2016(self) -> DataFrame:
        return b.trajectory_2016(self.spark, self.sf_dir)

    @cached_property
    def traversal_2016(self) -> DataFrame:
        return trajectories.traversals_2016(self.trajectory_2016)

    @cached_property
    def weather(self) -> DataFrame:
        return b.weather(self.spark, self.sf_dir)

    @cached_property
    def holiday(self) -> DataFrame:
        return b.holiday(self.spark, self.sf_dir)

    def link_stat(self, minutes: int = FINE) -> DataFrame:
        return links.link_travel_time(self.traversal, self.edge, minutes, MIN_LENGTH)

    @cached_property
    def cell_link(self) -> DataFrame:
        return links.cell_link_travel_time(self.link_stat(), self.edge, self.vertex, GRID)

    @cached_property
    def link_speed(self) -> DataFrame:
        return links.link_speed(self.traversal_2016, self.subnet, FINE)

    @cached_property
    def runs(self) -> DataFrame:
        return runs.cell_runs(self.traversal, self.edge, self.vertex, GRID, MINUTES)

    @cached_property
    def runs_2016(self) -> DataFrame:
        return runs.cell_runs_2016(self.traversal_2016, self.edge_geo, GRID, MINUTES)

    @cached_property
    def fresh_panel(self) -> DataFrame:
        return runs.cell_speed(self.runs)

    @cached_property
    def panel(self) -> DataFrame:
        return stage(self.fresh_panel, "panel")

    @cached_property
    def times(self) -> DataFrame:
        return panel.panel_times(self.panel)

    @cached_property
    def silent(self) -> DataFrame:
        """Cells with too few speeds among all windows, the missing ones of usual days included."""
        times = panel.fill_windows(self.panel, MINUTES, panel.incomplete_days(self.panel, MINUTES))
        return stage(panel.no_signal_cells(self.panel, GRID, times=times), "silent")

    @cached_property
    def dense(self) -> DataFrame:
        return panel.densify(self.panel, GRID)

    @cached_property
    def complete(self) -> DataFrame:
        """Every window from first to last, filled with label 4."""
        return panel.complete_panel(self.panel, GRID, MINUTES, self.silent)

    @cached_property
    def whole_days(self) -> DataFrame:
        """The completed panel's whole days."""
        return panel.keep_days(self.complete, panel.complete_days(panel.complete_times(self.panel, MINUTES), MINUTES))

    @cached_property
    def clean(self) -> DataFrame:
        """The cleaned panel: usual days, their missing windows and gaps interpolated."""
        return stage(panel.preprocess_panel(self.panel, GRID, MINUTES), "clean")

    @cached_property
    def values(self) -> DataFrame:
        """(w, x, y, value): speeds of the cleaned panel's whole days."""
        whole = panel.complete_days(panel.panel_times(self.clean), MINUTES)
        return stage(panel.keep_days(self.clean, whole).select("w", "x", "y", F.col("speed").alias("value")), "values")

    @cached_property
    def features(self) -> DataFrame:
        return stage(features.cpt_features(self.values, MINUTES), "features")

    @cached_property
    def labelled(self) -> DataFrame:
        """Features over congestion labels, for the class trees.

        Speeds become labels first; then missing windows are filled with the label "clear".
        """
        label = labels.congestion_label(F.col("speed")).cast("double")
        own = self.panel.withColumn("speed", label)
        whole = panel.complete_days(panel.complete_times(self.panel, MINUTES), MINUTES)
        days = panel.keep_days(panel.complete_panel(own, GRID, MINUTES, self.silent), whole)
        days = stage(days.select("w", "x", "y", F.col("speed").alias("value")), "labels")
        return stage(features.cpt_features(days, MINUTES), "features")

    def with_externals(self, rows: DataFrame) -> DataFrame:
        """Samples of the cells with signal, with calendar, holiday and weather columns."""
        external = features.external_features(panel.panel_times(rows), self.holiday, self.weather)
        return features.cell_samples(rows, external, self.silent)

    @cached_property
    def tree_samples(self) -> DataFrame:
        """Label samples of the cells with signal, with their external columns."""
        return stage(self.with_externals(self.labelled), "samples")

    def scored(self, predict: str, rows: DataFrame) -> DataFrame:
        """Predictions of the column ``predict``, rounded to whole numbers."""
        return rows.select(
            "w",
            F.lit(0).alias("flow"),
            "x",
            "y",
            labels.round_half_even(predict).cast("double").alias("predict"),
            labels.round_half_even("value").cast("double").alias("real"),
        )

    @cached_property
    def pred(self) -> DataFrame:
        """Mean of the lags as a prediction."""
        return self.scored("predict", evaluate.mean_predictor(self.features, CPT))

    @cached_property
    def pred_latest(self) -> DataFrame:
        """The latest lag as a prediction."""
        return self.scored("c1", self.features)

    @cached_property
    def change(self) -> DataFrame:
        return evaluate.frame_change(self.panel)
