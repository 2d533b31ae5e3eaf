"""The user's view of one experiment: tables in, DataFrames out; nothing runs until a result is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perievent.operators import joins, metrics, models, stats


@dataclass(frozen=True)
class Experiment:
    """traces: cell, trial, config, frame_ix, value; stimuli: config and its parameters; on: first stimulus frame;
    n_on: stimulus frames; degrees: direction step between configs, where they are directions."""

    traces: DataFrame
    stimuli: DataFrame | None = None
    on: int = 8
    n_on: int = 6
    degrees: float = 36.0

    def get_trial_metrics(self, post: int = 0) -> DataFrame:
        return metrics.trial_metrics(self.traces, self.on, self.n_on, post)

    def get_responses(self, metric: str = "stim_mean") -> DataFrame:
        """Stacked responses (datakey, cell, config, trial, response)."""
        return self.get_trial_metrics().select(F.lit("experiment").alias("datakey"), "cell", "config", "trial", F.col(metric).alias("response")).filter("response is not null")

    def get_stats(self) -> DataFrame:
        return metrics.by_config(self.get_responses())

    def get_psth(self) -> DataFrame:
        return metrics.psth(self.traces)

    def get_responsive_cells(self, threshold: float = 0.6) -> DataFrame:
        """Cells whose best config's stimulus means stand out of the baseline means by an AUC of at least threshold."""
        return stats.roc(self.get_trial_metrics(), ("cell",), "stim_mean", "base_mean", whole=True).filter(F.col("auc") >= threshold)

    def get_selective_cells(self) -> DataFrame:
        return stats.kruskal_wallis(self.get_responses(), ("cell",), "config", "response")

    def get_selectivity(self) -> DataFrame:
        return metrics.selectivity(self.get_stats(), self.degrees)

    def get_tuning(self, draws: int = 20, iterations: int = 100, seed: int = 0) -> DataFrame:
        return models.fit_orientation(models.bootstrap_means(self.get_responses(), draws, iterations, seed), self.degrees)

    def get_with_stimuli(self) -> DataFrame:
        """Responses with their stimulus's parameters."""
        if self.stimuli is None:
            raise ValueError("no stimuli")
        return self.get_responses().join(self.stimuli, "config")

    def select(self, cells: DataFrame) -> Experiment:
        """The experiment cut to the cells of a table."""
        return Experiment(joins.keep(self.traces, cells, ["cell"]), self.stimuli, self.on, self.n_on, self.degrees)
