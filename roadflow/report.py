"""What an operator leaves out or finds odd, counted while the data goes by: no scan of its own, and warnings once an action has run."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Report:
    """Counts by name, observed on a DataFrame, and a warning for each that isn't zero.

    ``counts`` and ``warn`` wait for the first action on what was derived from the watched DataFrame, so call them after one.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[Observation, dict[str, str]]] = []
        self._known: dict[str, int] = {}

    def watch(self, df: DataFrame, **what: tuple[Column, str]) -> DataFrame:
        """df, observed. what: for each name a condition whose rows are counted, and the warning's text."""
        if not what:
            return df
        observation = Observation()
        self._watched.append((observation, {name: text for name, (_, text) in what.items()}))
        return df.observe(observation, *(F.count_if(condition).alias(name) for name, (condition, _) in what.items()))

    @property
    def counts(self) -> dict[str, int]:
        for observation, texts in self._watched:
            if not texts.keys() <= self._known.keys():
                self._known |= {k: int(v) for k, v in observation.get.items()}
        return dict(self._known)

    def warn(self) -> dict[str, int]:
        counts = self.counts
        for _, texts in self._watched:
            for name, text in texts.items():
                if counts.get(name):
                    warnings.warn(f"{counts[name]} {text}", stacklevel=2)
        return counts
