"""Settings of a dictionary and of lookups, checked."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from enum import StrEnum

#: Size of the corpus behind the usual published English frequency list: a fixed value, used for word probabilities.
CORPUS_WORDS = 1_024_908_267_229


class Verbosity(StrEnum):
    TOP = "top"  # the most frequent term at the smallest distance
    CLOSEST = "closest"  # all terms at the smallest distance
    ALL = "all"  # all terms within the distance


@dataclass(frozen=True)
class Config:
    """``thresholds``: lengths from which terms are matched at max_edit_distance, at one more, and so on."""

    max_edit_distance: int = 2
    thresholds: tuple[int, ...] | None = None
    prefix_length: int = 7
    count_threshold: int = 1
    corpus_word_count: int = CORPUS_WORDS

    def __post_init__(self) -> None:
        if self.max_edit_distance < 0 or self.count_threshold < 0 or self.corpus_word_count < 1:
            raise ValueError("distances and counts can't be negative")
        if self.thresholds is not None:
            object.__setattr__(self, "thresholds", tuple(self.thresholds))
            if not self.thresholds or list(self.thresholds) != sorted(self.thresholds):
                raise ValueError("thresholds must ascend and not be empty")
        if self.prefix_length <= self.depth:
            raise ValueError("the prefix must be longer than the greatest distance")

    @property
    def depth(self) -> int:
        """Greatest distance of any term."""
        return self.max_edit_distance + (len(self.thresholds) - 1 if self.thresholds else 0)

    def reach(self, k: int, thresholds: tuple[int, ...] | None) -> int:
        """Greatest distance of a lookup; an error if the index doesn't reach it."""
        if thresholds is not None and (not thresholds or list(thresholds) != sorted(thresholds)):
            raise ValueError("thresholds must ascend and not be empty")
        reach = k + (len(thresholds) - 1 if thresholds else 0)
        if k < 0 or reach > self.depth:
            raise ValueError(f"distance {reach} is beyond the dictionary's {self.depth}")
        return reach

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))
