"""Run parameters: defaults and validation are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the method.
CLUSTER_KMER = 11  # length of the k-mers that group repeat variants
SCAN_RANGE = 24  # reach around an expected repeat, in bases
LOW_COMPLEXITY = 0.75  # share of one base from which a repeat is of low complexity
MAX_SIMILARITY = 0.82  # of spacers to each other and to the repeat
MAX_SPACER_LENGTH_DIFFERENCE = 12
MAX_REPEAT_SPACER_LENGTH_DIFFERENCE = 30
MAX_TRIMER_SHARE = 0.23
MIN_COLUMN_DEPTH = 2  # a column with more reads than this has a conservation
ZONE_CONSERVATION = 0.55
COLLAPSE_CONSERVATION = 0.75
COLLAPSE_SHARE = 0.30
PARTIAL_SIMILARITY = 0.85
PARTIAL_LENGTH = 4
MAX_SPACER_DEVIATION = 6.0
FLANKER_DEVIATIONS = 1.5


@dataclass(frozen=True)
class Params:
    min_repeat: int = 23
    max_repeat: int = 47
    min_spacer: int = 26
    max_spacer: int = 50
    window: int = 8
    min_repeats: int = 2
    shared_kmers: int = 6
    node_kmer: int = 7
    min_coverage: int = 3
    coverage_bins: int = -1
    colours: str = "BLUE_RED"

    def checked(self) -> Params:
        """Values out of range fall back to the defaults where that is the rule, and raise where it isn't."""
        d = Params()
        p = replace(
            self,
            min_repeat=d.min_repeat if self.min_repeat < 8 else self.min_repeat,
            min_spacer=d.min_spacer if self.min_spacer < 8 else self.min_spacer,
            window=self.window if 6 <= self.window <= 9 else d.window,
            shared_kmers=d.shared_kmers if self.shared_kmers < 4 else self.shared_kmers,
        )
        if p.max_repeat <= p.min_repeat:
            raise ValueError("max_repeat must exceed min_repeat")
        if p.max_spacer <= p.min_spacer:
            raise ValueError("max_spacer must exceed min_spacer")
        if p.min_repeats < 2:
            raise ValueError("min_repeats must be 2 at least")
        if p.coverage_bins != -1 and p.coverage_bins < 1:
            raise ValueError("coverage_bins must be 1 at least")
        return p

    @property
    def stride(self) -> int:
        """Distance of seeds: any repeat of the minimal length still holds a whole seed."""
        return max(1, self.min_repeat - (2 * self.window - 1))

    @property
    def shortest_read(self) -> int:
        return self.min_repeat + self.min_spacer + self.window + 1
