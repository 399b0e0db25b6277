"""Parameters of the three stages, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

# The defaults that results depend on.
GAPS = (1, 5, 10, 20, 50)
GAP_DIVISORS = {1: 1.0, 5: 3.0, 10: 3.5, 20: 3.8, 50: 4.2}
FUSIONS = ("mean", "max", "median", "rms")


@dataclass(frozen=True)
class Params:
    sampling_fps: float = 5.0
    gaps: tuple[int, ...] = GAPS
    gap_divisors: dict[int, float] = field(default_factory=lambda: dict(GAP_DIVISORS))
    fusion: str = "rms"
    input_scale: float = 0.25
    min_magnitude: float = 0.6
    cell_stride: int = 4
    cell_window: int = 8
    mean_radius: int = 2
    persistence_window: int = 15
    persistence_min: float = 0.85
    unit_block: int = 4
    tensor_sigma: float = 1.5
    tensor_strength: float = 400.0
    tensor_eps: float = 1e-6
    edge_strength: float = 950.0
    align_power: float = 2.0
    aperture_alpha: float = 1.0
    tau_high: float = 0.7
    tau_low: float = 0.4
    max_gap: int = 0
    min_event: int = 3
    neighbour_radius: int = 2
    min_tube_cells: int = 2
    min_tube_duration: int = 3
    merge_distance: int = 2
    merge_gap: int = 20
    suppress_contained: bool = True
    heat_min: float = 0.8
    heat_max: float = 3.5

    def __post_init__(self) -> None:
        rules = {
            "sampling_fps must be positive": self.sampling_fps > 0,
            f"fusion must be one of {', '.join(FUSIONS)}": self.fusion in FUSIONS,
            "gap 1 must be among the gaps": 1 in self.gaps,
            "gaps must be 1 or more and differ": all(g >= 1 for g in self.gaps) and len({*self.gaps}) == len(self.gaps),
            "gap divisors must be positive": all(x > 0 for x in self.gap_divisors.values()),
            "the window must not be smaller than the stride": self.cell_window >= self.cell_stride >= 1,
            "tau_low must not exceed tau_high": self.tau_low <= self.tau_high,
            "max_gap must not be negative": self.max_gap >= 0,
            "radii must be 1 or more": self.neighbour_radius >= 1 and self.mean_radius >= 0,
        }
        if broken := [text for text, holds in rules.items() if not holds]:
            raise ValueError("; ".join(broken))
