"""Pipeline configuration."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, fields

_POSITIVE = ("sample_rate_hz", "bandpass_low_hz", "bandpass_high_hz", "heading_tolerance_deg", "condition_number_threshold", "maneuver_detection_window", "maneuver_baseline_weight")
_NOT_NEGATIVE = ("ridge_alpha", "lasso_alpha", "elastic_net_alpha")
_CHOICES = {"model_terms": ("a", "b", "c", "d"), "earth_field_method": ("igrf", "steady_mean"), "compensation_strategy": ("standard", "adaptive_maneuver")}


@dataclass(frozen=True, kw_only=True)
class PipelineConfig:
    """Settings of calibration and compensation; immutable.

    ``sample_rate_hz``, the band-pass limits, ``compensation_strategy`` and
    ``use_heading_specific_calibration`` are declarative: they are checked and
    carried, but no operator acts on them.  Regularisation strengths follow the
    un-normalised objective |Aw - b|^2 + alpha * penalty.
    """

    sample_rate_hz: float = 10.0
    bandpass_low_hz: float = 0.1
    bandpass_high_hz: float = 0.9
    model_terms: str = "c"
    earth_field_method: str = "igrf"
    igrf_date: dt.date | None = field(default_factory=dt.date.today)
    use_ridge: bool = False
    ridge_alpha: float = 1e-3
    use_lasso: bool = False
    lasso_alpha: float = 1e-3
    use_elastic_net: bool = False
    elastic_net_alpha: float = 1e-3
    elastic_net_l1_ratio: float = 0.5
    segment_label_col: str | None = None
    reference_heading_deg: float | None = None
    heading_tolerance_deg: float = 45.0
    condition_number_threshold: float = 1e6
    use_imu_rates: bool = False
    compensation_strategy: str = "standard"
    maneuver_detection_window: int = 50
    maneuver_baseline_weight: float = 0.1
    use_heading_specific_calibration: bool = False
    use_cv: bool = False
    cv_folds: int = 5
    auto_regularize: bool = False

    def __post_init__(self):
        wrong = [f"{n} must be positive" for n in _POSITIVE if not getattr(self, n) > 0]
        wrong += [f"{n} must not be negative" for n in _NOT_NEGATIVE if not getattr(self, n) >= 0]
        wrong += [f"{n} must be one of {list(c)}, got {getattr(self, n)!r}" for n, c in _CHOICES.items() if getattr(self, n) not in c]
        if not 0 <= self.elastic_net_l1_ratio <= 1:
            wrong.append("elastic_net_l1_ratio must lie in [0, 1]")
        if self.cv_folds < 2:
            wrong.append("cv_folds must be at least 2")
        if not self.bandpass_low_hz < self.bandpass_high_hz:
            wrong.append("bandpass_low_hz must be less than bandpass_high_hz")
        if not self.bandpass_high_hz < self.sample_rate_hz / 2:
            wrong.append("bandpass_high_hz must be below the Nyquist frequency sample_rate_hz / 2")
        if self.earth_field_method == "igrf" and self.igrf_date is None:
            wrong.append("igrf_date is required for earth_field_method 'igrf'")
        if sum((self.use_ridge, self.use_lasso, self.use_elastic_net)) > 1:
            wrong.append("at most one of use_ridge, use_lasso and use_elastic_net may be set")
        if wrong:
            raise ValueError("; ".join(wrong))

    def replace(self, **changes) -> PipelineConfig:
        return PipelineConfig(**({f.name: getattr(self, f.name) for f in fields(self)} | changes))
