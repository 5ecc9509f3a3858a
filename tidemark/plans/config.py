"""Configuration: frozen dataclasses with validation. YAML is read where the library for it is installed."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

KINDS = ("FIX", "ITCH", "OUCH")


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    path: str
    symbols: tuple[str, ...] = ()

    def validate(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"source {self.name}: kind must be one of {', '.join(KINDS)}")
        if not self.path:
            raise ValueError(f"source {self.name}: no path")


@dataclass(frozen=True)
class Detectors:
    tqr_window_ms: int = 1000
    tqr_threshold: float = 2.5
    slippage_lookback: int = 100
    book_depth: int = 5
    refill_window_ms: int = 5000
    min_refills: int = 3
    vpin_bucket: int = 50_000
    vpin_buckets: int = 50
    pin_least_days: int = 5
    vpin_sigmas: float = 2.0
    vpin_threshold: float = 0.3
    pin_least_trades: int = 100
    pin_period: str = "day"
    pin_threshold: float = 0.25
    hawkes_threshold: float = 3.0
    large_trade: int = 10_000
    drift_information: float = 2.0
    drift_sigmas: float = 3.0
    price_step: int = 1
    refill_tolerance: float = 0.2
    dark_probability: float = 0.8
    dark_streak: int = 5
    slot_ms: int = 100

    def validate(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, str) and value <= 0:
                raise ValueError(f"{f.name} must be positive")
        if self.pin_period not in ("day", "week", "month"):
            raise ValueError("pin_period must be day, week or month")


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    detectors: Detectors = field(default_factory=Detectors)

    def validate(self) -> Config:
        for s in self.sources:
            s.validate()
        self.detectors.validate()
        return self

    def symbols(self) -> list[str]:
        """The distinct symbols of all sources, in order."""
        return list(dict.fromkeys(x for s in self.sources for x in s.symbols))

    @staticmethod
    def of(data: dict) -> Config:
        sources = tuple(Source(**{**s, "symbols": tuple(s.get("symbols", ()))}) for s in data.get("sources", ()))
        return Config(sources, Detectors(**data.get("detectors", {}))).validate()

    @staticmethod
    def load(path: str) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML library; use Config.of with a dict") from e
        with open(path) as f:
            return Config.of(yaml.safe_load(f))
