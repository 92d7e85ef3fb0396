"""Engine settings, read once from the environment into an immutable value."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Seconds of the day at which the session opens, closes and feeds connect beforehand.
OPEN, CLOSE, PRE_CONNECT = 33_300, 55_800, 33_240
ZONE = "Asia/Kolkata"


@dataclass(frozen=True)
class EngineConfig:
    timeframes: tuple[str, ...] = ("1m", "5m")
    min_candles: int = 15
    retention_minutes: int = 30
    depth_levels: int = 5
    base_dir: str = "market_data"
    stop_fraction: float = 0.002
    queue_limits: Mapping[str, int] = field(default_factory=lambda: {"quote": 5000, "depth": 5000, "signal": 1000})

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        frames = tuple(t.strip() for t in env.get("TIMEFRAMES", "1m,5m").split(",") if t.strip())
        return cls(
            timeframes=frames,
            min_candles=int(env.get("MIN_CANDLES", "15")),
            retention_minutes=int(env.get("RAM_WINDOW_MINUTES", "30")),
            depth_levels=int(env.get("DEPTH_LEVELS", "5")),
            base_dir=env.get("CONN_LOG_DIR", "market_data"),
        )
