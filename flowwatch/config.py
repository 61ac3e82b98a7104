"""Rule and cycle parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Rule type names as they appear in keys and alerts.
FAN_OUT = "FAN_OUT"
FAN_IN = "FAN_IN"
SHARED_DEVICE = "SHARED_DEVICE"
SHARED_IP = "SHARED_IP"
CIRCULAR_FLOW = "CIRCULAR_FLOW"

# Which column keys each windowed rule, which column is counted distinct, and
# whether the primary account is the key itself or the name UUID of the key.
RULE_SHAPES = {
    FAN_OUT: ("source_account_id", "destination_account_id", False),
    FAN_IN: ("destination_account_id", "source_account_id", False),
    SHARED_DEVICE: ("device_id", "source_account_id", True),
    SHARED_IP: ("ip_hash", "source_account_id", True),
}


@dataclass(frozen=True)
class RuleConfig:
    rule_type: str
    window_seconds: int = 60
    grace_seconds: int = 15
    min_distinct: int = 5
    min_count: int = 0          # <= 0: off
    min_amount: int = 0         # <= 0: off

    def __post_init__(self):
        if self.rule_type not in RULE_SHAPES:
            raise ValueError(f"unknown rule type {self.rule_type!r}")
        if self.window_seconds <= 0 or self.grace_seconds < 0:
            raise ValueError("window must be positive and grace non-negative")
        if self.min_distinct < 1:
            raise ValueError("min_distinct must be at least 1")

    @property
    def key_column(self) -> str:
        return RULE_SHAPES[self.rule_type][0]

    @property
    def counterparty_column(self) -> str:
        return RULE_SHAPES[self.rule_type][1]

    @property
    def hashed_primary(self) -> bool:
        return RULE_SHAPES[self.rule_type][2]


@dataclass(frozen=True)
class CycleConfig:
    max_depth: int = 4              # nodes on the cycle; paths have 1..max_depth-1 edges
    window_seconds: int = 86400
    tolerance_percent: int = 10

    def __post_init__(self):
        if self.max_depth < 2:
            raise ValueError("max_depth must be at least 2")
        if self.window_seconds <= 0 or self.tolerance_percent < 0:
            raise ValueError("window must be positive and tolerance non-negative")


# The reference's default thresholds (60 s windows, 15 s grace).
DEFAULT_RULES = (
    RuleConfig(FAN_OUT, 60, 15, 5),
    RuleConfig(FAN_IN, 60, 15, 5),
    RuleConfig(SHARED_DEVICE, 60, 15, 3),
    RuleConfig(SHARED_IP, 60, 15, 3),
)
DEFAULT_CYCLE = CycleConfig(4, 86400, 10)

# Parameters for the driver's sparse event table (60 s windows never fire on it).
DRIVER_RULES = (
    RuleConfig(FAN_OUT, 604800, 15, 5),
    RuleConfig(FAN_IN, 604800, 15, 5),
    RuleConfig(SHARED_DEVICE, 86400, 15, 3),
    RuleConfig(SHARED_IP, 43200, 15, 3),
)
DRIVER_CYCLE = CycleConfig(4, 259200, 50)


def rule(rules, rule_type: str) -> RuleConfig:
    for r in rules:
        if r.rule_type == rule_type:
            return r
    raise KeyError(rule_type)


def with_thresholds(cfg: RuleConfig, **changes) -> RuleConfig:
    return replace(cfg, **changes)
