"""Settings of the plans, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from tidepanel.operators.features import SETS

# The public names of the three parameter sets.
SET_ALIASES = {
    "MinimalFCParameters": "minimal",
    "EfficientFCParameters": "efficient",
    "ComprehensiveFCParameters": "comprehensive",
}


def parameter_set(name: str) -> str:
    key = SET_ALIASES.get(name, name)
    if key not in SETS:
        raise ValueError(f"unknown parameter set {name!r}; specify one of {', '.join(SET_ALIASES)}")
    return key


def whole_number(value, what: str) -> int:
    try:
        if isinstance(value, float) and not value.is_integer():
            raise ValueError
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{what} must be a valid integer") from None
    if number < 0:
        raise ValueError(f"{what} must be at least 0")
    return number


@dataclass(frozen=True)
class PrepareConfig:
    """``choose_on``: 'each_split' picks a transform for train and test apart,
    'train' uses the training choice for both. ``fit_scope``: 'split' imputes each
    split from its own points, 'all' from the whole series."""

    target: str
    deflator: str | None = None
    test_fraction: float = 0.2
    cap_factor: float = 3.0
    statistic: str = "autolag"
    choose_on: str = "each_split"
    fit_scope: str = "split"
    block_days: int | None = None

    def __post_init__(self):
        if not self.target:
            raise ValueError("no target series given")
        if not 0 < self.test_fraction < 1:
            raise ValueError("test_fraction must lie between 0 and 1")
        for value, allowed in (
            (self.statistic, ("autolag", "lag0")),
            (self.choose_on, ("each_split", "train")),
            (self.fit_scope, ("split", "all")),
        ):
            if value not in allowed:
                raise ValueError(f"unknown option {value!r}, expected one of {', '.join(allowed)}")


@dataclass(frozen=True)
class EngineerConfig:
    """``include_target`` lets features see the target's own values up to their
    date, as a parity option; it leaks what is to be predicted."""

    target: str
    rounds: int = 2
    drop_threshold: float = 0.002
    parameters: str = "minimal"
    max_shift: int | None = None
    include_target: bool = False

    def __post_init__(self):
        if not self.target:
            raise ValueError("no target series given")
        object.__setattr__(self, "rounds", whole_number(self.rounds, "rounds"))
        object.__setattr__(self, "drop_threshold", float(self.drop_threshold))
        object.__setattr__(self, "parameters", parameter_set(self.parameters))
