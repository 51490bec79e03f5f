"""Feature sets by configuration: names and parameters checked, one plan for all families, plans cached by what they compute."""

from __future__ import annotations

import copy
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import entropy, features, recursive
from tidegauge.functions.windows import roll

FAMILIES = ("technical", "volatility", "statistical", "entropy")
DEFAULTS = {
    "technical": {"features": ["rsi", "macd", "bollinger_bands", "sma", "ema", "atr"], "rsi_window": 14, "sma_window": 20, "ema_window": 20, "bollinger_window": 20, "atr_window": 14},
    "volatility": {"window": 20},
    "statistical": {"window": 20},
    "entropy": {"features": ["shannon", "permutation"], "window": 100, "bins": 10},
}


def split_families(asked: list[str]) -> tuple[list[str], list[str]]:
    """Known and unknown names of families."""
    return [a for a in asked if a in FAMILIES], [a for a in asked if a not in FAMILIES]


def parameter_errors(parameters: dict) -> list[str]:
    """What is wrong with parameters: windows are whole numbers from 2 on, bins as well; shares are within 0 and 1."""
    out = []
    for name, v in parameters.items():
        if name.endswith("window") or name == "bins":
            if not isinstance(v, int) or isinstance(v, bool) or v < 2:
                out.append(f"{name} must be a whole number of 2 or more")
        elif name in ("alpha", "beta", "r", "threshold") and not (isinstance(v, (int, float)) and 0 <= v <= 1):
            out.append(f"{name} must be within 0 and 1")
    return out


def merged(own: dict | None) -> dict:
    """The defaults with one's own values in their families; ValueError for unknown families and wrong values."""
    out = copy.deepcopy(DEFAULTS)
    for family, values in (own or {}).items():
        if family not in out:
            raise ValueError(f"unknown family {family!r}")
        out[family].update(values)
    wrong = [e for v in out.values() for e in parameter_errors(v)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def with_environment(value):
    """A configuration with ${NAME} in its strings replaced from the environment; unknown names stay."""
    if isinstance(value, dict):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [with_environment(v) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value) if isinstance(value, str) else value


def save_config(config: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True)


def load_config(path: str) -> dict:
    with open(path) as f:
        return merged(with_environment(json.load(f)))


def _technical(df: DataFrame, c: dict) -> DataFrame:
    for name in c["features"]:
        if name == "rsi":
            df = features.with_rsi(df, n=c["rsi_window"])
        elif name == "macd":
            df = recursive.macd(df)
        elif name == "bollinger_bands":
            df = features.with_bollinger(df, n=c["bollinger_window"])
        elif name == "sma":
            df = df.withColumn(f"sma_{c['sma_window']}", roll(F.avg, "close", c["sma_window"]))
        elif name == "ema":
            df = recursive.ewm(df, "close", span=c["ema_window"], adjust=False, out=f"ema_{c['ema_window']}")
        elif name == "atr":
            df = features.with_atr(df, c["atr_window"])
        else:
            raise ValueError(f"unknown technical feature {name!r}")
    return df


def _entropy(df: DataFrame, c: dict) -> DataFrame:
    n = c["window"]
    for name in c["features"]:
        if name == "shannon":
            df = entropy.with_histogram_entropies(df, "close", n, c["bins"])
        elif name == "permutation":
            df = entropy.with_permutation_entropy(df, "close", n)
        elif name in entropy.KERNELS:
            df = entropy.with_complexity(df, "close", n, (name,))
        else:
            raise ValueError(f"unknown entropy feature {name!r}")
    return df


BUILDERS = {"technical": _technical, "volatility": lambda df, c: features.with_volatility(df, c["window"]), "statistical": lambda df, c: features.rolling_statistics(df, n=c["window"]), "entropy": _entropy}


def compute(bars: DataFrame, families: list[str] | None = None, config: dict | None = None) -> DataFrame:
    """bars with the features of families (all by default)."""
    asked = list(FAMILIES) if families is None else families
    known, unknown = split_families(asked)
    if unknown:
        raise ValueError(f"unknown families {unknown}")
    missing = [c for c in ("open", "high", "low", "close") if c not in bars.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    c = merged(config)
    for f in FAMILIES:
        if f in known:
            bars = BUILDERS[f](bars, c[f])
    return bars


class FeatureCache:
    """Computed feature plans, persisted and found again by what they compute, not by the object that asks."""

    def __init__(self):
        self.held: dict[int, DataFrame] = {}

    def get(self, bars: DataFrame, families: list[str] | None = None, config: dict | None = None) -> DataFrame:
        made = compute(bars, families, config)
        return self.held.setdefault(made.semanticHash(), made.persist())

    def remove(self, df: DataFrame) -> None:
        if (old := self.held.pop(df.semanticHash(), None)) is not None:
            old.unpersist()

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
