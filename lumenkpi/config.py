"""Settings: one frozen object, passed explicitly; from code, a settings file or the environment."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, replace
from pathlib import Path

from lumenkpi.errors import InvalidInput

DAY = 24 * 3600
PERIODS = ("busy", "transition", "off_peak")
ENV_PREFIX = "LUMENKPI_"


def seconds_of_day(text: str | int) -> int:
    """Seconds since midnight of ``HH:MM`` or ``HH:MM:SS``."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"(\d{1,2}):(\d{2})(?::(\d{2}))?", str(text).strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise InvalidInput(f"not a time of day: {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


@dataclass(frozen=True)
class DayPeriod:
    """From ``start`` (inclusive) to ``end`` (exclusive) in seconds of the day; over midnight if start > end."""

    name: str
    start: int
    end: int

    def __post_init__(self) -> None:
        if self.start == self.end:
            raise InvalidInput(f"day period {self.name} is empty", period=self.name)

    def spans(self) -> list[tuple[int, int]]:
        return [(self.start, self.end)] if self.start < self.end else [(self.start, DAY), (0, self.end)]


@dataclass(frozen=True)
class Config:
    day_periods: tuple[DayPeriod, ...] = (DayPeriod("busy", 7 * 3600, 10 * 3600), DayPeriod("transition", 10 * 3600, 17 * 3600), DayPeriod("off_peak", 17 * 3600, 7 * 3600))
    granularity_minutes: int = 15
    min_clean_days: int = 14
    z_threshold: float = 3.0
    timezone: str = "UTC"
    database_url: str = ""
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        if self.granularity_minutes <= 0:
            raise InvalidInput("granularity_minutes must be positive")
        if self.min_clean_days <= 0:
            raise InvalidInput("min_clean_days must be positive")
        if self.z_threshold <= 0:
            raise InvalidInput("z_threshold must be positive")
        at = 0
        for a, b, name in sorted((a, b, p.name) for p in self.day_periods for a, b in p.spans()):
            if a != at:
                raise InvalidInput("day periods must cover the day exactly once", period=name, second=min(a, at))
            at = b
        if at != DAY:
            raise InvalidInput("day periods must cover the day exactly once", second=at)


#: Where each setting lies in a settings file.
_PLACES = {("app", "granularity_minutes"): "granularity_minutes", ("app", "min_clean_days"): "min_clean_days", ("app", "zscore_threshold"): "z_threshold", ("app", "timezone"): "timezone", ("database", "url"): "database_url", ("logging", "level"): "log_level"}


def from_mapping(tree: Mapping) -> Config:
    """A Config from a settings tree; unknown keys are rejected."""
    found: dict[str, object] = {}
    for section, values in tree.items():
        for key, value in values.items():
            if (section, key) == ("app", "day_periods"):
                spans = {name: (p["start"], p["end"]) for name, p in value.items()}
                if set(spans) != set(PERIODS):
                    raise InvalidInput("day_periods must name busy, transition and off_peak", found=sorted(spans))
                found["day_periods"] = tuple(DayPeriod(name, seconds_of_day(spans[name][0]), seconds_of_day(spans[name][1])) for name in PERIODS)
            elif (section, key) in _PLACES:
                found[_PLACES[section, key]] = value
            else:
                raise InvalidInput(f"unknown setting {section}.{key}")
    try:
        for name, kind in (("granularity_minutes", int), ("min_clean_days", int), ("z_threshold", float)):
            if name in found:
                found[name] = kind(found[name])
    except (TypeError, ValueError) as e:
        raise InvalidInput(f"a setting is not a number: {e}") from e
    return replace(Config(), **found)


def load(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Settings of a TOML or JSON file (defaults without one).

    A variable named after a setting's place, such as ``LUMENKPI_APP__MIN_CLEAN_DAYS``, goes before the file; its value is
    read as JSON where it is JSON (so day periods can be given too), else as text.
    """
    tree: dict[str, dict] = {}
    if path:
        text = Path(path).read_text("utf-8")
        try:
            tree = json.loads(text) if str(path).endswith(".json") else tomllib.loads(text)
        except ValueError as e:
            raise InvalidInput(f"{path} cannot be read: {e}", source=str(path)) from e
    given = os.environ if env is None else env
    places = {f"{ENV_PREFIX}{section}__{key}".upper(): (section, key) for section, key in [*_PLACES, ("app", "day_periods")]}
    unknown = sorted(name for name in given if name.startswith(ENV_PREFIX) and name not in places)
    if unknown:
        raise InvalidInput(f"unknown setting {unknown[0]}", found=unknown)
    for name in places.keys() & given.keys():
        section, key = places[name]
        try:
            value = json.loads(given[name])
        except ValueError:
            value = given[name]
        tree[section] = {**tree.get(section, {}), key: value}
    return from_mapping(tree)
