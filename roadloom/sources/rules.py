"""Rule files: what a user prefers and avoids. Unknown keys are errors; what is left out has the defaults."""

from __future__ import annotations

import json
import sys
import typing
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, TextIO

FAMILIES = ("highway", "surface", "smoothness")


class RulesError(ValueError):
    pass


@dataclass
class Action:
    """avoid, or priority with a value of 0 to 255."""

    action: str
    value: int = 0


# Fixed values, from here to Rules: the key names of rule files, and their defaults.


@dataclass
class SameRoad:
    enabled: bool = True
    priority: int = 30


@dataclass
class Direction:
    enabled: bool = True
    check_junctions_back: int = 50


@dataclass
class Speed:
    enabled: bool = False
    check_steps_back: int = 1000
    last_step_distance_below_avg_with_ratio: float = 1.3


@dataclass
class ShortDetours:
    enabled: bool = True
    min_detour_len_m: float = 5000.0


@dataclass
class SharpTurns:
    enabled: bool = True
    under_deg: float = 150.0
    priority: int = 60


@dataclass
class Basic:
    step_limit: int = 30000
    prefer_same_road: SameRoad = field(default_factory=SameRoad)
    progression_direction: Direction = field(default_factory=Direction)
    progression_speed: Speed = field(default_factory=Speed)
    no_short_detours: ShortDetours = field(default_factory=ShortDetours)
    no_sharp_turns: SharpTurns = field(default_factory=SharpTurns)


@dataclass
class StartFinish:
    variation_distances_m: list[float] = field(default_factory=lambda: [10000.0, 20000.0, 30000.0])
    variation_bearing_deg: list[float] = field(default_factory=lambda: [45.0 * k for k in range(8)])


@dataclass
class RoundTrip:
    variation_distance_ratios: list[float] = field(default_factory=lambda: [1.0, 0.8, 0.6, 0.4])
    variation_bearing_deg: list[float] = field(default_factory=lambda: [-25.0, -10.0, 10.0, 25.0])


@dataclass
class Waypoints:
    start_finish: StartFinish = field(default_factory=StartFinish)
    round_trip: RoundTrip = field(default_factory=RoundTrip)


@dataclass
class Retry:
    trigger_min_route_count: int = 50
    round_trip_adjustment_bearing_deg: list[float] = field(default_factory=lambda: [-135.0, -90.0, -45.0, 45.0, 90.0, 135.0])
    avoid_residential: list[bool] = field(default_factory=lambda: [True, False])


@dataclass
class Generation:
    waypoint_generation: Waypoints = field(default_factory=Waypoints)
    route_generation_retry: Retry = field(default_factory=Retry)


@dataclass
class Rules:
    basic: Basic = field(default_factory=Basic)
    highway: dict[str, Action] | None = None
    surface: dict[str, Action] | None = None
    smoothness: dict[str, Action] | None = None
    generation: Generation = field(default_factory=Generation)

    def avoided(self, family: str) -> set[str]:
        return {tag for tag, a in (getattr(self, family) or {}).items() if a.action == "avoid"}

    def priorities(self, family: str) -> dict[str, int]:
        return {tag: a.value for tag, a in (getattr(self, family) or {}).items() if a.action == "priority"}

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def _read(kind: Any, value: Any, at: str) -> Any:
    if is_dataclass(kind):
        if not isinstance(value, dict):
            raise RulesError(f"{at or 'rules'}: an object is expected")
        hints = typing.get_type_hints(kind)
        if unknown := sorted(set(value) - set(hints)):
            raise RulesError(f"{at or 'rules'}: unknown {', '.join(unknown)}")
        out = kind(**{k: _read(hints[k], v, f"{at}.{k}".lstrip(".")) for k, v in value.items()})
        if kind is Action and (out.action not in ("avoid", "priority") or (out.action == "priority") != ("value" in value)):
            raise RulesError(f"{at}: an action is avoid, or priority with a value")
        return out
    args = typing.get_args(kind)
    if type(None) in args:
        return None if value is None else _read(next(a for a in args if a is not type(None)), value, at)
    origin = typing.get_origin(kind)
    if origin is dict and isinstance(value, dict):
        return {k: _read(args[1], v, f"{at}.{k}") for k, v in value.items()}
    if origin is list and isinstance(value, list):
        return [_read(args[0], v, f"{at}[{k}]") for k, v in enumerate(value)]
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is int and isinstance(value, int) and not isinstance(value, bool):
        if value < 0 or (at.endswith(("priority", "value")) and value > 255):
            raise RulesError(f"{at}: {value} is out of range")
        return value
    if kind in (bool, str) and isinstance(value, kind):
        return value
    raise RulesError(f"{at}: {value!r} is of the wrong type")


def from_dict(value: dict[str, Any]) -> Rules:
    return _read(Rules, value, "")


def read_rules(path: str | None = None, stdin: TextIO | None = None) -> Rules:
    """Rules of a file, or of standard input if it is piped and holds something, or the defaults."""
    if path:
        with open(path, encoding="utf-8") as f:
            return from_dict(json.load(f))
    stdin = sys.stdin if stdin is None else stdin
    text = "" if stdin.isatty() else stdin.read()
    return from_dict(json.loads(text)) if text.strip() else Rules()


def json_schema(kind: Any = Rules) -> dict[str, Any]:
    """A JSON schema of rule files."""
    if is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        out = {"type": "object", "additionalProperties": False, "properties": {f.name: json_schema(hints[f.name]) for f in fields(kind)}}
        return out | ({"required": ["action"]} if kind is Action else {})
    args = typing.get_args(kind)
    if type(None) in args:
        return {"anyOf": [json_schema(next(a for a in args if a is not type(None))), {"type": "null"}]}
    if typing.get_origin(kind) is dict:
        return {"type": "object", "additionalProperties": json_schema(args[1])}
    if typing.get_origin(kind) is list:
        return {"type": "array", "items": json_schema(args[0])}
    return {"type": {int: "integer", float: "number", bool: "boolean", str: "string"}[kind]}
