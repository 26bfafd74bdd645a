"""What map tags say about a way or a relation, as Column expressions over a map<string, string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The highway and access values of roads that can be used, and the kinds of turn restrictions.
HIGHWAYS = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "motorway_link", "trunk_link",
    "primary_link", "secondary_link", "tertiary_link", "living_street", "track", "escape", "raceway", "road",
]
ACCESS = ["yes", "permissive", "public"]
NOT_ALLOWED = ["no_right_turn", "no_left_turn", "no_u_turn", "no_straight_on", "no_entry", "no_exit"]
ONLY_ALLOWED = ["only_right_turn", "only_left_turn", "only_u_turn", "only_straight_on"]
RESTRICTION_KEYS = ["restriction", "restriction:motorcycle", "restriction:conditional", "restriction:motorcar"]
KEPT = ["name", "ref", "highway", "surface", "smoothness"]


def _open(value: Column) -> Column:
    return value.isNull() | value.isin(ACCESS)


def way_ok(tags: str | Column = "tags") -> Column:
    """Whether a way is a road that can be used; without tags it isn't."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return F.coalesce(t["service"].isNull() & _open(t["access"]) & _open(t["motor_vehicle"]) & t["highway"].isin(HIGHWAYS), F.lit(False))


def direction(tags: str = "tags") -> Column:
    """roundabout, oneway or both."""
    t = F.col(tags)
    return F.when(t["junction"] == "roundabout", "roundabout").when(t["oneway"] == "yes", "oneway").otherwise("both")


def normal(value: Column) -> Column:
    """A kept tag's value: of one that ends in _link, every _link is dropped."""
    return F.when(value.endswith("_link"), F.replace(value, F.lit("_link"), F.lit(""))).otherwise(value)


def kept(tags: str = "tags") -> list[Column]:
    return [normal(F.col(tags)[k]).alias(k) for k in KEPT]


def restriction_value(tags: str = "tags") -> Column:
    """The first word of the first restriction tag there is."""
    return F.split(F.coalesce(*(F.col(tags)[k] for k in RESTRICTION_KEYS)), " ")[0]


def relation_ok(tags: str = "tags") -> Column:
    t = F.col(tags)
    return F.coalesce(t["type"].startswith("restriction") & F.coalesce(*(t[k] for k in RESTRICTION_KEYS)).isNotNull(), F.lit(False))


def restriction_kind(value: Column) -> Column:
    """not, only, or null for values that aren't known."""
    return F.when(value.isin(NOT_ALLOWED), "not").when(value.isin(ONLY_ALLOWED), "only")
