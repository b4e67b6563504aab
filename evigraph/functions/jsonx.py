"""Reading of JSON attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import _NUMBER
from .text import ascii_lower


def _path(dotted: str) -> str:
    return "$" + "".join(f"['{p}']" for p in dotted.split("."))


def patched(attrs: Column, members: dict[str, Column]) -> Column:
    """A JSON object's text with some top-level members set to values, or left out where these are null; the others keep their types and depth. A text
    that is no object counts as an empty one."""
    kept = F.coalesce(F.from_json(attrs, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(kept, lambda k, _: ~k.isin(*members))
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in members]), F.array(*[v.cast("variant") for v in members.values()]))
    return F.to_json(F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull())))


def text_at(attrs: Column, dotted: str) -> Column:
    """The value at a dotted path as text; null if it is missing or null."""
    return F.get_json_object(attrs, _path(dotted))


def number_at(attrs: Column, dotted: str) -> Column:
    """A JSON number, or a string that reads as one."""
    raw = F.trim(text_at(attrs, dotted))
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double"))


def equals(attrs: Column, dotted: str, value) -> Column:
    """Whether the value at a path equals a string, number or boolean, as text without case; false if it is missing."""
    want = ("true" if value else "false") if isinstance(value, bool) else str(value)
    return F.coalesce(ascii_lower(text_at(attrs, dotted)) == want.lower(), F.lit(False))


def canonical(attrs: Column, without: tuple[str, ...] = ("source_refs", "last_recomputed_at")) -> Column:
    """The top-level members, without some, as text in order of their names; null and non-objects are empty."""
    members = F.from_json(F.coalesce(attrs, F.lit("{}")), "map<string,string>")
    kept = F.map_entries(F.map_filter(members, lambda k, v: ~k.isin(*without)))
    return F.coalesce(F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";"), F.lit(""))


#: Attributes that may hold a node's time, in order.
TIME_KEYS = ("as_of", "observed_at", "timestamp", "date", "updated_at")


def parse_time(raw: Column) -> Column:
    """Unix seconds of an RFC 3339 text, of a date (its start) or of digits."""
    stamp = F.coalesce(raw.try_cast("timestamp"), F.try_to_timestamp(raw))
    return F.when(raw.rlike(r"^-?\d{9,12}$"), raw.try_cast("long")).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_seconds(stamp))


def node_time(attrs: Column) -> Column:
    """A node's business time: the first of TIME_KEYS that can be read."""
    return F.coalesce(*[parse_time(text_at(attrs, k)) for k in TIME_KEYS])


def unit_text(unit: Column) -> Column:
    """A KPI unit, a bare word or an object with one member, as text."""
    inner = F.coalesce(F.get_json_object(unit, "$.Currency"), F.get_json_object(unit, "$.Custom"))
    return F.coalesce(inner, F.trim(F.translate(unit, '"', "")))
