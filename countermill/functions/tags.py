"""Tag maps of a reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from countermill.functions.text import is_blank
from countermill.vocab import DATA_SOURCE, DEVICE_TYPE

_EMPTY = "map<string,string>"


def _map(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for key, value in pairs for x in (F.lit(key), value.cast("string"))])


def _or_empty(tags: Column) -> Column:
    return F.coalesce(tags, F.create_map().cast(_EMPTY))


def enrich_tags(
    base: Column,
    name: Column,
    description: Column,
    start_register: Column,
    register_count: Column,
    scale_factor: Column,
    offset: Column,
    device_tags: Column | None = None,
    timestamp_utc: Column | None = None,
) -> Column:
    """Channel tags plus channel facts, then device tags and defaults where absent.

    `timestamp_utc` is an argument, not a clock, so that results can be repeated. Duplicate keys
    raise in map_concat, so each part leaves out the keys that another part decides; the tests for
    that look at the plain inputs only, as a nested map would be built again for every key.
    """
    base = _or_empty(base)
    facts = _map(
        ("data_source", F.lit(DATA_SOURCE)),
        ("channel_name", name),
        ("channel_description", F.when(~is_blank(description), description)),
        ("register_start", start_register),
        ("register_count", register_count),
        ("scale_factor", scale_factor),
        ("offset", F.when(offset != 0, offset)),
    )
    always = ["data_source", "channel_name", "register_start", "register_count", "scale_factor"]

    def kept(key: Column) -> Column:
        described = (key == "channel_description") & ~is_blank(description)
        shifted = (key == "offset") & (offset != 0)
        return ~(key.isin(always) | described | F.coalesce(shifted, F.lit(False)))

    parts = [F.map_filter(base, lambda k, _: kept(k)), F.map_filter(facts, lambda _, v: v.isNotNull())]
    typed = F.map_contains_key(base, "device_type")
    if device_tags is not None:
        device_tags = _or_empty(device_tags)
        prefixed = F.transform_keys(device_tags, lambda k, _: F.concat(F.lit("device_"), k))
        parts.append(F.map_filter(prefixed, lambda k, _: ~F.map_contains_key(base, k)))
        typed = typed | F.map_contains_key(device_tags, "type")
    defaults = _map(
        ("device_type", F.when(~typed, F.lit(DEVICE_TYPE))),
        (
            "timestamp_utc",
            F.lit(None) if timestamp_utc is None else F.when(~F.map_contains_key(base, "timestamp_utc"), timestamp_utc),
        ),
    )
    parts.append(F.map_filter(defaults, lambda _, v: v.isNotNull()))
    return F.map_concat(*parts)


def shift_of(ts: Column, zone: str = "UTC") -> Column:
    """Shift by local hour of the event time."""
    hour = F.hour(F.from_utc_timestamp(ts, zone))
    return (
        F.when((hour >= 6) & (hour < 14), F.lit("day"))
        .when((hour >= 14) & (hour < 22), F.lit("evening"))
        .otherwise(F.lit("night"))
    )


def shift_tag(
    base: Column, device_tags: Column, ts: Column, zone: str = "UTC", processing_timestamp: Column | None = None
) -> Column:
    """Example of a custom tagger: location, shift and, when given, the processing time."""
    location = F.coalesce(F.try_element_at(device_tags, F.lit("location")), F.lit("unknown"))
    pairs = [("location", location), ("shift", shift_of(ts, zone))]
    if processing_timestamp is not None:
        pairs.append(("processing_timestamp", processing_timestamp))
    replaced = [key for key, _ in pairs]
    return F.map_concat(F.map_filter(_or_empty(base), lambda k, _: ~k.isin(replaced)), _map(*pairs))


def tags_text(tags: Column) -> Column:
    """A map as sorted `key=value` pairs, for keys of comparisons and text sinks."""
    pairs = F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")
