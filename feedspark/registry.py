"""The feed's tables: names, columns, types, code domains and whether a feed must have them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# The code domains of enumerated columns.
CODES: dict[str, dict[int | str, str]] = {
    "RouteType": {0: "tram", 1: "subway", 2: "rail", 3: "bus", 4: "ferry", 5: "cable tram", 6: "aerial lift", 7: "funicular", 11: "trolleybus", 12: "monorail"},
    "ContinuousPickup": {0: "continuous", 1: "none", 2: "phone agency", 3: "ask driver"},
    "ContinuousDropOff": {0: "continuous", 1: "none", 2: "phone agency", 3: "ask driver"},
    "StopLocation": {0: "stop or platform", 1: "station", 2: "entrance or exit", 3: "generic node", 5: "boarding area"},
    "WheelchairBoarding": {0: "unknown", 1: "possible", 2: "not possible"},
    "Ticketing": {0: "available", 1: "unavailable"},
    "Direction": {0: "outbound", 1: "inbound"},
    "BikesAllowed": {0: "unknown", 1: "allowed", 2: "not allowed"},
    "Pickup": {0: "regular", 1: "none", 2: "phone agency", 3: "ask driver"},
    "DropOff": {0: "regular", 1: "none", 2: "phone agency", 3: "ask driver"},
    "TimePoint": {0: "approximate", 1: "exact"},
    "Service": {0: "not available", 1: "available"},
    "ServiceException": {1: "added", 2: "removed"},
    "Payment": {0: "on board", 1: "before boarding"},
    "TransfersIncluded": {0: "none", 1: "one", 2: "two"},
    "ExactTimes": {0: "frequency based", 1: "schedule based"},
    "Transfer": {0: "recommended", 1: "timed", 2: "minimum time", 3: "impossible", 4: "in seat", 5: "re-board"},
    "PathwayMode": {1: "walkway", 2: "stairs", 3: "moving sidewalk", 4: "escalator", 5: "elevator", 6: "fare gate", 7: "exit gate"},
    "Bidirectional": {0: "one way", 1: "both ways"},
    "TableName": {n: n for n in ("agency", "stops", "routes", "trips", "stop_times", "feed_info", "pathways", "levels", "attributions")},
}

# Tables in order of loading, each with its columns. A column is name:type, the type followed by ! if a
# value is required. Types: s string, f double, u8 u32 u64 unsigned integers, any other a code domain.
_TABLES = """
required agency: agency_id:s! agency_name:s! agency_url:s! agency_timezone:s! agency_lang:s agency_phone:s agency_fare_url:s agency_email:s ticketing_deep_link_id:s
required stops: stop_id:s! stop_code:s stop_name:s stop_desc:s stop_lat:f stop_lon:f zone_id:s stop_url:s location_type:StopLocation parent_station:s stop_timezone:s wheelchair_boarding:WheelchairBoarding level_id:s platform_code:s
required routes: route_id:s! agency_id:s! route_short_name:s route_long_name:s route_desc:s route_type:RouteType! route_url:s route_color:s route_text_color:s route_sort_order:u32 continuous_pickup:ContinuousPickup continuous_drop_off:ContinuousDropOff ticketing_deep_link_id:s
required trips: route_id:s! service_id:s! trip_id:s! trip_headsign:s trip_short_name:s direction_id:Direction block_id:s shape_id:s wheelchair_accessible:WheelchairBoarding bikes_allowed:BikesAllowed trip_ticketing_id:s ticketing_type:Ticketing
required stop_times: trip_id:s! arrival_time:s departure_time:s stop_id:s! stop_sequence:u64! stop_headsign:s pickup_type:Pickup drop_off_type:DropOff continuous_pickup:ContinuousPickup continuous_drop_off:ContinuousDropOff shape_dist_traveled:f timepoint:TimePoint ticketing_type:Ticketing
optional calendar: service_id:s! start_date:s! end_date:s! monday:Service! tuesday:Service! wednesday:Service! thursday:Service! friday:Service! saturday:Service! sunday:Service!
optional calendar_dates: service_id:s! date:s! exception_type:ServiceException!
optional fare_attributes: fare_id:s! price:f! currency_type:s! payment_method:Payment! transfers:TransfersIncluded agency_id:s transfer_duration:u64
optional fare_rules: fare_id:s! route_id:s origin_id:s destination_id:s contains_id:s
optional shapes: shape_id:s! shape_pt_lat:f! shape_pt_lon:f! shape_pt_sequence:u64! shape_dist_traveled:f
optional frequencies: trip_id:s! start_time:s! end_time:s! headway_secs:u64! exact_times:ExactTimes
optional transfers: from_stop_id:s! to_stop_id:s! transfer_type:Transfer! min_transfer_time:u64
optional pathways: pathway_id:s! from_stop_id:s! to_stop_id:s! pathway_mode:PathwayMode! is_bidirectional:Bidirectional! length:f traversal_time:u64 stair_count:u64 max_slope:f min_width:f signposted_as:s reversed_signposted_as:s
optional levels: level_id:s! level_index:f! level_name:s
optional feed_info: feed_publisher_name:s! feed_publisher_url:s! feed_lang:s! default_lang:s feed_start_date:s feed_end_date:s feed_version:s feed_contact_email:s feed_contact_url:s
optional translations: table_name:TableName! field_name:s! language:s! translation:s! record_id:s record_sub_id:s field_value:s
optional attributions: attribution_id:s agency_id:s route_id:s trip_id:s organization_name:s! is_producer:u8! is_operator:u8! is_authority:u8! attribution_url:s attribution_email:s attribution_phone:s
optional ticketing_identifiers: ticketing_stop_id:s! stop_id:s! agency_id:s!
optional ticketing_deep_links: ticketing_deep_link_id:s! web_url:s android_intent_uri:s ios_universal_link_url:s
"""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    required: bool

    @property
    def codes(self) -> dict[int | str, str] | None:
        return CODES.get(self.kind)


@dataclass(frozen=True)
class TableSpec:
    name: str
    required: bool
    columns: tuple[ColumnSpec, ...]

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)


@lru_cache(maxsize=1)
def tables() -> dict[str, TableSpec]:
    """All table specs by name, in order of loading."""
    out = {}
    for line in _TABLES.strip().splitlines():
        load, name, columns = re.fullmatch(r"(\w+) (\w+): (.+)", line).groups()
        specs = (c.removesuffix("!").split(":") + [c.endswith("!")] for c in columns.split())
        out[name] = TableSpec(name, load == "required", tuple(ColumnSpec(*c) for c in specs))
    return out


def table_spec(name: str, columns: str, required: bool = True) -> TableSpec:
    """A table of one's own, its columns written as in the registry."""
    return TableSpec(name, required, tuple(ColumnSpec(*c.removesuffix("!").split(":"), c.endswith("!")) for c in columns.split()))


def stem(member: str) -> str:
    """A file's name without folders and without its last extension."""
    base = member.replace("\\", "/").rsplit("/", 1)[-1]
    head, dot, _ = base.rpartition(".")
    return head if dot and head else base


def table_of(member: str) -> str | None:
    """The table that a file holds, by its stem; None for files that the feed doesn't know."""
    name = stem(member)
    return name if name in tables() else None


def file_name(table: str) -> str:
    """The file of a table."""
    return f"{tables()[table].name}.txt"
