"""Parking, school and road-speed rules, as Column expressions over tag maps and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Square metres for a space, plausible range of a tagged capacity, and tag classes.
M2_LOT, M2_STREET = 30.0, 13.0
M2_PLAUSIBLE = (8.0, 80.0)
CLOSED_ACCESS = ("private", "no", "permit")
DECKS = ("multi-storey", "underground", "rooftop")
STREET = ("street_side", "lane")
#: Mean enrolment by jurisdiction and class, and of special schools.
ENROLMENT = {("NI", "primary"): 210, ("NI", "secondary"): 820, ("RoI", "primary"): 170, ("RoI", "secondary"): 575}
ENROLMENT_SPECIAL = 80
#: Name patterns of school classes.
PRIMARY_NAME = r"(?i)national school|\bN\.?S\b|\bB\.?N\.?S\b|\bG\.?N\.?S\b|primary|\bP\.?S\b|gaelscoil|bunscoil|\bscoil\b|infant|nursery|pre-?school"
SECONDARY_NAME = r"(?i)secondary|\bcollege\b|gramm?ar|community (school|college)|comprehensive|high school|post.?primary|col(á|a)iste|pobalscoil|vocational|academy"
#: Road classes with their base speeds in km/h, speed bands in mph, symbolic limits in km/h.
CLASS_KMH = {
    "motorway": 90, "motorway_link": 45, "trunk": 85, "trunk_link": 40, "primary": 65, "primary_link": 30, "secondary": 55, "secondary_link": 25,
    "tertiary": 40, "tertiary_link": 20, "unclassified": 25, "residential": 25, "living_street": 10, "service": 15, "road": 25, "other": 25,
}
BANDS_MPH = (20, 30, 40, 50, 60, 70)
BANDS = ("untagged", *map(str, BANDS_MPH), "other")
SNAP_MPH = 3
MPH_KMH = 1.609344
TAGGED_SHARE = 0.8
SYMBOLIC_KMH = {"gb:nsl_single": 96.54, "uk:nsl_single": 96.54, "gb:nsl_dual": 112.63, "uk:nsl_dual": 112.63, "gb:motorway": 112.63, "uk:motorway": 112.63, "none": 140.0}
TYPE_KMH = {"urban": 50.0, "rural": 90.0, "trunk": 110.0, "motorway": 130.0}
LIMIT_KEYS = ("maxspeed:advisory", "maxspeed", "source:maxspeed", "maxspeed:type")


def lenient_int(c: Column) -> Column:
    """The whole part of a number in a text, or null."""
    return c.try_cast("double").try_cast("int")


def tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def parking_spaces(tags: Column, area_m2: Column) -> Column:
    """Public spaces of a parking area: none if closed or without area; a deck's capacity, or its floors' area;
    elsewhere the tagged capacity where it is plausible for the area, or else the area by type."""
    kind, capacity = tag(tags, "parking"), lenient_int(tag(tags, "capacity"))
    deck = F.coalesce(kind.isin(*DECKS), F.lit(False)) | F.coalesce(tag(tags, "building") == "parking", F.lit(False))
    named = [F.when(x != 0, x) for x in (lenient_int(tag(tags, "building:levels")), lenient_int(tag(tags, "parking:levels")))]
    levels = F.greatest(F.coalesce(*named, F.lit(1)), F.lit(1))
    by_area = area_m2 / F.when(kind.isin(*STREET), F.lit(M2_STREET)).otherwise(F.lit(M2_LOT))
    plausible = (capacity > 0) & (area_m2 >= capacity * F.lit(M2_PLAUSIBLE[0])) & (area_m2 <= capacity * F.lit(M2_PLAUSIBLE[1]))
    return (
        F.when(F.coalesce(tag(tags, "access").isin(*CLOSED_ACCESS), F.lit(False)), F.lit(0.0))
        .when(area_m2.isNull() | (area_m2 <= 0), F.lit(0.0))
        .when(deck & (capacity > 0), capacity.cast("double"))
        .when(deck, area_m2 * levels / F.lit(M2_LOT))
        .when(plausible, capacity.cast("double"))
        .otherwise(by_area)
    )


def school_class(school_tag: Column, name: Column) -> Column:
    """primary, secondary, sen or unknown: by the tag, then by the name where only one pattern matches."""
    t, n = F.lower(F.coalesce(school_tag, F.lit(""))), F.coalesce(name, F.lit(""))
    p, s = n.rlike(PRIMARY_NAME), n.rlike(SECONDARY_NAME)
    return F.when(t.contains("secondary"), "secondary").when(t.contains("primary"), "primary").when(t.contains("special") | (t == "sen"), "sen").when(s & ~p, "secondary").when(p & ~s, "primary").otherwise("unknown")


def school_enrolment(school_tag: Column, name: Column, jurisdiction: Column) -> Column:
    """Mean enrolment of the class; unknown counts as primary, a null jurisdiction as RoI."""
    cls, where = school_class(school_tag, name), F.coalesce(jurisdiction, F.lit("RoI"))
    out = F.lit(None).cast("int")
    for (j, c), n in ENROLMENT.items():
        mine = (cls == "secondary") if c == "secondary" else cls.isin("primary", "unknown")
        out = F.when((where == j) & mine, F.lit(n)).otherwise(out)
    return F.when(cls == "sen", F.lit(ENROLMENT_SPECIAL)).otherwise(out)


def first_match(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Key of the first pattern in the list that occurs in the text; null if none."""
    out = F.lit(None).cast("string")
    for key, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(key)).otherwise(out)
    return out


def limit_kmh(value: Column) -> Column:
    """A speed limit tag in km/h; 0 where it sets none."""
    s = F.lower(F.trim(value))
    number = F.regexp_extract(s, r"^(\d+)", 1)
    out = F.lit(0.0)
    kind = F.regexp_extract(s, r"^[a-z][a-z]:([a-z]+)", 1)
    for k, v in TYPE_KMH.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    for k, v in SYMBOLIC_KMH.items():
        out = F.when(s == k, F.lit(v)).otherwise(out)
    mph = s.contains("mph") | s.contains("mp/h")
    return F.when(value.isNull(), F.lit(0.0)).when(number != "", number.try_cast("double") * F.when(mph, F.lit(MPH_KMH)).otherwise(F.lit(1.0))).otherwise(out)


def road_class(highway: Column) -> Column:
    return F.when(highway.isin(*CLASS_KMH), highway).otherwise("other")


def speed_band(kmh: Column) -> Column:
    """The nearest mph band within three, other, or untagged where there is no limit."""
    mph, out = kmh / F.lit(MPH_KMH), F.lit("other")
    for b in reversed(BANDS_MPH):
        out = F.when(F.abs(mph - F.lit(float(b))) <= SNAP_MPH, F.lit(str(b))).otherwise(out)
    return F.when(kmh.isNull() | (kmh <= 0), F.lit("untagged")).otherwise(out)


def band_of_tags(tags: Column) -> Column:
    """The band of the first of the limit tags that is present."""
    return speed_band(limit_kmh(F.coalesce(*(tag(tags, k) for k in LIMIT_KEYS))))


def base_kmh(cls: Column, band: Column, measured: Column | None = None) -> Column:
    """A measured speed, else the class's where there is no band, else a share of the band's."""
    by_class = F.lit(float(CLASS_KMH["other"]))
    for k, v in CLASS_KMH.items():
        by_class = F.when(cls == k, F.lit(float(v))).otherwise(by_class)
    own = F.when(band.isin("untagged", "other"), by_class).otherwise(band.try_cast("double") * F.lit(MPH_KMH * TAGGED_SHARE))
    return own if measured is None else F.coalesce(F.when(measured > 0, measured), own)


def bucket_key(cls: Column, band: Column) -> Column:
    return F.concat_ws("|", cls, band)


def bucket_index(cls: Column, band: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, CLASS_KMH)), cls) - 1) * len(BANDS) + F.array_position(F.array(*map(F.lit, BANDS)), band) - 1


def bucket_of_index(index: Column) -> Column:
    return F.struct(F.element_at(F.array(*map(F.lit, CLASS_KMH)), (F.floor(index / len(BANDS)) + 1).cast("int")).alias("cls"), F.element_at(F.array(*map(F.lit, BANDS)), (F.pmod(index, F.lit(len(BANDS))) + 1).cast("int")).alias("band"))


def edge_seconds(factor: Column, length_m: Column, kmh: Column) -> Column:
    """Travel time of an edge; an absent factor is 1."""
    return F.coalesce(factor, F.lit(1.0)) * length_m * F.lit(3.6) / kmh


#: Trip weights of amenities and shops, of any office, of anything else named, and amenities that are none.
POI_WEIGHTS = {"hospital": 5.0, "cinema": 3.0, "theatre": 3.0, "fuel": 2.0, "fast_food": 1.5, "place_of_worship": 0.5, "atm": 0.5, "toilets": 0.25, "supermarket": 1.5}
POI_OFFICE, POI_OTHER = 2.0, 1.0
POI_NONE = ("parking", "parking_space", "parking_entrance", "vending_machine", "post_box", "waste_basket", "bench", "bicycle_parking", "recycling", "shelter", "telephone", "grit_bin")


def poi_weight(tags: Column) -> Column:
    """The weight of a place by its amenity, else its shop, else its office; null if it is none or excluded."""
    table = F.create_map(*(F.lit(x) for k, v in POI_WEIGHTS.items() for x in (k, v)))
    named = [F.when(tag(tags, k) != "", tag(tags, k)) for k in ("amenity", "shop", "office")]
    amenity, shop, office = (F.when(n.isNotNull(), F.coalesce(F.try_element_at(table, n), F.lit(other))) for n, other in zip(named, (POI_OTHER, POI_OTHER, POI_OFFICE)))
    return F.when(F.coalesce(named[0].isin(*POI_NONE), F.lit(False)), F.lit(None).cast("double")).otherwise(F.coalesce(amenity, shop, office))


def geocode_queries(name: Column, jurisdiction: Column, town: Column, line: Column, postcode: Column, county: Column, eircode: Column) -> Column:
    """(queries, centroid): search texts from precise to coarse, and the place from 0 of the one by postcode alone, -2 if there is none."""
    given = lambda c: F.when(c != "", c)
    t, a, p, c, e = map(given, (town, line, postcode, county, eircode))
    north = F.array(F.concat_ws(", ", name, t, F.lit("Northern Ireland")), F.concat_ws(", ", a, t, F.coalesce(p, F.lit("")), F.lit("Northern Ireland")), p)
    north_ok = F.array(t.isNotNull(), t.isNotNull() & a.isNotNull(), p.isNotNull())
    south = F.array(F.concat_ws(", ", name, c, F.lit("Ireland")), F.concat_ws(", ", a, c, F.lit("Ireland")), F.concat_ws(", ", e, F.lit("Ireland")))
    south_ok = F.array(c.isNotNull(), c.isNotNull() & a.isNotNull(), e.isNotNull())
    is_north = F.coalesce(jurisdiction == "NI", F.lit(False))
    both = F.zip_with(F.when(is_north, north).otherwise(south), F.when(is_north, north_ok).otherwise(south_ok), lambda q, ok: F.when(ok, q))
    kept = F.filter(both, lambda q: q.isNotNull())
    return F.struct(kept.alias("queries"), F.when(F.when(is_north, p).otherwise(e).isNotNull(), F.size(kept) - 1).otherwise(F.lit(-2)).alias("centroid"))
