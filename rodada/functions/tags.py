"""Rules over OpenStreetMap tag maps as Column expressions: classification, cycling cost, one-way directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highway penalties, the cheapest factor, and labels that results carry.
HIGHWAY_PENALTY = {
    "cycleway": 0.75,
    "path": 0.90,
    "living_street": 0.95,
    "residential": 1.05,
    "unclassified": 1.10,
    "service": 1.15,
    "pedestrian": 1.20,
    "track": 1.25,
    "tertiary": 1.45,
    "tertiary_link": 1.50,
    "secondary": 1.90,
    "secondary_link": 1.95,
    "primary": 2.60,
    "primary_link": 2.65,
    "trunk": 3.80,
    "trunk_link": 3.90,
}
OTHER_PENALTY = 1.15
LEAST_PENALTY = 0.70
MOTORWAYS = ("motorway", "motorway_link")
ROUGH_SURFACES = ("unpaved", "gravel", "ground", "dirt", "compacted")
ACCESS_HIGHWAYS = ("residential", "living_street", "service", "unclassified", "pedestrian", "footway", "track")
NO_STREET = "Calle sin nombre"
NO_CYCLEWAY = "Vía ciclista sin nombre"
UNKNOWN = "Sin información"


def tag(tags: Column, key: str) -> Column:
    """The tag's value, '' if absent."""
    return F.coalesce(tags[key], F.lit(""))


def lowered(tags: Column, key: str) -> Column:
    return F.lower(tag(tags, key))


def _side(tags: Column, *sides: str) -> list[Column]:
    return [tag(tags, f"cycleway:{s}") for s in sides]


def _any(cols: list[Column], *values: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isin(*values)
    return out


def classify_cycleway(tags: Column) -> Column:
    """struct(category, label) of a cycling way."""
    named = F.exists(F.map_keys(tags), lambda k: k.startswith("cycleway"))
    main, sides = tag(tags, "cycleway"), _side(tags, "left", "right", "both")
    kind = lambda category, label: F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"))
    street = "Infraestructura ciclista sobre calle"
    return (
        F.when((tag(tags, "highway") == "cycleway") & (tag(tags, "segregated") == "yes"), kind("dedicated", "Vía ciclista dedicada (segregada)"))
        .when(tag(tags, "highway") == "cycleway", kind("dedicated", "Vía ciclista dedicada"))
        .when(named & _any([main, *sides], "track"), kind("on_street", f"{street} (segregada / track)"))
        .when(named & (_any([main], "lane", "share_busway") | _any(sides, "lane")), kind("on_street", f"{street} (ciclobanda / lane)"))
        .when(named, kind("on_street", street))
        .when(tag(tags, "bicycle") == "designated", kind("designated", "Vía designada / preferente para bicicleta"))
        .otherwise(kind("compatible", "Infraestructura ciclista compatible"))
    )


def number_in(text: Column, dot: bool) -> Column:
    """The digits of a text (and dots) as a number; null if they don't make one."""
    kept = F.regexp_replace(text, "[^0-9.]" if dot else "[^0-9]", "")
    return kept.try_cast("double")


def base_penalty(highway: Column) -> Column:
    """Penalty of a highway type without cycling infrastructure."""
    table = F.create_map(*[F.lit(x) for pair in HIGHWAY_PENALTY.items() for x in pair])
    return F.coalesce(table[highway], F.lit(OTHER_PENALTY))


def may_cycle(tags: Column) -> Column:
    """Whether bicycles may use a road: is_cyclable of its cost, for little work."""
    return ~(tag(tags, "highway").isin(*MOTORWAYS) | _private(tags) | lowered(tags, "bicycle").isin("no", "use_sidepath"))


def _private(tags: Column) -> Column:
    return lowered(tags, "access").isin("no", "private") & ~lowered(tags, "bicycle").isin("yes", "designated", "permissive")


def cycling_cost(tags: Column) -> Column:
    """struct(is_cyclable, penalty, category, label) of a road."""
    highway, bicycle = tag(tags, "highway"), lowered(tags, "bicycle")
    lane_values = ("track", "lane", "opposite_track", "opposite_lane", "share_busway", "yes")
    marked = (highway == "cycleway") | F.exists(F.map_entries(tags), lambda e: e["key"].startswith("cycleway") & e["value"].isin(*lane_values))
    protected = (highway == "cycleway") | _any([tag(tags, "cycleway"), *_side(tags, "left", "right", "both")], "track")
    segregated = tag(tags, "segregated") == "yes"
    base = base_penalty(highway)
    speed, lanes = number_in(tag(tags, "maxspeed"), True), number_in(tag(tags, "lanes"), False)
    calmed = F.when(speed <= 30, base * 0.9).when(speed >= 60, base + 0.4).when(speed >= 50, base + 0.2).otherwise(base)
    wide = calmed + F.when(lanes >= 4, 0.5).when(lanes >= 3, 0.25).otherwise(0.0)
    full = wide + F.when(lowered(tags, "surface").isin(*ROUGH_SURFACES), 0.35).otherwise(0.0)

    def out(ok: bool, penalty: Column | float, category: Column | str, label: Column | str) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(ok).alias("is_cyclable"), lit(penalty).cast("double").alias("penalty"), lit(category).alias("category"), lit(label).alias("label"))

    blocked = lambda why: out(False, float("inf"), "blocked", why)
    known = highway.isin(*HIGHWAY_PENALTY)
    street = F.when(known, F.concat(F.lit("Calle vehicular ("), highway, F.lit(")"))).otherwise(F.concat(F.lit("Vía urbana ("), F.when(highway == "", "general").otherwise(highway), F.lit(")")))
    return (
        F.when(highway.isin(*MOTORWAYS), blocked("Autopista vehicular no permitida"))
        .when(_private(tags), blocked("Acceso prohibido"))
        .when(bicycle.isin("no", "use_sidepath"), blocked("Prohibido para bicicletas"))
        .when(protected & segregated, out(True, 0.70, "dedicated_cycleway", "Ciclovía segregada protegida"))
        .when(protected, out(True, 0.78, "dedicated_cycleway", "Ciclovía dedicada"))
        .when(marked, out(True, 0.88, "cycle_lane", "Ciclobanda demarcada"))
        .when(bicycle == "designated", out(True, 0.88, "cycle_lane", "Vía con preferencia ciclista"))
        .otherwise(out(True, F.round(full, 3), F.when(base >= 1.8, "arterial_street").otherwise("local_street"), street))
    )


def directions(tags: Column) -> Column:
    """struct(forward, backward): which ways a bicycle may take a road."""
    own, general = lowered(tags, "oneway:bicycle"), lowered(tags, "oneway")
    contra = _any([lowered(tags, k) for k in ("cycleway", "cycleway:left", "cycleway:right")], "opposite", "opposite_lane", "opposite_track")
    way = lambda f, b: F.struct(F.lit(f).alias("forward"), F.lit(b).alias("backward"))
    return (
        F.when(own.isin("no", "0", "false"), way(True, True))
        .when(own.isin("yes", "1", "true"), way(True, False))
        .when(own.isin("-1", "reverse"), way(False, True))
        .when(contra, way(True, True))
        .when(general.isin("yes", "1", "true"), way(True, False))
        .when(general.isin("-1", "reverse"), way(False, True))
        .otherwise(way(True, True))
    )


def is_infra(category: Column) -> Column:
    """Whether a cost category is cycling infrastructure."""
    return category.isin("dedicated_cycleway", "cycle_lane")


def or_default(value: Column, default: str) -> Column:
    """The value, or the default for null and ''."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def cycleway_display(tags: Column) -> Column:
    """struct(name, has_custom_name, surface, surface_display, segregated, segregated_display); raw values stay null."""
    segregated = tags["segregated"]
    return F.struct(
        or_default(tags["name"], NO_CYCLEWAY).alias("name"),
        (tag(tags, "name") != "").alias("has_custom_name"),
        tags["surface"].alias("surface"),
        or_default(tags["surface"], UNKNOWN).alias("surface_display"),
        segregated.alias("segregated"),
        F.when(segregated == "yes", "Segregada físicamente").when(segregated == "no", "No segregada").otherwise(UNKNOWN).alias("segregated_display"),
    )
