"""Enrichment: direction, place, asset, threat list and severity, in that order; no event is ever lost by it.

Lookups are worked out for distinct addresses, hosts and names of the events as they came in (``base``: steps do not change those), and joined
back, so no step is worked out again for the next one; small tables of networks and assets are broadcast by Spark
if their size is known to be small.  Events are those of ``normalise.normalised``; each needs an ``event_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from . import lookups
from .normalise import HASHES, _put

# The code and names for addresses that are not routed publicly, and the networks that are reserved.
PRIVATE_CODE, PRIVATE_NAME = "XL", "Lab (private range)"
RESERVED = ("0.0.0.0/32", "255.255.255.255/32", "224.0.0.0/4", "::/128", "ff00::/8")


@dataclass
class Tables:
    """What events are enriched from; each table may be missing.

    places: (cidr, name, country_iso_code, country_name, city_name, organization, lat, lon); ranges: (lo, hi, cc) in the keys of ``ip_key``;
    countries: (cc, country, continent); hosts, addresses: (key, asset struct<role, owner, criticality, os>); zones: (cidr, zone, ord);
    networks: (cidr, description); domains, hashes: (indicator, description).
    """

    lab: tuple[str, ...] = ()
    places: DataFrame | None = None
    ranges: DataFrame | None = None
    countries: DataFrame | None = None
    hosts: DataFrame | None = None
    addresses: DataFrame | None = None
    zones: DataFrame | None = None
    networks: DataFrame | None = None
    domains: DataFrame | None = None
    hashes: DataFrame | None = None


def direction(source: Column, destination: Column, lab: tuple[str, ...]) -> Column:
    """internal, outbound, inbound or external by which ends are in the lab's networks; one end alone tells, too; null without any."""
    inside = lambda c: scalar.in_networks(c, lab)
    both = F.when(inside(source), F.when(inside(destination), "internal").otherwise("outbound")).otherwise(F.when(inside(destination), "inbound").otherwise("external"))
    one = F.when(source.isNotNull(), F.when(inside(source), "internal").otherwise("inbound")).when(destination.isNotNull(), F.when(inside(destination), "internal").otherwise("outbound"))
    return F.when(source.isNotNull() & destination.isNotNull(), both).otherwise(one)


def directed(events: DataFrame, lab: tuple[str, ...]) -> DataFrame:
    """A direction that the parser knows stays; the zones' direction is written in any case."""
    found = direction(F.col("source_ip"), F.col("destination_ip"), lab)
    return events.withColumn("extra", _put(F.col("extra"), network__direction=F.coalesce(F.col("extra")["network.direction"], found), palisade__network__zone_direction=found))


_PLACE = "struct<name:string,country_iso_code:string,country_name:string,city_name:string,organization:string,continent:string,lat:double,lon:double>"


def places(ips: DataFrame, tables: Tables) -> DataFrame:
    """(ip, place): of distinct addresses the own networks' place (the longest prefix), else reserved, private, by the country table, or unknown."""
    ip, null = F.col("ip"), F.lit(None).cast("string")
    out = ips.select("ip")
    if tables.places is not None:
        own = tables.places.select("cidr", F.struct(*[F.col(c).cast("double" if c in ("lat", "lon") else "string").alias(c) for c in ("name", "country_iso_code", "country_name", "city_name", "organization")], null.alias("continent"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("own"))
        out = lookups.by_network(out, own, ip, "cidr", "own", "ip")
    else:
        out = out.withColumn("own", F.lit(None).cast(_PLACE))
    if tables.ranges is not None:
        out = out.join(lookups.country(out, tables.ranges, ip, "ip"), "ip", "left")
    else:
        out = out.withColumn("cc", null)
    if tables.countries is not None:
        out = out.join(tables.countries.groupBy("cc").agg(F.min(F.struct("country", "continent")).alias("__c")), "cc", "left").select("ip", "own", "cc", "__c.country", "__c.continent")
    else:
        out = out.withColumn("country", null).withColumn("continent", null)

    def place(name: Column, code: Column = null, country: Column = null, continent: Column = null) -> Column:
        nothing = F.lit(None).cast("double")
        return F.struct(name.alias("name"), code.alias("country_iso_code"), country.alias("country_name"), null.alias("city_name"), null.alias("organization"), continent.alias("continent"), nothing.alias("lat"), nothing.alias("lon"))

    shown = F.coalesce("country", "cc")
    private = place(F.when(scalar.in_networks(ip, tables.lab), "Lab-Network").otherwise("Lab-Private"), F.lit(PRIVATE_CODE), F.lit(PRIVATE_NAME))
    found = F.when(F.col("own").isNotNull(), F.col("own").cast(_PLACE)).when(scalar.in_networks(ip, RESERVED), place(F.lit("Reserved"))).when(scalar.is_private(ip), private).when(F.col("cc").isNotNull(), place(shown, F.col("cc"), shown, F.col("continent"))).otherwise(place(F.lit("Unknown")))
    return out.select("ip", F.when(scalar.ip_key(ip).isNotNull(), found).alias("place"))


def located(events: DataFrame, tables: Tables, base: DataFrame | None = None) -> DataFrame:
    """Places of source and destination."""
    ips = (events if base is None else base).select(F.explode(F.array("source_ip", "destination_ip")).alias("ip")).where("ip is not null").distinct()
    found = places(ips, tables)
    for side in ("source", "destination"):
        events = events.join(found.select(F.col("ip").alias(f"{side}_ip"), F.col("place").alias("__p")), f"{side}_ip", "left")
        p = F.col("__p")
        given = {f"{side}__geo__{k}": p[k] for k in ("name", "country_iso_code", "country_name", "city_name", "continent")} | {f"{side}__as__organization__name": p["organization"], f"{side}__geo__location": F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), F.concat_ws(",", p["lat"], p["lon"]))}
        events = events.withColumn("extra", _put(F.col("extra"), **given)).drop("__p")
    return events


def owned(events: DataFrame, tables: Tables, base: DataFrame | None = None) -> DataFrame:
    """The asset by the host's short name, else by the first of its addresses that is known; zones (the first in order) name the places."""
    columns, base = events.columns, events if base is None else base
    if tables.hosts is not None or tables.addresses is not None:
        short = F.lower(F.substring_index(F.col("host"), ".", 1))
        null = F.lit(None).cast("struct<role:string,owner:string,criticality:string,os:string>")
        out = events
        if tables.hosts is not None:
            t = tables.hosts.groupBy(F.lower(F.substring_index("key", ".", 1)).alias("__h")).agg(F.min("asset").alias("__a"))
            out = out.withColumn("__h", short).join(t, "__h", "left").drop("__h")
        else:
            out = out.withColumn("__a", null)
        if tables.addresses is not None:
            # Addresses are asked for distinct lists of them.
            out = out.withColumn("__ips", F.col("extra")["host.ip"])
            lists = base.select(F.col("extra")["host.ip"].alias("__ips")).where("__ips is not null").distinct()
            by = lookups.by_any_key(lists, tables.addresses, F.transform(F.split("__ips", ","), lambda x: F.trim(x)), "key", "asset", "__ips")
            out = out.join(by, "__ips", "left").withColumn("__a", F.coalesce("__a", "asset"))
        a = F.col("__a")
        given = {"host__role": a["role"], "palisade__asset__owner": a["owner"], "palisade__asset__criticality": F.when(a.isNotNull(), F.lower(F.coalesce(a["criticality"], F.lit("medium")))), "host__os__name": F.coalesce(F.col("extra")["host.os.name"], a["os"])}
        events = out.withColumn("extra", _put(F.col("extra"), **given)).select(*columns)
    if tables.zones is not None:
        ips = base.select(F.explode(F.array("source_ip", "destination_ip")).alias("ip")).where("ip is not null").distinct()
        zones = lookups.by_network(ips, tables.zones, F.col("ip"), "cidr", "zone", "ip", "ord")
        for side in ("source", "destination"):
            events = events.join(zones.select(F.col("ip").alias(f"{side}_ip"), F.col("zone").alias("__z")), f"{side}_ip", "left")
            events = events.withColumn("extra", _put(F.col("extra"), **{f"{side}__geo__name": F.col("__z")})).drop("__z")
    return events.select(*columns)


def listed(events: DataFrame, tables: Tables, base: DataFrame | None = None) -> DataFrame:
    """The first hit of a threat list counts: addresses (an exact one before a network), then names by their suffixes, then hashes, each in the order of its fields."""
    columns, base, value = events.columns, events if base is None else base, lambda n: F.col("extra")[n]
    asked = []
    if tables.networks is not None:
        asked.append(("ipv4-addr", [F.col("source_ip"), F.col("destination_ip")], lambda d: lookups.by_network(d, tables.networks, F.col("v"), "cidr", "description", "v")))
    if tables.domains is not None:
        names = tables.domains.groupBy(F.regexp_replace(F.lower("indicator"), r"\.$", "").alias("ind")).agg(F.min("description").alias("description"))
        asked.append(("domain-name", [value("dns.question.name"), value("destination.domain"), value("url.domain")], lambda d: lookups.by_suffix(d, names, "v", "ind", "v").join(names, "ind")))
    if tables.hashes is not None:
        asked.append(("file-hash", [value(h) for h in (HASHES[2], HASHES[0], HASHES[1], HASHES[5])], lambda d: lookups.by_key(d.withColumn("__l", F.lower("v")), tables.hashes.select(F.lower("indicator").alias("ind"), "description"), "__l", "ind", ["description"])))
    hits = []
    for kind, fields, found in asked:
        # One lookup a kind: of the distinct values of all its fields.
        distinct = base.select(F.explode(F.array_compact(F.array(*fields))).alias("v")).distinct()
        answers = found(distinct).where("description is not null").select("v", "description")
        for i, c in enumerate(fields):
            name = f"__{kind}{i}"
            hits.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(kind).alias("type"), c.alias("value"), F.col(name).alias("description"))))
            events = events.withColumn("__v", c).join(answers.select(F.col("v").alias("__v"), F.col("description").alias(name)), "__v", "left").drop("__v")
    hit = F.coalesce(*hits) if hits else F.lit(None).cast("struct<type:string,value:string,description:string>")
    given = {"threat__indicator__matched": F.when(hit.isNotNull(), F.lit("true")), "threat__indicator__type": hit["type"], "threat__indicator__value": hit["value"], "threat__indicator__description": hit["description"]}
    out = events.withColumn("tags", scalar.with_tag(F.col("tags"), "threat-intel-match", hit.isNotNull()))
    return out.withColumn("extra", _put(F.col("extra"), **given)).select(*columns)


def scored(events: DataFrame) -> DataFrame:
    """events with ``severity_score``: the severity's number (10 without one), raised by the threat list and by the asset's worth."""
    named = F.create_map(*[F.lit(x) for pair in scalar.SEVERITIES.items() for x in pair])[F.lower("severity")]
    base = F.coalesce(named, F.col("severity").try_cast("int"), F.lit(10))
    matched = F.coalesce(F.col("extra")["threat.indicator.matched"] == "true", F.lit(False))
    return events.withColumn("severity_score", scalar.boosted_severity(F.when(matched, F.greatest(base, F.lit(scalar.SEVERITIES["high"]))).otherwise(base), F.col("extra")["palisade.asset.criticality"], F.lit(False)).cast("int"))


def enriched(events: DataFrame, tables: Tables) -> DataFrame:
    columns = events.columns
    out = located(directed(events, tables.lab), tables, events)
    return scored(listed(owned(out, tables, events), tables, events)).select(*columns, "severity_score")


def inventory(spark: SparkSession, path: str) -> Tables:
    """hosts, addresses and zones of an inventory file (YAML): assets with hostnames, ips and what is known of them; zones with networks.  A bad network is left out."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    many = lambda a, plural, single: [str(x) for x in a.get(plural) or ([a[single]] if a.get(single) else [])]
    assets = [a for a in data.get("assets") or [] if isinstance(a, dict)]
    known = lambda a: tuple(None if a.get(k) is None else str(a[k]) for k in ("role", "owner", "criticality", "os"))
    ddl = "key string, asset struct<role:string,owner:string,criticality:string,os:string>"
    hosts = {h.lower().split(".")[0]: known(a) for a in assets for h in many(a, "hostnames", "hostname")}  # of equal names the last counts
    ips = {i: known(a) for a in assets for i in many(a, "ips", "ip")}
    zones = [(c, str(z.get("name", c)), n) for n, (c, z) in enumerate((c, z) for z in data.get("zones") or [] for c in z.get("cidrs") or [])]
    return Tables(hosts=spark.createDataFrame(list(hosts.items()), ddl), addresses=spark.createDataFrame(list(ips.items()), ddl), zones=spark.createDataFrame(zones, "cidr string, zone string, ord int"))
