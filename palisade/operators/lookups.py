"""Lookups: by equal key, by a list of keys, by range or network, by the last start before, by domain suffix.

A lookup table is broadcast only if Spark's statistics of its files keep it below the session's threshold, or if it was counted and has ``TOLD`` rows at
most; all lookups are equi-joins, ranges through buckets of their leading digits, so none becomes a join of all rows with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import domain_suffixes, ip_key, let, network_keys


#: Rows of ranges or networks that every task may hold.
TOLD = 10_000


def by_key(df: DataFrame, table: DataFrame, left: str, right: str, columns: list[str]) -> DataFrame:
    """df with the table's columns; of rows with one key the least (in the order of the columns) counts."""
    t = table.where(F.col(right).isNotNull()).groupBy(F.col(right).alias("__k")).agg(F.min(F.struct(*columns)).alias("__v"))
    return df.join(t, df[left] == F.col("__k"), "left").select(*[df[c] for c in df.columns], *[F.col(f"__v.{c}").alias(c) for c in columns])


def by_any_key(df: DataFrame, table: DataFrame, keys: Column, right: str, value: str, row_id: str) -> DataFrame:
    """(row_id, value): the value of the first of a row's keys (an array) that the table has."""
    t = table.where(F.col(right).isNotNull()).groupBy(F.col(right).alias("__k")).agg(F.min(value).alias("__v"))
    asked = df.select(row_id, F.posexplode(keys).alias("__pos", "__k"))
    hit = asked.join(t, "__k").groupBy(row_id).agg(F.min_by("__v", "__pos").alias(value))
    return df.select(row_id).join(hit, row_id, "left")


def by_range(df: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, name: str, order: str, row_id: str, width: int, longest: bool = False, told: int = TOLD) -> DataFrame:
    """(row_id, name): for each row the range that holds its value: the first by ``order``, or the narrowest.

    width: of the least bucket; others are 64 times as wide each.  A range is told to the buckets of the level at which it touches two or three, so a wide
    one is not told to many; a value asks its own bucket at each level that ranges have.  Levels have few buckets or many ranges: those of up to ``told``
    ranges are told to all tasks, where a row picks its range by itself; rows are shuffled for the other levels only.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.lit(1.0), (F.col(hi) - F.col(lo) + 1) / width)) / F.log(F.lit(64.0)))).cast("int")
    size = lambda lv: (F.lit(float(width)) * F.pow(F.lit(64.0), lv))
    cells = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__l", level).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / size(F.col("__l"))), F.floor(F.col(hi) / size(F.col("__l"))))))
    best = F.struct((F.col(hi) - F.col(lo)).alias("w"), F.col(order).alias("o")) if longest else F.struct(F.col(order).alias("o"))
    cells = cells.select("__l", "__b", F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.struct(best.alias("best"), F.col(name).alias("name")).alias("is")).alias("__c"))
    counts = dict(map(tuple, cells.groupBy("__l").count().collect()))
    bucket = lambda lv: F.floor(F.col("__v") / size(lv))
    out, picked, small = df.select(row_id, F.col(value).alias("__v")), [], 0
    for lv, n in sorted(counts.items()):
        if small + n <= told:
            small += n
            lists = cells.where(F.col("__l") == lv).groupBy("__b").agg(F.collect_list("__c").alias(f"__c{lv}"))
            out = out.withColumn("__b", bucket(F.lit(lv))).join(F.broadcast(lists), "__b", "left").drop("__b")
            picked.append(F.array_min(F.transform(F.filter(f"__c{lv}", lambda c: F.col("__v").between(c["lo"], c["hi"])), lambda c: c["is"])))
    wide = [lv for lv in sorted(counts) if f"__c{lv}" not in out.columns]
    if wide:
        asked = df.select(row_id, F.col(value).alias("__v"), F.explode(F.array(*map(F.lit, wide))).alias("__l")).withColumn("__b", bucket(F.col("__l")))
        hit = asked.join(cells, ["__l", "__b"]).where(F.col("__v").between(F.col("__c.lo"), F.col("__c.hi")))
        out = out.join(hit.groupBy(row_id).agg(F.min("__c.is").alias("__wide")), row_id, "left")
        picked.append(F.col("__wide"))
    found = F.least(*picked) if len(picked) > 1 else picked[0] if picked else F.lit(None).cast(cells.schema["__c"].dataType["is"].dataType)
    return out.select(row_id, found["name"].alias(name))


def by_network(df: DataFrame, networks: DataFrame, ip: Column, cidr: str, value: str, row_id: str, order: str | None = None) -> DataFrame:
    """(row_id, value): for each row's address, of either version, the value of the network that holds it: the first by ``order``, else the longest prefix.

    Of each prefix length that the networks have an address asks one key, its own digits up to there; lengths number 160 at most.
    """
    nets = networks.select(network_keys(F.trim(F.col(cidr))).alias("__n"), F.col(value), (F.col(order) if order else F.lit(0)).alias("__o")).where("__n is not null")
    nets = nets.select(F.concat(F.substring("__n.lo", 1, 1), F.lpad(F.col("__n.width").cast("string"), 3, "0")).alias("__w"), F.col("__n.lo").alias("__lo"), "__n.width", "__o", value)
    counts = dict(map(tuple, nets.groupBy("__w").count().collect()))
    lengths = sorted(counts)
    if sum(counts.values()) <= TOLD:
        nets = F.broadcast(nets)  # a network may hold all addresses
    address = F.regexp_replace(ip, "^::ffff:(?=[0-9.]+$)", "")
    distinct = df.select(address.alias("__ip"), ip_key(ip).alias("__key")).where("__key is not null").distinct()
    asked = distinct.select("__ip", F.explode(F.filter(asks_for(F.col("__ip"), lengths), lambda x: x["__lo"].isNotNull())).alias("__a")).select("__ip", "__a.*")
    best = F.struct("__o", (-F.col("width")).alias("w"), value) if order else F.struct((-F.col("width")).alias("w"), value)
    found = asked.join(nets, ["__w", "__lo"]).groupBy("__ip").agg(F.min(best).alias("__b")).select("__ip", F.col(f"__b.{value}").alias(value))
    return df.select(row_id, address.alias("__ip")).join(found, "__ip", "left").select(row_id, value)


def asks_for(address: Column, lengths: list[str]) -> Column:
    """What an address asks for: each prefix length of its own version, with the first key of its network of that length."""
    own = lambda x: F.filter(F.array(*map(F.lit, lengths)).cast("array<string>"), lambda w: w.startswith(F.substring(ip_key(x), 1, 1)))
    return let(address, lambda x: F.transform(own(x), lambda w: F.struct(w.alias("__w"), network_keys(F.concat(x, F.lit("/"), F.substring(w, 2, 3).cast("int").cast("string")))["lo"].alias("__lo"))))


def as_of(df: DataFrame, starts: DataFrame, value: str, lo: str, hi: str, name: str, row_id: str, key: str | None = None) -> DataFrame:
    """(row_id, name): of the rows of ``starts`` (ranges that do not overlap) the last that starts at the value or before, if the value does not pass its end.

    Both sides are dealt by ``key`` (a coarse part of the value, told to every part that a range touches) and sorted together; the last start is
    carried along, so a row is compared with nothing.
    """
    part = [key] if key else []
    marks = starts.select(*part, F.col(lo).alias("__at"), F.lit(0).alias("__o"), F.lit(None).alias("__row"), F.struct(F.col(hi).alias("hi"), F.col(name).alias("name")).alias("__s"))
    asked = df.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("__at"), F.lit(1).alias("__o"), F.col(row_id).alias("__row"), F.lit(None).alias("__s"))
    w = Window.partitionBy(*part or [F.lit(0)]).orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.unionByName(asked).withColumn("__s", F.last("__s", ignorenulls=True).over(w)).where("__o = 1")
    found = carried.select(F.col("__row").alias(row_id), F.when(F.col("__at") <= F.col("__s.hi"), F.col("__s.name")).alias(name))
    return df.select(row_id).join(found, row_id, "left")


def country(df: DataFrame, ranges: DataFrame, ip: Column, row_id: str) -> DataFrame:
    """(row_id, cc): the country of an address of either version, from ranges (lo, hi, cc) in the keys of ``ip_key``; unallocated ones (ZZ) are none.

    Distinct addresses are dealt by their first digits (those of an IPv4 /8 or an IPv6 /16); a range is cut where it crosses such parts.
    """
    prefix = lambda k: F.when(k.startswith("4"), F.concat(F.lit("4"), F.substring(k, 26, 2))).otherwise(F.substring(k, 1, 5))
    number = lambda p: F.conv(F.substring(p, 2, 4), 16, 10).cast("long")
    touched = F.sequence(number(prefix(F.col("lo"))), number(prefix(F.col("hi"))))
    digits = F.when(F.col("lo").startswith("4"), 2).otherwise(4)
    cut = ranges.where("lo <= hi").withColumn("__p", F.explode(touched)).withColumn("__p", F.concat(F.substring("lo", 1, 1), F.lpad(F.lower(F.hex("__p")), digits, "0")))
    # In each part the range that came in from the parts before starts first.
    ips = df.select(ip.alias("__ip"), ip_key(ip).alias("__key")).where("__key is not null").distinct().withColumn("__p", prefix(F.col("__key")))
    found = as_of(ips, cut, "__key", "lo", "hi", "cc", "__ip", "__p")
    return df.select(row_id, ip.alias("__ip")).join(found.where("cc != 'ZZ'"), "__ip", "left").select(row_id, "cc")


def by_suffix(df: DataFrame, listed: DataFrame, host: str, indicator: str, row_id: str) -> DataFrame:
    """(row_id, indicator): the most specific listed suffix (two labels or more) of the host."""
    asked = df.select(row_id, F.posexplode(domain_suffixes(F.col(host))).alias("pos", "__s"))
    names = listed.groupBy(F.regexp_replace(F.lower(indicator), r"\.$", "").alias("__s")).agg(F.min(indicator).alias("__i"))
    hit = asked.join(names, "__s")
    return df.select(row_id).join(hit.groupBy(row_id).agg(F.min_by("__i", "pos").alias(indicator)), row_id, "left")
