"""Scalar functions on log fields, as Column expressions that stay in the JVM."""

from __future__ import annotations

import datetime as dt
import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and scores.
SEVERITIES = {"informational": 10, "low": 30, "medium": 50, "high": 75, "critical": 95}
# Texts that stand for "no value".
EMPTY = ("-", "", "NULL SID", "(null)")
# Seconds of a duration's unit.
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}


def duration(text: str | float) -> float:
    """Seconds of ``5m``, ``1H``, ``250 ms``; a bare number is seconds."""
    if isinstance(text, int | float):
        return float(text)
    plain = str(text).strip().lower()
    unit = next((u for u in sorted(UNITS, key=len, reverse=True) if plain.endswith(u)), "")
    number = plain.removesuffix(unit).strip()
    if not number or set(number) - set("0123456789.") or number.count(".") > 1 or number == ".":
        raise ValueError(f"not a duration: {text!r}")
    return float(number) * UNITS.get(unit, 1.0)


def moment(text: str, now: dt.datetime) -> dt.datetime:
    """A time given as ``now``, ``now-15m``, ``now+1h`` or in ISO form, against the clock that the caller gives."""
    plain = text.strip()
    if plain.startswith("now"):
        rest = plain[3:]
        if rest and rest[0] not in "+-":
            raise ValueError(f"not a time: {text!r}")
        return now + dt.timedelta(seconds=duration(rest[1:]) * (-1 if rest[0] == "-" else 1)) if rest else now
    return dt.datetime.fromisoformat(plain)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none.  A mapped IPv6 prefix is dropped."""
    plain = F.regexp_replace(ip, r"^::ffff:", "")
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    parts = F.split(plain, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(plain.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), value)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def ipv6(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, whose order is that of the addresses; null if it is none.  A zone is dropped, a dotted tail is read."""
    group = lambda n: F.lower(F.hex(n))
    parts = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
    run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7}"
    tail = lambda t: ipv4(F.regexp_extract(t, r":([0-9.]+)$", 1))
    undotted = lambda t: let(tail(t), lambda n: F.when(t.contains("."), F.concat(F.regexp_extract(t, "^(.*:)[0-9.]+$", 1), group(F.shiftrightunsigned(n, 16)), F.lit(":"), group(n % 65536))).otherwise(t))

    def digits(p: Column) -> Column:
        short = p.contains("::")
        right = F.when(short, parts(F.substring_index(p, "::", -1))).otherwise(F.array().cast("array<string>"))

        def joined(x: Column) -> Column:
            n = F.size(x["left"]) + F.size(x["right"])
            every = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), x["right"])
            good = p.rlike(f"^(?:{run})?(?:::(?:{run})?)?$") & F.when(short, n <= 7).otherwise(n == 8)
            return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

        return let(F.struct(parts(F.substring_index(p, "::", 1)).alias("left"), right.alias("right")), joined)

    return let(F.regexp_replace(F.lower(ip), "%[^%/]+$", ""), lambda t: let(undotted(t), digits))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Two-valued membership; a bad address is in no network, nor is one of the other version (a mapped address is of both)."""
    lo, hi = cidr_bounds(cidr)
    if ":" in cidr:
        return F.coalesce(ipv6(ip).between(f"{lo:032x}", f"{hi:032x}"), F.lit(False))
    return F.coalesce(ipv4(ip).between(lo, hi), F.lit(False))


def ip_key(ip: Column) -> Column:
    """An address of either version as 33 characters whose order is that of the addresses within the version: ``4`` or ``6``, then 32 hexadecimal
    digits; null if it is none.  A mapped IPv4 address is one of version 4."""
    return let(ip, lambda x: F.coalesce(F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4(x))), 32, "0")), F.concat(F.lit("6"), ipv6(x))))


def network_keys(cidr: Column) -> Column:
    """struct(lo, hi, width) of a network (or a single address) in the keys of ``ip_key``; null if it is none.  width: fixed bits of the prefix."""
    base = ip_key(F.substring_index(cidr, "/", 1))
    size = lambda b: F.when(b.startswith("4"), 32).otherwise(128)
    given = lambda b: F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(size(b))

    def ends(x: Column) -> Column:
        # Digits before the prefix's end stay, those after it are filled, and the digit at it keeps its leading bits.
        fixed = x["bits"] + 128 - x["size"]  # of 128
        whole, rest = (fixed / 4).cast("int"), F.pmod(fixed, F.lit(4))
        digit = F.conv(F.substring(x["base"], whole + 2, F.lit(1)), 16, 10).try_cast("int")
        free = F.element_at(F.array(*[F.lit(n) for n in (15, 7, 3, 1)]), (rest + 1).cast("int"))
        mixed = lambda fill: F.when(whole < 32, F.lower(F.hex((digit - F.pmod(digit, free + 1) + (free if fill == "f" else 0)).cast("long")))).otherwise(F.lit(""))
        end = lambda fill: F.rpad(F.concat(F.substring(x["base"], F.lit(1), whole + 1), mixed(fill)), 33, fill)
        return F.when(x["base"].isNotNull() & (x["bits"] >= 0) & (x["bits"] <= x["size"]), F.struct(end("0").alias("lo"), end("f").alias("hi"), x["bits"].alias("width")))

    return let(base, lambda b: let(F.struct(b.alias("base"), size(b).alias("size"), given(b).alias("bits")), ends))


def ip_version(ip: Column) -> Column:
    return F.substring(ip_key(ip), 1, 1).cast("int")


# Networks that are not routed publicly.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "::1/128", "fc00::/7", "fe80::/10")


def in_networks(ip: Column, networks: list[str] | tuple[str, ...]) -> Column:
    """Whether an address is in one of a few networks; two-valued."""
    inside = lambda key: reduce(lambda a, b: a | b, [key.between(*_bounds(n)) for n in networks])
    return F.coalesce(let(ip_key(ip), inside), F.lit(False)) if networks else F.lit(False)


def _bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr, strict=False)
    return tuple(f"{net.version}{int(x):032x}" for x in (net.network_address, net.broadcast_address))


def is_private(ip: Column) -> Column:
    return in_networks(ip, PRIVATE)


def directory(path: Column) -> Column:
    cut = F.when(path.contains("\\"), F.regexp_extract(path, r"^(.*)\\[^\\]*$", 1)).otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    return F.nullif(cut, F.lit(""))


def extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1)), F.lit(""))


def arguments(command: Column, most: int = 64) -> Column:
    """struct(args, n): a command line cut at blanks outside quotes.  A Windows line (with a backslash or ending in .exe) keeps its quotes, as
    its programs read the line themselves; another one loses them."""
    windows = command.contains("\\") | F.lower(command).endswith(".exe")
    raw = F.regexp_extract_all(command, F.lit(r"((?:[^\s\"']|\"[^\"]*\"|'[^']*'|[\"'])+)"), F.lit(1))
    kept = F.regexp_extract_all(command, F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    bare = F.transform(raw, lambda x: F.regexp_replace(x, r"\"([^\"]*)\"|'([^']*)'", "$1$2"))
    return let(F.when(windows, kept).otherwise(bare), lambda a: F.struct(F.slice(a, 1, most).alias("args"), F.size(a).alias("n")))


def unhexed(value: Column) -> Column:
    """The text of hexadecimal bytes (an even number of digits, four or more, good UTF-8; NUL is a blank); anything else stays."""
    looks = value.rlike("^(?:[0-9A-Fa-f]{2}){2,}$")
    text = F.try_validate_utf8(F.unhex(value).cast("string"))
    return F.when(looks, F.coalesce(F.trim(F.translate(text, "\x00", " ")), value)).otherwise(value)


def hashes(text: Column) -> Column:
    """map algorithm -> value of ``MD5=..,SHA256=..``; keys and values in lower case, the first of equal keys."""
    pairs = F.filter(F.transform(F.split(F.lower(text), ","), lambda x: F.trim(x)), lambda x: x.contains("="))
    return _as_map(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.substring_index(x, "=", -1)).alias("value"))), last=False)


def mac(value: Column) -> Column:
    """``aa:bb:cc:dd:ee:ff`` of twelve hexadecimal digits with any separators; anything else only loses outer blanks."""
    plain = F.lower(F.translate(F.trim(value), "-:.", ""))
    return F.when(plain.rlike("^[0-9a-f]{12}$"), F.regexp_replace(plain, "(..)(?!$)", "$1:")).otherwise(F.nullif(F.trim(value), F.lit("")))


def mentions(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, in any case; two-valued."""
    return F.coalesce(F.lower(text).rlike("|".join("\\Q" + w + "\\E" for w in words)), F.lit(False))


def with_tag(tags: Column, tag: str, when: Column) -> Column:
    """The tags with one more, once, where the condition holds; order stays."""
    known = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.coalesce(when, F.lit(False)), F.array_union(known, F.array(F.lit(tag)))).otherwise(F.array_distinct(known))


def ordered_distinct(*values: Column) -> Column:
    """The values (strings or arrays of them) without nulls and repeats, in order."""
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(v, F.array().cast("array<string>")) for v in values])))


# syslog's facilities and severities, in the order of their codes, and the log level of each severity.
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SYSLOG_SEVERITIES = "emergency alert critical error warning notice informational debug".split()
LEVELS = ("critical", "critical", "critical", "error", "warning", "info", "info", "debug")


def priority(pri: Column) -> Column:
    """struct(facility, severity, level) of a syslog PRI number."""
    n = pri.try_cast("int")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    good = n.between(0, len(FACILITIES) * 8 - 1)
    return F.when(good, F.struct(pick(FACILITIES, F.floor(n / 8)).alias("facility"), pick(SYSLOG_SEVERITIES, n % 8).alias("severity"), pick(LEVELS, n % 8).alias("level")))


def local_time(ts: Column, offset_hours: float = 0.0, opens: int = 8, closes: int = 19) -> Column:
    """struct(hour, weekday, business_hours): local hour, mon..sun, and whether it is Monday to Friday from ``opens`` up to ``closes``."""
    local = F.timestamp_micros(F.unix_micros(ts) + int(offset_hours * 3_600_000_000))
    day = F.weekday(local)
    name = F.element_at(F.array(*[F.lit(x) for x in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")]), day + 1)
    open_ = (day < 5) & (F.hour(local) >= opens) & (F.hour(local) < closes)
    return F.struct(F.hour(local).alias("hour"), name.alias("weekday"), open_.alias("business_hours"))


def event_id(*parts: Column) -> Column:
    """An id that is the same whenever the same record is read: a replayed one meets itself."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 32)


def basename(path: Column) -> Column:
    return F.when(path.contains("\\"), F.regexp_extract(path, r"([^\\]*)$", 1)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def cleaned(value: Column) -> Column:
    return F.when(~F.trim(value).isin(*EMPTY), F.trim(value))


def registered_domain(host: Column) -> Column:
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), "."))


def domain_suffixes(host: Column) -> Column:
    """All suffixes of two labels or more, the longest first."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def user_parts(user: Column) -> Column:
    """struct(name, domain) of ``DOM\\user`` or ``user@dom``."""
    slash, at = user.contains("\\"), user.contains("@")
    name = F.when(slash, F.substring_index(user, "\\", -1)).when(at, F.substring_index(user, "@", 1)).otherwise(user)
    domain = F.when(slash, F.substring_index(user, "\\", 1)).when(at, F.substring_index(user, "@", -1))
    return F.struct(name.alias("name"), domain.alias("domain"))


def to_int(value: Column) -> Column:
    return F.when(value.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(value, 3, 64), 16, 10).try_cast("long")).otherwise(value.try_cast("long"))


def _as_map(entries: Column, last: bool = True) -> Column:
    """map of array<struct<key,value>>; of equal keys the last (or the first) counts.  Sorted by key and place, neighbours tell which one that is."""
    placed = F.array_sort(F.transform(entries, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value"))))
    at = 1 if last else -1

    def pick(s: Column) -> Column:
        chosen = F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i + at)["key"] == x["key"], F.lit(False)))
        return F.map_from_entries(F.transform(chosen, lambda x: F.struct(x["key"], x["value"])))

    return let(placed, pick)


def key_values(text: Column, bare: Callable[[Column, Column], Column] | None = None) -> Column:
    """map of KEY=value pairs, values bare or quoted; of equal keys the last counts.  ``bare`` gives the value of a key and its bare text."""
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][\w.\-]*=(?:\"[^\"]*\"|'[^']*'|\S*))"), F.lit(1))
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[^=]*=", ""), r"^[\"']|[\"']$", "")
    value = lambda p: F.when(p.rlike(r"^[^=]*=[\"']"), plain(p)).otherwise(bare(F.substring_index(p, "=", 1), plain(p))) if bare else plain(p)
    return _as_map(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), value(p).alias("value"))))


def boosted_severity(score: Column, criticality: Column, listed: Column) -> Column:
    """Score plus the asset's boost (only above 10), at most 100; at least 75 for what a threat list names."""
    boost = F.when(score > 10, F.when(criticality == "critical", 20).when(criticality == "high", 10).when(criticality == "low", -10).otherwise(0)).otherwise(0)
    raised = F.least(score + boost, F.lit(100))
    return F.when(listed, F.greatest(raised, F.lit(75))).otherwise(raised)


def canonical(value: Column, aliases: dict[str, str]) -> Column:
    """Lower case, ``-`` and blanks to ``_``, then the alias if there is one."""
    plain = F.translate(F.lower(F.trim(value)), "- ", "__")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.coalesce(table[plain], plain) if table is not None else plain


# The patterns of times in logs, as Spark's formatter writes them, and what a text that fits looks like.  A text that a formatter
# refuses costs an exception, many times the work of reading it, so only those of its shape are given to it.
TIMES = {
    "dd/MMM/yyyy:HH:mm:ss Z": r"^\d\d/\p{L}.* ", "dd/MMM/yyyy:HH:mm:ss": r"^\d\d/\p{L}[^ ]*$", "MM/dd/yyyy HH:mm:ss": r"^\d\d/\d\d/\+?\d{4}", "MM/dd/yy HH:mm:ss": r"^\d\d/\d\d/\d\d ", "yyyy/MM/dd HH:mm:ss": r"^\+?\d{4,}/",
    "dd.MM.yyyy HH:mm:ss": r"^\d\d\.", "MMM d HH:mm:ss.SSSSSS yyyy": r"^\p{L}.*\..* \+?\d{4,}$", "MMM d HH:mm:ss yyyy": r"^\p{L}[^.]* \+?\d{4,}$",
}


def timestamp(text: Column, reference_year: int | Column, now: Column | None = None) -> Column:
    """The first reading that fits: epoch seconds (with a fraction) or milliseconds, ISO, a date, and the patterns of TIMES; a leading weekday is left out.

    A time without a year gets the reference year, or that of ``now``; one over two days after ``now`` is of the year before.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    seconds = text.rlike(r"^\d{10}(?:\.\d+)?$")
    epoch = F.when(seconds, F.timestamp_micros((text.try_cast("decimal(20,6)") * 1_000_000).cast("long"))).when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("long")))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))
    other = F.when(text.contains(":"), F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in TIMES.items()]))
    year = F.year(now) if now is not None else reference_year if isinstance(reference_year, Column) else F.lit(reference_year)
    bare = F.when(text.rlike("^[A-Z][a-z]{2} [0-9][^.]*:[0-9]{2}$"), F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), text), F.lit("yyyy MMM d HH:mm:ss")))
    if now is not None:
        bare = F.when(bare > now + F.expr("INTERVAL 2 DAYS"), F.coalesce(F.try_to_timestamp(F.concat_ws(" ", (year - 1).cast("string"), text), F.lit("yyyy MMM d HH:mm:ss")), F.add_months(bare, -12))).otherwise(bare)
    return F.coalesce(epoch, iso, other, bare)
