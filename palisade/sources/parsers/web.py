"""Access logs in combined format, and the error logs of two web servers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import basename, cleaned, ipv4, mentions, to_int, with_tag
from .base import Parser, at, extras, lookup

# User agents of tools that scan, and paths that nobody should ask for.
SCANNERS = ("nikto", "sqlmap", "nmap", "masscan", "dirbuster", "gobuster", "wpscan", "nuclei", "zgrab", "acunetix", "python-requests", "curl/", "wget/")
SENSITIVE = (".env", ".git", "wp-config", "passwd", ".htpasswd", ".aws", "id_rsa", "backup", ".bak", "shell.php", "phpmyadmin")
# The levels of web servers.
LEVELS = {"emerg": "critical", "alert": "critical", "crit": "critical", "error": "error", "warn": "warning", "notice": "info", "info": "info", "debug": "debug"}



def _cut(line: Column) -> Column:
    """The parts of an access line: address, user, time, method, URL, version, status, bytes, referrer, agent, forwarded address; null ones are empty.

    Quotes part the line first: request, referrer, agent and, in front of them or between them, what stands without quotes.
    """
    q = F.split(line, '"')
    part = lambda i: F.coalesce(F.trim(F.get(q, F.lit(i))), F.lit(""))
    word = lambda c, i: F.coalesce(F.get(F.split(F.trim(c), " +"), F.lit(i)), F.lit(""))
    before = F.substring_index(part(0), "[", 1)
    time = F.substring_index(F.substring_index(part(0), "[", -1), "]", 1)
    asked = part(1)
    method = F.regexp_extract(asked, "^[A-Z]+(?= |$)", 0)
    rest = F.trim(F.regexp_replace(asked, "^[A-Z]+(?: |$)", ""))
    version = F.regexp_extract(rest, r"(?:^| )HTTP/([0-9.]+)$", 1)
    url = F.regexp_replace(rest, r"(?:^| )HTTP/[0-9.]+$", "")
    forwarded = F.when(F.size(q) > 7, part(7)).otherwise(F.when(F.size(q) == 7, word(part(6), 0)).otherwise(""))
    return F.array(word(before, 0), word(before, 2), time, method, url, version, word(part(2), 0), word(part(2), 1), part(3), part(5), forwarded)


def _access(line: Column, clock, h: Column) -> dict[str, Column]:
    status, url, agent = to_int(at(h, 6)), at(h, 4), cleaned(at(h, 9))
    forwarded = F.trim(F.substring_index(at(h, 10), ",", 1))
    client = F.when(ipv4(forwarded).isNotNull(), forwarded)  # behind a proxy the client is the first address that it forwards
    return {
        "dataset": F.lit("nginx.access"), "ts": clock.time(at(h, 2)), "category": F.lit("web"), "type": F.lit("access"), "action": F.lit("http-request"), "outcome": F.when(status < 400, "success").otherwise("failure"), "user": cleaned(at(h, 1)), "source_ip": F.coalesce(client, at(h, 0)),
        "tags": with_tag(F.lit(None).cast("array<string>"), "scanner-user-agent", mentions(agent, SCANNERS)),
        "extra": extras(http__request__method=at(h, 3), url__original=url, url__path=F.substring_index(url, "?", 1), url__query=F.when(url.contains("?"), F.regexp_replace(url, r"^[^?]*\?", "")), http__version=at(h, 5), http__response__status_code=status, http__response__body__bytes=F.coalesce(to_int(at(h, 7)), F.lit(0).cast("long")), http__request__referrer=cleaned(at(h, 8)), user_agent__original=agent, client__ip=client, source__nat__ip=F.when(client.isNotNull(), at(h, 0)), log__level=F.when(status >= 500, F.lit("error"))),
    }


ACCESS = Parser("web", lambda line: line.rlike(r'^\S+ +\S+ +\S+ +\[[^\]]+\] +"[^"]*" +\d{3} '), _cut, _access)


def _path(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"[\"': ](/[^\"' ,]+)", 1), F.lit(""))


def _fields(message: Column) -> Column:
    """The pairs ``name: value`` that follow the message, parted by ``, ``; values may be quoted."""
    rest = F.regexp_extract_all(message, F.lit(r', ([a-z]+: (?:"[^"]*"|[^,]*))'), F.lit(1))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(rest, lambda x: F.substring_index(x, ": ", 1))), lambda k: F.struct(k, F.trim(F.regexp_extract(F.get(F.filter(rest, lambda x: x.startswith(F.concat(k, F.lit(": ")))), F.lit(0)), '^[a-z]+: "?([^"]*)"?$', 1)))))


def _error(line: Column, clock, h: Column, kv: Column) -> dict[str, Column]:
    # DATE TIME [LEVEL] PID#TID: *CONNECTION MESSAGE, client: IP, server: NAME, request: "..."
    words = F.split(line, " ", 5)
    message = F.regexp_replace(F.get(words, F.lit(4)), r"^\*\d+ ", "")
    request = F.split(kv["request"], " ")
    url = F.get(request, F.lit(1))
    path = _path(F.substring_index(message, ", client:", 1))
    return {
        "dataset": F.lit("nginx.error"), "ts": clock.time(F.concat_ws(" ", F.slice(words, 1, 2))), "pid": to_int(F.substring_index(F.get(words, F.lit(3)), "#", 1)), "category": F.lit("web"), "type": F.lit("error"), "action": F.lit("web-error"), "outcome": F.lit("failure"),
        "source_ip": kv["client"], "message": message, "tags": with_tag(F.lit(None).cast("array<string>"), "sensitive-path", mentions(message, SENSITIVE)),
        "extra": extras(log__level=lookup(F.translate(F.get(words, F.lit(2)), "[]", ""), LEVELS), http__request__method=F.get(request, F.lit(0)), url__original=url, url__path=F.substring_index(url, "?", 1), url__domain=kv["host"], nginx__server=kv["server"], nginx__upstream=kv["upstream"], http__request__referrer=kv["referrer"], file__path=path, file__name=basename(path), error__message=F.substring_index(message, ", client:", 1)),
    }


ERROR = Parser("web-error", lambda line: line.rlike(r"^\d{4}/\d\d/\d\d [0-9:]{8} \[[a-z]+\] \d+#\d+: "), lambda line: F.lit(True), _error, [lambda h: _fields(F.col("__raw"))])


def _apache(line: Column, clock, h: Column) -> dict[str, Column]:
    # [TIME] [MODULE:LEVEL] [pid PID:tid TID] [client IP:PORT] MESSAGE; the bracketed heads come in any number
    inside = lambda i: F.get(h, F.lit(i))
    tagged = lambda word: F.regexp_replace(F.get(F.filter(h, lambda x: x.startswith(word + " ")), F.lit(0)), f"^{word} ", "")
    client, message = tagged("client"), F.regexp_replace(line, r"^(?:\[[^\]]*\] ?)+", "")
    v4 = client.contains(".")
    code, path = F.nullif(F.regexp_extract(message, "^(AH[0-9]{5}): ", 1), F.lit("")), _path(message)
    return {
        "dataset": F.lit("apache.error"), "ts": clock.time(inside(0)), "pid": to_int(F.substring_index(tagged("pid"), ":", 1)), "category": F.lit("web"), "type": F.lit("error"), "action": F.lit("web-error"), "outcome": F.lit("failure"),
        "source_ip": F.when(v4, F.substring_index(client, ":", 1)).otherwise(client), "source_port": F.when(v4 & client.contains(":"), to_int(F.substring_index(client, ":", -1))), "message": message, "tags": with_tag(F.lit(None).cast("array<string>"), "sensitive-path", mentions(message, SENSITIVE)),
        "extra": extras(log__level=lookup(F.substring_index(inside(1), ":", -1), LEVELS), apache__module=F.when(inside(1).contains(":"), F.substring_index(inside(1), ":", 1)), error__code=code, error__message=F.regexp_replace(message, "^AH[0-9]{5}: ", ""), file__path=path, file__name=basename(path)),
    }


APACHE_ERROR = Parser("apache-error", lambda line: line.rlike(r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} +\d{1,2} [0-9:.]+ \d{4}\] \[[a-z_]*:?[a-z]+\] "), lambda line: F.regexp_extract_all(F.regexp_extract(line, r"^((?:\[[^\]]*\] ?)+)", 1), F.lit(r"\[([^\]]*)\]"), F.lit(1)), _apache)
