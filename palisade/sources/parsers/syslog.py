"""Syslog lines: RFC 5424, RFC 3164 and ISO headers, then the messages of the programs that matter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import key_values, priority, to_int, with_tag
from .base import Parser, at, chosen, extras, first_match, group_of, parts

_TIME = r"[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+"
_OLD = rf"(?:<(\d{{1,3}})>)?({_TIME}) +([^\s:]+) +([^\s:\[]+)(?:\[(\d+)\])?:? *(.*)"
_NEW = r"<(\d{1,3})>1 +(\S+) +(\S+) +(\S+) +(\S+) +(\S+) +(?:-|(?:\[[^\]]*\])+) *(.*)"


@dataclass
class Message:
    """One kind of message: programs that write it, its pattern, what it means, and which groups of the pattern are which field."""

    programs: str
    pattern: str
    action: str
    outcome: str
    category: str
    type: str
    severity: str | None = None
    user: int | None = None
    target: int | None = None
    ip: int | None = None
    port: int | None = None
    name: int | None = None  # a group, a unit, a jail, a session
    command: int | None = None
    method: int | None = None


_SSH, _ACCOUNTS, _BAN = "sshd|sshd-session|login", "useradd|userdel|usermod|groupadd|passwd", r"fail2ban(?:[.-]\w+)?"
_IP = r"([0-9a-fA-F:.]+)"
#: Tried in this order; the first one that fits counts.
MESSAGES = [
    Message(_SSH, rf"^Failed (\S+) for (?:invalid user )?(\S*) from {_IP}(?: port (\d+))?", "ssh-login-failed", "failure", "authentication", "start", "low", method=1, user=2, ip=3, port=4),
    Message(_SSH, rf"^Accepted (\S+) for (\S+) from {_IP}(?: port (\d+))?", "ssh-login-success", "success", "authentication", "start", method=1, user=2, ip=3, port=4),
    Message(_SSH, rf"maximum authentication attempts exceeded for (?:invalid user )?(\S*) from {_IP}(?: port (\d+))?", "ssh-login-failed", "failure", "authentication", "start", "low", user=1, ip=2, port=3),
    Message(_SSH, rf"^Invalid user (\S*) from {_IP}(?: port (\d+))?", "ssh-invalid-user", "failure", "authentication", "start", "low", user=1, ip=2, port=3),
    Message(_SSH, r"authentication failure;.*rhost=(\S*)(?: +user=(\S+))?", "ssh-pam-auth-failure", "failure", "authentication", "start", ip=1, user=2),
    Message(_SSH, r"session opened for user ([^\s(]+)", "ssh-session-opened", "success", "session", "start", user=1),
    Message(_SSH, r"session closed for user ([^\s(]+)", "ssh-session-closed", "success", "session", "end", user=1),
    Message(_SSH, rf"^(?:Disconnected|Connection closed|Received disconnect).* {_IP} port (\d+)", "ssh-disconnected", "unknown", "network", "end", ip=1, port=2),
    Message(_SSH, r"", "sshd-message", "unknown", "authentication", "info"),
    Message("sudo", r"^\s*(\S+) : .*(?:command not allowed|NOT in sudoers|incorrect password).*?(?:USER=(\S+))?.*COMMAND=(.*)$", "sudo-command", "failure", "process", "start", "medium", user=1, target=2, command=3),
    Message("sudo", r"^\s*(\S+) : .*USER=(\S+) ;.*COMMAND=(.*)$", "sudo-command", "success", "process", "start", user=1, target=2, command=3),
    Message("sudo", r"^\s*(\S+) : (?:\d+ incorrect password|command not allowed|user NOT in sudoers|a password is required)", "sudo-failed", "failure", "authentication", "start", "medium", user=1),
    Message("sudo", r"authentication failure;.*?user=(\S+)", "sudo-auth-failure", "failure", "authentication", "start", "low", user=1),
    Message("sudo", r"session opened for user ([^\s(]+)(?:.* by ([^\s(]*))?", "sudo-session-opened", "success", "session", "start", target=1, user=2),
    Message("sudo", r"", "sudo-message", "unknown", "process", "info"),
    Message("su", r"FAILED (?:SU \(to |su for )(\S+?)\)? (?:by )?(\S+)", "su-failed", "failure", "authentication", "start", "medium", target=1, user=2),
    Message("su", r"Successful su for (\S+) by (\S+)", "su-success", "success", "authentication", "start", target=1, user=2),
    Message("su", r"^\s*\(to (\S+)\) (\S+) on", "su-success", "success", "authentication", "start", target=1, user=2),
    Message("su", r"authentication failure;.*ruser=(\S*)(?:.*? user=(\S+))?", "su-pam-auth-failure", "failure", "process", "info", user=1, target=2),
    Message("su", r"session opened for user ([^\s(]+)(?:.* by ([^\s(]*))?", "su-session-opened", "success", "session", "start", target=1, user=2),
    Message("su", r"session closed for user ([^\s(]+)", "su-session-closed", "success", "session", "end", target=1),
    Message(_ACCOUNTS, r"new user: name=([^,]+), UID=\d+", "user-created", "success", "iam", "user", "medium", target=1),
    Message(_ACCOUNTS, r"new group: name=([^,]+), GID=\d+", "group-created", "success", "iam", "group", name=1),
    Message(_ACCOUNTS, r"delete user '([^']+)'", "user-deleted", "success", "iam", "user", "medium", target=1),
    Message(_ACCOUNTS, r"add '([^']+)' to (?:shadow )?group '(sudo|wheel|admin|root|docker)'", "group-member-added", "success", "iam", "group", "high", target=1, name=2),
    Message(_ACCOUNTS, r"add '([^']+)' to (?:shadow )?group '([^']+)'", "group-member-added", "success", "iam", "group", "low", target=1, name=2),
    Message(_ACCOUNTS, r"password (?:changed )?for '?([^'\s]+)'?(?: changed by '?([^'\s]+)'?)?", "user-password-change", "success", "iam", "user", target=1, user=2),
    Message("crond?", r"\(([^)]+)\) CMD \((.*)\)", "cron-command", "success", "process", "start", user=1, command=2),
    Message("systemd", r"^(?:Started|Starting) (.+?)\.*$", "systemd-unit-started", "success", "host", "start", name=1),
    Message("systemd", r"^(?:Stopped|Stopping) (.+?)\.*$", "systemd-unit-stopped", "success", "host", "end", name=1),
    Message("systemd", r"^Failed to start (.+?)\.*$", "systemd-unit-failed-to-start", "failure", "host", "info", name=1),
    Message("systemd", r"^Reloaded (.+?)\.*$", "systemd-unit-reloaded", "success", "host", "info", name=1),
    Message("systemd-logind", r"New session (\S+) of user ([^\s.]+)", "session-started", "success", "session", "start", name=1, user=2),
    Message("systemd-logind", r"Removed session ([^\s.]+)", "session-ended", "success", "session", "end", name=1),
    *[
        Message(_BAN, rf"\[([^\]]+)\]\s+{verb}\s+{_IP}", f"fail2ban-{action}", "success", "intrusion_detection", kind, severity, name=1, ip=2)
        for verb, action, kind, severity in (("Restore Ban", "restore-ban", "denied", "medium"), ("Ban", "ban", "denied", "medium"), ("Unban", "unban", "allowed", None), ("Found", "found", "info", None), ("Ignore", "ignore", "info", None), ("Flush", "flush", "info", None))
    ],
]
# The datasets of programs.
DATASETS = {"cron": "linux.cron", "crond": "linux.cron", "systemd": "linux.system", "kernel": "linux.firewall", "ufw": "linux.firewall"}
_PATTERNS = [m.pattern for m in MESSAGES]


# journald's priorities as levels are syslog's severities.
_JOURNAL = r'^\s*\{(?s:.*)"MESSAGE"\s*:'


def _head(line: Column) -> Column:
    """pri, time, host, program, pid, message, msgid; of a journal's record (JSON) the same from its fields."""
    new, old = parts(line, _NEW, 7), parts(line, _OLD, 6)
    order = (0, 1, 2, 3, 4, 6, 5)
    doc = F.from_json(line, "map<string,string>")
    micros = F.coalesce(doc["__REALTIME_TIMESTAMP"], doc["_SOURCE_REALTIME_TIMESTAMP"])
    journal = F.array(doc["PRIORITY"], F.concat(F.substring(micros, 1, 10), F.lit("."), F.substring(micros, 11, 6)), doc["_HOSTNAME"], F.coalesce(doc["SYSLOG_IDENTIFIER"], doc["_COMM"]), doc["_PID"], doc["MESSAGE"], F.lit(None).cast("string"), doc["_EXE"])
    lines = F.when(line.rlike(r"^<\d{1,3}>1 "), F.transform(F.array(*[F.get(new, F.lit(i)) for i in order]), lambda x: F.when(x != "-", x))).otherwise(F.concat(old, F.array(F.lit(""))))
    return F.when(line.rlike(r"^\s*\{"), journal).otherwise(lines)


def which_message(program: Column, message: Column) -> Column:
    """The number of the message's kind; programs without kinds of their own cost one test each."""
    out = F.lit(None).cast("int")
    for programs in dict.fromkeys(m.programs for m in MESSAGES):
        own = [i for i, m in enumerate(MESSAGES) if m.programs == programs]
        found = first_match(message, [_PATTERNS[i] for i in own])
        numbers = F.get(F.array(*map(F.lit, own)), found)
        out = F.when(program.rlike(f"^(?:{programs})$"), numbers).otherwise(out)
    return out


def _firewall(message: Column) -> Column:
    return F.when(message.contains("SRC=") & message.contains("DST="), key_values(message))


def _tags(ssh: Column, message: Column) -> Column:
    none = F.lit(None).cast("array<string>")
    odd = with_tag(none, "invalid-user", ssh & message.rlike("(?i)invalid user "))
    return with_tag(odd, "max-auth-attempts", ssh & message.contains("maximum authentication attempts"))


def meaning(program: Column, message: Column, which: Column, kv: Column) -> dict[str, Column]:
    """The fields of a program's message, whatever carried it."""
    pick = lambda name: group_of(message, which, _PATTERNS, [getattr(m, name) for m in MESSAGES])
    say = lambda name: chosen(which, [getattr(m, name) for m in MESSAGES])
    wall, prefix = kv.isNotNull(), F.upper(F.substring_index(message, "IN=", 1))
    blocked = prefix.rlike("BLOCK|DROP|REJECT|DENY")
    either = lambda a, b: F.when(blocked, a).otherwise(b)
    other = lambda a, b: F.when(wall, a).otherwise(b)
    ssh, accounts = program.startswith("ssh") | (program == "login"), program.rlike(f"^(?:{_ACCOUNTS})$")
    return {
        "dataset": other(F.lit("linux.firewall"), F.coalesce(F.create_map(*[F.lit(x) for p in DATASETS.items() for x in p])[program], F.when(program.startswith("fail2ban"), F.lit("linux.fail2ban")), F.when(ssh | accounts | program.isin("sudo", "su", "systemd-logind"), F.lit("linux.auth")), F.lit("syslog"))),
        "action": other(either("firewall-block", "firewall-allow"), F.coalesce(say("action"), F.concat(F.coalesce(program, F.lit("syslog")), F.lit("-message")))),
        "outcome": other(either("failure", "success"), F.coalesce(say("outcome"), F.lit("unknown"))),
        "category": other(F.lit("network"), F.coalesce(say("category"), F.when(accounts, "iam").otherwise("host"))),
        "type": other(either("denied", "allowed"), F.coalesce(say("type"), F.lit("info"))),
        "severity": say("severity"),
        "user": pick("user"), "target_user": pick("target"),
        "tags": _tags(ssh, message),
        "source_ip": F.coalesce(kv["SRC"], pick("ip")), "source_port": to_int(F.coalesce(kv["SPT"], pick("port"))),
        "destination_ip": kv["DST"], "destination_port": to_int(kv["DPT"]),
        "extra": extras(
            rule__name=F.coalesce(F.when(wall, F.trim(F.translate(F.substring_index(message, "IN=", 1), "[]", ""))), F.when(program.startswith("fail2ban"), pick("name"))), group__name=F.when(accounts, pick("name")), service__name=F.when(program == "systemd", pick("name")),
            process__command_line=F.trim(pick("command")), palisade__auth__method=pick("method"), network__transport=F.lower(kv["PROTO"]), network__direction=F.when(wall, F.when(F.coalesce(kv["IN"], F.lit("")) != "", "inbound").otherwise("outbound")), network__protocol=F.when(ssh, F.lit("ssh")),
            observer__ingress__interface__name=kv["IN"], observer__egress__interface__name=kv["OUT"],
        ),
    }


def _body(line: Column, clock, head: Column, kv: Column, which: Column) -> dict[str, Column]:
    program, message = F.lower(at(head, 3)), at(head, 5)
    found = meaning(program, message, which, kv)
    pri = priority(at(head, 0))
    journal = F.size(head) > 7
    found["dataset"] = F.when(journal & (found["dataset"] == "syslog"), F.lit("linux.journald")).otherwise(found["dataset"])
    found["extra"] = F.map_concat(found["extra"], extras(process__executable=at(head, 7), log__syslog__facility__name=pri["facility"], log__syslog__severity__name=pri["severity"], log__level=pri["level"], log__syslog__msgid=at(head, 6), log__syslog__hostname=at(head, 2), host__os__type=F.lit("linux")))
    return {"ts": clock.time(at(head, 1)), "host": at(head, 2), "program": program, "pid": to_int(at(head, 4)), "message": F.coalesce(message, F.lit(""))} | found


SYSLOG = Parser("syslog", lambda line: line.rlike(rf"{_JOURNAL}|^(?:<\d{{1,3}}>)?(?:1 +\S+ +\S+ +\S+ +\S+ +\S+ +[-\[]|(?:{_TIME}) +[^\s:]+ +[^\s:\[]+(?:\[|:| ))"), _head, _body, [lambda h: _firewall(at(h, 5)), lambda h, _: which_message(F.lower(at(h, 3)), at(h, 5))])
