"""Windows event XML (Security, System, PowerShell, Defender, Task Scheduler, RDP, Sysmon), DHCP server and firewall logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import EMPTY, _as_map, basename, cleaned, hashes, let, mac, to_int
from .base import Parser, at, extras, lookup

# Channels and the datasets of their events.
CHANNELS = {
    "security": "windows.security", "system": "windows.system", "application": "windows.application", "microsoft-windows-sysmon/operational": "windows.sysmon",
    "microsoft-windows-powershell/operational": "windows.powershell", "windows powershell": "windows.powershell", "microsoft-windows-windows defender/operational": "windows.defender",
    "microsoft-windows-taskscheduler/operational": "windows.taskscheduler", "microsoft-windows-terminalservices-localsessionmanager/operational": "windows.rdp",
    "microsoft-windows-windows firewall with advanced security/firewall": "windows.firewall", "microsoft-windows-dns-client/operational": "windows.dns",
}
# Event levels, logon types, and the reasons of failed logons by status.
LEVELS = {"0": "info", "1": "critical", "2": "error", "3": "warning", "4": "info", "5": "verbose"}
LOGON_TYPES = {"2": "interactive", "3": "network", "4": "batch", "5": "service", "7": "unlock", "8": "network-cleartext", "9": "new-credentials", "10": "remote-interactive", "11": "cached-interactive"}
FAILURES = {
    "0xc000006d": "bad username or password", "0xc000006a": "wrong password", "0xc0000064": "user does not exist", "0xc0000072": "account disabled", "0xc0000234": "account locked out",
    "0xc0000070": "workstation restriction", "0xc000006f": "outside allowed hours", "0xc0000193": "account expired", "0xc0000071": "password expired", "0xc000015b": "logon type not granted", "0xc0000133": "clock skew",
}
# Event ids by dataset, each with category, type, action, severity (an empty one is none).
EVENTS = {
    "windows.security": """
        4624 authentication start logon-success -
        4625 authentication start logon-failed low
        4634,4647 authentication end logoff -
        4648 authentication start logon-explicit-credentials -
        4672 iam admin special-privileges-assigned -
        4688 process start process-created -
        4689 process end process-terminated -
        4697 configuration creation service-installed medium
        4698 configuration change scheduled-task-created low
        4699 configuration change scheduled-task-deleted low
        4700 configuration change scheduled-task-enabled low
        4701 configuration change scheduled-task-disabled low
        4702 configuration change scheduled-task-updated low
        4720 iam user user-created low
        4722 iam user user-enabled low
        4723 iam user user-password-change low
        4724 iam user user-password-reset low
        4725 iam user user-disabled low
        4726 iam user user-deleted low
        4738 iam user user-changed low
        4767 iam user user-unlocked low
        4781 iam user user-renamed low
        4728,4732,4756 iam group group-member-added medium
        4729,4733,4757 iam group group-member-removed low
        4740 iam user user-locked-out medium
        4768 authentication start kerberos-tgt-request -
        4769 authentication start kerberos-service-ticket -
        4771 authentication start kerberos-preauth-failed -
        4776 authentication start ntlm-authentication -
        1102 configuration deletion audit-log-cleared high
        4719 configuration change audit-policy-changed medium
        5140,5145 file access network-share-accessed -
        5156,5158 network allowed wfp-connection-allowed -
        5152,5157 network denied wfp-connection-blocked -""",
    "windows.system": """
        7045 configuration creation service-installed medium
        7036 host change service-state-changed -
        7040 configuration change service-start-type-changed -
        104 configuration deletion event-log-cleared high
        1074 host info system-shutdown-initiated -
        6005 host info eventlog-started -
        6006 host info eventlog-stopped -
        6008 host info unexpected-shutdown -
        41 host info kernel-power-unexpected-reboot -""",
    "windows.powershell": """
        4104 process info powershell-scriptblock -
        4103 process info powershell-module-logging -
        400,403,600 process info powershell-engine-state -""",
    "windows.defender": """
        1116,1006,1015 malware info defender-threat-detected high
        1117,1118,1119,1007,1008 malware info defender-threat-action high
        5001,5004,5010,5012 configuration change defender-protection-changed high""",
    "windows.taskscheduler": """
        106 configuration info scheduled-task-registered -
        129,200 configuration info scheduled-task-started -""",
    "windows.rdp": """
        21 session info rdp-logon-success -
        22 session info rdp-shell-start -
        23 session info rdp-logoff -
        24 session info rdp-disconnected -
        25 session info rdp-reconnected -""",
    "windows.sysmon": """
        1 process start process-created -
        2 file change file-time-changed -
        3 network connection network-connection -
        4 host info sysmon-state-changed medium
        5 process end process-terminated -
        6 driver start driver-loaded -
        7 process info image-loaded -
        8 process access remote-thread-created -
        9 file access raw-disk-access -
        10 process access process-accessed -
        11 file creation file-created -
        12 registry change registry-key-changed -
        13 registry change registry-value-set -
        14 registry change registry-key-renamed -
        15 file creation file-stream-created -
        16 host info sysmon-config-changed medium
        17 file creation pipe-created -
        18 file access pipe-connected -
        19 configuration creation wmi-filter medium
        20 configuration creation wmi-consumer medium
        21 configuration creation wmi-binding medium
        22 network protocol dns-query -
        23 file deletion file-deleted -
        24 host info clipboard-changed -
        25 process change process-tampering high
        26 file deletion file-delete-detected -
        27 file denied file-block-executable -
        28 file denied file-block-shredding -
        29 file creation file-executable-detected -
        255 host info sysmon-error -""",
}
# The category of other events of a dataset.
OTHERWISE = {"windows.security": "host", "windows.system": "host", "windows.powershell": "process", "windows.defender": "malware", "windows.taskscheduler": "configuration", "windows.rdp": "session", "windows.sysmon": "host"}


def _table() -> dict[str, tuple[str, ...]]:
    return {f"{dataset} {code}": tuple(rest) for dataset, rows in EVENTS.items() for codes, *rest in map(str.split, rows.strip().splitlines()) for code in codes.split(",")}


_KNOWN = _table()
_BY_TARGET = ("4624", "4625", "4634", "4647", "4768", "4769", "4771", "4776")
_GROUPS = ("4728", "4732", "4756", "4729", "4733", "4757")


def _data(line: Column) -> Column:
    """map of EventData's names and values; the last of equal names counts."""
    found = F.regexp_extract_all(line, F.lit(r"(?s)(<Data Name=['\"][^'\"]+['\"]>[^<]*)</Data>"), F.lit(1))
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "&lt;", "<"), "&gt;", ">"), "&quot;", '"'), "&amp;", "&")
    return _as_map(F.transform(found, lambda x: F.struct(F.regexp_extract(x, "Name=['\"]([^'\"]+)['\"]>", 1).alias("key"), plain(F.regexp_replace(x, "^[^>]*>", "")).alias("value"))))


def _system(line: Column) -> Column:
    """provider, code, level, time, record, channel, computer."""
    patterns = (r"<Provider Name=['\"]([^'\"]+)", r"<EventID[^>]*>(\d+)</EventID>", r"<Level>(\d+)", r"SystemTime=['\"]([^'\"]+)", r"<EventRecordID>(\d+)", "<Channel>([^<]+)", "<Computer>([^<]+)")
    head = F.substring_index(line, "<EventData", 1)
    return F.array(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in patterns])


def dataset_of(channel: Column, provider: Column) -> Column:
    ch = F.lower(channel)
    guess = F.when(ch.contains("sysmon") | F.lower(F.coalesce(provider, F.lit(""))).contains("sysmon"), "windows.sysmon").when(ch.contains("powershell"), "windows.powershell").when(ch.contains("defender"), "windows.defender")
    other = F.concat(F.lit("windows."), F.regexp_replace(F.regexp_replace(ch, "[^a-z0-9]+", "_"), "^_|_$", ""))
    # Without a channel the ids are read as those of the Security log, the only ones that are unique in practice.
    return F.coalesce(lookup(ch, CHANNELS), guess, other, F.lit("windows.security"))


def winlog(h: Column, data: Column) -> dict[str, Column]:
    """The event's fields from (provider, code, level, time, record, channel, computer) and its data, whatever carried them."""
    provider, code = at(h, 0), at(h, 1)
    dataset = dataset_of(at(h, 5), provider)
    key = F.concat_ws(" ", dataset, code)
    found = F.split(lookup(key, {k: " ".join(v) for k, v in _KNOWN.items()}), " ")
    known = lambda i: F.get(found, F.lit(i))
    value = lambda *names: F.coalesce(*[data[n] for n in names])
    action = F.coalesce(known(2), F.concat(F.replace(dataset, F.lit("windows."), F.lit("")), F.lit("-"), code), F.lit("event"))
    status = F.lower(value("SubStatus", "Status"))
    bad = code.isin("4625", "4771", "5152", "5157") | (code.isin("4768", "4769", "4776") & (F.coalesce(status, F.lit("0x0")) != "0x0"))
    failed = (dataset == "windows.security") & bad
    by_target, groups = code.isin(*_BY_TARGET), code.isin(*_GROUPS)
    full = value("User", "SourceUser", "Detection User", "UserContext", "UserName")
    both = F.coalesce(F.when(by_target, value("TargetUserName")), value("SubjectUserName"), F.when(code == "1074", value("param7")), F.when(dataset.isin("windows.sysmon", "windows.defender", "windows.taskscheduler", "windows.rdp"), full), F.when(dataset == "windows.security", value("TargetUserName")))
    user = F.substring_index(both, "\\", -1)
    domain = F.coalesce(F.when(by_target, value("TargetDomainName")), value("SubjectDomainName"), F.when(both.contains("\\"), F.substring_index(both, "\\", 1)))
    member = F.regexp_replace(F.substring_index(value("MemberName", "MemberSid"), ",", 1), "^(?i:CN=)", "")
    ip = lambda *names: F.regexp_replace(value(*names), "^::ffff:", "")
    path = F.coalesce(value("NewProcessName", "Image", "SourceImage", "Application", "ActionName"), F.when(dataset != "windows.defender", value("ProcessName")), value("Process Name", "param1"))
    path = F.when(dataset.isin("windows.system") & (code != "1074"), F.lit(None).cast("string")).otherwise(path)
    task = value("TaskContent")
    tag = lambda name: F.trim(F.regexp_extract(task, f"(?is)<{name}>(.*?)</{name}>", 1))
    task_command = F.when(task.isNotNull(), F.nullif(F.trim(F.concat_ws(" ", tag("Command"), tag("Arguments"))), F.lit("")))
    script = F.substring(value("ScriptBlockText"), 1, 8000)
    command = F.coalesce(value("CommandLine"), F.substring(script, 1, 4000), task_command, F.when(code == "7045", value("ImagePath")))
    file = F.coalesce(value("TargetFilename", "ImageLoaded", "ShareName"), F.when(dataset.isin("windows.defender", "windows.powershell"), F.replace(value("Path"), F.lit("file:_"), F.lit(""))))
    hashed, file_hash = hashes(value("Hashes", "Hash")), code.isin("6", "7", "11", "15", "23", "26", "29")
    parent, registry = value("ParentProcessName", "ParentImage"), value("TargetObject")
    initiated = F.lower(value("Initiated"))
    direction = F.coalesce(F.when(initiated == "true", "outbound").when(initiated == "false", "inbound"), lookup(value("Direction"), {"%%14592": "inbound", "%%14593": "outbound"}), value("Direction"))
    protocol = F.lower(value("Protocol"))
    service = F.when(dataset.isin("windows.security", "windows.system"), F.coalesce(value("ServiceName"), F.when(code.isin("7036", "7040"), value("param1"))))
    return {
        "dataset": dataset, "host": F.substring_index(at(h, 6), ".", 1), "program": F.lower(basename(path)), "pid": to_int(F.coalesce(value("NewProcessId", "SourceProcessId", "ProcessID"), F.when(code != "4688", value("ProcessId")))), "code": code,
        "category": F.coalesce(known(0), lookup(dataset, OTHERWISE), F.lit("host")), "type": F.coalesce(known(1), F.lit("info")), "action": action, "outcome": F.when(failed, "failure").otherwise("success"), "severity": F.nullif(known(3), F.lit("-")),
        "user": user, "domain": domain, "target_user": F.when(groups, member).when(dataset == "windows.security", value("TargetUserName")),
        "source_ip": ip("IpAddress", "SourceAddress", "SourceIp", "Address"), "source_port": to_int(value("IpPort", "SourcePort")), "destination_ip": ip("DestAddress", "DestinationIp"), "destination_port": to_int(value("DestPort", "DestinationPort")),
        "message": F.concat_ws(" ", provider, F.lit("EventID"), code, action, command),
        "extra": F.map_concat(
            extras(
                event__provider=provider, host__os__type=F.lit("windows"), log__level=F.coalesce(lookup(at(h, 2), LEVELS), F.lit("info")), winlog__channel=at(h, 5), winlog__record_id=at(h, 4), winlog__logon__type=F.coalesce(lookup(value("LogonType"), LOGON_TYPES), value("LogonType")), winlog__logon__id=value("TargetLogonId", "SubjectLogonId", "LogonId"),
                winlog__logon__failure__status=F.when(failed, status), winlog__logon__failure__reason=F.when(failed, F.coalesce(lookup(status, FAILURES), value("FailureReason"))), winlog__privileges=value("PrivilegeList"), winlog__task__name=value("TaskName"), group__name=F.when(groups, value("TargetUserName")),
                process__executable=path, process__command_line=command, process__parent__executable=parent, process__parent__name=F.lower(basename(parent)), process__parent__command_line=value("ParentCommandLine"), process__parent__pid=F.coalesce(value("ParentProcessId"), F.when(code == "4688", value("ProcessId"))), process__integrity_level=value("IntegrityLevel", "MandatoryLabel"),
                process__target__executable=value("TargetImage"), process__target__name=F.lower(basename(value("TargetImage"))), process__hash__md5=F.when(~file_hash, hashed["md5"]), process__hash__sha1=F.when(~file_hash, hashed["sha1"]), process__hash__sha256=F.when(~file_hash, hashed["sha256"]), file__hash__sha256=F.when(file_hash, hashed["sha256"]), process__hash__imphash=hashed["imphash"],
                service__name=service, service__path=value("ServiceFileName", "ImagePath"), service__account=value("ServiceAccount", "AccountName"), service__state=F.when(code == "7036", value("param2")), file__path=file, file__name=F.coalesce(value("RelativeTargetName", "PipeName"), basename(file)),
                registry__path=registry, registry__value=F.substring_index(registry, "\\", -1), registry__hive=F.substring_index(registry, "\\", 1), registry__data__strings=F.when(registry.isNotNull(), value("Details")), dns__question__name=F.lower(value("QueryName")), dns__answers__data=F.regexp_replace(F.regexp_replace(value("QueryResults"), "::ffff:|type:  5 ", ""), ";$", ""), dns__response_code=value("QueryStatus"),
                network__direction=direction, network__transport=F.coalesce(lookup(protocol, {"1": "icmp", "6": "tcp", "17": "udp"}), protocol), network__protocol=F.coalesce(F.when(action == "dns-query", F.lit("dns")), F.lower(value("DestinationPortName"))), source__domain=value("WorkstationName", "Workstation", "SourceHostname"), destination__domain=value("TargetServerName", "DestinationHostname"),
                threat__name=value("Threat Name", "ThreatName"), threat__severity=value("Severity Name", "SeverityName"), powershell__file__script_block_text=script, powershell__payload=F.substring(value("Payload"), 1, 4000), sysmon__granted_access=F.lower(value("GrantedAccess")), sysmon__event_type=F.when(registry.isNotNull(), value("EventType")), sysmon__rule_name=F.when(dataset == "windows.sysmon", value("RuleName")),
            ),
            F.transform_keys(F.map_filter(data, lambda _, v: v != ""), lambda k, _: F.concat(F.lit("winlog.event_data."), k)),
        ),
    }


def _told(data: Column) -> Column:
    """The data without what stands for no value."""
    return F.map_filter(F.transform_values(data, lambda _, v: F.trim(v)), lambda _, v: ~v.isin(*EMPTY))


def flattened(text: Column, depth: int = 3) -> Column:
    """map of dotted name -> value of a JSON object; objects inside are opened to ``depth`` names, lists and what lies deeper stay JSON text."""
    out = F.map_entries(F.from_json(text, "map<string,string>"))
    for _ in range(depth - 1):
        inner = lambda e: F.transform(F.map_entries(F.when(e["value"].rlike(r"^\s*\{"), F.from_json(e["value"], "map<string,string>"))), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value")))
        out = F.flatten(F.transform(out, lambda e: F.coalesce(inner(e), F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))))
    return _as_map(out)


def _record(line: Column) -> Column:
    """struct(h, data): of the XML, or of a shipper's JSON record of the same event."""
    names = ("winlog.provider_name", "winlog.event_id", "winlog.level", "@timestamp", "winlog.record_id", "winlog.channel", "winlog.computer_name")
    plain = F.struct(_system(line).alias("h"), _told(_data(line)).alias("data"))
    prefix = "winlog.event_data."
    given = let(flattened(line), lambda doc: F.struct(F.transform(F.array(*map(F.lit, names)), lambda n: doc[n]).alias("h"), _told(F.transform_keys(F.map_filter(doc, lambda k, _: k.startswith(prefix)), lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))).alias("data")))
    return F.when(line.rlike(r"^\s*<"), plain).otherwise(given)


def _event(line: Column, clock, record: Column) -> dict[str, Column]:
    h, data = record["h"], record["data"]
    return {"ts": clock.time(F.coalesce(F.when(at(h, 5).contains("Sysmon"), data["UtcTime"]), at(h, 3)))} | winlog(h, data)


XML = Parser("windows", lambda line: line.rlike(r"^\s*(?:<\?xml[^>]*>\s*)?<Event\b|^\s*\{(?s:.*)\"winlog(?:\.event_id|\.channel|\"\s*:)"), _record, _event)

# Event ids of the DHCP server's log, each with category, type and what happened.
DHCP_EVENTS = """
    00 host info log-started
    01 host info log-stopped
    02 host info log-paused
    10 network allowed lease-assigned
    11 network allowed lease-renewed
    12 network info lease-released
    13 network denied ip-conflict
    14 network denied lease-denied-scope-full
    15 network denied lease-denied
    16 network info lease-deleted
    17,18 network info lease-expired
    20 network allowed bootp-assigned
    21 network allowed bootp-dynamic
    22 network denied bootp-denied
    23 network info bootp-deleted
    24 host info cleanup-started
    25 host info cleanup-stats
    30 network info dns-update-request
    31 network error dns-update-failed
    32 network info dns-update-success
    33,36 network denied packet-dropped-policy
    34,35 network error dns-update-request-failed
    50 host error unreachable-domain
    51 host info authorized
    52 host info upgraded
    53 host info cached-authorization
    54 host error authorization-failed
    55 host info authorization-succeeded
    56 host error authorization-failed-stopped
    57,61,62 host info another-server-found
    58 host error server-unreachable
    59 host error network-failure
    60 host info no-dc-reachable
    63 host info restarting-rogue-detection
    64 host info no-dhcp-enabled-interfaces"""
_DHCP = {code: tuple(rest) for codes, *rest in map(str.split, DHCP_EVENTS.strip().splitlines()) for code in codes.split(",")}


def _dhcp(line: Column, clock, h: Column) -> dict[str, Column]:
    code = F.lpad(at(h, 0), 2, "0")
    found = F.split(lookup(code, {k: " ".join(v) for k, v in _DHCP.items()}), " ")
    known = lambda i, other: F.coalesce(F.get(found, F.lit(i)), other)
    kind = known(1, F.lit("info"))
    return {
        "dataset": F.lit("windows.dhcp"), "ts": clock.time(F.concat_ws(" ", at(h, 1), at(h, 2))), "host": cleaned(F.lower(at(h, 5))), "code": code, "category": known(0, F.lit("network")), "type": kind, "action": F.concat(F.lit("dhcp-"), known(2, code)), "outcome": F.when(kind.isin("denied", "error"), "failure").otherwise("success"),
        "severity": F.when(kind == "denied", "medium"), "user": cleaned(at(h, 7)), "source_ip": cleaned(at(h, 4)), "message": F.coalesce(at(h, 3), F.lit("")),
        "extra": extras(client__ip=cleaned(at(h, 4)), client__domain=cleaned(F.lower(at(h, 5))), client__mac=mac(at(h, 6)), dhcp__transaction_id=at(h, 8), dhcp__qresult=at(h, 9), event__provider=F.lit("Microsoft-DHCP-Server"), host__os__type=F.lit("windows")),
    }


DHCP = Parser("dhcp", lambda line: line.rlike(r"^\s*\d{1,2}\s*,\s*\d\d/\d\d/\d{2,4}\s*,[^,]*,[^,]*,[^,]*,[^,]*,"), lambda line: F.transform(F.split(line, ","), lambda x: F.trim(x)), _dhcp)


def _firewall(line: Column, clock, h: Column) -> dict[str, Column]:
    blocked, field = at(h, 2) == "DROP", lambda i: cleaned(at(h, i))
    return {
        "dataset": F.lit("windows.firewall_log"), "ts": clock.time(F.concat_ws(" ", at(h, 0), at(h, 1))), "category": F.lit("network"), "type": F.when(blocked, "denied").otherwise("allowed"), "action": F.when(blocked, "firewall-block").otherwise("firewall-allow"), "outcome": F.when(blocked, "failure").otherwise("success"),
        "source_ip": field(4), "destination_ip": field(5), "source_port": to_int(field(6)), "destination_port": to_int(field(7)),
        "extra": extras(network__transport=F.lower(field(3)), network__bytes=field(8), network__direction=lookup(at(h, 16), {"SEND": "outbound", "RECEIVE": "inbound"}), host__os__type=F.lit("windows")),
    }


#: W3C lines of the firewall: date, time, action, protocol, addresses, ports, size, nine more, and the path.
FIREWALL = Parser("firewall", lambda line: line.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d (?:ALLOW|DROP|INFO-EVENTS-LOST) \S+ \S+ \S+ \S+ \S+ "), lambda line: F.split(F.trim(line), " "), _firewall)
