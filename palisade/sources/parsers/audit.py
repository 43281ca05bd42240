"""Linux audit records: key=value pairs, with more of them inside msg='...', some values in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import basename, key_values, to_int, unhexed
from .base import Parser, extras, lookup

# Audit record types and their category, type and action.
RECORDS = {
    "SYSCALL": ("process", "info", "auditd-syscall"), "EXECVE": ("process", "start", "process-executed"), "PROCTITLE": ("process", "info", "auditd-proctitle"),
    "USER_LOGIN": ("authentication", "start", "logon"), "USER_AUTH": ("authentication", "start", "auth"), "USER_ACCT": ("authentication", "start", "auditd-user-acct"),
    "CRED_ACQ": ("authentication", "start", "auditd-cred-acq"), "CRED_DISP": ("authentication", "start", "auditd-cred-disp"), "CRED_REFR": ("authentication", "start", "auditd-cred-refr"),
    "USER_ERR": ("authentication", "start", "auditd-user-err"), "LOGIN": ("authentication", "start", "auditd-login"), "USER_START": ("session", "start", "session-started"), "USER_END": ("session", "end", "session-ended"),
    "USER_CMD": ("process", "start", "sudo-command"), "ADD_USER": ("iam", "user", "user-created"), "DEL_USER": ("iam", "user", "user-deleted"), "ADD_GROUP": ("iam", "group", "group-created"),
    "DEL_GROUP": ("iam", "group", "group-deleted"), "USER_CHAUTHTOK": ("iam", "user", "user-password-change"), "USER_MGMT": ("iam", "user", "account-management"), "GRP_MGMT": ("iam", "group", "account-management"),
    "ROLE_ASSIGN": ("iam", "user", "role-assigned"), "SERVICE_START": ("host", "start", "service-started"), "SERVICE_STOP": ("host", "end", "service-stopped"), "PATH": ("file", "access", "auditd-path"),
    "CONFIG_CHANGE": ("configuration", "change", "auditd-config-change"), "DAEMON_START": ("configuration", "change", "auditd-daemon-start"), "DAEMON_END": ("configuration", "change", "auditd-daemon-end"), "DAEMON_ABORT": ("configuration", "change", "auditd-daemon-abort"),
}
# Fields whose values may be in hexadecimal, and texts that stand for no value.
HEX_FIELDS = ("cmd", "proctitle", "acct", "comm", "cwd", "dir", "path", "name")
NONE = ("", "?", "(none)", "unset", "4294967295")


def _pairs(line: Column) -> Column:
    """All pairs of a record, its own and those inside msg='...'; the stamp is cut off first, by the format's own delimiters.

    Only bare values are in hexadecimal: a quoted "1209" is that text.  Arguments are so in EXECVE alone; elsewhere a0 and the like are numbers.
    """
    body = F.substring_index(line, "): ", -1)
    coded = lambda k: k.isin(*HEX_FIELDS) | (line.contains("type=EXECVE ") & k.rlike("^a[0-9]+$"))
    return key_values(F.translate(F.replace(body, F.lit("msg='"), F.lit("")), "'", " "), lambda k, v: F.when(coded(k), unhexed(v)).otherwise(v))


def _body(line: Column, clock, kv: Column) -> dict[str, Column]:
    # node=N type=T msg=audit(SECONDS.MILLIS:SERIAL): pairs
    stamp = F.substring_index(F.substring_index(line, "msg=audit(", -1), ")", 1)
    kind = F.substring_index(F.substring_index(F.substring_index(line, "type=", -1), " msg=", 1), " ", 1)
    node = F.when(line.startswith("node="), F.substring_index(F.substring_index(line, " ", 1), "=", -1))
    value = lambda k: F.when(~kv[k].isin(*NONE), kv[k])
    result = F.lower(F.coalesce(kv["res"], kv["success"]))
    outcome = F.when(result.isin("success", "yes", "1"), "success").when(result.isin("failed", "no", "0"), "failure").otherwise("unknown")
    known = lambda i: lookup(kind, {k: v[i] for k, v in RECORDS.items()})
    odd = kind.startswith("ANOM_")
    action = F.when(kind.isin("USER_LOGIN", "USER_AUTH"), F.concat(known(2), F.when(outcome == "success", "-success").otherwise("-failed")))
    action = F.coalesce(action, known(2), F.when(odd, F.lit("auditd-anomaly")), F.concat(F.lit("auditd-"), F.translate(F.lower(kind), "_", "-")))
    iam, program = known(0) == "iam", F.lower(F.coalesce(basename(value("exe")), value("comm")))
    # a0, a1, ... in their order; a record has a few dozen at most, cut into records by the kernel
    args = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at(kv, F.concat(F.lit("a"), i.cast("string")))), lambda x: x.isNotNull())
    command = F.when(kind == "EXECVE", F.array_join(args, " ")).when(kind == "USER_CMD", value("cmd")).when(kind == "PROCTITLE", value("proctitle"))
    program = F.when(command.isNotNull() & kind.isin("EXECVE", "USER_CMD"), F.lower(basename(F.substring_index(command, " ", 1)))).otherwise(program)
    return {
        "dataset": F.lit("linux.auditd"), "ts": clock.time(F.substring_index(stamp, ":", 1)), "host": F.substring_index(node, ".", 1), "action": action,
        "category": F.coalesce(known(0), F.when(odd, "intrusion_detection").otherwise("host")), "type": F.coalesce(known(1), F.lit("info")), "outcome": outcome,
        "severity": F.when(odd | (known(0) == "configuration"), "medium").when(iam | ((kind == "USER_AUTH") & (outcome != "success")), "low"),
        "user": F.when(~F.coalesce(iam, F.lit(False)), value("acct")), "target_user": F.when(iam, value("acct")), "source_ip": value("addr"), "pid": to_int(value("pid")), "program": program, "message": F.substring_index(line, "): ", -1),
        "extra": F.map_concat(
            extras(auditd__type=kind, auditd__serial=F.substring_index(stamp, ":", -1), process__command_line=command, process__parent__pid=value("ppid"), user__id=F.coalesce(value("uid"), value("id")), auditd__login_uid=value("auid"), service__name=value("unit"), file__path=value("name"), process__executable=value("exe"), process__working_directory=value("cwd"), network__protocol=F.when((value("terminal") == "ssh") | value("exe").contains("sshd"), "ssh"), source__domain=F.when(value("addr").isNull(), value("hostname")), user__effective__name=F.when(kind == "USER_CMD", "root"), host__os__type=F.lit("linux")),
            F.transform_keys(F.map_filter(kv, lambda k, v: ~k.isin("type", "serial", "login_uid") & (v != "")), lambda k, _: F.concat(F.lit("auditd."), k)),
        ),
    }


AUDIT = Parser("auditd", lambda line: line.rlike(r"^(?:node=\S+ +)?type=\S+ +msg=audit\([0-9.]+:[0-9]+\):"), _pairs, _body)
