"""Ready-made detections. Thresholds are parameters; the defaults are those the rules are used with.

The rules read the columns of the usual event tables: connections (sip, dip, dport, bytes,
bytes_out, duration, protocol, action), logins (sip, dip, dport, account, service, result,
password_hash, logon_type), DNS (sip, qtype, query, query_len, resp_size), HTTP (sip,
method, uri), directory changes and processes (sip, account, action), data access (account,
action, row_count, bytes_out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions import scalars as fn
from tallyhawk.operators import enrich
from tallyhawk.plans.rule import Rule, Step

REMOTE_PORTS = (22, 445, 3389, 5985)
IP = ("ip", "sip")
PAIR = ("sip", "dip")

# Substrings and patterns that give away SQL injection in a URI.
SQLI_PATTERNS = [
    "'", "%27", "union.*select", "sleep", "pg_sleep", "waitfor.*delay", "benchmark", "1=1", "extractvalue", "updatexml",
    "into.*outfile", "load_file", "xp_cmdshell", "sp_executesql",
]


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _distinct(column: str, least: float) -> tuple[Step, ...]:
    return (Step("TRUE", least, "distinct", column),)


def _count(least: float) -> tuple[Step, ...]:
    return (Step("TRUE", least),)


def port_scan(ports: int = 10, events: int = 10, dur: str = "20s") -> Rule:
    return Rule("port_scan", ("sip",), dur, _distinct("dport", ports), 80, IP, "action = 'syn'", f"count(*) >= {events}")


def password_spraying(accounts: int = 5, dur: str = "5m") -> Rule:
    return Rule("password_spraying", ("password_hash",), dur, _distinct("account", accounts), 75, ("credential", "password_hash"), "result = 'failed'")


def ssh_brute_force(failures: int = 10, dur: str = "5m") -> Rule:
    return Rule("ssh_brute_force", ("sip",), dur, _count(failures), 70, IP, "service = 'ssh' AND result = 'failed'")


def lateral_spread(hosts: int = 5, events: int = 5, dur: str = "5m") -> Rule:
    return Rule("lateral_spread", ("sip",), dur, _distinct("dip", hosts), 75, IP, f"{_in('dport', REMOTE_PORTS)} AND action = 'syn'", f"count(*) >= {events}")


def beaconing(events: int = 20, dur: str = "10m", bytes_out: int = 1000, duration: int = 2) -> Rule:
    return Rule("c2_beaconing", PAIR, dur, _count(events), 70, IP, f"bytes_out < {bytes_out} AND duration < {duration} AND action = 'syn'", f"count(*) >= {events}")


def heartbeat(events: int = 12, variance: float = 60, dur: str = "24h", bytes_out: int = 200) -> Rule:
    """Small connections of a pair at even intervals: their variance in seconds squared stays within ``variance``."""
    return Rule("heartbeat", PAIR, dur, _count(1), 90, IP, f"bytes_out < {bytes_out}", f"count(*) >= {events} AND var_pop(interval_s) <= {variance}")


def dns_tunneling(events: int = 10, closing: int = 20, dur: str = "5m") -> Rule:
    return Rule("dns_tunneling", ("sip",), dur, _count(events), 85, IP, "qtype = 'TXT'", f"count(*) >= {closing}")


def data_exfiltration(events: int = 5, size: int = 10_000_000, dur: str = "5m") -> Rule:
    return Rule("data_exfiltration", ("sip",), dur, _count(events), 80, IP, f"bytes_out > {size}")


def pass_the_hash(hosts: int = 3, events: int = 5, dur: str = "10m") -> Rule:
    where = f"logon_type = 3 AND {_in('dport', REMOTE_PORTS[1:])} AND result = 'success'"
    return Rule("pass_the_hash", ("sip",), dur, _distinct("dip", hosts), 90, IP, where, f"count(*) >= {events}")


def scan_login_xfer(dur: str = "30m", small: int = 1000, large: int = 10_000) -> Rule:
    scan = f"src = 'conn' AND {_in('dport', REMOTE_PORTS[:3])} AND bytes_out < {small}"
    steps = (Step(scan, 1), Step("src = 'auth' AND result = 'success'", 1), Step(f"src = 'conn' AND bytes_out >= {large}", 1))
    return Rule("scan_login_xfer", PAIR, dur, steps, 95, IP)


def rat_propagation(dur: str = "30m", small: int = 1000, large: int = 10_000) -> Rule:
    return scan_login_xfer(dur, small, large).with_(name="rat_propagation")


def rat_propagation_exploit(dur: str = "30m", small: int = 1000, large: int = 10_000) -> Rule:
    steps = scan_login_xfer(dur, small, large).steps
    return Rule("rat_propagation_exploit", PAIR, dur, (steps[0], steps[2]), 90, IP)


def new_account(events: int = 2, dur: str = "5m") -> Rule:
    return Rule("new_account", ("sip",), dur, _count(1), 75, IP, "action IN ('user_created', 'added_to_priv_group')", f"count(*) >= {events}")


def scheduled_task(events: int = 1, dur: str = "5m") -> Rule:
    return Rule("scheduled_task", ("sip",), dur, _count(events), 65, IP, "action = 'process_create'")


def data_bulk_export(rows: int = 100_000, size: int = 50_000_000, closing: int = 5, dur: str = "5m") -> Rule:
    steps = (Step("TRUE", rows, "sum", "row_count"), Step("TRUE", size, "sum", "bytes_out"))
    close = f"sum(row_count) >= {rows * closing} AND sum(bytes_out) >= {size * closing}"
    return Rule("data_bulk_export", ("account",), dur, steps, 70, ("user", "account"), "action IN ('select', 'download')", close)


def close_demo(size: int = 200, events: int = 2, dur: str = "5m") -> Rule:
    return Rule("close_demo", ("sip",), dur, _count(1), 70, IP, f"bytes >= {size}", f"count(*) >= {events}")


def netflow_syn_scan(ports: int = 5, dur: str = "5m") -> Rule:
    return Rule("netflow_syn_scan", ("sip",), dur, _distinct("dport", ports), 75, IP, "protocol = 'tcp' AND action = 'syn'")


def netflow_dns_tunnel_probe(events: int = 3, length: int = 40, dur: str = "5m") -> Rule:
    return Rule("netflow_dns_tunnel_probe", ("sip",), dur, _count(events), 80, IP, f"qtype = 'TXT' AND query_len >= {length}")


def sqli_probe(events: int = 5, dur: str = "5m") -> Rule:
    """Reads the boolean ``injected``; see ``marked_sqli``."""
    return Rule("sqli_probe", ("sip",), dur, _count(events), 80, IP, "method = 'GET' AND injected")


def marked_sqli(http: DataFrame) -> DataFrame:
    return http.withColumn("injected", fn.regex_any(F.col("uri"), SQLI_PATTERNS))


def known_route(dur: str = "5m") -> Rule:
    return Rule("known_netflow_still_routes", ("sip",), dur, _count(1), 60, IP, "protocol = 'tcp' AND action = 'syn'")


def scan_detect(events: int = 50, dur: str = "5m") -> Rule:
    return Rule("scan_detect", ("sip",), dur, _count(events), 70, IP, close=f"count(*) >= {events}")


def traffic_spike(events: int = 100, dur: str = "5m") -> Rule:
    return scan_detect(events, dur).with_(name="traffic_spike", score=80)


def brute_force_count(failures: int = 3, dur: str = "5m") -> Rule:
    return Rule("brute_force_then_scan", ("sip",), dur, _count(failures), 70, IP, "result = 'failed'", "count(*) >= 1")


def port_scan_distinct(ports: int = 10, dur: str = "5m") -> Rule:
    return Rule("port_scan_kit", ("sip",), dur, _distinct("dport", ports), 60, IP, "action = 'syn'")


def data_exfil(burst: int = 100_000_000, total: int = 50_000_000, dur: str = "10m") -> Rule:
    return Rule("data_exfil", ("sip",), dur, (Step("TRUE", burst, "sum", "bytes"),), 85, IP, close=f"sum(bytes) >= {total}", close_mode="or")


def dns_tunnel_avg(size: float = 500, dur: str = "5m") -> Rule:
    return Rule("dns_tunnel", ("sip",), dur, (Step("TRUE", size, "avg", "resp_size"),), 50 + 20, IP)


def chain_attack(scans: int = 5, logins: int = 3, dur: str = "30m") -> Rule:
    return Rule("chain_attack", ("sip",), dur, (Step("action = 'syn'", scans), Step("action = 'login_fail'", logins)), 90, IP)


# --- row triggers and lookups ---------------------------------------------------------------------


def weak_password_login(logins: DataFrame, hashes: DataFrame, service: str = "") -> DataFrame:
    """Successful logins with a listed password hash, one row each, with what the list says and a sentence on it."""
    good = logins.where("result = 'success'" + (f" AND service = '{service}'" if service else ""))
    found = enrich.snapshot(good, hashes, {"password_hash": "hash_value"}, {"found_password": "password_masked", "category": "category"}, ["password_masked"], required=True)
    password, kind = F.coalesce("found_password", F.lit("?")), F.coalesce("category", F.lit("unknown"))
    detail = fn.fmt("listed password {} [{}] opened account {} to {}", password, kind, F.col("account"), F.col("sip"))
    return found.withColumns({"found_password": password, "category": kind, "detail": detail})


def weak_password_rule(dur: str = "5m") -> Rule:
    """The windowed form, on the rows of ``weak_password_login``."""
    return Rule("weak_password", ("sip",), dur, _count(1), 75, IP)


def first_seen_relationship(conns: DataFrame, history: DataFrame | None = None) -> DataFrame:
    return enrich.first_seen(conns.where("action = 'established'"), ["sip", "dip"], "ts", "event_id", history)


def dga_domain(dns: DataFrame, reputation: DataFrame) -> DataFrame:
    """A and AAAA queries for a domain that ``reputation`` (query, verdict) has a verdict on."""
    found = enrich.snapshot(dns.where("qtype IN ('A', 'AAAA')"), reputation, {"query": "domain"}, {"verdict": "verdict"}, ["verdict"])
    return found.where(F.col("verdict").isNotNull())


def privileged_anomaly(logins: DataFrame, unauthorised: DataFrame, services: tuple[str, ...] = ("smb", "rdp", "winlogon")) -> DataFrame:
    """Successful logins of a listed (account, host) pair."""
    return enrich.has(logins.where(f"result = 'success' AND {_in('service', services)}"), unauthorised, {"account": "account", "dip": "host"})


def off_hours(ts: Column, first: int = 8, last: int = 18) -> Column:
    """Outside working hours: before ``first``, from ``last`` on, or at the weekend."""
    return ~F.hour(ts).between(first, last - 1) | F.dayofweek(ts).isin(1, 7)


def off_hours_activity(logins: DataFrame, first: int = 8, last: int = 18) -> DataFrame:
    return logins.where("result = 'success'").where(off_hours(F.col("ts"), first, last))
