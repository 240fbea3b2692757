"""Registered queries of closings, windows, pipelines and the ready-made detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhawk.operators import alerts, enrich, match, windows
from tallyhawk.operators.match import Step
from tallyhawk.plans import detections as d
from tallyhawk.plans import rule, sql
from tallyhawk.plans.core_queries import SOURCE, E, customers, events, table, us
from tallyhawk.plans.rule import Rule
from tallyhawk.sources import routing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


_PORT = "CASE k % 5 WHEN 0 THEN 22 WHEN 1 THEN 445 WHEN 2 THEN 3389 WHEN 3 THEN 5985 ELSE k END"
_SIZE = "CAST(floor(amount * 100) AS BIGINT)"
#: Event tables of the detections, as projections of ``events``.
VIEWS = {
    "conn": {
        "sip": "user_id", "dip": "k % 4", "dport": _PORT, "bytes": _SIZE, "bytes_out": _SIZE, "duration": "k % 4", "protocol": "'tcp'",
        "action": "CASE event_type WHEN 'click' THEN 'syn' WHEN 'view' THEN 'syn' WHEN 'error' THEN 'login_fail' ELSE 'established' END",
    },
    "auth": {
        "sip": "user_id", "dip": "k % 4", "dport": _PORT, "account": "k % 7", "service": "CASE WHEN k % 3 = 0 THEN 'rdp' ELSE 'ssh' END",
        "result": "CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'success' END", "password_hash": "k % 10", "logon_type": "3 - k % 2",
    },
    "dns": {"sip": "user_id", "qtype": "CASE event_type WHEN 'click' THEN 'TXT' WHEN 'view' THEN 'A' WHEN 'error' THEN 'AAAA' ELSE 'TXT' END", "query": "k % 50", "query_len": "k", "resp_size": _SIZE},
    "http": {"sip": "user_id", "method": "CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END", "uri": "CASE k % 4 WHEN 0 THEN '/item?id=1%27' WHEN 1 THEN '/q?s=union all select' WHEN 2 THEN '/a?b=1=1' ELSE '/home' END"},
    "change": {"sip": "user_id", "account": "k % 7", "action": "CASE event_type WHEN 'click' THEN 'user_created' WHEN 'view' THEN 'added_to_priv_group' WHEN 'error' THEN 'process_create' ELSE 'login' END"},
    "data": {"sip": "user_id", "account": "user_id", "action": "CASE event_type WHEN 'click' THEN 'select' WHEN 'view' THEN 'download' ELSE 'insert' END", "row_count": "k", "bytes_out": _SIZE},
}
BASE = ("event_id", "ts")


def view(spark, sf, name: str) -> DataFrame:
    own = events(spark, sf).withColumnRenamed("value", "amount")
    return own.selectExpr(*BASE, *[f"{e} AS {c}" for c, e in VIEWS[name].items()])


def view_sql(name: str) -> str:
    return f"SELECT {', '.join(BASE)}, {', '.join(f'{e} AS {c}' for c, e in VIEWS[name].items())} FROM ({SOURCE})"


def _both(spark, sf) -> DataFrame:
    """Connections and logins as one stream of flagged rows; login ids follow all connection ids."""
    conn = view(spark, sf, "conn").withColumn("src", F.lit("conn"))
    auth = view(spark, sf, "auth").select((F.col("event_id") + 1_000_000_000).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("ts"), "sip", "dip", "result", F.lit("auth").alias("src"))
    return conn.unionByName(auth, allowMissingColumns=True)


_BOTH_SQL = (
    f"SELECT event_id, ts, sip, dip, dport, bytes_out, 'conn' AS src, NULL AS result FROM ({view_sql('conn')}) UNION ALL "
    f"SELECT event_id + 1000000000, ts + INTERVAL 30 MINUTE, sip, dip, NULL, NULL, 'auth', result FROM ({view_sql('auth')})"
)


def _rule(name: str, r: Rule, source: str, delay: str = "0s", prepare=None, source_sql: str | None = None, end_reason: str | None = "eos"):
    def run(spark, sf):
        rows = _both(spark, sf) if source == "both" else view(spark, sf, source)
        return rule.flat(rule.run(r, prepare(rows) if prepare else rows, delay=delay, end_reason=end_reason))

    run.__name__, run.__doc__ = name, f"{r.name} over {source} events."
    told = source_sql or (_BOTH_SQL if source == "both" else view_sql(source))
    query(rule.oracle(r, told, delay, end_reason))(run)


# Thresholds are scaled to the driver's events, about two a user and day.
_rule("l01_port_scan", d.port_scan(3, 3, "3d"), "conn")
_rule("l02_password_spraying", d.password_spraying(4, "2h"), "auth")
_rule("l03_ssh_brute_force", d.ssh_brute_force(3, "4d"), "auth")
_rule("l06_lateral_spread", d.lateral_spread(2, 3, "3d"), "conn")
_rule("l07_c2_beaconing", d.beaconing(2, "10d", 6000), "conn", "2d")
_rule("e17_periodicity", d.heartbeat(3, 1.5e10, "20d", 6000), "conn", "2d")
_rule("l09_dns_tunneling", d.dns_tunneling(2, 4, "4d"), "dns")
_rule("l10_data_exfiltration", d.data_exfiltration(3, 5000, "3d"), "conn")
_rule("l11_pass_the_hash", d.pass_the_hash(2, 2, "6d"), "auth")
_rule("l13_scan_login_xfer", d.scan_login_xfer("6d", 6000, 7000), "both")
_rule("l14_new_account", d.new_account(2, "2d"), "change")
_rule("l15_scheduled_task", d.scheduled_task(1, "1d"), "change")
_rule("l16_data_bulk_export", d.data_bulk_export(60, 6000, 2, "6d"), "data")
_rule("l18_close_demo", d.close_demo(4000, 2, "1d"), "conn", "12h")
_rule("l22_rat_propagation", d.rat_propagation("8d", 6000, 7000), "both")
_rule("l22_rat_propagation_exploit", d.rat_propagation_exploit("4d", 6000, 7000), "both")
_rule(
    "l23_sqli_probe", d.sqli_probe(3, "2d"), "http", prepare=d.marked_sqli,
    source_sql=f"SELECT *, regexp_matches(uri, '{'|'.join('(' + p.replace(chr(39), chr(39) * 2) + ')' for p in d.SQLI_PATTERNS)}') AS injected FROM ({view_sql('http')})",
)
_rule("l28_brute_force", d.brute_force_count(2, "2d"), "auth")
_rule("l28_port_scan", d.port_scan_distinct(4, "4d"), "conn")
_rule("l28_data_exfil", d.data_exfil(10_000, 12_000, "1d"), "conn", "6h")
_rule("l28_dns_tunnel", d.dns_tunnel_avg(6000, "1d"), "dns")
_rule("l28_chain_attack", d.chain_attack(2, 1, "4d"), "conn")

_AND = Rule("and_close", ("sip",), "1d", (Step("TRUE", 2),), 70, ("ip", "sip"), "action = 'syn'", "count(*) >= 3 AND sum(bytes) >= 10000")
_rule("e8_and_close", _AND, "conn", "12h")
_rule("e9_or_close", _AND.with_(name="or_close", close_mode="or"), "conn", "12h")
_rule("e11_close_conditions", _AND.with_(name="close_conditions", close="count(*) >= 2 AND avg(bytes) >= 5000 AND max(dport) > 100 AND count(DISTINCT dip) >= 2"), "conn")
_rule("c8_close_guard", _AND.with_(name="close_guard", close="count(*) >= 2 AND min(bytes) >= 1000 AND close_reason = 'timeout'"), "conn", "12h")

_OPEN = _AND.with_(dur="6d", close="count(*) >= 2")
_rule("f9_close_timeout", _OPEN.with_(name="by_timeout"), "conn", "1d", end_reason=None)
_rule("f10_close_eos", _OPEN.with_(name="by_end", dur="60d"), "conn", "1d")
_rule("f11_close_flush", _OPEN.with_(name="by_flush"), "conn", "1d", end_reason="flush")
_rule("i8_no_end_close", _OPEN.with_(name="swept", close_mode="or"), "conn", "10d", end_reason=None)
_rule("e10_close_counts_all", _AND.with_(name="all_events", steps=(Step("bytes >= 5000", 1), Step("bytes < 5000", 1)), close="count(*) >= 3"), "conn")

# --- routed streams ---------------------------------------------------------------------------

_SCAN, _PROBE = d.netflow_syn_scan(3, "3d"), d.netflow_dns_tunnel_probe(2, 40, "3d")


def _tagged(spark, sf, tag: str = "NULL", fixed: str = "") -> DataFrame:
    """All events as one stream; ``tag`` is the SQL expression of its tag field."""
    return routing.tag(events(spark, sf).withColumnRenamed("value", "amount").withColumn("stream_tag", F.expr(tag)), fixed)


def _window(stream: DataFrame, tag: str, name: str) -> DataFrame:
    return routing.window(stream, tag, *BASE, *[F.expr(e).alias(c) for c, e in VIEWS[name].items()])


def _window_sql(name: str, where: str = "TRUE") -> str:
    return f"SELECT {', '.join(BASE)}, {', '.join(f'{e} AS {c}' for c, e in VIEWS[name].items())} FROM ({SOURCE}) WHERE {where}"


@query(f"SELECT * FROM ({rule.oracle(_SCAN, _window_sql('conn'), name='w0')}) UNION ALL SELECT * FROM ({rule.oracle(_PROBE, _window_sql('dns'), name='w1')})")
def l19_netflow_syn_scan(spark, sf):
    """One tagged stream feeds a connection and a DNS window, with a rule on each."""
    stream = _tagged(spark, sf, fixed="netflow")
    scans, probes = rule.run(_SCAN, _window(stream, "netflow", "conn")), rule.run(_PROBE, _window(stream, "netflow", "dns"))
    return rule.flat(scans.unionByName(probes))


_MIXED = "CASE WHEN event_type IN ('click', 'view') THEN 'netflow' ELSE 'dns' END"


@query(
    f"SELECT * FROM ({rule.oracle(_SCAN, _window_sql('conn', _MIXED + chr(61) + repr('netflow')), name='w0')}) UNION ALL "
    f"SELECT * FROM ({rule.oracle(_PROBE.with_(name='dns_tunnel_probe'), _window_sql('dns', _MIXED + chr(61) + repr('dns')), name='w1')})"
)
def l20_dns_tunnel_probe(spark, sf):
    """A stream of mixed tags: each tag feeds its own window, with a rule on each."""
    stream = _tagged(spark, sf, _MIXED)
    scans = rule.run(_SCAN, _window(stream, "netflow", "conn"))
    return rule.flat(scans.unionByName(rule.run(_PROBE.with_(name="dns_tunnel_probe"), _window(stream, "dns", "dns"))))


_ROUTE = d.known_route("1d")
_STRAY = "CASE event_type WHEN 'error' THEN ' ' WHEN 'signup' THEN 'mystery' ELSE 'netflow' END"


@query(
    f"SELECT rule_name AS name, count(*) AS n FROM ({rule.oracle(_ROUTE, _window_sql('conn', _STRAY + chr(61) + repr('netflow')))}) GROUP BY rule_name UNION ALL "
    f"SELECT CASE event_type WHEN 'error' THEN 'missing_stream_tag_field' ELSE 'unknown_stream_schema' END, count(*) FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1"
)
def l26_known_route(spark, sf):
    """A known route keeps alerting while rows of an unknown tag and of none are counted as misses."""
    stream = _tagged(spark, sf, _STRAY)
    found = rule.run(_ROUTE, _window(stream, "netflow", "conn")).groupBy(F.col("rule_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(routing.misses(stream, ["netflow"]).select(F.col("reason").alias("name"), F.col("rows").alias("n")))


_TARGET = T.StructType([T.StructField(n, t) for n, t in (("sip", T.LongType()), ("alert_type", T.StringType()), ("detail", T.StringType()), ("request_count", T.IntegerType()), ("sensor", T.StringType()))])


def _yielding(name: str, r: Rule, kind: str, n: int):
    def run(spark, sf):
        found = rule.run(r, view(spark, sf, "conn"))
        base = {"alert_type": F.lit("base"), "sensor": F.lit("flow")}
        fields = alerts.preset(base, sip=F.col("entity_id"), alert_type=F.lit(kind), detail=F.lit(f"{n} or more requests"), request_count=F.lit(str(n)))
        return alerts.yields(found, _TARGET, fields)

    run.__name__, run.__doc__ = name, f"{r.name} in the target's shape: a preset, what the rule gives by name, and the target's types."
    query(f"SELECT CAST(entity_id AS BIGINT) AS sip, '{kind}' AS alert_type, '{n} or more requests' AS detail, CAST({n} AS INTEGER) AS request_count, 'flow' AS sensor FROM ({rule.oracle(r, view_sql('conn'))})")(run)


_yielding("l27_scan_detect", d.scan_detect(5, "2d"), "scanner", 5)
_yielding("l27_traffic_spike", d.traffic_spike(6, "2d"), "spike", 6)

# --- row triggers and joins ---------------------------------------------------------------


def _hashes(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").cast("bigint").alias("hash_value"), F.col("n_name").alias("password_masked"), F.when(F.col("n_nationkey") > 0, F.col("n_name")).alias("category"))


_HASHES = "SELECT CAST(n_nationkey AS BIGINT) AS hash_value, n_name AS password_masked, CASE WHEN n_nationkey > 0 THEN n_name END AS category FROM nation WHERE n_nationkey < 4"
_WEAK = f"SELECT a.*, password_masked, coalesce(category, 'unknown') AS category FROM ({view_sql('auth')}) a JOIN ({_HASHES}) ON password_hash = hash_value WHERE result = 'success' AND service = 'ssh'"


@query(
    f"SELECT event_id, password_masked AS found_password, category, 'listed password ' || password_masked || ' [' || category || '] opened account ' || account || ' to ' || sip AS detail FROM ({_WEAK})"
)
def l04_weak_password_login(spark, sf):
    return d.weak_password_login(view(spark, sf, "auth"), _hashes(spark, sf), "ssh").select("event_id", "found_password", "category", "detail")


@query(rule.oracle(d.weak_password_rule("1d"), f"SELECT * FROM ({_WEAK})"))
def l25_weak_password_windowed(spark, sf):
    return rule.flat(rule.run(d.weak_password_rule("1d"), d.weak_password_login(view(spark, sf, "auth"), _hashes(spark, sf), "ssh")))


@query(f"SELECT event_id, sip, dip FROM (SELECT *, row_number() OVER (PARTITION BY sip, dip ORDER BY ts, event_id) AS n FROM ({view_sql('conn')}) WHERE action = 'established') WHERE n = 1 AND NOT (sip < 5 AND dip = 0)")
def l05_first_seen_relationship(spark, sf):
    history = customers(spark, sf).where("c_custkey < 5").select(F.col("c_custkey").alias("sip"), F.lit(0).cast("bigint").alias("dip")).unionByName(
        customers(spark, sf).limit(0).select(F.col("c_custkey").alias("sip"), F.col("c_custkey").alias("dip"))
    ).unionByName(view(spark, sf, "conn").where("sip < 5 AND dip = 0").select("sip", "dip"))
    return d.first_seen_relationship(view(spark, sf, "conn"), history).select("event_id", "sip", "dip")


@query(f"SELECT event_id, sip, n_name AS verdict FROM ({view_sql('dns')}) JOIN nation ON query = n_nationkey WHERE qtype IN ('A', 'AAAA')")
def l08_dga_domain(spark, sf):
    bad = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("domain"), F.col("n_name").alias("verdict"))
    return d.dga_domain(view(spark, sf, "dns"), bad).select("event_id", "sip", "verdict")


@query(f"SELECT event_id, account, dip FROM ({view_sql('auth')}) WHERE result = 'success' AND service = 'rdp' AND (account, dip) IN (SELECT (n_nationkey % 7, n_regionkey) FROM nation)")
def l12_privileged_anomaly(spark, sf):
    pairs = table(spark, sf, "nation").select((F.col("n_nationkey") % 7).alias("account"), F.col("n_regionkey").alias("host"))
    return d.privileged_anomaly(view(spark, sf, "auth"), pairs).select("event_id", "account", "dip")


@query(f"SELECT event_id, sip FROM ({view_sql('auth')}) WHERE result = 'success' AND (hour(ts) < 8 OR hour(ts) >= 18 OR dayofweek(ts) IN (0, 6))")
def l17_off_hours(spark, sf):
    return d.off_hours_activity(view(spark, sf, "auth")).select("event_id", "sip")


_WHITE = d.port_scan(3, 3, "3d").with_(name="port_scan_whitelist")


@query(
    f"SELECT a.*, c_mktsegment AS department, c_name AS owner FROM ({rule.oracle(_WHITE, view_sql('conn'))}) a LEFT JOIN customer ON entity_id = CAST(c_custkey AS VARCHAR) "
    "WHERE entity_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)"
)
def l21_port_scan_whitelist(spark, sf):
    found = rule.flat(rule.run(_WHITE, view(spark, sf, "conn")))
    owners = customers(spark, sf).withColumn("ip", F.col("c_custkey").cast("string"))
    kept = enrich.anti(found, owners.where("c_acctbal < 0"), {"entity_id": "ip"})
    return enrich.snapshot(kept, owners, {"entity_id": "ip"}, {"department": "c_mktsegment", "owner": "c_name"}, ["c_name"])


_SSH = d.ssh_brute_force(3, "4d")


@query(
    sql.anchored(f"SELECT * FROM ({view_sql('auth')}) WHERE {_SSH.where}", ["sip"], "4d")
    + f" SELECT sip, {sql.us('window_start')} AS window_start_us, count(*) AS window_events, count(*) // 3 AS matches, CAST(3 AS DOUBLE) AS trigger_value, {sql.us('min(ts)')} AS first_event_us, {sql.us('max(ts)')} AS last_event_us, "
    f"{sql.us('window_start + INTERVAL 4 DAY')} AS window_end_us, arg_min(dip, (ts, event_id)) AS first_dip, max(account) AS top_account FROM w "
    "WHERE sip NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY sip, window_start HAVING count(*) >= 3"
)
def l24_ssh_evidence(spark, sf):
    return _evidence(spark, sf)


def _evidence(spark, sf):
    bound = view(spark, sf, "auth").where(_SSH.where)
    tracked = match.track(bound, ["sip"], "ts", "event_id", _SSH.dur, list(_SSH.steps))
    seen = match.evidence(tracked, ["sip"], "ts", "event_id", _SSH.dur, F.min_by("dip", F.struct("ts", "event_id")).alias("first_dip"), F.max("account").alias("top_account"))
    kept = enrich.anti(seen.where("matches > 0"), customers(spark, sf).where("c_acctbal < 0"), {"sip": "c_custkey"})
    times = ("window_start", "first_event", "last_event", "window_end")
    return kept.select("sip", us("window_start"), "window_events", "matches", "trigger_value", *[us(t) for t in times[1:]], "first_dip", "top_account")


_STAGED = [Step("action = 'syn'", 2), Step("action = 'login_fail'", 1)]


@query(
    sql.chain(view_sql("conn"), ["sip"], "4d", _STAGED)
    + f" SELECT sip, {sql.us('window_start')} AS window_start_us, count(*) AS window_events, count(*) FILTER (fired) AS matches, count(*) FILTER (step = 0) AS scans_reached, count(*) FILTER (step = 1) AS logins_reached, "
    f"arg_max(measure, (ts, event_id)) FILTER (fired) AS trigger_value, {sql.us('min(ts)')} AS first_event_us, {sql.us('max(ts)')} AS last_event_us FROM w "
    "WHERE window_start IS NOT NULL AND (action = 'syn' OR action = 'login_fail') GROUP BY sip, window_start"
)
def e13_evidence(spark, sf):
    """What a two-step chain leaves behind in each window: its counts, how often each step was reached, the measure that fired last."""
    tracked = match.track(view(spark, sf, "conn"), ["sip"], "ts", "event_id", "4d", _STAGED)
    reached = [F.count_if(F.col("step") == i).alias(n) for i, n in enumerate(("scans_reached", "logins_reached"))]
    seen = match.evidence(tracked, ["sip"], "ts", "event_id", "4d", *reached)
    return seen.select("sip", us("window_start"), "window_events", "matches", "scans_reached", "logins_reached", "trigger_value", us("first_event"), us("last_event"))


@query(
    sql.anchored(E, ["user_id"], "3d")
    + f" SELECT user_id, {sql.us('window_start')} AS window_start_us, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, arg_min(k, (ts, event_id)) AS first_k, arg_max(k, (ts, event_id)) AS last_k FROM w GROUP BY user_id, window_start"
)
def e16_values(spark, sf):
    rows = windows.anchored(events(spark, sf), ["user_id"], "ts", "event_id", "3d")
    at = F.struct("ts", "event_id")
    return rows.groupBy("user_id", "window_start").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.min_by("k", at).alias("first_k"), F.max_by("k", at).alias("last_k")
    ).select("user_id", us("window_start"), "kinds", "first_k", "last_k")


# --- windows ---------------------------------------------------------------------------------


@query(sql.anchored(E, ["user_id"], "1d") + f" SELECT event_id, user_id, {sql.us('window_start')} AS window_start_us, CAST(row_in_window AS BIGINT) AS row_in_window FROM w")
def f1_anchored(spark, sf):
    return windows.anchored(events(spark, sf), ["user_id"], "ts", "event_id", "1d").select("event_id", "user_id", us("window_start"), "row_in_window")


@query(ORACLES["f1_anchored"])
def f1_anchored_split(spark, sf):
    """Anchored windows dealt by the stretches between gaps, for keys with very many rows."""
    cut = windows.stretches(events(spark, sf), ["user_id"], "ts", "1d", "part")
    return windows.anchored(cut, ["user_id"], "ts", "event_id", "1d", ["part"]).select("event_id", "user_id", us("window_start"), "row_in_window")


@query(sql.anchored(f"SELECT *, user_id % 2 AS half FROM {E}", ["half"], "1h") + f" SELECT event_id, half, {sql.us('window_start')} AS window_start_us, CAST(row_in_window AS BIGINT) AS row_in_window FROM w")
def f1_anchored_blocks(spark, sf):
    """Anchored windows of two keys that hardly pause, cut into blocks of a day."""
    halves = events(spark, sf).withColumn("half", F.col("user_id") % 2)
    return windows.anchored(windows.blocks(halves, ["half"], "ts", "1h", "1d"), ["half"], "ts", "event_id", "1h").select("event_id", "half", us("window_start"), "row_in_window")


_SPLIT = Rule("counted_blocks", ("half",), "2h", (Step("event_type = 'click'", 5),), 60, ("half", "half"))


@query(rule.oracle(_SPLIT, f"SELECT *, user_id % 2 AS half FROM ({SOURCE})"))
def i10_hot_keys(spark, sf):
    """A counting rule on two hot keys, each dealt to many tasks."""
    halves = events(spark, sf).withColumn("half", F.col("user_id") % 2).withColumnRenamed("value", "amount")
    return rule.flat(rule.run(_SPLIT, halves, split=True))


@query(f"SELECT user_id, {sql.us('time_bucket(INTERVAL 6 HOUR, ts)')} AS window_start_us, count(*) AS n, round(sum(value), 4) AS total FROM {E} GROUP BY ALL")
def f2_fixed(spark, sf):
    rows = windows.fixed(events(spark, sf), "ts", "6h")
    return rows.groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", us("window_start"), "n", "total")


@query(
    f"SELECT user_id, {sql.us('min(ts)')} AS window_start_us, {sql.us('max(ts) + INTERVAL 12 HOUR')} AS window_end_us, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM "
    f"(SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM {E})) GROUP BY user_id, s"
)
def f3_session(spark, sf):
    return windows.sessions(events(spark, sf), ["user_id"], "ts", "12h", F.count(F.lit(1)).alias("n")).select("user_id", us("window_start"), us("window_end"), "n")


@query(f"SELECT * FROM (SELECT event_id, count(*) OVER t AS n, CAST(len(list_distinct(list(event_type) OVER t)) AS INTEGER) AS kinds FROM {E} WINDOW t AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) WHERE n >= 3")
def f4_trailing(spark, sf):
    told = windows.trailing_counts(events(spark, sf), ["user_id"], "ts", "1d", kinds="event_type")
    rows = told.select("event_id", "n", F.col("kinds").cast("int").alias("kinds"))
    return rows.where("n >= 3")


_PAIRED = Rule("two_sources", ("user_id",), "5d", (Step("src = 'event' AND amount >= 60", 1), Step("src = 'order'", 1)), 90, ("user", "user_id"))
_TWO = "SELECT event_id, ts, user_id, 'event' AS src, amount FROM (" + SOURCE + ") UNION ALL SELECT 1000000000 + o_orderkey, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 720), o_custkey, 'order', NULL FROM orders"


@query(rule.oracle(_PAIRED, _TWO))
def f8_two_sources(spark, sf):
    own = events(spark, sf).select("event_id", "ts", "user_id", F.lit("event").alias("src"), F.col("value").alias("amount"))
    orders = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1_000_000_000).alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + (F.col("o_orderkey") % 720) * 3600).alias("ts"), F.col("o_custkey").alias("user_id"), F.lit("order").alias("src")
    )
    return rule.flat(rule.run(_PAIRED, own.unionByName(orders, allowMissingColumns=True)))


_MAPPED = Rule("key_map", ("who",), "4d", (Step("src = 'act' AND event_type = 'view'", 1), Step("src = 'buy'", 1)), 40, ("user", "who"))


@query(
    rule.oracle(
        _MAPPED,
        "SELECT event_id, ts, user_id AS who, event_type, 'act' AS src FROM events UNION ALL SELECT 1000000000 + o_orderkey, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 700), o_custkey, NULL, 'buy' FROM orders",
    )
)
def e6_key_map(spark, sf):
    """One chain over two tables whose key columns have different names."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_orderkey") + 1_000_000_000).alias("order_no"), F.timestamp_seconds(F.lit(1704067200) + (F.col("o_orderkey") % 700) * 3600).alias("at")
    )
    acts = events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    both = match.aligned(act=(acts, {"user_id": "who"}), buy=(orders, {"o_custkey": "who", "order_no": "event_id", "at": "ts"}))
    return rule.flat(rule.run(_MAPPED, both))


@query(
    f"SELECT * FROM (SELECT window_start_us, user_id, scan, row_number() OVER (PARTITION BY window_start_us ORDER BY scan DESC, user_id) AS rank FROM (SELECT {sql.us('time_bucket(INTERVAL 1 DAY, ts)')} AS window_start_us, user_id, count(DISTINCT k) AS scan FROM {E} GROUP BY ALL HAVING count(DISTINCT k) >= 3)) WHERE rank <= 2"
)
def f12_top_scanners(spark, sf):
    per = windows.fixed(events(spark, sf), "ts", "1d").groupBy("window_start", "user_id").agg(F.count_distinct("k").alias("scan")).where("scan >= 3")
    return alerts.top(per, ["window_start"], F.col("scan"), 2, "user_id").select(us("window_start"), "user_id", "scan", F.col("rank").cast("bigint").alias("rank"))


_FIRST = Rule("stage_one", ("sip",), "1d", (Step("TRUE", 2),), 50, ("ip", "sip"), "action = 'syn'")
_SECOND = Rule("stage_two", ("sip",), "5d", (Step("TRUE", 2),), 80, ("ip", "sip"))
_STAGE_SQL = f"SELECT CAST(entity_id AS BIGINT) AS sip, make_timestamp(fired_at_us) AS ts, entity_id || ':' || fired_at_us AS event_id, rule_name FROM ({rule.oracle(_FIRST, view_sql('conn'), name='a')})"


@query(rule.oracle(_SECOND, _STAGE_SQL))
def f13_pipeline(spark, sf):
    first = rule.run(_FIRST, view(spark, sf, "conn"))
    return rule.flat(rule.run(_SECOND, rule.alerts_as_events(first, {"sip": F.col("entity_id").cast("bigint")})))


@query(f"SELECT rule_name, count(*) AS n FROM ({rule.oracle(_FIRST, view_sql('conn'), name='a')}) GROUP BY rule_name UNION ALL SELECT rule_name, count(*) FROM ({rule.oracle(_SECOND, _STAGE_SQL)}) GROUP BY rule_name")
def f14_chain(spark, sf):
    """Rules that read each other's alerts, run in dependency order, as counts per rule."""
    made: dict[str, DataFrame] = {}
    rules = {r.name: r for r in (_FIRST, _SECOND)}
    for name in rule.ordered({"stage_two": {"stage_one"}, "stage_one": set()}):
        source = view(spark, sf, "conn") if name == "stage_one" else rule.alerts_as_events(made["stage_one"], {"sip": F.col("entity_id").cast("bigint")})
        made[name] = rule.run(rules[name], source)
    return made["stage_one"].unionByName(made["stage_two"]).groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))


_MANY = [d.port_scan(3, 3, "3d"), d.netflow_syn_scan(3, "3d"), d.data_exfiltration(3, 5000, "3d"), _AND]


@query(" UNION ALL ".join(f"SELECT * FROM ({rule.oracle(r, view_sql('conn'), name=f'w{i}')})" for i, r in enumerate(_MANY[:3])))
def f15_multi_rule(spark, sf):
    """Three of four rules over one view, chosen by name."""
    rows = view(spark, sf, "conn")
    return rule.flat(rule.run_all(_MANY, {r.name: rows for r in _MANY}, [r.name for r in _MANY[:3]]))


@query(f"SELECT rule_name, score, entity_type, entity_id, origin, fired_at_us FROM ({rule.oracle(_FIRST, view_sql('conn'))})")
def g5_dedup(spark, sf):
    once = rule.run(_FIRST, view(spark, sf, "conn"))
    return rule.flat(alerts.distinct(once.unionByName(once))).drop("measure")


@query(f"SELECT event_id, src, ts_us FROM (SELECT event_id, 'a' AS src, {sql.us('ts')} AS ts_us FROM {E} WHERE k < 10 UNION ALL SELECT event_id, 'b', {sql.us('ts')} FROM {E} WHERE k >= 95) ORDER BY ts_us, event_id")
def g3_merge(spark, sf):
    e = events(spark, sf)
    both = e.where("k < 10").withColumn("src", F.lit("a")).unionByName(e.where("k >= 95").withColumn("src", F.lit("b")))
    return both.orderBy("ts", "event_id").select("event_id", "src", us("ts"))


