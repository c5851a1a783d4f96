"""DuckDB statements with the results the registered queries must give.

They state the meaning literally (rule windows are simulated event by event) and
share nothing with the Spark operators but the derived input columns.
"""

from __future__ import annotations

import re

from .fixtures import duckdb_views

_VIEWS = duckdb_views()


def _needs(sql: str, known: dict[str, str], found: list[str], inside: str = "") -> None:
    for name, body in known.items():
        if name != inside and name not in found and re.search(rf"\b{name}\b", sql):
            _needs(body, known, found, name)
            found.append(name)


def _with(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with the derived views it names in front."""
    known = {**_VIEWS, **(extra or {})}
    found: list[str] = []
    _needs(sql, known, found)
    if not found:
        return sql
    return f"with recursive {', '.join(f'{n} as ({known[n]})' for n in found)} {sql}"


PAGE = "event_id, timestamp, source, event_type, severity, source_ip"
WORDS = r"regexp_split_to_array(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+')"
DOC_WORDS = WORDS.format("text")
LINE_WORDS = WORDS.format("line")
LINE_TEXT = f"concat(' ', array_to_string({LINE_WORDS}, ' '), ' ')"


def _iso(ts: str) -> str:
    return (
        f"case when epoch_us({ts}) % 1000000 = 0 then strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"else strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') end"
    )


# Log formats, as searched by DuckDB.
_T = r"(\w+\s+\d+\s+[\d:]+)\s+"
_SSHD = _T + r"\S+\s+sshd\[\d+\]:\s+"
_FAILED = _SSHD + r"Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)"
_ACCEPTED = _SSHD + r"Accepted (?:password|publickey) for (\S+) from ([\d.]+) port (\d+)"
_INVALID = _SSHD + r"Invalid user (\S+) from ([\d.]+) port (\d+)"
_SUDO = _T + r"\S+\s+sudo:\s+(\S+)\s+:.*COMMAND=(.*)"
_MAX = (
    _SSHD
    + r"maximum authentication attempts exceeded for (?:invalid user )?(\S+) from ([\d.]+)"
)
_SYSLOG = r"^(\w+\s+\d+\s+[\d:]+)\s+(\S+)\s+(\S+?)(?:\[\d+\])?:\s+(.*)"
_AUTH_KIND = (
    f"case when regexp_matches(value, '{_FAILED}') then 'ssh_failed' "
    f"when regexp_matches(value, '{_ACCEPTED}') then 'ssh_success' "
    f"when regexp_matches(value, '{_INVALID}') then 'ssh_invalid_user' "
    f"when regexp_matches(value, '{_SUDO}') then 'sudo_command' "
    f"when regexp_matches(value, '{_MAX}') then 'ssh_brute_force' end"
)


def _stamp(text: str) -> str:
    return (
        rf"try_strptime(concat('2024 ', regexp_replace({text}, '\s+', ' ', 'g')), "
        "'%Y %b %d %H:%M:%S')"
    )


def _group(i: int, ssh: bool = True) -> str:
    kinds = [("ssh_failed", _FAILED), ("ssh_success", _ACCEPTED), ("ssh_invalid_user", _INVALID)]
    if i <= 3:
        kinds.append(("ssh_brute_force", _MAX))
    if not ssh:
        kinds.append(("sudo_command", _SUDO))
    whens = " ".join(f"when '{k}' then regexp_extract(value, '{p}', {i})" for k, p in kinds)
    return f"case kind {whens} end"


_SEVERITY_TEXT = (
    "case when m like '%error%' then 'medium' when m like '%fail%' then 'medium' "
    "when m like '%critical%' then 'high' when m like '%panic%' then 'critical' "
    "when m like '%segfault%' then 'high' when m like '%oom-killer%' then 'high' "
    "when m like '%killed process%' then 'high' when m like '%out of memory%' then 'high' "
    "else 'info' end"
)

# Fixed rule settings: predicate, key, severity, name, response, window, threshold.
_IP_KEY = "coalesce(nullif(source_ip, ''), 'unknown')"
_RULES = {
    "BRUTE_001": ("event_type in ('ssh_failed', 'ssh_brute_force')", _IP_KEY, "high",
                  "SSH Brute Force", "flag + auto-block suggestion", 300, 10),
    "PRIV_001": ("event_type = 'sudo_command'", "coalesce(username, 'unknown')", "critical",
                 "Privilege Escalation Attempt", "immediate alert", 120, 1),
    "SCAN_001": ("source = 'network'", _IP_KEY, "medium",
                 "Port Scan Detection", "flag + network context", 60, 50),
    "EXFIL_001": ("source = 'network'", _IP_KEY, "high",
                  "Data Exfiltration Indicator", "alert + traffic breakdown", 600, 3),
}


def _simulated(name: str, view: str, predicate: str, key: str, window: int, threshold: int):
    """A rule's buffer, event by event: ``buf`` is the buffer with the event added."""
    kept = f"case when len(s.buf) >= {threshold} then []::bigint[] else s.buf end"
    return {
        f"{name}_in": (
            f"select {key} as key, epoch_us(timestamp) as us, event_id as id, row_number() over "
            f"(partition by {key} order by timestamp, event_id) as rn from {view} where {predicate}"
        ),
        f"{name}_sim": (
            f"select key, rn, us, id, [us] as buf from {name}_in where rn = 1 union all "
            f"select e.key, e.rn, e.us, e.id, list_append(list_filter({kept}, "
            f"lambda x: x >= e.us - {window * 1000000}), e.us) "
            f"from {name}_sim s join {name}_in e on e.key = s.key and e.rn = s.rn + 1"
        ),
        f"{name}_fires": (
            f"select key as group_key, make_timestamp(us) as fired_at, id as fired_id, "
            f"cast(len(buf) as int) as matched, list_transform(buf[1:10], lambda x: "
            f"{_iso('make_timestamp(x)')}) as evidence from {name}_sim where len(buf) >= {threshold}"
        ),
    }


def _of_rule(rule_id: str, view: str = "sec_burst") -> dict[str, str]:
    predicate, key, *_, window, threshold = _RULES[rule_id]
    return _simulated(rule_id.lower(), view, predicate, key, window, threshold)


_ALL_RULES = {name: body for r in _RULES for name, body in _of_rule(r).items()}
_ALL_FIRES = " union all ".join(
    f"select '{r}' as rule_id, '{severity}' as severity, '{name}' as name, "
    f"'{response}' as response, {window} as secs, * from {r.lower()}_fires"
    for r, (_, _, severity, name, response, window, _) in _RULES.items()
)


def _fire(rule_id: str) -> str:
    return _with(
        f"select '{rule_id}' as rule_id, group_key, fired_at, fired_id, matched, "
        f"array_to_string(evidence, ',') as evidence from {rule_id.lower()}_fires",
        _of_rule(rule_id),
    )


_DNS = {
    "domains": (
        "select domain from sec_events where event_type = 'dns_query' and domain <> '' union "
        "select regexp_extract(url, '://([^/?#:]+)', 1) from pages"
    ),
    "labels_of": (
        "select domain, split_part(domain, '.', 1) as l, string_split(domain, '.') as parts "
        "from domains"
    ),
    "dns_f": (
        "select domain, l, coalesce(list_aggregate(string_split(l, ''), 'entropy'), 0) as entropy, "
        "cast(length(l) as double) as subdomain_length, "
        "(length(l) - length(regexp_replace(l, '[0-9]', '', 'g'))) / greatest(length(l), 1) "
        "as digit_ratio, "
        "(length(l) - length(regexp_replace(l, '[bcdfghjklmnpqrstvwxyz]', '', 'gi'))) "
        "/ greatest(length(l), 1) as consonant_ratio, "
        "cast(regexp_matches(l, '^[a-f0-9]{16,}$') as double) as has_hex, "
        "cast(greatest(len(parts) - 2, 0) as double) as dot_count, "
        "cast(coalesce(list_max(list_transform(parts[:-2], lambda x: length(x))), 0) as double) "
        "as max_label_length, "
        "cast(length(domain) as double) as total_length from labels_of"
    ),
    "dns_l": (
        "select domain, entropy, case when has_hex > 0.5 and subdomain_length > 16 "
        "then 'tunneling_suspect' "
        "when entropy > 3.8 and digit_ratio > 0.4 and subdomain_length > 12 then 'dga_suspect' "
        "when entropy > 4.0 and subdomain_length > 20 then 'tunneling_suspect' "
        "else 'normal' end as label, "
        "cast(case when has_hex > 0.5 and subdomain_length > 16 then 0.85 "
        "when entropy > 3.8 and digit_ratio > 0.4 and subdomain_length > 12 then 0.7 "
        "when entropy > 4.0 and subdomain_length > 20 then 0.65 else 0.9 end as double) "
        "as confidence from dns_f"
    ),
}


def _traffic(seconds: int, start: str, host: str = "") -> str:
    return (
        f"select {start} as window_start, {host} count(*) / {seconds}.0 as packets_per_second, "
        f"sum(bytes) / {seconds}.0 as bytes_per_second, "
        "count(distinct dest_ip) as unique_dest_ips, "
        "count(distinct dest_port) as unique_dest_ports, "
        "count(*) filter (protocol = 'tcp') / count(*) as tcp_ratio, "
        "count(*) filter (protocol = 'udp') / count(*) as udp_ratio "
        "from sec_events where source = 'network' group by all"
    )


_FEATURES = (
    "packets_per_second", "bytes_per_second", "unique_dest_ips", "unique_dest_ports",
    "tcp_ratio", "udp_ratio",
)
_SNAPSHOT_COLUMNS = (
    "round(packets_per_second, 6) as packets_per_second, "
    "round(bytes_per_second, 6) as bytes_per_second, unique_dest_ips, unique_dest_ports, "
    "round(tcp_ratio, 6) as tcp_ratio, round(udp_ratio, 6) as udp_ratio"
)
_SNAPSHOTS = {"snapshots": _traffic(3600, "date_trunc('hour', timestamp)")}


def _half_up(number: str, digits: int) -> str:
    """The number as text, halves rounded up."""
    return f"printf('%.{digits}f', floor({number} * {10**digits} + 0.5) / {10**digits})"


_NARRATED = "if(len(flags) > 0, concat('Statistical outliers: ', array_to_string(flags, ', ')), 'Normal traffic pattern')"
# Alert rows of each detector: severity, narrative, created_at.
_TRAFFIC_ALERTS = (
    f"select 'high' as severity, concat('Anomalous network traffic (score: ', "
    f"{_half_up('least(1.0, len(flags) * 0.3)', 2)}, '): ', {_NARRATED}) as narrative, window_start as created_at "
    "from flagged where len(flags) >= 2"
)
_DNS_ALERTS = (
    "select case when label = 'tunneling_suspect' then 'high' else 'medium' end as severity, "
    "concat('Suspicious DNS query: ', domain, ' classified as ', label, ' (confidence: ', "
    f"{_half_up('confidence * 100', 0)}, '%). Subdomain entropy: ', {_half_up('entropy', 2)}, '.') as narrative, "
    "timestamp as created_at from sec_events join dns_l using (domain) "
    "where event_type = 'dns_query' and label <> 'normal'"
)
_LOGIN_ALERTS = (
    "select 'high' as severity, concat('Anomalous login detected (score: ', "
    f"{_half_up('score', 2)}, '). Source IP: ', coalesce(source_ip, 'None'), ', User: ', "
    "coalesce(username, 'unknown'), '. This login deviates from established baseline patterns.') as narrative, "
    "timestamp as created_at from logins join login_scores using (x) where score >= 0.52"
)
_RULE_ALERTS = (
    "select severity, concat('Rule ''', name, ''' triggered: ', cast(matched as string), "
    "' matching events from ', group_key, ' within ', cast(secs as string), "
    f"'s window. Recommended action: ', response) as narrative, fired_at as created_at from ({_ALL_FIRES})"
)


def _flagged(limit: float, where: str = "") -> dict[str, str]:
    stats = ", ".join(
        f"avg({f}) as {f}_m, case when stddev_pop({f}) < 1e-12 then 1 else stddev_pop({f}) "
        f"end as {f}_s"
        for f in _FEATURES
    )
    off = "abs(({0} - {0}_m) / {0}_s)"
    flags = ", ".join(
        f"case when n >= 30 and {off.format(f)} > {limit} then concat('{f} (', {_half_up(off.format(f), 1)}, 'σ)') end"
        for f in _FEATURES
    )
    return {
        **_SNAPSHOTS,
        "base_stats": f"select count(*) as n, {stats} from snapshots {where}",
        "flagged": (
            f"select window_start, list_filter([{flags}], lambda x: x is not null) as flags "
            "from snapshots, base_stats"
        ),
    }


def _draw(*parts: str) -> str:
    text = f"concat_ws(':', {', '.join(parts)})"
    return f"('0x' || substr(md5({text}), 1, 13))::bigint / {16**13}::double"


_SAMPLE = 256
_PATH = (
    "case when {0} > 2 then 2 * (ln({0} - 1.0) + 0.5772156649015329) - 2 * ({0} - 1.0) / {0} "
    "when {0} = 2 then 1.0 else 0.0 end"
)


def _forest(p: str, features: int, train: str, rows: str) -> dict[str, str]:
    """A forest grown and walked in SQL: ``train`` gives (id, x), ``rows`` the x to score.

    A row's trees are the places its draws lead to; samples are split node by node; every
    row then goes down every tree. ``{p}_scores`` has (x, score).
    """
    lows = ", ".join(f"min(x[{i + 1}]) over w" for i in range(features))
    highs = ", ".join(f"max(x[{i + 1}]) over w" for i in range(features))
    gap = f"case when share >= 1 then 0 else floor(ln({_draw('42', chr(39) + 'rows' + chr(39), 'id', '{0}')} + {16.0**-13!r}) / ln(1 - share))::bigint end"
    split = (
        f"select *, case when len(usable) > 0 and depth < ceil(log2(greatest(psi, 2))) and n > 1 then "
        f"usable[1 + floor({_draw('42', chr(39) + 'feature' + chr(39), 'tree', 'node')} * len(usable))::int] end as f, "
        f"{_draw('42', chr(39) + 'split' + chr(39), 'tree', 'node')} as u from (select *, "
        f"list_filter(range(1, {features + 1}), lambda i: hi[i] > lo[i]) as usable from "
        f"(select *, count(*) over w as n, [{lows}] as lo, [{highs}] as hi from {{0}} window w as (partition by tree, node)))"
    )
    cut = "case when lo[f] + u * (hi[f] - lo[f]) <= lo[f] or lo[f] + u * (hi[f] - lo[f]) > hi[f] then hi[f] else lo[f] + u * (hi[f] - lo[f]) end"
    columns = f"tree, node, depth, x, psi, n, f, {cut} as split"
    return {
        f"{p}_train": train,
        f"{p}_share": (
            f"select least(1.0, (least({_SAMPLE}, count(*)) + 6 * sqrt(least({_SAMPLE}, count(*)))) / count(*)) as share, "
            f"least({_SAMPLE}, count(*)) as size from {p}_train"
        ),
        f"{p}_draws": (
            f"select id, x, 0 as i, {gap.format(0)} as tree from {p}_train, {p}_share union all "
            f"select id, x, i + 1, tree + 1 + {gap.format('i + 1')} from {p}_draws, {p}_share where tree < 99"
        ),
        f"{p}_sample": (
            f"select *, count(*) over (partition by tree) as psi from (select tree, 1::bigint as node, 0 as depth, x from {p}_draws, {p}_share "
            f"where tree < 100 qualify row_number() over (partition by tree order by {_draw('42', chr(39) + 'order' + chr(39), 'id', 'tree')}, id) <= size)"
        ),
        f"{p}_grown": (
            f"select {columns} from ({split.format(f'{p}_sample')}) union all select {columns} from ("
            + split.format(
                f"(select tree, node * 2 + (x[f] >= split)::int as node, depth + 1 as depth, x, psi from {p}_grown where f is not null)"
            )
            + ")"
        ),
        f"{p}_nodes": (
            f"select distinct tree, node, f, split, (depth + {_PATH.format('n')}) / greatest({_PATH.format('psi')}, 1.0) as path from {p}_grown"
        ),
        f"{p}_rows": f"select distinct x from (select x from {p}_train union all {rows})",
        f"{p}_walk": (
            f"select x, tree, 1::bigint as node from {p}_rows, (select distinct tree from {p}_nodes) union all "
            f"select w.x, w.tree, w.node * 2 + (w.x[n.f] >= n.split)::int from {p}_walk w join {p}_nodes n "
            "on w.tree = n.tree and w.node = n.node where n.f is not null"
        ),
        f"{p}_raw": (
            f"select w.x, pow(2, -avg(n.path)) as raw from {p}_walk w join {p}_nodes n on w.tree = n.tree and w.node = n.node "
            "where n.f is null group by w.x"
        ),
        f"{p}_offset": f"select quantile_cont(round(raw, 6), 0.95) as q from {p}_train join {p}_raw using (x)",
        f"{p}_scores": f"select x, least(greatest(0.5 - (q - raw), 0.0), 1.0) as score from {p}_raw, {p}_offset",
    }


_LOGINS = {
    "logins": (
        "select event_id, timestamp, source_ip, username, [hour(timestamp)::double, (isodow(timestamp) - 1)::double, "
        "(isodow(timestamp) >= 6)::int::double, "
        "(('0x' || substr(md5(coalesce(nullif(source_ip, ''), 'unknown')), 1, 8))::bigint % 1000)::double, "
        "(event_type = 'ssh_success')::int::double, "
        "(('0x' || substr(md5(coalesce(nullif(username, ''), 'unknown')), 1, 8))::bigint % 1000)::double] as x "
        "from sec_events where source = 'auth' and event_type in ('ssh_failed', 'ssh_success', 'ssh_invalid_user')"
    )
}


def _login_forest(until: str, view: str = "sec_events") -> dict[str, str]:
    train = (
        f"select event_id::varchar as id, x from logins where timestamp >= timestamp '{until}' - interval 30 days "
        f"and timestamp < timestamp '{until}'"
    )
    logins = {"logins": _LOGINS["logins"].replace("sec_events", view)}
    return {**logins, **_forest("login", 6, train, "select x from logins")}


_TRAFFIC_X = f"[{', '.join(f'{f}::double' for f in _FEATURES)}] as x"
_TRAFFIC_FOREST = {
    **_flagged(3.0),
    **_forest(
        "traffic",
        6,
        f"select epoch(window_start)::bigint::varchar as id, {_TRAFFIC_X} from snapshots where window_start < timestamp '2024-01-25'",
        f"select {_TRAFFIC_X} from snapshots",
    ),
}


# Expected sentences, by the type of the first event.
_SOURCE = "coalesce(nullif(f.source_ip, ''), 'unknown source')"
_PORT = "coalesce(cast(nullif(f.dest_port, 0) as varchar), 'N/A')"
_NARRATIVE = f"""case f.event_type
when 'ssh_failed' then concat('Password guessing over SSH: ', n, ' wrong passwords sent by ', {_SOURCE}, ' to port ', {_PORT},
  ', all in ', window_minutes, ' minutes. Next step: ask who owns the address, and rate-limit it until somebody answers.')
when 'ssh_brute_force' then concat('SSH brute-force attempt: the server cut ', {_SOURCE}, ' off ', n,
  ' times for too many tries. Next step: drop packets of ', {_SOURCE}, ', then reset the accounts it aimed at.')
when 'ssh_invalid_user' then concat('Search for account names: ', {_SOURCE}, ' asked ', n,
  ' times for users this machine does not have. Next step: shut the address out and compare its names with the real ones.')
when 'connection_attempt' then concat('Port scan: ', {_SOURCE}, ' knocked ', n, ' times in ', window_minutes,
  ' minutes. Next step: list the ports that answered and close those nobody needs.')
when 'dns_query' then concat('Odd DNS names: ', n, ' queries of ', {_SOURCE},
  ', rated suspicious activity. Next step: decode a few of the names and isolate the machine if they carry data.')
else concat('Unusual run of ', f.event_type, ': ', n, ' events, severity medium, from ', {_SOURCE}, ' in ', window_minutes,
  ' minutes; suspicious activity. Next step: find out what the address is used for.') end"""

_ALERT_STATE = {
    "alert_state": (
        "select alert_id, severity, narrative, created_at, event_time, "
        "case when alert_id in (select alert_id from sec_acks) then 1 else 0 end as acknowledged "
        "from sec_alerts"
    ),
    "sev": "select severity as v, count(*) as n from sec_events group by 1",
    "ips": (
        "select source_ip as v, count(*) as n from sec_events where source_ip is not null "
        "group by 1 order by n desc, v limit 10"
    ),
    "types": (
        "select event_type as v, count(*) as n from sec_events group by 1 "
        "order by n desc, v limit 10"
    ),
}
_CARDS = (
    "(select count(*) from sec_events) as total_events, "
    "(select count(*) from sec_events where timestamp >= timestamp '2024-01-29 11:00:00') "
    "as events_last_hour, "
    "(select count(*) from alert_state where acknowledged = 0) as open_alerts"
)


def _facet(view: str, name: str) -> str:
    return (
        f"(select string_agg(concat(v, '=', cast(n as string)), ',' order by n desc, v) "
        f"from {view}) as {name}"
    )


def _hash_bucket(text: str) -> str:
    return f"cast(cast(concat('0x', substr(md5({text}), 1, 8)) as bigint) % 1000 as int)"


_TOP_IPS = (
    "select source_ip, count(*) as count from sec_events where source_ip is not null "
    "group by 1 order by count desc, source_ip limit 10"
)
_EDGES = {
    "edges": (
        "select coalesce(source_ip, 'local') as src, coalesce(dest_ip, 'local') as dst, "
        "count(*) as count from sec_events "
        "where coalesce(source_ip, 'local') <> coalesce(dest_ip, 'local') group by 1, 2"
    )
}
_HOURS = "strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H:%M') as hour"


def _severities(*names: str) -> str:
    return ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in names)


def oracle_statements() -> dict[str, str]:
    """One statement per query; the forest of Spark ML (`dns_forest`) has none."""
    burst_ip = "(partition by source_ip order by timestamp "
    statements = {
        "search_page": _with(
            f"select {PAGE} from sec_events where source = 'auth' and severity = 'medium' "
            "order by timestamp desc, event_id desc limit 100 offset 50"
        ),
        "search_by_severity": _with(
            f"select {PAGE} from sec_events order by case severity when 'info' then 0 "
            "when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end desc, "
            "event_id desc limit 500"
        ),
        "search_after": _with(
            f"select {PAGE} from sec_events where source > 'dns' or "
            "(source = 'dns' and event_id > 300) order by source, event_id limit 200"
        ),
        "search_total": _with(
            "select count(*) as total from sec_events "
            "where event_type = 'ssh_failed' and source_ip = '10.0.0.7'"
        ),
        "search_time_range": _with(
            f"select {PAGE} from sec_events where source = 'network' and timestamp between "
            "timestamp '2024-01-10 00:00:00' and timestamp '2024-01-17 12:00:00'"
        ),
        "event_by_id": _with(f"select {PAGE} from sec_events where event_id = 17"),
        "text_search_all": (
            f"select doc_id, lang from (select *, {DOC_WORDS} as w from documents) "
            "where list_contains(w, 'the') and list_contains(w, 'and') "
            "and not list_contains(w, 'of')"
        ),
        "text_search_any": (
            f"select doc_id, lang from (select *, {DOC_WORDS} as w from documents) "
            "where list_contains(w, 'reau') or list_contains(w, 'thntion') "
            "or list_contains(w, 'eauen')"
        ),
        "text_search_phrase": _with(
            f"select {PAGE} from sec_events where contains({LINE_TEXT}, "
            "' failed password for invalid user ') and list_contains("
            f"{LINE_WORDS}, 'host1')"
        ),
        "text_search_prefix": (
            f"select doc_id, lang from (select *, {DOC_WORDS} as w from documents) "
            "where len(list_filter(w, lambda x: starts_with(x, 'oue'))) > 0"
        ),
        "text_index_search": (
            f"select doc_id, lang from (select *, {DOC_WORDS} as w from documents) "
            "where list_contains(w, 'the') and list_contains(w, 'and') "
            "and not list_contains(w, 'of')"
        ),
        "text_index_phrase": _with(
            f"select {PAGE} from sec_events where contains({LINE_TEXT}, ' failed password for invalid user ') "
            f"and list_contains({LINE_WORDS}, 'host1') and not list_contains({LINE_WORDS}, 'user3')"
        ),
        "rollup_overview": _with(
            "select (select count(*) from sec_events) as total_events, (select count(*) from sec_events "
            "where timestamp >= timestamp '2024-01-29 11:20:00') as events_last_hour, "
            "(select count(*) from sec_events where severity = 'critical') as critical_events, "
            "(select count(*) from alert_state where acknowledged = 0) as open_alerts, "
            f"{_facet('sev', 'severity_breakdown')}, {_facet('ips', 'top_source_ips')}, {_facet('types', 'top_event_types')}",
            _ALERT_STATE,
        ),
        "session_narratives": _with(
            f"select cluster_key, window_start, n as count, f.event_type, f.source_ip, f.dest_port, window_minutes, {_NARRATIVE} as narrative "
            "from (select source_ip as cluster_key, min(timestamp) as window_start, count(*) as n, "
            "greatest(1, ceil(epoch_us(max(timestamp) - min(timestamp)) / 60000000))::int as window_minutes, "
            "first({'event_type': event_type, 'source_ip': source_ip, 'dest_port': dest_port} order by timestamp, event_id) as f "
            "from (select *, count(*) filter (begins) over (partition by source_ip order by timestamp, event_id) as session "
            "from (select *, coalesce(timestamp - lag(timestamp) over (partition by source_ip order by timestamp, event_id) "
            "> interval 60 minutes, true) as begins from sec_events)) group by source_ip, session)"
        ),
        "word_postings": _with(
            f"select word, count(*) as rows from (select unnest(list_distinct({LINE_WORDS})) "
            "as word from sec_events) where word <> '' group by word"
        ),
        "overview": _with(
            f"select {_CARDS}, {_facet('sev', 'severity_breakdown')}, "
            f"{_facet('ips', 'top_source_ips')}, {_facet('types', 'top_event_types')}",
            _ALERT_STATE,
        ),
        "cards": _with(
            f"select {_CARDS}, (select count(*) from sec_events where severity = 'critical') "
            "as critical_events",
            _ALERT_STATE,
        ),
        "severity_breakdown": _with(
            "select severity, count(*) as count, case severity when 'info' then 0 "
            "when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end "
            "as severity_rank from sec_events group by severity"
        ),
        "top_source_ips": _with(_TOP_IPS),
        "top_event_types": _with(
            "select event_type, count(*) as count from sec_events group by 1 "
            "order by count desc, event_type limit 10"
        ),
        "top_share": _with(
            f"select *, round(count / greatest(max(count) over (), 1), 9) as share "
            f"from ({_TOP_IPS})"
        ),
        "heatmap": _with(
            "select cast(dayofweek(timestamp) as int) as day, cast(hour(timestamp) as int) as hour, "
            "count(*) as count from sec_events where timestamp >= timestamp '2024-01-24' "
            "group by 1, 2"
        ),
        "heatmap_dense": _with(
            "select cast(d as int) as day, cast(h as int) as hour, coalesce(n, 0) as count, "
            "case when coalesce(n, 0) = 0 then 0 when n / top > 0.75 then 4 "
            "when n / top > 0.5 then 3 when n / top > 0.25 then 2 else 1 end as band "
            "from range(7) days(d), range(24) hours(h) left join (select dayofweek(timestamp) as dd, "
            "hour(timestamp) as hh, count(*) as n, max(count(*)) over () as top from sec_events "
            "where timestamp >= timestamp '2024-01-24' and severity in ('high', 'critical') "
            "group by 1, 2) on d = dd and h = hh"
        ),
        "timeline": _with(
            f"select {_HOURS}, {_severities('info', 'medium', 'high', 'critical')} "
            "from sec_events group by 1"
        ),
        "timeline_newest": _with(
            f"select {_HOURS}, {_severities('info', 'low', 'medium', 'high', 'critical')} "
            "from (select * from sec_events order by timestamp desc, event_id desc limit 500) "
            "group by 1"
        ),
        "graph_edges": _with("select * from edges", _EDGES),
        "graph_nodes": _with(
            "select id, case when starts_with(id, '10.') or starts_with(id, '192.168.') "
            "then 'internal' else 'external' end as \"group\", cast(sum(n) as bigint) "
            "as event_count from (select src as id, count as n from edges union all "
            "select dst, 0 from edges) group by id",
            _EDGES,
        ),
        "recent": _with(
            f"select {PAGE} from sec_events order by timestamp desc, event_id desc limit 100"
        ),
        "recent_by_severity": _with(
            f"select {PAGE} from (select * from sec_events order by timestamp desc, event_id desc "
            "limit 5000) where severity = 'high' order by timestamp desc, event_id desc limit 100"
        ),
        "live_feed": _with(
            f"select {PAGE} from sec_events order by timestamp desc, event_id desc limit 200"
        ),
        "wire_json": _with(
            f"select {_iso('timestamp')} as timestamp, source, event_type, severity, source_ip, "
            "line as raw_message, dest_ip, cast(dest_port as varchar) as dest_port, username, protocol, "
            "cast(bytes as varchar) as bytes, domain, source_ip is null as no_source, dest_port is null as no_port from sec_events"
        ),
        "parse_auth": _with(
            f"select event_id, {_stamp(_group(1, False))} as timestamp, kind as event_type, "
            "case kind when 'ssh_success' then 'info' when 'sudo_command' then 'low' "
            "when 'ssh_brute_force' then 'high' else 'medium' end as severity, "
            f"{_group(3)} as source_ip, {_group(2, False)} as username, "
            f"coalesce({_group(4)}, '') as port, case when kind = 'sudo_command' "
            f"then trim(regexp_extract(value, '{_SUDO}', 3)) else '' end as command "
            f"from (select *, {_AUTH_KIND} as kind from sec_lines) where kind is not null"
        ),
        "parse_syslog": _with(
            f"select event_id, {_stamp('g[1]')} as timestamp, "
            f"concat('syslog_', g[3]) as event_type, {_SEVERITY_TEXT} as severity, "
            "g[2] as hostname, g[3] as process from (select event_id, "
            f"[regexp_extract(value, '{_SYSLOG}', 1), regexp_extract(value, '{_SYSLOG}', 2), "
            f"regexp_extract(value, '{_SYSLOG}', 3)] as g, "
            f"lower(regexp_extract(value, '{_SYSLOG}', 4)) as m from sec_lines "
            f"where regexp_matches(value, '{_SYSLOG}'))"
        ),
        "parse_rejects": _with(
            "select event_id, case when source = 'auth' then 'auth' else 'syslog' end as source, "
            "line as raw_message, 'no_match' as reject_reason from "
            f"(select event_id, source, line, line as value from sec_events) where "
            f"case when source = 'auth' then ({_AUTH_KIND}) is null "
            f"else not regexp_matches(value, '{_SYSLOG}') end"
        ),
        "ingest_logs": _with(
            "select source, event_type, severity, count(*) as count from (select "
            "case when source = 'auth' then 'auth' else 'syslog' end as source, "
            f"coalesce(case when source = 'auth' then ({_AUTH_KIND}) "
            f"when regexp_matches(value, '{_SYSLOG}') "
            f"then concat('syslog_', regexp_extract(value, '{_SYSLOG}', 3)) end, 'no_match') "
            "as event_type, case when source = 'auth' then case ("
            f"{_AUTH_KIND}) when 'ssh_success' then 'info' when 'sudo_command' then 'low' "
            "when 'ssh_brute_force' then 'high' else 'medium' end "
            f"when regexp_matches(value, '{_SYSLOG}') then {_SEVERITY_TEXT} else '' end "
            "as severity from (select source, line as value, lower(line) as m from sec_events)) "
            "group by 1, 2, 3"
        ),
        "syslog_severity": _with(
            f"select source, {_SEVERITY_TEXT} as found, count(*) as count "
            "from (select source, lower(line) as m from sec_events) group by 1, 2"
        ),
        "validate_events": _with(
            "select event_id, case when line is null then 'raw_message_null' "
            "when source not in ('auth', 'syslog', 'network', 'dns') then 'source_value' "
            "when severity not in ('info', 'low', 'medium', 'high', 'critical') "
            "then 'severity_value' else 'dest_port_range' end as violations from sec_invalid "
            "where line is null or source not in ('auth', 'syslog', 'network', 'dns') "
            "or severity not in ('info', 'low', 'medium', 'high', 'critical') "
            "or dest_port not between 0 and 65535"
        ),
        "fire_brute": _fire("BRUTE_001"),
        "fire_scan": _fire("SCAN_001"),
        "fire_exfil": _fire("EXFIL_001"),
        "fire_borderline": _with(
            "select group_key, fired_at, fired_id from borderline_fires",
            _simulated(
                "borderline", "sec_burst", "event_type = 'ssh_failed'", "source_ip", 2, 4
            ),
        ),
        "priv_alerts": _with(
            "select coalesce(username, 'unknown') as group_key, timestamp as fired_at, "
            "event_id as fired_id, 'critical' as severity from sec_events "
            "where event_type = 'sudo_command'"
        ),
        "match_rules": _with(
            " union all ".join(
                f"select '{r}' as rule_id, {key} as group_key, count(*) as count from sec_events "
                f"where {predicate} group by 1, 2"
                for r, (predicate, key, *_) in _RULES.items()
            )
        ),
        "rule_alerts": _with(
            "select concat('[\"', array_to_string(evidence, '\",\"'), '\"]') as event_cluster, "
            "severity, concat('Rule ''', name, ''' triggered: ', cast(matched as string), "
            "' matching events from ', group_key, ' within ', cast(secs as string), "
            "'s window. Recommended action: ', response) as narrative, 0 as acknowledged, "
            f"fired_at as created_at from ({_ALL_FIRES})",
            _ALL_RULES,
        ),
        "recent_matches": _with(
            f"select rule_id, group_key, fired_at, fired_id from ({_ALL_FIRES}) "
            "order by fired_at desc, fired_id desc, rule_id desc limit 100",
            _ALL_RULES,
        ),
        "rolling_count": _with(
            f"select event_id, count(*) over {burst_ip} "
            "range between interval 5 seconds preceding and current row) as rolling from sec_burst"
        ),
        "sudo_sequence": _with(
            "select event_id, timestamp, first_at from (select *, last_value(case when event_type "
            "= 'ssh_failed' then timestamp end ignore nulls) over (partition by "
            "coalesce(username, 'unknown') order by timestamp, event_id rows between "
            "unbounded preceding and 1 preceding) as first_at from sec_burst "
            "where event_type in ('ssh_failed', 'sudo_command')) where event_type = 'sudo_command' "
            "and timestamp - first_at <= interval 3 seconds"
        ),
        "sudo_failure_sequence": _with(
            "select event_id, happened as timestamp, first_at from (select *, last_value(case when failed "
            "then happened end ignore nulls) over (partition by username order by happened, event_id rows between "
            "unbounded preceding and 1 preceding) as first_at from (select event_id, username, "
            "date_trunc('second', timestamp) as happened, event_type = 'syslog_CRON' as failed from sec_events "
            "where event_type = 'sudo_command' or (event_type = 'syslog_CRON' and event_id % 2 = 1))) "
            "where not failed and happened - first_at <= interval 180 seconds"
        ),
        "port_scan_distinct": _with(
            "select group_key, timestamp, event_id, distinct_items from (select source_ip "
            "as group_key, timestamp, event_id, count(distinct dest_port) over "
            f"{burst_ip} range between interval 60 seconds preceding and current row) "
            "as distinct_items from sec_burst where source = 'network') where distinct_items > 25"
        ),
        "exfil_deviation": _with(
            "select host, bucket, round(total, 3) as total, samples, round(mean, 3) as mean, "
            "round(std, 3) as std from (select *, count(*) over w as samples, "
            "avg(total) over w as mean, stddev_pop(total) over w as std from "
            "(select concat('host', cast(event_id % 3 as string)) as host, "
            "date_trunc('hour', timestamp) as bucket, sum(bytes) as total from sec_events "
            "where source = 'network' group by 1, 2) window w as (partition by host "
            "order by bucket rows between 720 preceding and 1 preceding)) "
            "where samples >= 30 and total > mean + 2 * std"
        ),
        "login_features": _with(
            "select event_id, cast(hour(timestamp) as int) as hour_of_day, "
            "cast(isodow(timestamp) - 1 as int) as day_of_week, "
            "cast(isodow(timestamp) >= 6 as int) as is_weekend, "
            f"{_hash_bucket('coalesce(source_ip, $$unknown$$)')} as source_ip_hash, "
            "cast(event_type = 'ssh_success' as int) as auth_success, "
            f"{_hash_bucket('coalesce(username, $$unknown$$)')} as username_hash "
            "from sec_events where source = 'auth' "
            "and event_type in ('ssh_failed', 'ssh_success', 'ssh_invalid_user')"
        ),
        "dns_features": _with(
            "select domain, round(entropy, 9) as entropy, subdomain_length, "
            "round(digit_ratio, 9) as digit_ratio, round(consonant_ratio, 9) as consonant_ratio, "
            "has_hex, dot_count, max_label_length, total_length from dns_f",
            _DNS,
        ),
        "dns_analysis": _with(
            "select domain, cast(subdomain_length as int) as subdomain_length, "
            "round(entropy, 9) as subdomain_entropy, has_hex = 1 as has_hex_encoding, "
            "regexp_matches(l, '^[A-Za-z0-9+/]{20,}={0,2}$') as has_base64_encoding, "
            "(entropy > 4 and subdomain_length > 20) or has_hex = 1 as suspicious from dns_f",
            _DNS,
        ),
        "dns_heuristic": _with("select domain, label, confidence from dns_l", _DNS),
        "dns_forest_held_out": _with(
            "select label, count(*) as domains, true as learned, true as shares, true as same_features "
            "from dns_l where substr(md5(domain), 1, 1) in ('0', '1', '2', '3') group by label",
            _DNS,
        ),
        "dns_alerts": _with(_DNS_ALERTS, _DNS),
        "traffic_snapshots": _with(
            f"select window_start, {_SNAPSHOT_COLUMNS} from snapshots", _SNAPSHOTS
        ),
        "traffic_by_host": _with(
            f"select window_start, host, {_SNAPSHOT_COLUMNS} from by_host",
            {
                "by_host": _traffic(
                    6 * 3600, "time_bucket(interval '6 hours', timestamp)", "source_ip as host,"
                )
            },
        ),
        "traffic_zscores": _with(
            "select window_start, array_to_string(flags, ',') as flags from flagged",
            _flagged(2.0, "where window_start < timestamp '2024-01-25'"),
        ),
        "traffic_analysis": _with(
            "select window_start, round(least(1.0, len(flags) * 0.3), 6)::double as anomaly_score, "
            "len(flags) >= 2 as is_anomalous, "
            f"{_NARRATED} as description from flagged",
            _flagged(2.0),
        ),
        "traffic_alerts": _with(_TRAFFIC_ALERTS, _flagged(1.5)),
        "login_forest_scores": _with(
            "select event_id, round(score, 6) as anomaly_score, score > 0.5 as is_anomaly "
            "from logins join login_scores using (x) where timestamp >= timestamp '2024-01-25'",
            _login_forest("2024-01-25"),
        ),
        "login_alerts": _with(_LOGIN_ALERTS, _login_forest("2024-01-25")),
        "score_events": _with(
            "select event_id, round(coalesce(score, 0.0), 6) as anomaly_score from sec_events "
            "left join (select event_id, score from logins join login_scores using (x)) using (event_id)",
            _login_forest("2024-01-31"),
        ),
        "traffic_forest_scores": _with(
            "select window_start, round(greatest(score, least(1.0, len(flags) * 0.3)), 6)::double as anomaly_score, "
            "greatest(score, least(1.0, len(flags) * 0.3)) > 0.5 or len(flags) >= 2 as is_anomalous "
            f"from (select window_start, {_TRAFFIC_X} from snapshots) join traffic_scores using (x) join flagged using (window_start)",
            _TRAFFIC_FOREST,
        ),
        "alerts_list": _with(
            "select alert_id, severity, acknowledged, created_at from alert_state "
            "where acknowledged = 0 and severity = 'high' "
            "order by created_at desc, alert_id desc limit 200 offset 20",
            _ALERT_STATE,
        ),
        "alerts_ack": _with("select alert_id, acknowledged from alert_state", _ALERT_STATE),
        "alerts_ack_unknown": _with(
            "select distinct alert_id from sec_acks "
            "where alert_id not in (select alert_id from sec_alerts)"
        ),
        "alert_narratives": _with(
            "select alert_id, text as narrative, case when length(text) > 60 "
            "then concat(substr(text, 1, 60), '...') else text end as preview, event_time "
            "from (select *, coalesce(nullif(narrative, ''), 'No narrative available.') as text "
            "from sec_alerts)"
        ),
        "anomalies_list": _with(
            "select event_id, anomaly_score from sec_scored where anomaly_score >= 0.9 "
            "order by anomaly_score desc, event_id limit 300 offset 10"
        ),
        "cluster_digest": _with(
            "select source as cluster_key, window_start, string_agg(concat('[', "
            "strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '] ', upper(severity), ' ', event_type, "
            "' from ', coalesce(source_ip, 'local'), ': ', substr(line, 1, 120)), chr(10) "
            "order by timestamp, event_id) as digest from (select *, "
            "time_bucket(interval '6 hours', timestamp) as window_start, row_number() over "
            "(partition by source, time_bucket(interval '6 hours', timestamp) "
            "order by timestamp, event_id) as rn from sec_events) where rn <= 5 group by 1, 2"
        ),
        "cluster_narratives": _with(
            "select key as cluster_key, day as window_start, n as count, f.event_type, "
            "f.source_ip, "
            f"{_NARRATIVE} as narrative from (select *, 1440 as window_minutes from (select source_ip as key, "
            "date_trunc('day', timestamp) as day, count(*) as n, "
            "first({'event_type': event_type, 'source_ip': source_ip, 'dest_port': dest_port} "
            "order by timestamp, event_id) as f from sec_events group by 1, 2))"
        ),
        "detect": _with(
            " union all ".join([_RULE_ALERTS, _LOGIN_ALERTS, _DNS_ALERTS.replace("sec_events", "sec_burst"), _TRAFFIC_ALERTS]),
            {**_ALL_RULES, **_DNS, **_flagged(3.0), **_login_forest("2024-01-31", "sec_burst")},
        ),
        "stream_brute": _with(
            "select 'BRUTE_001' as rule_id, group_key, fired_at, fired_id, matched "
            "from brute_001_fires",
            _of_rule("BRUTE_001"),
        ),
        "stream_rules": _with(f"select rule_id, group_key, fired_at, fired_id from ({_ALL_FIRES})", _ALL_RULES),
        "stream_rule_batches": _with(
            f"select rule_id, group_key, fired_at, fired_id from ({_ALL_FIRES})", _ALL_RULES
        ),
        "detect_stream": _with(
            " union all ".join([_RULE_ALERTS, _LOGIN_ALERTS, _DNS_ALERTS, _TRAFFIC_ALERTS]),
            {
                **{n: b for r in _RULES for n, b in _of_rule(r, "sec_events").items()},
                **_DNS,
                **_flagged(3.0, "where window_start < timestamp '2024-01-25'"),
                **_login_forest("2024-01-25"),
            },
        ),
        "stream_feed": _with(
            f"select {PAGE} from sec_events order by timestamp desc, event_id desc limit 200"
        ),
        "stream_traffic": _with(
            f"select window_start, {_SNAPSHOT_COLUMNS} from snapshots", _SNAPSHOTS
        ),
        "stored_events": _with(
            "select cast(timestamp as date) as event_date, source, count(*) as count "
            "from sec_events where timestamp between timestamp '2024-01-05 00:00:00' "
            "and timestamp '2024-01-20 23:59:59' group by 1, 2"
        ),
    }
    # The stream stores what the batch job stores.
    statements["ingest_stream"] = statements["ingest_logs"]
    # And finds what the batch operators find.
    statements["stream_sudo_sequence"] = statements["sudo_failure_sequence"]
    statements["stream_port_scan"] = statements["port_scan_distinct"]
    statements["stream_session_narratives"] = statements["session_narratives"]
    statements["rollup_heatmap"] = statements["heatmap"]
    statements["rollup_timeline"] = statements["timeline"]
    statements["alerts_ack_bucketed"] = statements["alerts_ack"]
    statements["stream_exfil"] = statements["exfil_deviation"]
    return statements
