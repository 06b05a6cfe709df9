"""The same relations in ANSI SQL, as common table expressions for the oracle."""

from __future__ import annotations

from .. import config as C
from .bindings import AS_OF, CODES, EVENTS_AS_OF, JOB_STATUS, STATUS

NOW, EVENTS_NOW = f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{EVENTS_AS_OF}'"


def case(key: str, values: dict, default: str = "NULL") -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return f"(CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {default} END)"


_code = case("((CAST(left(o_orderpriority, 1) AS INT) - 1) + 5 * (o_orderkey % 3)) % 13", dict(enumerate(CODES)))
_window = case("code", {k: v[2] for k, v in C.TRIGGERS.items()}, str(C.DEFAULT_DECAY_DAYS))
_weight, _half = (case("code", {k: v[i] for k, v in C.TRIGGERS.items()}) for i in (0, 1))
_key = "user_id * 7 + event_id % 7"
_domain = "'customer' || lpad(CAST({k} AS VARCHAR), 9, '0') || '.io'"
_band = case("c_custkey % 6", dict(enumerate(C.BAND_TO_MAX)))
_points = case("band", C.BAND_POINTS, "55.0")
_reach = case("status", C.REACHABILITY, "0.0")
_rank = case("status", {"verified": 0, "role_account": 1, "catch_all": 2, "risky": 3, "unverified": 4}, "9")

RELATIONS: dict[str, str] = {
    "companies": f"""SELECT c_custkey AS k, lower(replace(c_name, '#', '')) || '.io' AS domain, c_name AS display_name, n_name AS country, c_mktsegment AS industry, {_band} AS band,
      CASE WHEN c_custkey % 9 <> 0 THEN 'tpl_' || CAST(c_custkey % 8 AS VARCHAR) END AS template, coalesce(n, 0) AS open_roles,
      CAST(floor(c_acctbal / 200) AS BIGINT) AS subdomains,
      c_custkey % 3 = 0 AS ai, c_custkey % 10 NOT IN (0, 9) AS dns_known, c_custkey % 4 <> 0 AS mx, c_custkey % 3 <> 1 AS spf,
      CASE WHEN c_custkey % 5 = 1 THEN 'none' WHEN c_custkey % 5 > 1 THEN 'reject' END AS dmarc, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS dnssec,
      CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 4 = 1 END AS security_txt
      FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "triggers": f"""SELECT *, observed_at + to_days({_window}) AS decays_at FROM (SELECT o_orderkey AS trigger_id, o_custkey AS k, {_code} AS code,
      {NOW} - to_days(CAST(date_diff('day', o_orderdate, {NOW}) % 240 AS INT)) AS observed_at, o_orderstatus <> 'F' AS active FROM orders)""",
    "evidence": f"""SELECT l_orderkey AS trigger_id, l_orderkey * 10 + l_linenumber AS evidence_id, l_suppkey % 7 AS source_id,
      'https://s' || CAST(l_suppkey AS VARCHAR) || '.example.org/' || CAST(l_partkey AS VARCHAR) AS url,
      {NOW} - to_days(CAST(date_diff('day', l_shipdate, TIMESTAMP '2002-01-01') % 400 AS INT)) AS observed_at,
      CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS reachable, l_linestatus = 'O' AS ours FROM lineitem""",
    "contacts": f"""SELECT event_id AS contact_id, {_key} AS k,
      CASE WHEN event_id % 11 <> 0 THEN (CASE WHEN event_type = 'signup' THEN 'info' ELSE 'user' || CAST(user_id AS VARCHAR) END) || '@' || {_domain.format(k=f"({_key})")} END AS email,
      {case("event_type", STATUS)} AS status, CASE WHEN value > 80 THEN 'User ' || CAST(user_id AS VARCHAR) END AS full_name, ts AS first_seen_at FROM events""",
    "feedback": """SELECT doc_id AS feedback_id, doc_id AS k, CASE WHEN toxic = 1 THEN 'contacted'
    WHEN quality = 1 THEN 'good' ELSE 'bad' END AS verdict, doc_id % 3 AS actor,
      TIMESTAMP '2001-07-01 00:00:00' + to_days(CAST(doc_id % 30 AS INT)) AS created_at FROM labels""",
    "dispatches": f"""SELECT event_id AS dispatch_id, {_key} AS k, CASE WHEN value > 80 THEN 'A' WHEN value > 40 THEN 'B' ELSE 'C' END AS tier,
      CAST(least(100, floor(value)) AS INT) AS score, ts AS dispatched_at FROM events""",
    "jobs": f"""SELECT event_id AS job_id, 'kind_' || CAST(user_id % 4 AS VARCHAR) AS kind, {case("event_type", JOB_STATUS)} AS status,
    CAST(event_id % 5 AS INT) AS priority, ts AS created_at,
      CAST(event_id % 4 AS INT) AS attempts, CAST(event_id % 3 AS INT) AS reclaims, ts + INTERVAL 15 MINUTE AS lease_expires_at,
      'user:' || CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key FROM events""",
    "heartbeats": "SELECT event_id AS seq, event_type AS unit, ts AS seen_at, value >= 10 AS ok, value, user_id % 3 AS build FROM events",
    "suppressed": f"SELECT upper({_domain.format(k='c_custkey')}) AS value, 'domain' AS kind FROM customer WHERE c_custkey % 50 = 0",
    "quarantined": f"SELECT {_domain.format(k='c_custkey')} AS subject, 'lead' AS kind FROM customer WHERE c_custkey % 37 = 0",
    "live": f"SELECT *, date_diff('second', observed_at, {NOW}) / 86400.0 AS age FROM triggers WHERE active AND decays_at > {NOW}",
    "best_contact": f"""SELECT k, email, status, full_name FROM (SELECT *, row_number() OVER (PARTITION BY k
    ORDER BY (full_name IS NULL), {_rank}, email, contact_id) AS r
      FROM contacts WHERE email IS NOT NULL) WHERE r = 1""",
    "per_trigger": f"""SELECT t.k, t.trigger_id, t.code, t.age, CASE WHEN {_half} <= 0 THEN {_weight}
    ELSE {_weight} * exp(-ln(2) * greatest(0.0, t.age) / {_half}) END AS w FROM live t""",
    "trigger_sums": """SELECT k, least(100.0, sum(w)) AS trigger, min(age) AS newest, count(*) AS n_triggers,
    bool_or(code = 'T4_HIRING_AI_ONLY') AND NOT bool_or(code = 'T3_HIRING_SEC') AS alone,
      bool_or(code = 'T9_MARKETPLACE') AS gig, bool_or(code IN ('T1_AI_SHIP', 'T11_STACK_RISK')) AS ai_code, bool_or(code IN ('T7_SURFACE_SPRAWL',
      'T5_COMPLIANCE')) AS watch_code FROM per_trigger GROUP BY k""",
    "sources": "SELECT t.k, count(DISTINCT e.source_id) AS n_sources FROM live t JOIN evidence e ON e.trigger_id = t.trigger_id GROUP BY t.k",
    "facts": """SELECT c.*, coalesce(s.trigger, 0.0) AS trigger, s.newest, coalesce(s.n_triggers, 0) AS n_triggers, coalesce(s.alone, false) AS alone, coalesce(s.gig,
    false) AS gig, coalesce(s.ai_code, false) AS ai_code,
      coalesce(s.watch_code, false) AS watch_code, coalesce(n.n_sources, 0) AS n_sources, coalesce(b.status, 'none') AS status, coalesce(x.named, false) AS named,
      dns_known AND mx AND (NOT spf OR dmarc IS NULL OR dmarc = 'none') AS gap, EXISTS (SELECT 1 FROM suppressed s2 WHERE lower(s2.value) = c.domain) AS is_suppressed
      FROM companies c LEFT JOIN trigger_sums s ON s.k = c.k LEFT JOIN sources n ON n.k = c.k LEFT JOIN best_contact b ON b.k = c.k
      LEFT JOIN (SELECT k, bool_or(full_name IS NOT NULL) AS named FROM contacts GROUP BY k) x ON x.k = c.k""",
    "components": f"""SELECT *, least(100.0, {_points} + CASE WHEN alone THEN 15.0 ELSE 0.0 END) AS icp_fit, least(100.0, {_reach} + CASE
    WHEN named THEN 10.0 ELSE 0.0 END) AS reachability,
      least(100.0, CASE WHEN ai THEN 60.0 ELSE 0.0 END + CASE WHEN subdomains >= 25 THEN 25.0 ELSE 0.0 END + CASE WHEN gap THEN 15.0 ELSE 0.0 END) AS surface,
      CASE WHEN newest IS NULL THEN 0.0 ELSE greatest(0.0, least(100.0, 100.0 * (1 - greatest(0.0, newest) / 120.0))) END AS freshness,
      CASE WHEN is_suppressed THEN -100.0 ELSE 0.0 END AS p_suppressed, CASE WHEN n_triggers > 0 AND newest > 180 THEN -20.0 ELSE 0.0 END AS p_stale,
      CASE WHEN n_triggers > 0 AND n_sources <= 1 THEN -15.0 ELSE 0.0 END AS p_single
      FROM (SELECT * REPLACE (coalesce(band, CASE WHEN open_roles >= 40 THEN '1000+' WHEN open_roles >= 15 THEN '201-1000' END) AS band) FROM facts)""",
    "leads": """SELECT *, CASE WHEN score >= 72 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'REJECT' END AS tier,
      CASE WHEN gig THEN 'gig' WHEN ai_code AND ai THEN 'ai_llm_assessment' WHEN watch_code AND NOT ai THEN 'watch' ELSE 'snapshot_free' END AS offer
      FROM (SELECT *, CAST(round_even(greatest(0.0, least(100.0, raw)), 0) AS INT) AS score FROM (SELECT *, weighted + p_suppressed + p_stale + p_single AS raw FROM
      (SELECT *, trigger * 0.45 + icp_fit * 0.25 + reachability * 0.15 + surface * 0.10 + freshness * 0.05 AS weighted FROM components)))""",
}


def sql(body: str) -> str:
    """``body`` with the relations that it needs in front."""
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name, own in RELATIONS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(own)
                if name not in needed:
                    needed.append(name)

    add(body)
    with_ = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in needed)
    body = body.strip()
    if not with_:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {with_},\n{body[5:]}"
    return f"WITH {with_}\n{body}"
