"""DuckDB SQL fragments for the cross-check queries (oracle side only).

They restate the fixture recipe and the expressions of ``flowwatch.functions``
in plain SQL; nothing here runs on Spark.
"""

from __future__ import annotations


def v3(expr: str) -> str:
    """Name-based UUID of ``expr`` in DuckDB SQL (same text as the Spark form)."""
    h = f"md5({expr})"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'||"
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||"
            f"substr({h},21,12))")


EVENT_COLS = ("event_id, transaction_id, schema_version, correlation_id, source_account_id, "
              "destination_account_id, amount_minor, currency, device_id, ip_hash, occurred_at, ingested_at")

_BASE = f"""
fx_b AS (SELECT event_id AS id, user_id AS u, ts, CAST(props->>'$.k' AS INTEGER) AS k,
                event_type AS et, value AS v FROM events),
fx_t AS (SELECT id,
  {v3("'ev-'||CAST(id AS VARCHAR)")} AS event_id,
  CASE WHEN id%107=0 THEN NULL ELSE {v3("'tx-'||CAST(id AS VARCHAR)")} END AS transaction_id,
  CASE WHEN id%97=0 THEN 2 ELSE 1 END AS schema_version,
  CASE WHEN id%83=0 THEN NULL WHEN id%79=0 THEN 'corr-'||CAST(id AS VARCHAR)
       ELSE {v3("'co-'||CAST(id AS VARCHAR)")} END AS correlation_id,
  {v3("'acct-'||CAST(u AS VARCHAR)")} AS source_account_id,
  CASE WHEN id%109=0 THEN NULL
       WHEN id%89=0 THEN {v3("'acct-'||CAST(u AS VARCHAR)")}
       ELSE {v3("'acct-'||CAST((u//10)*10 + (u%10 + 1 + k%9)%10 AS VARCHAR)")} END AS destination_account_id,
  CASE WHEN id%103=0 THEN CAST(0 AS BIGINT) ELSE CAST(round(v*100) AS BIGINT) END AS amount_minor,
  CASE WHEN id%101=0 THEN 'usd' WHEN et IN ('purchase','view','click') THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN et='error' THEN NULL WHEN id%61=0 THEN 'dev-'||repeat('x', 260) ELSE 'dev-'||CAST(u//10 AS VARCHAR)||'-'||CAST(k%3 AS VARCHAR) END AS device_id,
  CASE WHEN k%10=0 THEN '' ELSE 'ip-'||CAST(u//5 AS VARCHAR) END AS ip_hash,
  CASE WHEN id%113=0 THEN NULL ELSE ts END AS occurred_at,
  ts + to_seconds((k*37)%1200) AS ingested_at
  FROM fx_b),
raw AS (
  SELECT {EVENT_COLS} FROM fx_t
  UNION ALL
  SELECT event_id, transaction_id, schema_version, correlation_id, source_account_id,
         destination_account_id, amount_minor, currency, device_id, ip_hash, occurred_at,
         ingested_at + INTERVAL 1 HOUR FROM fx_t WHERE id%50=0
  UNION ALL
  SELECT {v3("'ev2-'||CAST(id AS VARCHAR)")}, transaction_id, schema_version, correlation_id, source_account_id,
         destination_account_id, amount_minor, currency, device_id, ip_hash, occurred_at,
         ingested_at + INTERVAL 2 HOUR FROM fx_t WHERE id%75=0
  UNION ALL
  SELECT event_id, {v3("'tx3-'||CAST(id AS VARCHAR)")}, schema_version, correlation_id, source_account_id,
         destination_account_id, amount_minor, currency, device_id, ip_hash, occurred_at,
         ingested_at + INTERVAL 3 HOUR FROM fx_t WHERE id%131=0
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fx_t WHERE id%127=0)"""

REASON = """CASE
  WHEN coalesce(event_id, transaction_id, correlation_id, source_account_id, destination_account_id, currency, device_id, ip_hash,
                CAST(schema_version AS VARCHAR), CAST(amount_minor AS VARCHAR), CAST(occurred_at AS VARCHAR),
                CAST(ingested_at AS VARCHAR)) IS NULL THEN 'Event is null'
  WHEN event_id IS NULL OR transaction_id IS NULL THEN 'Missing IDs'
  WHEN source_account_id IS NULL OR destination_account_id IS NULL THEN 'Missing account IDs'
  WHEN source_account_id = destination_account_id THEN 'Source equals destination'
  WHEN amount_minor IS NULL OR amount_minor <= 0 THEN 'Amount must be positive'
  WHEN currency IS NULL OR NOT regexp_full_match(currency, '[A-Z]{3}') THEN 'Invalid currency format'
  WHEN schema_version IS NULL OR schema_version <> 1 THEN 'Unsupported schema version'
  WHEN occurred_at IS NULL OR ingested_at IS NULL THEN 'Missing timestamps'
END"""

_CLASSIFIED = f"""
classified AS (SELECT *, {REASON} AS failure_reason FROM raw),
valid AS (SELECT {EVENT_COLS} FROM classified WHERE failure_reason IS NULL)"""


def with_fixture(*ctes: str) -> str:
    """``WITH`` clause holding raw/classified/valid plus extra CTEs."""
    parts = [_BASE.strip(), _CLASSIFIED.strip()] + [c.strip() for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n"


def epoch_us(ts: str) -> str:
    return f"epoch_us({ts})"


def window_start(ts: str, seconds: str) -> str:
    """Epoch-aligned window start, keeping microseconds exact."""
    return f"make_timestamp(({epoch_us(ts)} // (CAST({seconds} AS BIGINT)*1000000)) * (CAST({seconds} AS BIGINT)*1000000))"


def activity_cte(rules) -> str:
    """R5 long form with per-rule window bounds (``act``)."""
    from flowwatch.config import RULE_SHAPES
    selects = []
    for r in rules:
        key, cp, _ = RULE_SHAPES[r.rule_type]
        cond = f"{key} IS NOT NULL"
        if key in ("device_id", "ip_hash"):
            cond += f" AND length(regexp_replace({key}, '\\s', '', 'g')) > 0"
        selects.append(
            f"SELECT '{r.rule_type}' AS rule_type, {key} AS key, {cp} AS counterparty, event_id, transaction_id, "
            f"amount_minor, currency, occurred_at, ingested_at, "
            f"{window_start('occurred_at', str(r.window_seconds))} AS window_start, "
            f"{window_start('occurred_at', str(r.window_seconds))} + to_seconds({r.window_seconds}) AS window_end, "
            f"{r.min_distinct} AS min_d, {r.min_count} AS min_c, {r.min_amount} AS min_a, "
            f"{r.grace_seconds} AS grace, {'true' if RULE_SHAPES[r.rule_type][2] else 'false'} AS hashed "
            f"FROM valid WHERE {cond}")
    return "act AS (" + "\nUNION ALL\n".join(selects) + ")"
