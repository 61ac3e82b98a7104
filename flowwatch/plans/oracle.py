"""DuckDB cross-check SQL for the catalog (oracle side only).

Written independently of the Spark plans: global windows and plain joins in
the most direct form, over the same driver tables and fixture recipe.
"""

from __future__ import annotations

import math

from flowwatch.config import DRIVER_CYCLE, DRIVER_RULES, CycleConfig, rule
from flowwatch.plans.catalog import LOOKUP_ACCOUNT_NAME, LOOKUP_END, LOOKUP_START, STREAM_RULES, TRIM_ROUNDS
from flowwatch.plans.sqlfrag import EVENT_COLS, REASON, v3, window_start, with_fixture

UUID_RE = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CAND_COLS = ("candidate_id, deduplication_key, rule_type, primary_account_id, window_start, window_end, "
             "distinct_accounts_count, transaction_count, total_amount_minor, currency, involved_accounts, "
             "transaction_ids, generated_at, trigger_event_id")
ALERT_COLS = ("alert_id, deduplication_key, rule_type, primary_account_id, status, involved_accounts, "
              "transaction_ids, generated_at, trigger_event_id")
LEDGER_COLS = ("transaction_id, event_id, source_account_id, destination_account_id, amount_minor, currency, "
               "device_id, ip_hash, occurred_at, ingested_at")
GROUP = "rule_type, key, currency, window_start"
GUP = f"gup AS (SELECT * FROM valid WHERE correlation_id IS NULL OR regexp_full_match(correlation_id, '{UUID_RE}'))"
ARR = "ingested_at, event_id"


def _act(src: str, rules, name: str) -> str:
    parts = []
    for r in rules:
        key, cp = {"FAN_OUT": ("source_account_id", "destination_account_id"),
                   "FAN_IN": ("destination_account_id", "source_account_id"),
                   "SHARED_DEVICE": ("device_id", "source_account_id"),
                   "SHARED_IP": ("ip_hash", "source_account_id")}[r.rule_type]
        cond = f"{key} IS NOT NULL"
        if key in ("device_id", "ip_hash"):
            cond += f" AND length(regexp_replace({key}, '\\s', '', 'g')) > 0"
        hashed = "true" if r.rule_type in ("SHARED_DEVICE", "SHARED_IP") else "false"
        ws = window_start("occurred_at", str(r.window_seconds))
        parts.append(
            f"SELECT '{r.rule_type}' AS rule_type, {key} AS key, {cp} AS counterparty, event_id, transaction_id, "
            f"amount_minor, currency, occurred_at, ingested_at, {ws} AS window_start, "
            f"{ws} + to_seconds(CAST({r.window_seconds} AS BIGINT)) AS window_end, {r.min_distinct} AS min_d, "
            f"{r.min_count} AS min_c, {r.min_amount} AS min_a, {r.grace_seconds} AS grace, {hashed} AS hashed "
            f"FROM {src} WHERE {cond}")
    return f"{name} AS (" + "\nUNION ALL\n".join(parts) + ")"


def _rule_ctes(src: str, rules, p: str, drop_late: bool = True) -> list[str]:
    """CTEs ``{p}act``, ``{p}hit`` (crossing rows), ``{p}cand`` (candidates, joined strings).

    ``pos`` is the one delivery order that everything below follows, copies included.
    """
    late = ("" if not drop_late else " WHERE stream_time IS NULL OR window_end + to_seconds(grace) > stream_time")
    return [
        _act(src, rules, f"{p}act"),
        f"""{p}st AS (SELECT *, max(occurred_at) OVER (PARTITION BY rule_type ORDER BY {ARR}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stream_time FROM {p}act)""",
        f"""{p}pos AS (SELECT * EXCLUDE (stream_time), row_number() OVER (PARTITION BY {GROUP} ORDER BY {ARR}) AS pos
              FROM {p}st{late})""",
        f"""{p}fs AS (SELECT *, row_number() OVER (PARTITION BY {GROUP}, counterparty ORDER BY pos) AS fs_rn
              FROM {p}pos)""",
        f"""{p}run AS (SELECT *, sum(CASE WHEN fs_rn = 1 THEN 1 ELSE 0 END) OVER g AS run_d,
              sum(amount_minor) OVER g AS run_a FROM {p}fs
              WINDOW g AS (PARTITION BY {GROUP} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""{p}hit AS (SELECT rule_type, key, currency, window_start, min(pos) AS cross_pos FROM {p}run
              WHERE run_d >= min_d AND (min_c <= 0 OR pos >= min_c) AND (min_a <= 0 OR run_a >= min_a)
              GROUP BY ALL)""",
        f"""{p}upto AS (SELECT a.*, a.hashed AS h_hashed, c.ingested_at AS cross_ts, c.event_id AS cross_id
              FROM {p}hit h JOIN {p}pos a USING (rule_type, key, currency, window_start)
              JOIN {p}pos c ON c.rule_type = h.rule_type AND c.key = h.key AND c.currency = h.currency
                AND c.window_start = h.window_start AND c.pos = h.cross_pos
              WHERE a.pos <= h.cross_pos)""",
        f"""{p}snap AS (SELECT rule_type, key, currency, window_start, window_end, h_hashed AS hashed, cross_ts, cross_id,
              CAST(count(DISTINCT counterparty) AS INTEGER) AS distinct_accounts_count,
              count(*) AS transaction_count, CAST(sum(amount_minor) AS BIGINT) AS total_amount_minor,
              string_agg(DISTINCT counterparty, ',' ORDER BY counterparty) AS involved_accounts,
              string_agg(DISTINCT transaction_id, ',' ORDER BY transaction_id) AS transaction_ids
              FROM {p}upto GROUP BY ALL)""",
        f"""{p}cand AS (SELECT {v3('dk')} AS candidate_id, dk AS deduplication_key, rule_type,
              CASE WHEN hashed THEN {v3('key')} ELSE key END AS primary_account_id, window_start, window_end,
              distinct_accounts_count, transaction_count, total_amount_minor, currency, involved_accounts,
              transaction_ids, cross_ts AS generated_at, cross_id AS trigger_event_id
              FROM (SELECT *, rule_type||'-'||key||'-'||currency||'-'||CAST(epoch_ms(window_start) AS VARCHAR) AS dk
                    FROM {p}snap))""",
    ]


def _edge_pred(e: str, as_of: bool) -> str:
    s = (f"{e}.total_amount_minor BETWEEN c.lo AND c.hi AND {e}.latest_occurred_at >= c.tmin "
         f"AND {e}.latest_occurred_at <= c.t")
    if as_of:
        s += (f" AND ({e}.valid_from_ts < c.ci OR ({e}.valid_from_ts = c.ci AND {e}.valid_from_event_id < c.ce))"
              f" AND ({e}.valid_to_ts IS NULL OR c.ci < {e}.valid_to_ts"
              f" OR (c.ci = {e}.valid_to_ts AND c.ce <= {e}.valid_to_event_id))")
    return s


def _graph_ctes(src: str, p: str) -> list[str]:
    return [
        f"""{p}g1 AS (SELECT * EXCLUDE (g_rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {ARR})
              AS g_rn FROM {src}) WHERE g_rn = 1)""",
        f"""{p}ge AS (SELECT source_account_id AS src, destination_account_id AS dst, currency, occurred_at, amount_minor,
              transaction_id, ingested_at, event_id FROM {p}g1)""",
        f"""{p}edges AS (SELECT src, dst, currency, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen,
              count(*) AS transaction_count, CAST(sum(amount_minor) AS BIGINT) AS total_amount_minor,
              max(CASE WHEN l_rn = 1 THEN transaction_id END) AS latest_transaction_id,
              max(CASE WHEN l_rn = 1 THEN occurred_at END) AS latest_occurred_at
              FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, currency
                    ORDER BY occurred_at DESC, ingested_at, event_id) AS l_rn FROM {p}ge)
              GROUP BY src, dst, currency)""",
        f"""{p}ge2 AS (SELECT *, max(occurred_at) OVER (PARTITION BY src, dst, currency ORDER BY {ARR}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM {p}ge)""",
        f"""{p}ver AS (SELECT src, dst, currency, min(occurred_at) OVER w AS first_seen, max(occurred_at) OVER w AS last_seen,
              count(*) OVER w AS transaction_count, CAST(sum(amount_minor) OVER w AS BIGINT) AS total_amount_minor,
              last_value(CASE WHEN prev_max IS NULL OR occurred_at > prev_max THEN transaction_id END IGNORE NULLS)
                OVER w AS latest_transaction_id,
              max(occurred_at) OVER w AS latest_occurred_at,
              ingested_at AS valid_from_ts, event_id AS valid_from_event_id,
              lead(ingested_at) OVER w2 AS valid_to_ts, lead(event_id) OVER w2 AS valid_to_event_id
              FROM {p}ge2
              WINDOW w AS (PARTITION BY src, dst, currency ORDER BY {ARR}
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                     w2 AS (PARTITION BY src, dst, currency ORDER BY {ARR}))""",
    ]


def _cycle_ctes(src: str, cfg: CycleConfig, edges: str, as_of: bool, p: str) -> list[str]:
    tol = cfg.tolerance_percent
    cand = (f"""{p}cc AS (SELECT event_id AS ce, ingested_at AS ci, transaction_id AS ctx, source_account_id AS cs,
              destination_account_id AS cd, occurred_at AS t, occurred_at - to_seconds(CAST({cfg.window_seconds} AS BIGINT)) AS tmin,
              amount_minor - (amount_minor * {tol}) // 100 AS lo, amount_minor + (amount_minor * {tol}) // 100 AS hi
              FROM {src})""")
    selects = []
    for depth in range(1, cfg.max_depth):
        joins, nodes, txs, curs = [], ["c.cd"], [], []
        prev = "c.cd"
        for h in range(1, depth + 1):
            e = f"e{h}"
            on = [f"{e}.src = {prev}", _edge_pred(e, as_of)]
            if h > 1:
                on.append(f"{e}.latest_occurred_at >= e{h-1}.latest_occurred_at")
            if h == depth:
                on.append(f"{e}.dst = c.cs")
            else:
                on.append(f"{e}.dst NOT IN ({', '.join(nodes + ['c.cs'])})")
            joins.append(f"JOIN {edges} {e} ON " + " AND ".join(on))
            nodes.append(f"{e}.dst")
            txs.append(f"{e}.latest_transaction_id")
            curs.append(f"{e}.currency")
            prev = f"{e}.dst"
        selects.append(
            f"SELECT c.ce AS cand_event_id, c.ci AS cand_ingested_at, c.ctx AS cand_transaction_id, "
            f"c.cs AS primary_account_id, {depth} AS depth, [{', '.join(nodes)}] AS acc_list, "
            f"[{', '.join(txs)}] AS tx_list, [{', '.join(curs)}] AS cur_list FROM {p}cc c " + " ".join(joins))
    paths = f"{p}paths AS (" + "\nUNION ALL\n".join(selects) + ")"
    calert = f"""{p}calert AS (SELECT {v3("dk||'|'||cand_event_id||'|'||CAST(epoch_us(cand_ingested_at) AS VARCHAR)||'|'||array_to_string(tx_list, ',')||'|'||array_to_string(cur_list, ',')")} AS alert_id,
              dk AS deduplication_key, 'CIRCULAR_FLOW' AS rule_type, primary_account_id, 'OPEN' AS status,
              array_to_string(list_sort(list_distinct(acc_list)), ',') AS involved_accounts,
              array_to_string(list_sort(list_distinct(list_concat(tx_list, [cand_transaction_id]))), ',') AS transaction_ids,
              cand_ingested_at AS generated_at, cand_event_id AS trigger_event_id
              FROM (SELECT *, 'CIRCULAR_FLOW_'||array_to_string(list_sort(acc_list), '_') AS dk FROM {p}paths))"""
    return [cand, paths, calert]


def _trim_ctes(cfg: CycleConfig, rounds: int) -> list[str]:
    """Edges and candidates without those that lack a neighbour, ``rounds`` times: neighbours by EXISTS over whole tables."""
    us, tol = cfg.window_seconds * 1_000_000, cfg.tolerance_percent
    band = lambda x: f"CAST(floor(ln(greatest(CAST({x} AS DOUBLE), 1.0)) / {math.log((100 + tol) / (100 - tol))!r}) AS INTEGER)"
    out = [
        f"""te AS (SELECT *, epoch_us(latest_occurred_at) // {us} AS bucket, {band("total_amount_minor")} AS band FROM g_edges)""",
        f"""t0 AS MATERIALIZED (SELECT DISTINCT true AS edge, src, dst, bucket, band FROM te UNION ALL
              SELECT DISTINCT false, source_account_id, destination_account_id, epoch_us(occurred_at) // {us},
              {band(f"amount_minor - (amount_minor * {tol}) // 100")} FROM valid)"""]
    for k in range(rounds):
        follows = f"""EXISTS (SELECT 1 FROM t{k} n WHERE n.src = r.dst AND CASE
              WHEN r.edge AND n.edge THEN n.bucket - r.bucket IN (0, 1) AND abs(n.band - r.band) <= 2
              WHEN r.edge THEN n.bucket - r.bucket IN (0, 1) AND r.band - n.band IN (0, 1, 2)
              WHEN n.edge THEN r.bucket - n.bucket IN (0, 1) AND n.band - r.band IN (0, 1, 2) ELSE false END)"""
        precedes = f"""EXISTS (SELECT 1 FROM t{k} n WHERE n.dst = r.src AND CASE
              WHEN r.edge AND n.edge THEN r.bucket - n.bucket IN (0, 1) AND abs(n.band - r.band) <= 2
              WHEN r.edge THEN n.bucket - r.bucket IN (0, 1) AND r.band - n.band IN (0, 1, 2)
              WHEN n.edge THEN r.bucket - n.bucket IN (0, 1) AND n.band - r.band IN (0, 1, 2) ELSE false END)"""
        out.append(f"t{k + 1} AS MATERIALIZED (SELECT * FROM t{k} r WHERE {follows} AND {precedes})")
    return out + [f"trimmed AS (SELECT te.* FROM te SEMI JOIN (SELECT * FROM t{rounds} WHERE edge) k USING (src, dst, bucket, band))"]


def _paths_out(p: str) -> str:
    return (f"SELECT cand_event_id, cand_ingested_at, cand_transaction_id, primary_account_id, depth, "
            f"array_to_string(acc_list, '>') AS path_accounts, array_to_string(tx_list, ',') AS path_transactions, "
            f"array_to_string(cur_list, ',') AS path_currencies FROM {p}paths")


def _alert_ctes(src: str, rules, cycle: CycleConfig, p: str) -> list[str]:
    """Rule + cycle alert events (``{p}aev``) and canonical alerts (``{p}alerts``)."""
    return (_rule_ctes(src, rules, p) + [GUP] + _graph_ctes("gup", p) + _cycle_ctes(src, cycle, f"{p}ver", True, p) + [
        f"""{p}rev AS (SELECT candidate_id AS alert_id, deduplication_key, rule_type, primary_account_id,
              'OPEN' AS status, involved_accounts, transaction_ids, generated_at, trigger_event_id FROM {p}cand)""",
        f"""{p}aev AS (SELECT {ALERT_COLS} FROM {p}rev UNION ALL SELECT {ALERT_COLS} FROM {p}calert)""",
        f"""{p}alerts AS (SELECT alert_id, deduplication_key, rule_type, primary_account_id, status,
              generated_at AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY deduplication_key
              ORDER BY generated_at, trigger_event_id, alert_id) AS a_rn FROM {p}aev
              WHERE rule_type IS NOT NULL AND primary_account_id IS NOT NULL AND length(deduplication_key) <= 255)
              WHERE a_rn = 1)""",
        f"""{p}aacc AS (SELECT DISTINCT a.alert_id, x.account_id FROM (SELECT DISTINCT deduplication_key,
              unnest(string_split(involved_accounts, ',')) AS account_id FROM {p}aev) x
              JOIN {p}alerts a USING (deduplication_key))""",
        f"""{p}atx AS (SELECT DISTINCT a.alert_id, x.transaction_id FROM (SELECT DISTINCT deduplication_key,
              unnest(string_split(transaction_ids, ',')) AS transaction_id FROM {p}aev) x
              JOIN {p}alerts a USING (deduplication_key))""",
    ])


def _ledger_ctes() -> list[str]:
    return [
        f"""win AS (SELECT * EXCLUDE (w_rn) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
              ORDER BY {ARR}) AS w_rn FROM valid) WHERE w_rn = 1)""",
        f"""wown AS (SELECT w.*, o.owner FROM win w JOIN (SELECT event_id, transaction_id AS owner FROM
              (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {ARR}) AS o_rn FROM win) WHERE o_rn = 1) o
              USING (event_id))""",
        """wchk AS (SELECT *, CASE WHEN owner <> transaction_id THEN 'event_id already used by transaction '||owner
              WHEN coalesce(length(device_id), 0) > 255 OR coalesce(length(ip_hash), 0) > 255
              THEN 'device_id or ip_hash longer than 255 characters' END AS error FROM wown)""",
        f"""led AS (SELECT {LEDGER_COLS}, ingested_at AS processed_at FROM wchk WHERE error IS NULL)""",
        f"""conf AS (SELECT {', '.join('v.' + c.strip() for c in LEDGER_COLS.split(','))}, w.event_id AS winner_event_id,
              'Conflicting identity or payload for transaction '||v.transaction_id AS error
              FROM valid v JOIN win w ON v.transaction_id = w.transaction_id WHERE v.event_id <> w.event_id)""",
    ]


def _messages_cte() -> str:
    return """msg AS (SELECT id, source_account_id AS key, ingested_at AS received_at, id % 223 = 0 AND id % 229 <> 0 AS double_encoded,
          CASE WHEN id % 211 = 0 AND id % 229 <> 0 THEN 'Malformed JSON payload' END AS decode_error, id % 229 = 0 AS null_event,
          * EXCLUDE (id) FROM fx_t)"""


def _dead_letter_cte() -> str:
    return """dl AS (
          SELECT 'normalisation' AS origin, 'transactions.raw' AS topic, key, decode_error AS error,
                 received_at AS event_time FROM msg WHERE decode_error IS NOT NULL
          UNION ALL
          SELECT 'ledger', 'transactions.validated', transaction_id, error, ingested_at FROM conf
          UNION ALL
          SELECT 'ledger', 'transactions.validated', transaction_id, error, ingested_at FROM wchk WHERE error IS NOT NULL
          UNION ALL
          SELECT 'graph', 'graph.updates', source_account_id, 'correlation_id is not a UUID', ingested_at
          FROM valid WHERE NOT regexp_full_match(correlation_id, '""" + UUID_RE + """')
          UNION ALL
          SELECT 'alerts', 'fraud.alerts', deduplication_key, 'alert rejected: missing rule/primary or key too long', generated_at
          FROM f_aev WHERE length(deduplication_key) > 255)"""


def _match_ctes() -> list[str]:
    return _rule_ctes("valid", DRIVER_RULES, "s_") + [
        "by_time AS (SELECT * REPLACE (occurred_at AS ingested_at) FROM valid)",
        *_rule_ctes("by_time", DRIVER_RULES, "x_", drop_late=False),
        """exp AS (SELECT rule_type, primary_account_id, deduplication_key AS scenario_id, generated_at AS trigger_at
              FROM x_cand)""",
        """s_alerts AS (SELECT rule_type, primary_account_id, candidate_id AS alert_id, generated_at AS created_at
              FROM s_cand WHERE length(deduplication_key) <= 255)""",
        """em AS (SELECT *, row_number() OVER (PARTITION BY rule_type, primary_account_id ORDER BY scenario_id) AS rk
              FROM exp)""",
        """am AS (SELECT rule_type, primary_account_id, alert_id, created_at, row_number() OVER
              (PARTITION BY rule_type, primary_account_id ORDER BY created_at, alert_id) AS rk FROM s_alerts)""",
        """mt AS (SELECT coalesce(em.rule_type, am.rule_type) AS rule_type,
              coalesce(em.primary_account_id, am.primary_account_id) AS primary_account_id, em.scenario_id,
              am.alert_id, em.trigger_at, am.created_at,
              CASE WHEN em.scenario_id IS NOT NULL AND am.alert_id IS NOT NULL THEN 'TP'
                   WHEN em.scenario_id IS NOT NULL THEN 'FN' ELSE 'FP' END AS outcome
              FROM em FULL OUTER JOIN am ON em.rule_type = am.rule_type
              AND em.primary_account_id = am.primary_account_id AND em.rk = am.rk)""",
    ]


def _q(*ctes, body: str) -> str:
    return with_fixture(*ctes) + body


def _one_rule(rt: str) -> str:
    return _q(*_rule_ctes("valid", (rule(DRIVER_RULES, rt),), "r_"), body=f"SELECT {CAND_COLS} FROM r_cand")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["transaction_intake"] = _q(f"""rq AS (SELECT *, CASE
          WHEN (transaction_id IS NOT NULL AND NOT regexp_full_match(transaction_id, '{UUID_RE}'))
            OR (source_account_id IS NOT NULL AND NOT regexp_full_match(source_account_id, '{UUID_RE}'))
            OR (destination_account_id IS NOT NULL AND NOT regexp_full_match(destination_account_id, '{UUID_RE}'))
            THEN 'Malformed request body'
          WHEN transaction_id IS NULL OR source_account_id IS NULL OR destination_account_id IS NULL
            OR amount_minor IS NULL OR amount_minor <= 0 OR currency IS NULL
            OR NOT regexp_full_match(currency, '[A-Z]{{3}}') OR occurred_at IS NULL THEN 'Validation failed'
          WHEN source_account_id = destination_account_id THEN 'Source and destination accounts must be different.'
          ELSE 'ACCEPTED' END AS status FROM fx_t)""", body=f"""
        SELECT id AS request_id, status,
          CASE WHEN status = 'ACCEPTED' THEN {v3("'event:'||CAST(id AS VARCHAR)")} END AS event_id, transaction_id,
          CASE WHEN status = 'ACCEPTED' THEN {v3("'correlation:'||CAST(id AS VARCHAR)")} END AS correlation_id,
          ingested_at FROM rq""")
    q["json_decode"] = _q(_messages_cte(), body="""
        SELECT id, double_encoded, decode_error,""" + ", ".join(
        f"CASE WHEN decode_error IS NULL AND NOT null_event THEN {c.strip()} END AS {c.strip()}" for c in EVENT_COLS.split(",")) +
        " FROM msg")
    al = _alert_ctes("valid", DRIVER_RULES, DRIVER_CYCLE, "f_")
    q["dead_letter"] = _q(_messages_cte(), *_ledger_ctes(), *al, _dead_letter_cte(),
                          body="SELECT origin, topic, key, error, event_time FROM dl")
    q["event_time"] = _q(body="""SELECT event_id, ingested_at, occurred_at,
        coalesce(make_timestamp(epoch_us(occurred_at) // 1000 * 1000), ingested_at) AS event_time FROM raw""")
    q["normalise_valid"] = _q(body="SELECT * FROM valid")
    q["normalise_invalid"] = _q(body=f"""SELECT {EVENT_COLS}, failure_reason, ingested_at AS failed_at
        FROM classified WHERE failure_reason IS NOT NULL""")
    q["normalise_counts"] = _q(body="SELECT failure_reason, count(*) AS event_count FROM classified GROUP BY 1")
    q["activity_by_source"] = _q(body="SELECT *, source_account_id AS key FROM valid")
    q["activity_by_destination"] = _q(body="SELECT *, destination_account_id AS key FROM valid")
    q["activity_by_device"] = _q(body="""SELECT *, device_id AS key FROM valid
        WHERE device_id IS NOT NULL AND length(regexp_replace(device_id, '\\s', '', 'g')) > 0""")
    q["activity_by_ip"] = _q(body="""SELECT *, ip_hash AS key FROM valid
        WHERE ip_hash IS NOT NULL AND length(regexp_replace(ip_hash, '\\s', '', 'g')) > 0""")
    q["activity_union"] = _q(_act("valid", DRIVER_RULES, "a"), body="""SELECT rule_type, key, counterparty, event_id,
        transaction_id, amount_minor, currency, occurred_at, ingested_at FROM a""")
    q["graph_update"] = _q(GUP, body=f"SELECT source_account_id AS key, {EVENT_COLS} FROM gup")

    for key, rt in (("fan_out", "FAN_OUT"), ("fan_in", "FAN_IN"), ("shared_device", "SHARED_DEVICE"),
                    ("shared_ip", "SHARED_IP")):
        q[key] = _one_rule(rt)
    q["rule_streaming"] = _q(*_rule_ctes("valid", STREAM_RULES, "r_"), body=f"SELECT {CAND_COLS} FROM r_cand")
    rc = _rule_ctes("valid", DRIVER_RULES, "r_")
    q["rule_first_crossing"] = _q(*rc, body=f"SELECT {CAND_COLS} FROM r_cand")
    q["candidate_event_time"] = _q(*rc, body="""SELECT deduplication_key, generated_at,
        make_timestamp(epoch_us(generated_at) // 1000 * 1000) AS event_time FROM r_cand""")
    tot = f"""tot AS (SELECT rule_type, key, currency, window_start, window_end, min_d, min_c, min_a, hashed,
          CAST(count(DISTINCT counterparty) AS INTEGER) AS distinct_accounts_count, count(*) AS transaction_count,
          CAST(sum(amount_minor) AS BIGINT) AS total_amount_minor FROM r_act GROUP BY ALL),
        fired AS (SELECT * FROM tot WHERE distinct_accounts_count >= min_d AND (min_c <= 0 OR transaction_count >= min_c)
          AND (min_a <= 0 OR total_amount_minor >= min_a))"""
    q["rule_window_final"] = _q(rc[0], tot, body="""SELECT rule_type, key, currency, window_start, window_end,
        distinct_accounts_count, transaction_count, total_amount_minor FROM fired""")
    q["candidate_identity"] = _q(rc[0], tot, body=f"""SELECT rule_type, key, currency, window_start,
        dk AS deduplication_key, {v3('dk')} AS candidate_id,
        CASE WHEN hashed THEN {v3('key')} ELSE key END AS primary_account_id
        FROM (SELECT *, rule_type||'-'||key||'-'||currency||'-'||CAST(epoch_ms(window_start) AS VARCHAR) AS dk
              FROM fired)""")
    q["late_events"] = _q(rc[0], f"""lt AS (SELECT *, max(occurred_at) OVER (PARTITION BY rule_type ORDER BY {ARR}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stream_time FROM r_act)""", body="""
        SELECT rule_type, key, currency, window_start, window_end, event_id, transaction_id, occurred_at,
        ingested_at, stream_time FROM lt WHERE window_end + to_seconds(grace) <= stream_time""")
    q["rule_evidence"] = _q(*rc, body="""
        SELECT DISTINCT c.deduplication_key, 'account' AS kind, u.counterparty AS value FROM r_cand c
          JOIN r_upto u ON c.rule_type = u.rule_type AND c.trigger_event_id = u.cross_id
          AND c.window_start = u.window_start AND c.currency = u.currency
          AND c.deduplication_key = u.rule_type||'-'||u.key||'-'||u.currency||'-'||CAST(epoch_ms(u.window_start) AS VARCHAR)
        UNION ALL
        SELECT DISTINCT c.deduplication_key, 'transaction', u.transaction_id FROM r_cand c
          JOIN r_upto u ON c.rule_type = u.rule_type AND c.trigger_event_id = u.cross_id
          AND c.window_start = u.window_start AND c.currency = u.currency
          AND c.deduplication_key = u.rule_type||'-'||u.key||'-'||u.currency||'-'||CAST(epoch_ms(u.window_start) AS VARCHAR)""")

    q["alert_generation"] = _q(*al, body=f"SELECT {ALERT_COLS} FROM f_rev")
    q["alert_union"] = _q(*al, body=f"SELECT {ALERT_COLS} FROM f_aev")
    q["alerts"] = _q(*al, body="SELECT * FROM f_alerts")
    q["alert_accounts"] = _q(*al, body="SELECT alert_id, account_id FROM f_aacc")
    q["alert_transactions"] = _q(*al, body="SELECT alert_id, transaction_id FROM f_atx")
    q["alert_dedup_stats"] = _q(*al, body="""SELECT e.rule_type,
        count(*) FILTER (WHERE e.alert_id = a.alert_id) AS created,
        count(*) FILTER (WHERE e.alert_id <> a.alert_id) AS duplicates
        FROM f_aev e JOIN f_alerts a USING (deduplication_key)
        WHERE e.rule_type IS NOT NULL AND e.primary_account_id IS NOT NULL AND length(e.deduplication_key) <= 255
        GROUP BY e.rule_type""")
    q["alert_evidence_counts"] = _q(*al, body="""SELECT coalesce(x.alert_id, y.alert_id) AS alert_id,
        coalesce(x.n, 0) AS account_count, coalesce(y.n, 0) AS transaction_count
        FROM (SELECT alert_id, count(*) AS n FROM f_aacc GROUP BY 1) x
        FULL OUTER JOIN (SELECT alert_id, count(*) AS n FROM f_atx GROUP BY 1) y ON x.alert_id = y.alert_id""")
    q["alerts_by_rule"] = _q(*al, body="""SELECT alert_id, deduplication_key, primary_account_id, created_at
        FROM f_alerts WHERE rule_type = 'SHARED_DEVICE'""")

    led = _ledger_ctes()
    q["ledger"] = _q(*led, body="SELECT * FROM led")
    q["ledger_conflicts"] = _q(*led, body="SELECT * FROM conf")
    q["ledger_replays"] = _q(*led, body=f"""SELECT {', '.join('v.' + c.strip() for c in LEDGER_COLS.split(','))}
        FROM valid v JOIN win w ON v.transaction_id = w.transaction_id
        WHERE v.event_id = w.event_id
        QUALIFY row_number() OVER (PARTITION BY v.transaction_id, v.event_id ORDER BY v.ingested_at) > 1""")
    q["ledger_constraints"] = _q(*led, body=f"SELECT {LEDGER_COLS}, error FROM wchk WHERE error IS NOT NULL")
    q["ledger_lookup"] = _q(*led, body=f"""SELECT * FROM led WHERE source_account_id = {v3(f"'{LOOKUP_ACCOUNT_NAME}'")}
        AND occurred_at >= TIMESTAMP '{LOOKUP_START}' AND occurred_at < TIMESTAMP '{LOOKUP_END}'""")

    gr = [GUP, *_graph_ctes("gup", "g_")]
    q["graph_processed"] = _q(*gr, body=f"SELECT {EVENT_COLS} FROM g_g1")
    q["graph_accounts"] = _q(*gr, body="""SELECT DISTINCT unnest([source_account_id, destination_account_id])
        AS account_id FROM g_g1""")
    q["graph_edges"] = _q(*gr, body="SELECT * FROM g_edges")
    q["graph_used_device"] = _q(*gr, body="""SELECT DISTINCT source_account_id AS account_id, device_id FROM g_g1
        WHERE device_id IS NOT NULL AND device_id <> ''""")
    q["graph_used_ip"] = _q(*gr, body="""SELECT DISTINCT source_account_id AS account_id, ip_hash FROM g_g1
        WHERE ip_hash IS NOT NULL AND ip_hash <> ''""")
    q["graph_edge_report"] = _q(*gr, body="SELECT src, dst, currency, transaction_count, total_amount_minor FROM g_edges")
    q["graph_edge_versions"] = _q(*gr, body="SELECT * FROM g_ver")

    q["circular_flow"] = _q(*gr, *_cycle_ctes("valid", DRIVER_CYCLE, "g_ver", True, "c_"), body=_paths_out("c_"))
    q["circular_flow_snapshot"] = _q(*gr, *_cycle_ctes("valid", DRIVER_CYCLE, "g_edges", False, "c_"),
                                     body=_paths_out("c_"))
    q["circular_alert"] = _q(*gr, *_cycle_ctes("valid", DRIVER_CYCLE, "g_ver", True, "c_"),
                             body=f"SELECT {ALERT_COLS} FROM c_calert")
    q["cycle_prefilter"] = _q(*gr, *_trim_ctes(DRIVER_CYCLE, TRIM_ROUNDS), body="SELECT * EXCLUDE (bucket, band) FROM trimmed")

    mt = _match_ctes()
    q["evaluation_match"] = _q(*mt, body="SELECT * FROM mt")
    q["evaluation_metrics"] = _q(*mt, """cnt AS (SELECT count(*) FILTER (WHERE outcome = 'TP') AS tp,
          count(*) FILTER (WHERE outcome = 'FP') AS fp, count(*) FILTER (WHERE outcome = 'FN') AS fn,
          (SELECT count(*) FROM valid) AS total_transactions FROM mt),
        pr AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE)) END AS precision,
          CASE WHEN tp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fn AS DOUBLE)) END AS recall,
          CAST(total_transactions - tp - fn AS DOUBLE) AS neg FROM cnt)""", body="""
        SELECT tp, fp, fn, total_transactions, precision, recall,
          CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
          CASE WHEN neg = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / neg END AS fpr,
          CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(fn AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fn AS DOUBLE)) END AS fnr
        FROM pr""")
    q["detection_latency"] = _q(*mt, body="""SELECT count(*) AS true_positives,
        CASE WHEN count(*) = 0 THEN CAST(0 AS BIGINT) ELSE
          CAST(sum((epoch_us(created_at) - epoch_us(trigger_at)) // 1000) // count(*) AS BIGINT) END
          AS avg_latency_ms
        FROM mt WHERE outcome = 'TP'""")
    q["evaluation_misses"] = _q(*mt, body="SELECT * FROM mt WHERE outcome <> 'TP'")

    q["alerts_per_minute"] = _q(*al, body="""SELECT make_timestamp(epoch_us(created_at) // 60000000 * 60000000)
        AS minute, rule_type, count(*) AS alert_count FROM f_alerts GROUP BY 1, 2""")
    q["dead_letters_per_minute"] = _q(_messages_cte(), *_ledger_ctes(), *al, _dead_letter_cte(), body="""
        SELECT make_timestamp(epoch_us(event_time) // 60000000 * 60000000) AS minute, topic,
        count(*) AS dead_letter_count FROM dl GROUP BY 1, 2""")
    return q
