"""DuckDB SQL for the queries of ``catalog`` that SQL can express."""

from __future__ import annotations

from . import centroids, mixing
from .catalog import URL_RULES

OP4 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((lane - 1) % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * {mixing.MAX_REPEATS} AS cap,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS lane FROM sources)),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER fill, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0)) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / weight, lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT * EXCLUDE (level), least(cap, max(level) OVER () * weight) AS target FROM levels),
blocked AS (
  SELECT *, greatest(least(source_size, {mixing.LEAST_BLOCKS}),
                     round(source_size / greatest(1.0, least({float(mixing.SLOT_WORDS)}, total / {mixing.SLOTS}))))::BIGINT AS blocks
  FROM goal WHERE source_size > 0),
wanted AS (SELECT *, target * blocks / source_size AS wanted FROM blocked),
highs AS (SELECT *, sum(wanted) OVER (ORDER BY lane ROWS UNBOUNDED PRECEDING) AS high, sum(wanted) OVER () AS every FROM wanted),
lanes AS (SELECT *, coalesce(lag(high) OVER (ORDER BY lane), 0.0) AS low FROM highs),
points AS (
  SELECT slot, (slot * {mixing.GOLDEN_STEP} % {mixing.GOLDEN_RANGE})::DOUBLE / {float(mixing.GOLDEN_RANGE)} * every AS x
  FROM (SELECT max(every) AS every, unnest(range(ceil(max(every))::BIGINT)) AS slot FROM lanes)),
ranked AS (
  SELECT lane, blocks, row_number() OVER (PARTITION BY lane ORDER BY slot) - 1 AS rank
  FROM points JOIN lanes ON x >= low AND x < high),
times AS (
  SELECT lane, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < blocks * {mixing.MAX_REPEATS} GROUP BY ALL),
lines AS (
  SELECT b.lane, b.block, coalesce(times, 0) AS times, (b.block * source_size + blocks - 1) // blocks AS b_begin,
         ((b.block + 1) * source_size + blocks - 1) // blocks AS b_end
  FROM (SELECT lane, source_size, blocks, unnest(range(blocks)) AS block FROM lanes) b LEFT JOIN times USING (lane, block)),
placed AS (
  SELECT *, row_number() OVER () AS k, tail - size AS head
  FROM (SELECT doc_id, size, g.lane, g.source_size, g.target, l.blocks,
               sum(size) OVER (PARTITION BY g.lane ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS tail
        FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN lanes l ON l.lane = g.lane)),
taken AS (
  SELECT k, sum((least(tail, b_end) - greatest(head, b_begin)) * times) AS taken
  FROM placed p JOIN lines l ON p.lane = l.lane AND b_end > head AND b_begin < tail WHERE size > 0 GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (k)
"""



def _op11(cfg: centroids.ClusterConfig = centroids.ClusterConfig()) -> str:
    """Lloyd's rounds over whole vectors, a pair of CTEs per round; vectors keep a number of their own, as ids may repeat."""
    near = """
near_{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, min(struct_pack(d := d, c := cluster)) AS best, any_value(v) AS v
  FROM (SELECT rid, vec_id, cluster, v, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d
        FROM kept, cent_{r}) GROUP BY rid)"""
    moved = """
cent_{n} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.w, c.w) AS w
  FROM cent_{r} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS w
    FROM (SELECT best.c AS cluster, i, sum(v[i]) AS s, count(*) AS n
          FROM near_{r}, (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY ALL) GROUP BY cluster) m ON c.cluster = m.cluster)"""
    rounds = ",".join(near.format(r=r, dims=cfg.dims) + "," + moved.format(r=r, n=r + 1, dims=cfg.dims) for r in range(cfg.rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({cfg.scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {cfg.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {cfg.dims}),
cent_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{cfg.start}' || vec_id), v) - 1 AS cluster, v AS w
  FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {cfg.k}),{rounds},{near.format(r=cfg.rounds, dims=cfg.dims)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance,
       sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM near_{cfg.rounds} JOIN cent_{cfg.rounds} ON best.c = cluster
"""


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP13 = f"""
WITH rules(rule_host, rule_path, said) AS (VALUES {_RULES}),
rests AS (SELECT row_number() OVER () AS k, page_id,
                 CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (
  SELECT k, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(said, length(rule_host || rule_path)) AS said
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM parts LEFT JOIN fits USING (k)
"""

# crc32 and the repair itself as SQL: a label is the best (cost, audit) of a state, taken on row by row.
_INSERTS = """
    SELECT conv_id, i, q, min(struct_pack(cost := cost, audit := audit)) AS best
    FROM (SELECT conv_id, i, q, cost, audit FROM {0}
          UNION ALL SELECT conv_id, i, if(q = 2, 3, 2), cost + 3, audit || 'I' FROM {0}
          UNION ALL SELECT conv_id, i, if(q = 2, 2, 3), cost + 6, audit || 'II' FROM {0}) GROUP BY ALL"""
OP12 = f"""
WITH RECURSIVE space AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) % 20 AS draw FROM space),
hurt AS (
  SELECT conv_id, turn, if(draw = 4, 'user', role) AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE draw WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn),
numbered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(left(text, 64)), sha256(text), copy) AS i
  FROM hurt),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
labels AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, struct_pack(cost := 0::BIGINT, audit := '') AS best FROM totals
  UNION ALL
  SELECT conv_id, i, q, best FROM (
    WITH opened AS ({_INSERTS.format("(SELECT conv_id, i, q, best.cost AS cost, best.audit AS audit FROM labels)")}),
    edits AS (
      SELECT o.conv_id, o.i + 1 AS i, e.q, o.best.cost + e.cost AS cost, o.best.audit || e.letter AS audit
      FROM opened o JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1,
      LATERAL (SELECT o.q AS q, 4::BIGINT AS cost, 'D' AS letter
               UNION ALL SELECT if(o.q = 2, 3, 2), 3 + if(f.fault = 't', 3, 0), 'R' WHERE f.fault NOT IN ('b', 'd')
               UNION ALL SELECT CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, if(f.fault = 't', 3, 0), 'K'
               WHERE f.fault NOT IN ('b', 'd') AND (f.initial = 's' AND o.q = 0 OR f.initial = 'u' AND o.q <> 2 OR f.initial = 'a' AND o.q = 2)) e)
    SELECT conv_id, i, q, min(struct_pack(cost := cost, audit := audit)) AS best FROM edits GROUP BY ALL)),
closing AS ({_INSERTS.format("(SELECT l.conv_id, i, q, best.cost AS cost, best.audit AS audit FROM labels l JOIN totals t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND i = n)")}),
chosen AS (SELECT conv_id, min(best) AS best FROM closing WHERE q IN (0, 3) GROUP BY conv_id),
letters AS (
  SELECT conv_id, letter, place, sum((letter <> 'I')::INT) OVER past AS i, sum((letter <> 'D')::INT) OVER past AS written
  FROM (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, unnest(range(length(best.audit))) AS place FROM chosen WHERE best.audit <> '')
  WINDOW past AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
led AS (SELECT l.conv_id, l.letter, l.place, l.written, f.role, f.text,
               max((l.letter = 'K' AND f.initial = 's')::INT) OVER (PARTITION BY l.conv_id) AS system_turn
        FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.letter <> 'I'
        WHERE l.letter <> 'D'),
hashed AS (
  SELECT conv_id, sha256(string_agg(if(letter = 'K', role, if((written - system_turn) % 2 = 1, 'user', 'assistant')) || ':' || coalesce(text, ''),
                                    chr(10) ORDER BY place)) AS repaired_sha256
  FROM led GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE: dict[str, str] = {
    "op4_mix_sources": OP4, "op11_centroids": _op11(), "op12_conversation_repair": OP12, "op13_url_filter": OP13}
