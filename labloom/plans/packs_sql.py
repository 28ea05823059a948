"""Problem 1 as SQL for DuckDB, by JSON functions: packs (p), their parts (f), and those that hold something (g)."""

from __future__ import annotations

PARTS = """WITH read AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM proof_packs WHERE payload IS NOT NULL),
d AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM read),
u AS (SELECT record_id, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.envelope') THEN j->'$.envelope'->'$.proof_pack' WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.proof_packs') THEN j->'$.proof_packs' ELSE j END AS j FROM d),
k AS (SELECT record_id, 0::BIGINT AS pack_ord, j AS p FROM u WHERE json_type(j) = 'OBJECT' UNION ALL SELECT record_id, unnest(range(json_array_length(j)::BIGINT)) AS pack_ord, unnest(json_extract(j, '$[*]')) FROM u WHERE json_type(j) = 'ARRAY'),
p AS (SELECT record_id, pack_ord, p, p->>'$.benchmark_id' AS b, CASE WHEN p->>'$.lineage' IS NOT NULL THEN p->>'$.lineage.id' END AS l FROM k WHERE p->>'$.benchmark_id' IS NOT NULL),
parts AS (SELECT record_id, pack_ord, 'threshold' AS child, l AS parent, p->'$.lineage.mapping_threshold_config.overrides' AS h, 'candidate_code' AS k, 'threshold' AS v FROM p WHERE l IS NOT NULL
  UNION ALL SELECT record_id, pack_ord, 'artifact_ref', b, p->'$.artifact_refs', 'kind', 'href' FROM p UNION ALL SELECT record_id, pack_ord, 'metric', b, p->'$.metrics', 'name', 'value' FROM p UNION ALL SELECT record_id, pack_ord, 'report', b, p->'$.reports', 'report_name', 'payload' FROM p),
e AS (SELECT record_id, pack_ord, child, parent, unnest(json_keys(h)) AS key, unnest(json_extract(h, '$.*')) AS value, true AS keyed FROM parts WHERE json_type(h) = 'OBJECT'
  UNION ALL SELECT record_id, pack_ord, child, parent, x->>('$.' || k), x->('$.' || v), false FROM (SELECT *, unnest(json_extract(h, '$[*]')) AS x FROM parts WHERE json_type(h) = 'ARRAY')),
f AS (SELECT record_id, pack_ord, child, parent, key, CASE WHEN child = 'report' AND keyed THEN value->'$.payload' ELSE value END AS value FROM e WHERE key IS NOT NULL),
g AS (SELECT * FROM f WHERE value IS NOT NULL AND json_type(value) <> 'NULL')
"""
FOUND = (
    PARTS
    + """SELECT record_id, pack_ord, 'pack' AS child, '' AS parent_key, b AS child_key FROM p
UNION ALL SELECT record_id, pack_ord, 'lineage', b, l FROM p WHERE l IS NOT NULL
UNION ALL SELECT record_id, pack_ord, 'threshold', l, 'default' FROM p WHERE l IS NOT NULL AND p->>'$.lineage.mapping_threshold_config.default' IS NOT NULL
UNION ALL SELECT record_id, pack_ord, child, parent, key FROM g
UNION ALL SELECT record_id, pack_ord, 'check', key, m FROM (SELECT record_id, pack_ord, key, unnest(json_extract(value, '$.checks[*].metric'))->>'$' AS m FROM g WHERE child = 'report') WHERE m IS NOT NULL"""
)

_NUMBER = lambda c: f"try_cast({c} AS DOUBLE)"
CHECKS = (
    PARTS
    + f""", c AS (SELECT record_id, pack_ord, key AS report_name, unnest(json_extract(value, '$.checks[*]')) AS c FROM g WHERE child = 'report'),
n AS (SELECT record_id, pack_ord, report_name, c->>'$.metric' AS metric, c->>'$.observed' AS x, c->>'$.baseline' AS y, {_NUMBER("c->>'$.observed'")} AS observed, {_NUMBER("c->>'$.baseline'")} AS baseline FROM c WHERE c->>'$.metric' IS NOT NULL)
SELECT record_id, pack_ord, report_name, metric, observed - baseline AS delta, CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN coalesce(observed >= baseline, x = y) THEN 'pass' ELSE 'regressed' END AS status FROM n"""
)
TIMINGS = (
    PARTS
    + f"""SELECT key AS name, ends_with(key, '_ms') AS timing, count({_NUMBER("value->>'$'")}) AS n, round(avg({_NUMBER("value->>'$'")}), 4) AS mean, max({_NUMBER("value->>'$'")}) AS greatest FROM g WHERE child = 'metric' GROUP BY 1, 2"""
)
VALUES = (
    PARTS
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pack_ord) - 1 AS pack_no FROM p),
a AS (SELECT record_id, pack_ord, 'pack' AS child, '' AS parent_key, b AS child_key, p AS v FROM p UNION ALL SELECT record_id, pack_ord, 'lineage', b, l, p->'$.lineage' FROM p WHERE l IS NOT NULL
  UNION ALL SELECT record_id, pack_ord, 'threshold', l, 'default', p->'$.lineage.mapping_threshold_config.default' FROM p WHERE l IS NOT NULL AND p->>'$.lineage.mapping_threshold_config.default' IS NOT NULL UNION ALL SELECT record_id, pack_ord, child, parent, key, value FROM g
  UNION ALL SELECT record_id, pack_ord, 'check', key, c->>'$.metric', c FROM (SELECT record_id, pack_ord, key, unnest(json_extract(value, '$.checks[*]')) AS c FROM g WHERE child = 'report') WHERE c->>'$.metric' IS NOT NULL),
w AS (SELECT * EXCLUDE (v), unnest(json_keys(v)) AS name, unnest(json_extract(v, '$.*')) AS x FROM a WHERE json_type(v) = 'OBJECT' UNION ALL SELECT * EXCLUDE (v), 'value', v FROM a WHERE json_type(v) <> 'OBJECT')
SELECT record_id, pack_ord, pack_no, child, parent_key, child_key, name, x->>'$' AS value FROM w JOIN o USING (record_id, pack_ord) WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL')"""
)

NODES = """WITH r AS (SELECT record_id, payload::JSON AS j FROM proof_packs WHERE json_valid(payload)), n AS (SELECT r.record_id, x.key, x.type, x.atom, x.id, x.parent FROM r, json_tree(r.j) x),
o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY id) - 1 AS node, row_number() OVER (PARTITION BY record_id, parent ORDER BY id) - 1 AS place FROM n)
SELECT o.record_id, o.node, p.node AS parent, CASE WHEN p.type = 'OBJECT' THEN o.key END AS key, o.place, CASE o.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'scalar' END AS kind, CASE WHEN o.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN o.atom->>'$' END AS value
FROM o LEFT JOIN o p ON p.record_id = o.record_id AND p.id = o.parent"""
