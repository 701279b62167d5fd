"""SQL that the queries of the general problems are compared with, where SQL can say them at the size of the comparison.

Local times are resolved here by another way than in the operator: the offsets a day before and a day after a local time
give two candidates, and those that lead back to it count.
"""

from __future__ import annotations

from quarrybed.operators import instants
from quarrybed.operators.nested import LIST_KEYS

DAY = 86_400_000_000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _number_sql(n: str) -> str:
    f, t, z = instants.FROM_S, instants.TO_S, instants.SHIFT_S
    within = lambda unit, shift: f"{n} >= {(f + shift) * unit} AND {n} < {(t + shift) * unit}"
    return f"CASE WHEN {within(1, 0)} THEN {n} * 1000000 WHEN {within(1000, 0)} THEN {n} * 1000 WHEN {within(1000000, 0)} THEN {n} WHEN {within(1000000, z)} THEN {n} - {z * 1000000} WHEN {within(10000000, z)} THEN ({n} - {z * 10000000}) // 10 END"


def _instants_sql(source: str) -> str:
    """A query that adds ``us`` and ``resolution`` to a relation with ``value, own_zone, host_zone``."""
    canon = " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN regexp_replace(s, {_quoted(p)}, {_quoted(o.replace('$', chr(92)))})" for p, o in instants._FORMS)
    names = {**{m: i for i, m in enumerate(instants._MONTHS, 1)}, **{m: i for i, m in enumerate(instants._LONG, 1)}, "sept": 9}
    months = " ".join(f"WHEN '{m}' THEN {i}" for m, i in names.items())
    blanks = "[\\s   ]+"
    return f"""
SELECT *, CASE WHEN us IS NULL THEN NULL WHEN stated IS NOT NULL THEN 'stated' WHEN back1 AND back2 AND c1 <> c2 THEN 'ambiguous' WHEN back1 OR back2 THEN 'direct' ELSE 'nonexistent' END AS resolution FROM (
SELECT *, coalesce(stated, CASE WHEN back1 AND back2 THEN least(c1, c2) WHEN back2 THEN c2 ELSE c1 END) AS us FROM (
SELECT *, epoch_us(timezone(zone, make_timestamptz(c1))) = t AS back1, epoch_us(timezone(zone, make_timestamptz(c2))) = t AS back2 FROM (
SELECT *, t - (epoch_us(timezone(zone, make_timestamptz(t - {DAY}))) - (t - {DAY})) AS c1, t - (epoch_us(timezone(zone, make_timestamptz(t + {DAY}))) - (t + {DAY})) AS c2 FROM (
SELECT x.* EXCLUDE (own_zone, host_zone), coalesce(number_us, t - CAST(m AS BIGINT) * 60000000) AS stated, CASE WHEN m IS NULL AND z = '' THEN coalesce(zo.name, zh.name) WHEN m IS NULL THEN zt.name END AS zone FROM (
SELECT *, CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN try_cast(substr(replace(z, ':', ''), 2, 2) AS INT) < 24 AND try_cast(substr(replace(z, ':', ''), 4, 2) AS INT) < 60 THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (try_cast(substr(replace(z, ':', ''), 2, 2) AS INT) * 60 + try_cast(substr(replace(z, ':', ''), 4, 2) AS INT)) END ELSE (SELECT max(offset_minutes) FROM zone_abbreviations a WHERE upper(a.abbreviation) = upper(z)) END AS m FROM (
SELECT *, CASE WHEN p[1] <> '0000' AND mo IS NOT NULL AND hour < 24 AND minute < 60 AND second < 60 THEN epoch_us(CAST(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, mo, d) AS DATE) AS TIMESTAMP)) + CAST(hour * 3600 + minute * 60 + second AS BIGINT) * 1000000 + micro END AS t, p[9] AS z FROM (
SELECT *, CASE WHEN length(p[1]) = 2 THEN 2000 ELSE 0 END + try_cast(p[1] AS INT) AS y, coalesce(try_cast(p[2] AS INT), CASE lower(p[2]) {months} END) AS mo, try_cast(p[3] AS INT) AS d,
 CASE WHEN p[8] = '' THEN try_cast(p[4] AS INT) WHEN try_cast(p[4] AS INT) BETWEEN 1 AND 12 THEN try_cast(p[4] AS INT) % 12 + CASE WHEN lower(p[8]) = 'p' THEN 12 ELSE 0 END END AS hour, try_cast(p[5] AS INT) AS minute,
 CASE WHEN p[6] = '' THEN 0 ELSE try_cast(p[6] AS INT) END AS second, CASE WHEN p[7] = '' THEN 0 ELSE try_cast(rpad(substr(p[7], 1, 6), 6, '0') AS BIGINT) END AS micro FROM (
SELECT *, string_split(CASE {canon} END, '|') AS p, CASE WHEN regexp_full_match(s, '[0-9]{{1,19}}') THEN {_number_sql("try_cast(s AS BIGINT)")} WHEN regexp_full_match(s, '[0-9]{{1,19}}[.][0-9]+') AND try_cast(split_part(s, '.', 1) AS BIGINT) >= {instants.FROM_S} AND try_cast(split_part(s, '.', 1) AS BIGINT) < {instants.TO_S} THEN try_cast(split_part(s, '.', 1) AS BIGINT) * 1000000 + try_cast(rpad(substr(split_part(s, '.', 2), 1, 6), 6, '0') AS BIGINT) END AS number_us FROM (
SELECT *, trim(regexp_replace(regexp_replace(value, '[(][^()]*[)]', ' ', 'g'), '{blanks}', ' ', 'g')) AS s FROM ({source})))))) x
LEFT JOIN (SELECT lower(name) AS k, min(name) AS name FROM pg_timezone_names() GROUP BY 1) zo ON zo.k = lower(x.own_zone)
LEFT JOIN (SELECT lower(name) AS k, min(name) AS name FROM pg_timezone_names() GROUP BY 1) zh ON zh.k = lower(x.host_zone)
LEFT JOIN (SELECT lower(name) AS k, min(name) AS name FROM pg_timezone_names() GROUP BY 1) zt ON zt.k = lower(x.z)))))"""


_HOSTS = "(SELECT evidence_id, max(host_timezone) AS host_zone FROM evidence_sources GROUP BY 1)"
_OWN = "json_extract_string(try_cast(payload AS JSON), '$.userTimezone')"
_TEXTS = f"""
SELECT source_table, entry_id, value, own_zone, host_zone FROM (
 SELECT 'rfc822_metadata' AS source_table, entry_id, evidence_id, date_header AS value, CAST(NULL AS VARCHAR) AS own_zone FROM rfc822_metadata
 UNION ALL SELECT 'activity', entry_id, evidence_id, start_time, {_OWN} FROM activity) LEFT JOIN {_HOSTS} USING (evidence_id)"""
_ALL = f"""
SELECT DISTINCT source_table, entry_id, us AS epoch_micros, resolution FROM ({_instants_sql(_TEXTS)}) WHERE us IS NOT NULL
UNION SELECT source_table, entry_id, us, 'stated' FROM (
 SELECT 'recycle_bin_records' AS source_table, entry_id, {_number_sql("deletion_timestamp_filetime")} AS us FROM recycle_bin_records
 UNION ALL SELECT 'shimcache_entries', entry_id, {_number_sql("raw_filetime")} FROM shimcache_entries) WHERE us IS NOT NULL"""

_ACTIVE = "(SELECT * FROM activity WHERE activity_type = 6 AND app_id IS NOT NULL AND evidence_id IS NOT NULL)"
_ENDS = f"SELECT entry_id, evidence_id, app_id, {{c}} AS value, {_OWN} AS own_zone, host_zone FROM {_ACTIVE} LEFT JOIN {_HOSTS} USING (evidence_id)"
_SPANS = f"""
SELECT DISTINCT evidence_id, app_id, s.us AS lo, e.us AS hi FROM ({_instants_sql(_ENDS.format(c="start_time"))}) s
JOIN (SELECT entry_id, us FROM ({_instants_sql(_ENDS.format(c="end_time"))})) e USING (entry_id) WHERE s.us < e.us"""

#: Every object and array of a record with its path, the item around it and whether it stands in an array.
_WALK = f"""
WITH RECURSIVE r AS (SELECT DISTINCT entry_id, try_cast(ltrim(metadata_json, chr(65279)) AS JSON) AS j FROM filesystem_entries WHERE entry_id IS NOT NULL),
r2 AS (SELECT entry_id, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM r),
w(entry_id, v, path, parent, tag, place) AS (
 SELECT entry_id, j, '', '', '', 'any' FROM r2 WHERE json_type(j) IN ('OBJECT', 'ARRAY')
 UNION ALL
 SELECT entry_id, c.x, CASE WHEN is_array THEN path || '[' || c.k || ']' ELSE CASE WHEN path = '' THEN c.k ELSE path || '.' || c.k END || CASE WHEN bare THEN '[0]' ELSE '' END END,
  CASE WHEN NOT is_array AND place = 'array' THEN path ELSE parent END, CASE WHEN is_array THEN tag WHEN path = '' THEN c.k ELSE tag || '.' || c.k END, CASE WHEN is_array OR bare THEN 'array' ELSE 'key' END
 FROM (SELECT *, json_type(c.x) = 'OBJECT' AND NOT is_array AND c.k IN ({", ".join(map(_quoted, LIST_KEYS))}) AS bare FROM (
  SELECT *, json_type(v) = 'ARRAY' AS is_array, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: struct_pack(k := CAST(i AS VARCHAR), x := json_extract(v, '$[' || i || ']')))
   ELSE list_transform(json_keys(v), lambda k: struct_pack(k := k, x := json_extract(v, '$."' || k || '"'))) END) AS c FROM w)) WHERE json_type(c.x) IN ('OBJECT', 'ARRAY'))
"""

_REF = "CASE WHEN {r}.ref_version = 'v3' THEN {r}.high || ':' || {r}.low ELSE {r}.entry || '-' || {r}.sequence END"
_TREES = f"""
WITH RECURSIVE a AS (SELECT evidence_id AS t, {_REF.format(r='file_reference')} AS v, {_REF.format(r='parent_reference')} AS p, file_name AS n, usn FROM usn_records),
r AS (SELECT t, v, arg_max(p, usn) AS p, arg_max(n, usn) AS n FROM a GROUP BY t, v),
up(t, v, x, d, path) AS (SELECT t, v, v, 0, '' FROM r UNION ALL SELECT u.t, u.v, r.p, u.d + 1, CASE WHEN u.d = 0 THEN r.n ELSE r.n || '/' || u.path END FROM up u JOIN r ON r.t = u.t AND r.v = u.x AND r.p <> r.v WHERE u.d < 200),
done AS (SELECT u.* FROM up u LEFT JOIN r ON r.t = u.t AND r.v = u.x WHERE r.v IS NULL OR r.p = r.v)
"""


def oracle_sql() -> dict:
    """SQL by query; trees there are less than 200 levels deep."""
    return {
        "p3_found": f"SELECT DISTINCT source_table, entry_id, epoch_micros FROM ({_ALL}) WHERE entry_id IS NOT NULL",
        "p3_resolutions": f"SELECT source_table, resolution, count(*) AS records FROM ({_ALL}) GROUP BY 1, 2",
        "p5_found": _TREES + "SELECT r.t AS evidence_id, r.v AS node_ref, coalesce(done.x, '') AS root_ref, coalesce(done.d, -1)::BIGINT AS depth, coalesce(done.path, '') AS full_path FROM r LEFT JOIN done ON done.t = r.t AND done.v = r.v",
        "p5_descendants": _TREES + "SELECT up.t AS evidence_id, up.x AS ancestor_ref, up.v AS descendant_ref, up.d::BIGINT AS distance FROM up JOIN done ON done.t = up.t AND done.v = up.v JOIN r ON r.t = up.t AND r.v = up.x WHERE up.d > 0",
        "p6_found": _WALK + "SELECT DISTINCT entry_id, parent AS parent_path, path AS item_path FROM w WHERE place = 'array' AND json_type(v) = 'OBJECT'",
        "p6_tables": _WALK + "SELECT DISTINCT entry_id, parent AS parent_path, path AS item_path, json_extract_string(v, '$.kind') AS kind, json_extract_string(v, '$.address') AS address FROM w WHERE place = 'array' AND json_type(v) = 'OBJECT' AND tag = 'message.recipients'",
        "p7_found": f"""
WITH spans AS ({_SPANS}),
n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY evidence_id, app_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spans),
g AS (SELECT *, sum(opens) OVER (PARTITION BY evidence_id, app_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM n),
p AS (SELECT evidence_id, app_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY evidence_id, app_id, k),
q AS (SELECT evidence_id, app_id, lag(hi) OVER (PARTITION BY evidence_id, app_id ORDER BY lo) AS lo, lo AS hi FROM p)
SELECT evidence_id, app_id, 'period' AS period_kind, lo AS start_micros, hi AS end_micros FROM p UNION ALL SELECT evidence_id, app_id, 'gap', lo, hi FROM q WHERE hi - lo <= {DAY}""",
    }
