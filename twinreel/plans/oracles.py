"""The named queries in DuckDB SQL, written from the semantics: a scan where the
library works in rounds, nested loops where it joins by bins."""

from __future__ import annotations

from . import library, media


def _items(constant: bool = False) -> str:
    duration = "60" if constant else "60 + vec_id % 40"
    return f"""items AS (
  SELECT vec_id AS id, '/lib/' || label || '/' || vec_id || '.mp4' AS path, CAST({duration} AS INT) AS duration, label, embedding AS e FROM embeddings),
ranked AS (SELECT *, row_number() OVER (ORDER BY duration, path) AS r FROM items)"""


_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.e[i] > 0) <> (b.e[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


def _edges(bits: int, constant: bool = False) -> str:
    return f"""{_items(constant)},
near AS (
  SELECT a.r AS u, b.r AS v, a.id AS uid, b.id AS vid, a.path AS u_path, b.path AS v_path, {_DISTANCE} AS d
  FROM ranked a JOIN ranked b ON a.r < b.r AND b.duration <= CAST(trunc(CAST(1.1 AS DOUBLE) * a.duration) AS INT)),
edges AS (SELECT * FROM near WHERE d <= {bits})"""


def _claims(bits: int, constant: bool = False) -> str:
    """A scan in order that carries the list of leaders."""
    return f"""WITH RECURSIVE {_edges(bits, constant)},
lower AS (SELECT v, list(u) AS us FROM edges GROUP BY v),
scan(k, leaders) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT k + 1, CASE WHEN us IS NOT NULL AND list_has_any(leaders, us) THEN leaders ELSE list_append(leaders, k + 1) END
  FROM scan LEFT JOIN lower ON lower.v = k + 1 WHERE k < (SELECT count(*) FROM items)),
lead AS (SELECT unnest(leaders) AS r FROM scan WHERE k = (SELECT count(*) FROM items)),
claims AS (
  SELECT uid AS leader, vid AS member, u_path AS leader_path, v_path AS member_path, d AS distance
  FROM edges WHERE u IN (SELECT r FROM lead) AND v NOT IN (SELECT r FROM lead)
  QUALIFY row_number() OVER (PARTITION BY v ORDER BY u) = 1),
members AS (
  SELECT c.leader AS group_id, i.*, 0 AS last FROM claims c JOIN items i ON i.id = c.member
  UNION ALL SELECT DISTINCT c.leader, i.*, 1 FROM claims c JOIN items i ON i.id = c.leader),
far AS (
  SELECT a.group_id, max({_DISTANCE}) AS max_distance FROM members a JOIN members b ON a.group_id = b.group_id AND a.path < b.path GROUP BY 1),
sizes AS (SELECT group_id, count(*) AS size FROM members GROUP BY 1)"""


def _refs(exclusive: bool) -> str:
    only = "QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY a.duration, a.path) = 1" if exclusive else ""
    return f"""WITH {_items()}
SELECT a.path AS reference_path, b.path AS candidate_path, {_DISTANCE} AS distance
FROM items a JOIN items b ON a.label = 0 AND b.label <> 0
 AND b.duration BETWEEN CAST(trunc(CAST(0.95 AS DOUBLE) * a.duration) AS INT) AND CAST(trunc(CAST(1.05 AS DOUBLE) * a.duration) AS INT)
WHERE {_DISTANCE} <= 25 {only}"""


def _sorted(key: str, way: str) -> str:
    return f"""{_claims(22)},
t AS (
  SELECT s.group_id, s.size, f.max_distance, l.duration AS lead_duration, l.path AS lead_path,
    (SELECT m.duration FROM members m WHERE m.group_id = s.group_id ORDER BY m.last, m.duration, m.path LIMIT 1) AS first_duration
  FROM sizes s JOIN far f USING (group_id) JOIN members l ON l.group_id = s.group_id AND l.last = 1)
SELECT group_id, row_number() OVER (ORDER BY {key} {way}, lead_duration DESC, lead_path DESC) - 1 AS place FROM t"""


_DOCS = """docs AS (
  SELECT doc_id AS id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, CAST(n_chars AS INT) AS duration, coalesce(text, '') AS content FROM documents)"""
_CONFIRMED = f"""{_DOCS},
confirmed AS (SELECT min(id) OVER g AS component_id, id, path, content FROM docs WINDOW g AS (PARTITION BY content) QUALIFY count(*) OVER g > 1),
cpairs AS (SELECT a.path AS lo, b.path AS hi, a.component_id FROM confirmed a JOIN confirmed b ON a.component_id = b.component_id AND a.path < b.path),
rejected AS (
  SELECT a.path AS lo, b.path AS hi FROM docs a JOIN docs b ON a.content = b.content AND a.path < b.path AND (a.id + b.id) % 3 = 0
  WHERE a.id IN (SELECT doc_id FROM labels) AND b.id IN (SELECT doc_id FROM labels))"""


def _band(low: str, high: str) -> str:
    return f"""SELECT a.duration, CAST(count(*) AS BIGINT) AS in_band
FROM (SELECT DISTINCT n_chars AS duration FROM documents) a JOIN documents b ON b.n_chars BETWEEN {low} AND {high} GROUP BY 1"""


_LOG = """log AS (SELECT '/u/' || user_id || '/' || event_type AS path, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, event_id FROM events),
known AS (SELECT path, max(mtime) AS mtime, CASE WHEN length(path) % 7 = 0 THEN 'NotVideo' END AS err_kind FROM log WHERE event_id % 2 = 0 GROUP BY path),
listing AS (SELECT path, max(mtime) AS mtime FROM log WHERE length(path) % 5 <> 0 GROUP BY path)"""


def _changes(known: str) -> str:
    return f"""SELECT path, CASE WHEN l.mtime IS NULL THEN 'remove' WHEN k.mtime IS NULL OR abs(l.mtime - k.mtime) > 2 THEN 'update' ELSE 'keep' END AS action
FROM listing l FULL JOIN {known} k USING (path)"""


_TEXT = """CASE p_partkey % 7 WHEN 0 THEN p_partkey % 9 || ' as ' || p_partkey % 5 || ' at ' || p_partkey % 4
 WHEN 1 THEN p_partkey % 9 || ' at ' || p_partkey % 5 || ' as ' || p_partkey % 4 WHEN 2 THEN p_partkey % 9 || ' at ' || p_partkey % 5
 WHEN 3 THEN p_partkey % 9 || ' as ' || p_partkey % 5 WHEN 4 THEN '' || p_partkey % 9 WHEN 5 THEN 'u' || p_partkey % 9 ELSE 'keep this' END"""

_REMOVE_KNOWN = f"""WITH RECURSIVE {_CONFIRMED},
rough AS (
  SELECT d.duration % 50 AS g, d.path, c.component_id AS c, row_number() OVER (PARTITION BY d.duration % 50 ORDER BY d.id DESC) AS k
  FROM docs d LEFT JOIN confirmed c USING (path)),
walk(g, k, buckets) AS (
  SELECT g, 0::BIGINT, []::STRUCT(b INT, c BIGINT, path VARCHAR)[] FROM (SELECT DISTINCT g FROM rough)
  UNION ALL
  SELECT w.g, r.k, list_append(w.buckets, {{
    'b': (SELECT min(n) FROM range(0, len(w.buckets) + 1) t(n) WHERE len(list_filter(w.buckets, lambda x: x.b = n)) = 0
          OR r.c IS NULL OR len(list_filter(w.buckets, lambda x: x.b = n AND (x.c IS NULL OR x.c <> r.c))) > 0)::INT,
    'c': r.c, 'path': r.path}})
  FROM walk w JOIN rough r ON r.g = w.g AND r.k = w.k + 1),
done AS (SELECT g, unnest(buckets) AS m FROM walk QUALIFY k = max(k) OVER (PARTITION BY g))
SELECT CAST(g AS BIGINT) AS group_id, m.b AS bucket, m.path AS path FROM done QUALIFY count(*) OVER (PARTITION BY g, m.b) > 1"""

_REMOVE_FALSEPOS = f"""WITH RECURSIVE {_CONFIRMED},
steps AS (SELECT component_id AS g, path, row_number() OVER (PARTITION BY component_id ORDER BY id DESC) AS k FROM confirmed),
peers AS (SELECT path, list(other) AS los FROM (SELECT hi AS path, lo AS other FROM rejected UNION ALL SELECT lo, hi FROM rejected) GROUP BY path),
walk(g, k, kept) AS (
  SELECT g, 0::BIGINT, []::VARCHAR[] FROM (SELECT DISTINCT g FROM steps)
  UNION ALL
  SELECT w.g, s.k, CASE WHEN p.los IS NOT NULL AND list_has_any(w.kept, p.los) THEN w.kept ELSE list_append(w.kept, s.path) END
  FROM walk w JOIN steps s ON s.g = w.g AND s.k = w.k + 1 LEFT JOIN peers p ON p.path = s.path),
done AS (SELECT g, kept FROM walk QUALIFY k = max(k) OVER (PARTITION BY g))
SELECT g AS group_id, unnest(kept) AS path FROM done WHERE len(kept) > 1"""

_A, _B = ("o_orderkey % 30", "o_orderkey % 23", "o_orderkey % 17", "o_orderkey % 19"), ("o_orderkey % 7", "o_orderkey % 41", "o_orderkey % 29", "o_orderkey % 11")


def oracle_sql() -> dict[str, str]:
    return _named() | media.oracle_sql() | library.oracle_sql()


def _named() -> dict[str, str]:
    claims = "SELECT leader_path, member_path, distance FROM claims"
    bound = lambda f: f"CAST(trunc(CAST({f} AS DOUBLE) * a.duration) AS INT)"
    return {
        "hamming_pairs": f"WITH {_edges(22)} SELECT u_path, v_path, d AS distance, round(d / CAST(64 AS DOUBLE), 6) AS normalised FROM edges",
        "hamming_histogram": f"WITH {_edges(25)} SELECT d AS distance, count(*) AS pairs FROM edges GROUP BY d",
        "search_self": f"{_claims(22)} {claims}",
        "search_self_tight": f"{_claims(19)} {claims}",
        "search_self_constant_duration": f"{_claims(19, True)} {claims}",
        "search_refs": _refs(False),
        "search_refs_consume": _refs(True),
        "duration_band_self": _band("a.duration", bound("1.1")),
        "duration_band_ref": _band(bound("0.95"), bound("1.05")),
        "group_pairs": f"{_claims(22)} SELECT a.group_id, a.path AS a_path, b.path AS b_path FROM members a JOIN members b ON a.group_id = b.group_id AND a.path < b.path",
        "group_sizes": f"{_claims(22)} SELECT group_id, size FROM sizes",
        "group_max_distance": f"{_claims(22)} SELECT group_id, max_distance FROM far",
        "group_members": f"{_claims(22)} SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY last, duration, path) - 1 AS place, path FROM members",
        "sort_num_matches": _sorted("size", "DESC"),
        "sort_num_matches_rev": _sorted("size", "ASC"),
        "sort_distance": _sorted("max_distance", "ASC"),
        "sort_distance_rev": _sorted("max_distance", "DESC"),
        "sort_duration": _sorted("first_duration", "DESC"),
        "sort_duration_rev": _sorted("first_duration", "ASC"),
        "unique_paths": f"{_claims(22)} SELECT path FROM items WHERE id NOT IN (SELECT id FROM members)",
        "path_filter": f"WITH {_DOCS} SELECT path FROM docs WHERE (path LIKE '/src1/%' OR path LIKE '/src2/%' OR path LIKE '/src3/en/%') AND path NOT LIKE '/src2/fr/%'",
        "ext_filter": r"""
WITH p AS (SELECT page_id AS id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
x AS (SELECT id, path, split_part(path, '/', -1) AS name FROM p),
e AS (SELECT id, path, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN lower(split_part(name, '.', -1)) ELSE '' END AS extension FROM x)
SELECT id, extension, starts_with(path, '/') AND extension NOT IN ('html', 'png', 'ds_store') AS kept FROM e""",
        "role_split": f"""WITH {_DOCS}, s AS (SELECT path, split_part(path, '/', 2) AS src, split_part(path, '/', 3) AS lang FROM docs)
SELECT path, CASE src WHEN 'src3' THEN 'reference' ELSE 'candidate' END AS role FROM s WHERE src IN ('src1', 'src2', 'src3') AND NOT (src = 'src2' AND lang = 'de')""",
        "path_parts": """SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS base, '/' || source || '/' || lang AS folder,
 '/' || source || '/' || lang || '/' || doc_id || '.mp4' AS as_mp4, '/trash/' || source || '/' || lang || '/' || doc_id || '.txt' AS trashed,
 '/' || source || '/' || lang || '/' || doc_id || '.txt' AS back FROM documents""",
        "content_dups": f"WITH {_DOCS} SELECT path, min(path) OVER g AS first_path, count(*) OVER g AS copies FROM docs WINDOW g AS (PARTITION BY content) QUALIFY count(*) OVER g > 1",
        "confirmed_components": f"WITH {_CONFIRMED} SELECT component_id, path FROM confirmed",
        "moved_files": f"""WITH {_CONFIRMED}, known AS (SELECT * FROM confirmed WHERE component_id <> id)
SELECT d.path, k.component_id, min(k.path) AS first_member FROM docs d JOIN known k ON d.content = k.content WHERE d.path NOT IN (SELECT path FROM known) GROUP BY 1, 2""",
        "falsepos_pairs": f"WITH {_CONFIRMED} SELECT lo, hi FROM rejected",
        "falsepos_closure": f"""WITH {_DOCS}, s AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS f FROM docs WHERE id IN (SELECT doc_id FROM labels))
SELECT a.path AS lo, b.path AS hi FROM s a JOIN s b ON a.f = b.f AND a.path < b.path""",
        "missed_matches": f"WITH {_CONFIRMED} SELECT lo, hi FROM cpairs WHERE regexp_replace(lo, '/[^/]*$', '') <> regexp_replace(hi, '/[^/]*$', '')",
        "validation_failures": f"WITH {_CONFIRMED} SELECT lo, hi FROM cpairs INTERSECT SELECT lo, hi FROM rejected",
        "unmatch_groups": f"WITH {_CONFIRMED} SELECT component_id, path FROM confirmed WHERE component_id NOT IN (SELECT component_id FROM cpairs JOIN rejected USING (lo, hi))",
        "drop_deleted": f"""WITH {_CONFIRMED} SELECT component_id, path FROM confirmed WHERE split_part(path, '/', 2) NOT IN ('src1', 'src2')
QUALIFY count(*) OVER (PARTITION BY component_id) > 1""",
        "filter_groups": f"""WITH {_CONFIRMED} SELECT component_id AS group_id, path FROM confirmed WHERE split_part(path, '/', 2) NOT IN ('src1', 'src3')
QUALIFY count(*) OVER (PARTITION BY component_id) > 1""",
        "extract_reference": f"""WITH {_CONFIRMED}, m AS (SELECT *, split_part(path, '/', 2) IN ('src1', 'src2', 'src3') AS ref FROM confirmed)
SELECT a.component_id AS group_id, a.path AS reference_path, b.path FROM m a JOIN m b ON a.component_id = b.component_id AND a.ref AND NOT b.ref""",
        "remove_known": _REMOVE_KNOWN,
        "remove_falsepos": _REMOVE_FALSEPOS,
        "change_detect": f"WITH {_LOG} {_changes('known')}",
        "cache_upsert": f"""WITH {_LOG}
SELECT l.path, CASE WHEN k.path IS NULL OR abs(l.mtime - k.mtime) > 2 THEN l.mtime ELSE k.mtime END AS mtime,
 CASE WHEN k.path IS NULL OR abs(l.mtime - k.mtime) > 2 THEN NULL ELSE k.err_kind END AS err_kind FROM listing l LEFT JOIN known k USING (path)""",
        "reload_errors": f"WITH {_LOG} {_changes('(SELECT * FROM known WHERE err_kind IS NULL)')}",
        "prune_deleted": f"WITH {_LOG} SELECT path, mtime FROM known WHERE path IN (SELECT path FROM listing)",
        "sampling_plan": """
WITH d AS (SELECT doc_id, n_chars / CAST(100 AS DOUBLE) AS s FROM documents)
SELECT doc_id, s AS seconds,
 CASE WHEN s = 2 THEN 2147483647 ELSE least(2147483647, CAST(floor(CASE WHEN s < 2 THEN 64 WHEN s < 10 THEN 64 / (s - 2) ELSE 6.4::DOUBLE END * 16384) AS BIGINT)) END AS fps_num,
 16384 AS fps_den, round(CASE WHEN s < 10 THEN 0 WHEN s < 25 THEN greatest(0, s - 12) ELSE 15 END, 6) AS seek FROM d""",
        "crop_algebra": f"""SELECT o_orderkey, least({_A[0]}, {_B[0]}) AS u_left, least({_A[1]}, {_B[1]}) AS u_right, least({_A[2]}, {_B[2]}) AS u_top, least({_A[3]}, {_B[3]}) AS u_bottom,
 (100 - {_A[0]} - {_A[1]}) * (80 - {_A[2]} - {_A[3]}) AS area, round((100 - {_A[0]} - {_A[1]}) / CAST(80 - {_A[2]} - {_A[3]} AS DOUBLE), 6) AS aspect,
 CASE WHEN abs({_B[1]} - {_B[0]}) * abs({_B[3]} - {_B[2]}) > abs({_A[1]} - {_A[0]}) * abs({_A[3]} - {_A[2]}) THEN {_B[0]} ELSE {_A[0]} END AS biggest_left,
 {_A[0]} = 0 AND {_A[1]} = 0 AND {_A[2]} = 0 AND {_A[3]} = 0 AS uncropped, {_A[0]} + 1 AS eroded_left, 100 - {_B[0]} - {_B[1]} AS view_width FROM orders""",
        "quality_rank": """SELECT a.l_orderkey, a.l_linenumber,
 round((SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_quantity < a.l_quantity) / CAST((SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey) AS DOUBLE), 6) AS quality
FROM lineitem a""",
        "frame_pair_diff": """WITH d AS (SELECT user_id, abs(floor(value) - floor(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS d FROM events)
SELECT user_id, CAST(sum(CASE WHEN d >= 8 THEN d ELSE 0 END) AS BIGINT) AS change FROM d GROUP BY 1""",
        "resolution_parse": rf"""
WITH t AS (SELECT p_partkey, {_TEXT} AS plain FROM part),
u AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 3 THEN replace(plain, ' ', '') WHEN 5 THEN plain || '98765432109876543210' ELSE plain END AS text FROM t),
p AS (SELECT p_partkey, text, regexp_extract_all(text, '\d+') AS n, regexp_replace(regexp_replace(text, '\s', '', 'g'), '\d+', '#', 'g') AS form FROM u),
d AS (
  SELECT p_partkey, text, form, n[1] AS c, CASE form WHEN '#as#at#' THEN n[2] WHEN '#at#as#' THEN n[3] WHEN '#as#' THEN n[2] ELSE n[1] END AS b,
    CASE form WHEN '#as#at#' THEN n[3] WHEN '#at#as#' THEN n[2] WHEN '#at#' THEN n[2] WHEN '#as#' THEN n[2] ELSE n[1] END AS f
  FROM p WHERE form IN ('#as#at#', '#at#as#', '#at#', '#as#', '#', 'u#')),
i AS (SELECT *, try_cast(b AS BIGINT) AS bi, try_cast(f AS BIGINT) AS fi, try_cast(c AS BIGINT) AS ci FROM d)
SELECT p.p_partkey, p.text, i.form = 'u#' AS untrash, bi AS basename_idx, fi AS dirname_idx, ci AS contents_idx,
 CASE WHEN i.form IS NULL THEN NULL WHEN ci IS NULL THEN 'not a number: contents_idx: ' || c WHEN bi IS NULL THEN 'not a number: basename_idx: ' || b
  WHEN fi IS NULL THEN 'not a number: dirname_idx: ' || f ELSE trim(
  CASE WHEN bi >= 6 THEN 'basename index not valid: ' || bi || '. ' ELSE '' END || CASE WHEN fi >= 6 THEN 'dirname index not valid: ' || fi || '. ' ELSE '' END
  || CASE WHEN ci >= 6 THEN 'contents index not valid: ' || ci || '.' ELSE '' END) END AS errors
FROM p LEFT JOIN i USING (p_partkey)""",
        "rotation_parse": "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 270 WHEN 3 THEN 180 WHEN 4 THEN 180 WHEN 5 THEN 270 WHEN 6 THEN 90 END AS rotation FROM part",
        "probe_json": """SELECT event_id, event_id % 100 + 0.5::DOUBLE AS duration, event_id * 10 AS size,
 CASE WHEN event_id % 2 = 1 THEN 1080 ELSE event_id % 1920 + 1 END AS width, CASE WHEN event_id % 2 = 1 THEN event_id % 1920 + 1 ELSE 1080 END AS height FROM events""",
        "display_formats": """SELECT o_orderkey, printf('%02d:%02d:%02d', o_orderkey * 7 // 3600, o_orderkey * 7 // 60 % 60, o_orderkey * 7 % 60) AS clock,
 o_orderkey || 'x' || (o_orderkey + 1) AS dimensions FROM orders""",
    }
