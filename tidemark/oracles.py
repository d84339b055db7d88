"""DuckDB SQL for the queries of the reconciliation engine, written from their meaning, not from the DataFrame code."""

from __future__ import annotations

_BASE = """
WITH d AS (
  SELECT doc_id, text, source, lang, doc_id % 20 AS k, 1700000000000 + doc_id * 1000 AS t,
         octet_length(encode(text)) AS sz, sha256(text) AS h, md5(text) AS m,
         CASE doc_id % 20 WHEN 17 THEN source || '/' || doc_id || '/.DS_Store' WHEN 18 THEN '.cfg/doc-' || doc_id || '.md'
              ELSE source || '/' || lang || '/doc-' || doc_id || '.md' END AS path
  FROM documents),
sides AS (
  SELECT path, doc_id, k, h, k NOT IN (6, 7, 8, 10) AS l, k NOT IN (4, 5, 8, 9) AS r, k NOT IN (9, 10, 11, 12, 17, 18, 19) AS b,
         sz + CASE WHEN k IN (1, 3, 5) THEN 1 ELSE 0 END AS l_size,
         CASE WHEN k IN (1, 3, 5, 14) THEN t + 5000 WHEN k = 15 THEN 0 ELSE t END AS l_mtime,
         CASE WHEN k IN (15, 19) THEN '' WHEN k IN (1, 3, 5) THEN sha256(text || 'L') ELSE h END AS l_hash,
         sz + CASE WHEN k IN (2, 3, 7, 12) THEN 1 ELSE 0 END AS r_size,
         t + CASE WHEN k IN (2, 3, 7, 13, 16) THEN 9000 ELSE 1000 END AS r_mtime,
         CASE k WHEN 11 THEN 'sha256' WHEN 16 THEN 'quickxor' ELSE 'md5' END AS r_algo,
         CASE WHEN k IN (2, 3, 7, 12) THEN md5(text || 'R') WHEN k = 11 THEN h ELSE m END AS r_sum,
         h AS b_hash, t AS bl_mtime, t + 1000 AS br_mtime, sz AS b_size, m AS b_sum
  FROM d),
mixed AS (
  SELECT *,
         CASE WHEN l_hash <> '' THEN l_hash <> b_hash WHEN l_mtime > 0 THEN l_mtime <> bl_mtime OR l_size <> b_size ELSE TRUE END AS lc,
         CASE WHEN r_mtime = br_mtime AND r_size = b_size THEN FALSE WHEN r_algo = 'md5' THEN r_sum <> b_sum ELSE TRUE END AS rc,
         l_hash <> '' AND r_algo = 'sha256' AND r_sum = l_hash AS same
  FROM sides WHERE (l OR r OR b) AND NOT starts_with(path, '.') AND NOT contains(path, '/.')),
plan AS (
  SELECT *, {action} AS action FROM mixed WHERE {action} IS NOT NULL)
"""


def _action(left: str = "l") -> str:
    return f"""CASE WHEN b AND {left} AND r THEN CASE WHEN lc AND rc THEN 'conflict' WHEN lc THEN 'push' WHEN rc THEN 'pull' END
              WHEN b AND {left} THEN CASE WHEN lc THEN 'conflict' ELSE 'delete_local' END
              WHEN b AND r THEN CASE WHEN rc THEN 'conflict' ELSE 'delete_remote' END
              WHEN b THEN 'cleanup' WHEN {left} AND r THEN CASE WHEN same AND l_size = r_size THEN 'match' ELSE 'conflict' END
              WHEN {left} THEN 'push' WHEN r THEN 'pull' END"""


_PLAN = _BASE.replace("{action}", _action())
#: A side that an authoritative listing fills in is as the baseline has it.
_CONFIRMED = _BASE.replace("l_hash <> b_hash", "l AND l_hash <> b_hash").replace("{action}", _action("(l OR (b AND doc_id % 2 = 0))"))

_MOVES = """
WITH d AS (SELECT doc_id, source, doc_id % 10 AS r, source || '/' || lang || '/doc-' || doc_id || '.md' AS old FROM documents),
m AS (SELECT *, 'moved/' || old AS new FROM d)
"""
_ROW = "SELECT {path} AS path, '{action}' AS action, {old} AS old_path, {folder} AS is_folder, {pull} AS needs_pull, {n} AS n, {reason} AS reason FROM {rows}"


def _row(path: str, action: str, rows: str, old: str = "NULL::VARCHAR", folder: str = "FALSE", pull: str = "FALSE", n: str = "0::BIGINT", reason: str = "NULL::VARCHAR") -> str:
    return _ROW.format(path=path, action=action, rows=rows, old=old, folder=folder, pull=pull, n=n, reason=reason)


_LOCAL_FOLDERS = """
WITH m AS (SELECT doc_id, source, source || '/' || lang || '/doc-' || doc_id || '.md' AS old, 'moved/' || source || '/' || lang || '/doc-' || doc_id || '.md' AS new FROM documents),
s AS (SELECT source, count(*) AS n, bool_or(doc_id % 97 = 5) AS odd FROM m GROUP BY source)
"""
_REMOTE_FOLDERS = """
WITH m AS (SELECT doc_id, source, CASE WHEN source LIKE '%3' THEN '.hidden/' ELSE 'moved/' END || source AS folder,
                  source || '/' || lang || '/doc-' || doc_id || '.md' AS old,
                  CASE WHEN source LIKE '%3' THEN '.hidden/' ELSE 'moved/' END || source || '/' || lang || '/doc-' || doc_id || '.md' AS new FROM documents),
s AS (SELECT source, folder, count(*) AS n, CASE WHEN source LIKE '%3' THEN 'cross_regime' WHEN bool_or(doc_id % 97 = 5) THEN 'destination_occupied' END AS reason FROM m GROUP BY source, folder)
"""
_PATHS = "SELECT doc_id, source, lang, source || '/' || lang || '/doc-' || doc_id || '.md' AS path FROM documents"
_DELTA = f"""
WITH p AS ({_PATHS}), e AS (
  SELECT doc_id % 7 AS r, path, CASE doc_id % 7 WHEN 1 THEN source || '/' || lang || '/new-doc-' || doc_id || '.md' WHEN 2 THEN source || '/doc-' || doc_id || '.md' ELSE path END AS now FROM p WHERE doc_id % 7 <= 4)
SELECT now AS path, 'modified' AS kind, NULL::VARCHAR AS old_path FROM e WHERE r > 0
UNION ALL SELECT path, 'deleted', NULL FROM e WHERE r <= 2
UNION ALL SELECT now, 'renamed', path FROM e WHERE r IN (1, 2)
"""
_DIFF = """
WITH e AS (SELECT doc_id % 7 AS r, source || '/doc-' || doc_id AS path FROM documents)
SELECT CASE WHEN r = 1 THEN 'moved/' || path ELSE path END AS path, 'modified' AS kind, NULL::VARCHAR AS old_path FROM e WHERE r IN (1, 2, 3)
UNION ALL SELECT path, 'deleted', NULL FROM e WHERE r IN (0, 1)
UNION ALL SELECT 'moved/' || path, 'renamed', path FROM e WHERE r = 1
"""
_PRUNE = f"""
WITH p AS ({_PATHS}), g AS (SELECT *, source = 'src1' OR (source = 'src3' AND lang = 'en') OR doc_id = 4 AS gone FROM p),
folders AS (SELECT source AS f FROM g UNION SELECT source || '/' || lang FROM g UNION SELECT 'src5/xx'),
touched AS (SELECT source AS f FROM g WHERE gone UNION SELECT source || '/' || lang FROM g WHERE gone)
SELECT f AS path FROM touched
WHERE NOT EXISTS (SELECT 1 FROM g WHERE NOT gone AND starts_with(path, f || '/'))
  AND NOT EXISTS (SELECT 1 FROM folders o WHERE starts_with(o.f, touched.f || '/') AND o.f NOT IN (SELECT f FROM touched))
"""
_NODES = f"""
WITH p AS ({_PATHS})
SELECT DISTINCT 's:' || source AS id, source AS path FROM p
UNION ALL SELECT DISTINCT 'l:' || source || '/' || lang, source || '/' || lang FROM p
UNION ALL SELECT 'd:' || doc_id, path FROM p
UNION ALL VALUES ('o:1', 'orphan'), ('o:2', 'orphan/below'), ('c:1', 'one'), ('c:2', 'two'), ('c:3', 'one/under')
"""
_FUNCTIONS = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') || '//part\x.Md/' AS raw FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '\\', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS path FROM a),
s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, '.md' AS extension, array_to_string(parts[1:len(parts) - 1], '/') AS parent, len(parts)::BIGINT AS depth,
       array_to_string(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')), '|') AS above,
       path[1:length(path) - 3] || '.conflict-2.Md' AS second, 'top/' || path AS rebased, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS slug
FROM s
"""
_GAPS = """
WITH e AS (SELECT user_id::VARCHAR AS stream_key, ts, ts - lag(ts) OVER w {apart} INTERVAL 1 HOUR AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(CASE WHEN far IS NULL OR far THEN 1 ELSE 0 END) OVER (PARTITION BY stream_key ORDER BY ts) AS burst FROM e)
SELECT stream_key, epoch_us(min(ts)) AS first, epoch_us(max(ts)) {plus}, count(*) AS n FROM b GROUP BY stream_key, burst
"""
_RETRY = """
WITH e AS (
  SELECT event_id, ['googledrive', 'dropbox', 'onedrive'][event_id % 3 + 1] AS provider, [401, 403, 404, 429, 500, 507, 423][event_id % 7 + 1] AS status,
         CASE WHEN event_id % 2 = 0 THEN 'userRateLimitExceeded' WHEN event_id % 5 = 0 THEN 'path/insufficient_space' ELSE '' END AS reason,
         event_id % 4 + 1 AS attempt, CASE WHEN event_id % 11 = 0 THEN 7000.0 WHEN event_id % 13 = 0 THEN 0.0 END AS wait, (event_id % 10) / 10.0 AS rng FROM events),
k AS (
  SELECT *, CASE WHEN provider = 'googledrive' AND status = 403 AND reason = 'userRateLimitExceeded' THEN 'rateLimit'
                 WHEN provider = 'dropbox' AND (contains(reason, 'insufficient_space') OR status = 507) THEN 'storageFull'
                 WHEN provider = 'onedrive' AND status = 507 THEN 'permission' WHEN status = 401 THEN 'auth' WHEN status = 403 THEN 'permission'
                 WHEN status = 404 THEN 'notFound' WHEN status = 429 THEN 'rateLimit' ELSE 'transient' END AS kind FROM e),
a AS (
  SELECT *, CASE kind WHEN 'auth' THEN 'auth' WHEN 'permission' THEN 'permission' WHEN 'storageFull' THEN 'permission' END AS abort FROM k),
j AS (
  SELECT *, CASE WHEN abort IS NOT NULL THEN 'abort' WHEN kind = 'notFound' THEN 'stop' WHEN attempt >= 3 THEN 'exhausted' ELSE 'retry' END AS action FROM a)
SELECT event_id, kind, action, abort, CASE WHEN action = 'retry' THEN round(least(coalesce(wait, 2 ** (attempt - 1) * 1000 * (0.5 + rng)), 64000))::BIGINT END AS delay_ms FROM j
"""
_SUMMARY = """
, o AS (SELECT split_part(path, '/', 1) AS burst, action, l AND l_size % 7 = 0 AS failed FROM plan),
c AS (
  SELECT burst, count(*) FILTER (action = 'push' AND NOT failed) AS pushed, count(*) FILTER (action = 'pull' AND NOT failed) AS pulled,
         count(*) FILTER (action = 'match' AND NOT failed) AS matched, count(*) FILTER (action IN ('delete_local', 'delete_remote') AND NOT failed) AS deleted,
         count(*) FILTER (starts_with(action, 'rename') AND NOT failed) AS renamed, count(*) FILTER (action = 'conflict' AND NOT failed) AS conflicts, count(*) FILTER (failed) AS errors
  FROM o GROUP BY burst)
SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN pushed > 0 THEN pushed || ' pushed' END, CASE WHEN pulled > 0 THEN pulled || ' pulled' END, CASE WHEN matched > 0 THEN matched || ' matched' END,
         CASE WHEN deleted > 0 THEN deleted || ' deleted' END, CASE WHEN renamed > 0 THEN renamed || ' renamed' END, CASE WHEN conflicts > 0 THEN conflicts || ' conflicts' END, CASE WHEN errors > 0 THEN errors || ' errors' END), ''), 'nothing to do') AS message
FROM c
"""

SQL: dict[str, str] = {
    "plan_cold": _PLAN + "SELECT path, action, CASE WHEN l THEN l_size END AS local_size, CASE WHEN r THEN r_size END AS remote_size FROM plan",
    "plan_warm": _PLAN + "SELECT path, action FROM plan WHERE (l AND (NOT b OR lc)) OR (b AND NOT l) OR k IN (2, 3, 4, 5, 7, 8, 10, 11, 12, 16)",
    "plan_hot_few": _PLAN + "SELECT path, action FROM plan WHERE doc_id % 1000 IN (21, 43, 63, 109, 104, 382, 905)",
    "plan_hot": _PLAN + "SELECT path, action FROM plan WHERE k IN (0, 1, 3, 5, 6, 9, 14, 2, 4, 13)",
    "local_changed": _PLAN + "SELECT path, lc AS changed FROM mixed WHERE l AND b",
    "remote_changed": _PLAN + "SELECT path, rc AS changed FROM mixed WHERE r AND b",
    "same_content": _PLAN + "SELECT path, same FROM mixed WHERE l AND r",
    "exclusion_scope": _PLAN
    + r"""SELECT path, contains(path, '.DS_Store') AS junk, starts_with(path, '.') OR contains(path, '/.') AS hidden, contains(path, '/.') AS hidden_in_scope,
          starts_with(path, 'src4/') OR starts_with(path, 'src5/fr/') OR regexp_full_match(path, 'src6/de/doc-[^/]*6\.md') AS ignored FROM d""",
    "path_functions": _FUNCTIONS,
    "content_digests": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CASE WHEN text = '' THEN sha256('') ELSE sha256(unhex(sha256(text))) END AS block FROM documents",
    "initial_match_enrichment": _PLAN + "SELECT path, CASE WHEN k = 19 THEN 'match' ELSE action END AS action, CASE WHEN l THEN CASE WHEN k = 19 THEN h ELSE l_hash END END AS hash FROM plan",
    "confirm_deletions": _CONFIRMED + "SELECT path, action FROM plan",
    "rename_local_files": _MOVES
    + " UNION ALL ".join(
        [
            _row("new", "rename_remote", "m WHERE r < 6", "old"),
            _row("old", "delete_remote", "m WHERE r IN (6, 7)"),
            _row("new", "push", "m WHERE r IN (6, 7, 8)"),
            _row("new", "skipped", "m WHERE r IN (6, 7, 8)", "old", reason="CASE r WHEN 6 THEN 'hash_mismatch' WHEN 7 THEN 'hash_missing' ELSE 'action_type_mismatch' END"),
        ]
    ),
    "rename_remote_files": _MOVES
    + " UNION ALL ".join([_row("new", "rename_local", "m WHERE r < 8", "old", pull="r = 6"), _row("new", "pull", "m WHERE r = 8"), _row("new", "skipped", "m WHERE r = 8", "old", reason="'action_type_mismatch'")]),
    "rename_local_folders": _LOCAL_FOLDERS
    + " UNION ALL ".join(
        [
            _row("'moved/' || source", "rename_remote", "s WHERE NOT odd", "source", "TRUE", n="n"),
            _row("old", "delete_remote", "m JOIN s USING (source) WHERE odd"),
            _row("new", "push", "m JOIN s USING (source) WHERE odd"),
            _row("'moved/' || source", "skipped", "s WHERE odd", "source", "TRUE", reason="'hash_mismatch'"),
        ]
    ),
    "rename_remote_folders": _REMOTE_FOLDERS
    + " UNION ALL ".join(
        [
            _row("folder", "rename_local", "s WHERE reason IS NULL", "source", "TRUE", n="n"),
            _row("old", "delete_local", "m JOIN s USING (source) WHERE s.reason IS NOT NULL"),
            _row("new", "pull", "m JOIN s USING (source) WHERE s.reason IS NOT NULL"),
            _row("folder || '/extra-' || doc_id || '.md'", "push", "m WHERE doc_id % 97 = 5"),
            _row("folder", "skipped", "s WHERE reason IS NOT NULL", "source", "TRUE", reason="reason"),
        ]
    ),
    "snapshot_diff_by_id": _DIFF,
    "resolve_paths": _NODES,
    "apply_id_delta": _DELTA,
    "subtree_rewrite": f"WITH p AS ({_PATHS}) SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'en' THEN 'english/doc-' || doc_id || '.md' WHEN source = 'src1' THEN 'old/one/' || lang || '/doc-' || doc_id || '.md' WHEN source = 'src2' THEN 'src2b/' || lang || '/doc-' || doc_id || '.md' ELSE path END AS path FROM p",
    "subtree_remove": f"WITH p AS ({_PATHS}) SELECT doc_id, path FROM p WHERE source <> 'src1' AND NOT (source = 'src3' AND lang = 'en')",
    "prune_empty_folders": _PRUNE,
    "missing_folders": f"WITH p AS ({_PATHS}), f AS (SELECT doc_id, source AS path, 1 AS depth FROM p UNION ALL SELECT doc_id, source || '/' || lang, 2 FROM p) SELECT DISTINCT path, depth::BIGINT AS depth FROM f WHERE path NOT IN (SELECT path FROM f WHERE doc_id % 3 = 0)",
    "deletion_quarantine": _PLAN + "SELECT path, action, starts_with(action, 'delete') AND (SELECT count(*) FROM plan WHERE starts_with(action, 'delete')) > 5 AS held FROM plan",
    "listing_completeness": _PLAN
    + """, c AS (SELECT count(*) FILTER (b) AS baseline, count(*) FILTER (l) AS local_files, count(*) FILTER (r AND path < 'src12') AS remote_files FROM mixed)
         SELECT *, CASE WHEN baseline < 10 THEN NULL WHEN local_files < floor(baseline * 0.5) THEN 'local' WHEN remote_files < floor(baseline * 0.5) THEN 'remote' END AS incomplete FROM c""",
    "deletion_velocity": """WITH e AS (SELECT event_id, (user_id % 5)::VARCHAR AS key, ts FROM events WHERE event_type = 'error'),
         s AS (SELECT event_id, key, (count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))::BIGINT AS total FROM e) SELECT *, total > 3 AS tripped FROM s""",
    "action_summary": _PLAN + "SELECT action, count(*) AS n FROM plan GROUP BY action",
    "notification": _PLAN + _SUMMARY,
    "detection_profile": _PLAN + "SELECT count(*) FILTER (l AND NOT r) AS local_only, count(*) FILTER (r AND NOT l) AS remote_only, count(*) FILTER (l AND r) AS both, count(*) FILTER (NOT l AND NOT r) AS neither, 0::BIGINT AS enriched FROM mixed",
    "conflict_outcome": _PLAN
    + """SELECT path, CASE WHEN NOT l THEN 'kept_remote' WHEN NOT r THEN 'kept_local' WHEN l_mtime > 0 AND l_mtime > r_mtime THEN 'kept_local' WHEN l_mtime > 0 AND l_mtime < r_mtime THEN 'kept_remote'
         WHEN same THEN 'kept_local' ELSE 'duplicated' END AS outcome FROM plan WHERE action = 'conflict'""",
    "conflict_sibling_path": _PLAN + "SELECT path, replace(path, '.md', CASE WHEN doc_id % 9 = 0 THEN '.conflict-3.md' WHEN doc_id % 3 = 0 THEN '.conflict-2.md' ELSE '.conflict.md' END) AS duplicate_path FROM plan WHERE action = 'conflict'",
    "commit_baseline": _PLAN
    + """SELECT path, CASE WHEN l THEN l_hash ELSE '' END AS hash, CASE WHEN l THEN l_mtime ELSE 0 END AS local_mtime, CASE WHEN r THEN r_mtime ELSE 0 END AS remote_mtime, CASE WHEN l THEN l_size ELSE 0 END AS local_size,
              CASE WHEN r THEN r_size ELSE 0 END AS remote_size, CASE WHEN r THEN r_sum END AS checksum, 1800000000000 AS synced_at FROM plan WHERE action IN ('push', 'pull', 'match', 'conflict')
         UNION ALL SELECT path, b_hash, bl_mtime, br_mtime, b_size, b_size, b_sum, 1700000000000 FROM mixed WHERE b AND path NOT IN (SELECT path FROM plan)""",
    "execution_phases": _PLAN
    + """SELECT CASE action WHEN 'conflict' THEN 2 WHEN 'delete_local' THEN 4 WHEN 'delete_remote' THEN 4 ELSE 1 END::BIGINT AS phase,
              CASE action WHEN 'push' THEN 'upload' WHEN 'pull' THEN 'download' WHEN 'conflict' THEN 'conflict' WHEN 'delete_local' THEN 'local' WHEN 'delete_remote' THEN 'remote' ELSE 'state' END AS lane, action, count(*) AS n
         FROM plan GROUP BY action""",
    "retry_decisions": _RETRY,
    "history_cap": "SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 500",
    "debounce_sessions": _GAPS.format(apart=">=", plus="AS last"),
    "session_windows": _GAPS.format(apart=">", plus="+ 3600000000 AS fires_at"),
    "sliding_velocity": """WITH e AS (SELECT user_id::VARCHAR AS stream_key, epoch_us(ts) // 300000000 AS slot FROM events WHERE event_type = 'error')
         SELECT stream_key, (slot + i) * 300000000 AS until, count(*) AS n FROM e, range(1, 13) s(i) GROUP BY ALL""",
    "rename_chain_collapse": "SELECT user_id::VARCHAR AS stream_key, 'u' || user_id || '/' || count(*) AS new_path, 'u' || user_id || '/0' AS old_path FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "tracked_conflicts": f"WITH p AS ({_PATHS}) SELECT path FROM p WHERE doc_id % 5 = 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0)",
    "drive_entities": "SELECT source || '/' || doc_id AS path, doc_id % 10 = 0 AS is_directory, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS size, CASE WHEN doc_id % 10 > 0 AND doc_id % 3 = 0 THEN 1704164645678 ELSE 0 END AS mtime, CASE WHEN doc_id % 10 > 0 THEN md5(text) END AS checksum FROM documents",
    "dropbox_entities": "SELECT source || '/Doc-' || doc_id AS path, doc_id % 10 = 0 AS is_directory, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE n_chars END AS size, CASE WHEN doc_id % 10 > 0 THEN 1704164645000 ELSE 0 END AS mtime, CASE WHEN doc_id % 10 > 0 THEN md5(text) END AS checksum FROM documents WHERE doc_id % 4 <> 0",
}
