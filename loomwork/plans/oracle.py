"""The same queries as plain SQL over the benchmark tables, for an independent engine.

``SILVER`` derives artifacts and edges from the tables; each query adds what it needs.
"""

from __future__ import annotations

from loomwork.functions.files import CODE_EXTS, IGNORE_DIRS, IGNORE_EXTS, IMAGE_EXTS
from loomwork.functions.text import STOPWORDS


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _h(kind: str, source: str, key: str) -> str:
    return f"'{kind}:' || substr(sha256('{source}|{kind}|' || {key}), 1, 40)"


def _person(actor: str) -> str:
    email = f"lower(trim(regexp_extract({actor}, '<([^>]+)>', 1)))"
    return f"'person:' || substr(sha256('person|' || {email}), 1, 40)"


def _name(actor: str) -> str:
    return f"trim(split_part({actor}, '<', 1))"


# The token rule; long texts, so the pattern is applied once per text.
def _tokens(text: str) -> str:
    words = f"list_transform(regexp_extract_all({text}, '[a-zA-Z][a-zA-Z0-9_+#-]{{2,}}'), lambda w: lower(w))"
    return f"list_filter(list_distinct({words}), lambda w: NOT list_contains([{_list(STOPWORDS)}], w))"


SILVER = f"""
dev AS (
  SELECT c_custkey, c_mktsegment AS repo,
         CASE WHEN c_acctbal >= 0 THEN c_name || ' <cust' || c_custkey || '@example.com>' END AS actor
  FROM customer),
fpart AS (
  SELECT p_partkey, p_name, p_type, p_brand, p_size,
         p_partkey || (CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.png'
                       WHEN 3 THEN '.pdf' WHEN 4 THEN '.ipynb' ELSE '.bin' END) AS path,
         CASE p_size % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'text' WHEN 2 THEN 'image'
              WHEN 3 THEN 'pdf' WHEN 4 THEN 'notebook' ELSE 'binary' END AS modality
  FROM part),
head_line AS (
  SELECT l_orderkey, l_partkey FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1),
n_files AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS files_changed FROM lineitem GROUP BY l_orderkey),
commits AS MATERIALIZED (
  SELECT o.o_orderkey, d.repo, d.actor, CAST(o.o_orderkey AS VARCHAR) AS sha, o.o_orderdate AS created_at,
         o.o_orderpriority AS title,
         o.o_orderpriority || coalesce(chr(10) || p.p_name, '') AS message,
         coalesce(n.files_changed, 0) AS files_changed,
         {_h('commit', 'git', "d.repo || ':' || o.o_orderkey")} AS id
  FROM orders o JOIN dev d ON o.o_custkey = d.c_custkey
  LEFT JOIN head_line h ON h.l_orderkey = o.o_orderkey
  LEFT JOIN fpart p ON p.p_partkey = h.l_partkey
  LEFT JOIN n_files n ON n.l_orderkey = o.o_orderkey),
touch AS MATERIALIZED (
  SELECT DISTINCT c.repo, c.sha, c.id AS commit_id, c.created_at, f.path, f.p_partkey,
         {_h('file', 'git', "c.repo || ':' || f.path")} AS file_id
  FROM lineitem l JOIN commits c ON l.l_orderkey = c.o_orderkey JOIN fpart f ON l.l_partkey = f.p_partkey),
files AS MATERIALIZED (
  SELECT t.file_id AS id, t.repo, t.path, max(t.created_at) AS created_at, any_value(f.p_size) AS size,
         any_value(f.modality) AS modality, any_value(sha256(f.p_name)) AS content_hash,
         any_value(f.p_type || ' ' || f.p_brand) AS said
  FROM touch t JOIN fpart f USING (p_partkey) GROUP BY t.file_id, t.repo, t.path),
file_titles AS (
  SELECT file_id, list(title ORDER BY touched_at DESC, title) AS titles FROM (
    SELECT t.file_id, c.title, max(t.created_at) AS touched_at FROM touch t JOIN commits c ON c.id = t.commit_id GROUP BY 1, 2)
  GROUP BY file_id),
file_text AS (
  SELECT f.id, f.path || chr(10) || chr(10) || (CASE modality
           WHEN 'code' THEN f.said WHEN 'text' THEN f.said
           WHEN 'image' THEN '[image file png]'
           WHEN 'pdf' THEN '[pdf document, ' || size || ' bytes]'
           WHEN 'notebook' THEN '[ipynb document, ' || size || ' bytes]'
           ELSE '[binary file bin, ' || size || ' bytes]' END)
         || chr(10) || chr(10) || 'Commits that touched this file:' || chr(10) || '- '
         || array_to_string(t.titles, chr(10) || '- ') AS text
  FROM files f JOIN file_titles t ON t.file_id = f.id),
file_extra AS (
  SELECT id, CAST(json_object('path', path, 'size', size, 'modality', modality,
              'binary', modality IN ('image', 'pdf', 'binary')) AS VARCHAR) AS extra FROM files),
turns AS (
  SELECT conv_id, turn, role, CAST(conv_id AS VARCHAR) AS sid, d.repo, d.actor,
         trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts,
         {_h('ai_session', 'claude_code', 'conv_id')} AS session
  FROM conversations JOIN dev d ON conv_id = d.c_custkey),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n
  FROM turns WHERE role IN ('user', 'assistant') AND text <> ''),
span AS (
  SELECT conv_id, any_value(sid) AS sid, any_value(repo) AS repo, any_value(actor) AS actor,
         any_value(session) AS session, min(ts) AS created_at, max(ts) AS ended_at
  FROM turns GROUP BY conv_id),
messages AS (
  SELECT *, {_h('ai_message', 'claude_code', "sid || ':' || uuid")} AS id,
         CASE WHEN role = 'assistant' THEN 'assistant' ELSE actor END AS said_by
  FROM (SELECT *, CASE WHEN role = 'user' THEN 'u' || turn ELSE sid || ':' || n END AS uuid FROM kept)),
prompt AS (
  SELECT conv_id, text AS first_prompt FROM kept WHERE role = 'user'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) = 1),
sessions AS (
  SELECT s.*, p.first_prompt, coalesce(m.n_messages, 0) AS n_messages,
         coalesce(substr(p.first_prompt, 1, 120), 'session ' || substr(s.sid, 1, 8)) AS title
  FROM span s LEFT JOIN prompt p USING (conv_id)
  LEFT JOIN (SELECT conv_id, count(*) AS n_messages FROM kept GROUP BY conv_id) m USING (conv_id)),
artifacts AS MATERIALIZED (
  SELECT id, 'commit' AS kind, 'git' AS source, repo, actor, created_at, title, message AS text,
         CAST(NULL AS VARCHAR) AS object_uri, CAST(NULL AS VARCHAR) AS modality FROM commits
  UNION ALL
  SELECT id, 'file', 'git', repo, NULL, created_at, path, w.text, 's3://work/blobs/' || content_hash, modality
  FROM files JOIN file_text w USING (id)
  UNION ALL
  SELECT session, 'ai_session', 'claude_code', repo, actor, created_at, substr(title, 1, 200),
         title || coalesce(chr(10) || chr(10) || first_prompt, ''), NULL, NULL FROM sessions
  UNION ALL
  SELECT id, 'ai_message', 'claude_code', NULL, said_by, ts, substr(text, 1, 120), text, NULL, NULL
  FROM messages),
authored AS (
  SELECT {_person('actor')} AS src_id, id AS dst_id, created_at FROM commits WHERE actor IS NOT NULL
  UNION ALL
  SELECT {_person('actor')}, session, created_at FROM span WHERE actor IS NOT NULL),
pairs AS (
  SELECT a.file_id AS src_id, b.file_id AS dst_id, a.commit_id, a.created_at
  FROM touch a JOIN touch b ON a.commit_id = b.commit_id AND a.file_id < b.file_id
  WHERE a.commit_id IN (SELECT commit_id FROM touch GROUP BY commit_id HAVING count(*) <= 25)),
co_edited AS (
  SELECT src_id, dst_id, CAST(count(*) AS DOUBLE) AS weight, max(created_at) AS created_at
  FROM pairs GROUP BY src_id, dst_id),
ai_touched AS (
  SELECT t.session AS src_id, f.id AS dst_id, CAST(count(*) AS DOUBLE) AS weight, min(s.created_at) AS created_at
  FROM turns t JOIN span s ON s.conv_id = t.conv_id
  JOIN fpart p ON p.p_partkey = (t.conv_id * 31 + t.turn) % (SELECT count(*) FROM part)
  JOIN files f ON f.repo = t.repo AND f.path = p.path
  WHERE t.role = 'assistant' GROUP BY t.session, f.id),
edges AS MATERIALIZED (
  SELECT src_id, dst_id, 'authored' AS relation, CAST(1 AS DOUBLE) AS weight, created_at FROM authored
  UNION ALL SELECT commit_id, file_id, 'modified', 1, created_at FROM touch
  UNION ALL SELECT src_id, dst_id, 'co_edited', weight, created_at FROM co_edited
  UNION ALL SELECT id, session, 'message_of_session', 1, ts FROM messages
  UNION ALL SELECT src_id, dst_id, 'ai_touched_file', weight, created_at FROM ai_touched)"""


def topics_sql(art: str = "artifacts", edg: str = "edges") -> str:
    """CTEs of the topic rules over the named artifact and edge tables."""
    return f""",
tok AS MATERIALIZED (
  SELECT id, kind, actor, unnest({_tokens("coalesce(title, '') || ' ' || coalesce(text, '')")}) AS term
  FROM {art} WHERE kind IN ('commit', 'ai_message', 'ai_session')),
terms AS (
  SELECT term, count(*) AS df FROM tok GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 24),
hit AS MATERIALIZED (SELECT tok.* FROM tok JOIN terms USING (term)),
msg_session AS (
  SELECT h.term, e.dst_id AS sid FROM hit h JOIN {edg} e ON e.src_id = h.id AND e.relation = 'message_of_session'
  WHERE h.kind = 'ai_message'),
topic_sessions AS (
  SELECT term, id AS sid FROM hit WHERE kind = 'ai_session' UNION SELECT term, sid FROM msg_session),
topic_people AS (
  SELECT term, {_person('actor')} AS pid FROM hit WHERE kind = 'commit' AND actor IS NOT NULL
  UNION
  SELECT s.term, {_person('a.actor')} FROM topic_sessions s JOIN {art} a ON a.id = s.sid AND a.kind = 'ai_session'
  WHERE a.actor IS NOT NULL),
topic_files AS (
  SELECT DISTINCT h.term, e.dst_id AS fid FROM hit h JOIN {edg} e ON e.src_id = h.id AND e.relation = 'modified'
  WHERE h.kind = 'commit'),
members AS MATERIALIZED (
  SELECT term, 'person' AS member_kind, pid AS member FROM topic_people
  UNION ALL SELECT term, 'ai_session', sid FROM topic_sessions
  UNION ALL SELECT term, 'file', fid FROM topic_files),
about AS (
  SELECT 'topic:' || term AS source, member AS target, CAST(1 AS DOUBLE) AS weight FROM members WHERE member_kind <> 'file'
  UNION ALL SELECT 'topic:' || term, fid, 1 FROM topic_files),
names AS (
  SELECT pid, name FROM (
    SELECT {_person('actor')} AS pid, {_name('actor')} AS name, min(created_at) AS seen_at, actor
    FROM {art} WHERE kind IN ('commit', 'ai_session') AND actor IS NOT NULL GROUP BY actor)
  QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seen_at, actor) = 1),
authored_to AS MATERIALIZED (
  SELECT DISTINCT e.src_id AS pid, e.dst_id AS id, a.kind FROM {edg} e JOIN {art} a ON a.id = e.dst_id
  WHERE e.relation = 'authored' AND a.kind IN ('commit', 'ai_session'))"""


def graph_sql(art: str = "artifacts", edg: str = "edges") -> str:
    return topics_sql(art, edg) + f""",
g_nodes AS MATERIALIZED (
  SELECT pid AS id, coalesce(any_value(names.name), pid) AS label, 'person' AS kind, '' AS modality,
         count(*) AS artifact_count
  FROM authored_to LEFT JOIN names USING (pid) GROUP BY pid
  UNION ALL
  SELECT id, title, kind, coalesce(modality, ''), 1 FROM {art} WHERE kind IN ('file', 'ai_session')
  UNION ALL
  SELECT 'topic:' || term, term, 'topic', '', count(*)
  FROM hit WHERE term IN (SELECT term FROM members) GROUP BY term),
g_raw AS MATERIALIZED (
  SELECT {_person('a.actor')} AS source, e.dst_id AS target, 'modified' AS relation, CAST(count(*) AS DOUBLE) AS weight
  FROM {edg} e JOIN {art} a ON a.id = e.src_id AND a.kind = 'commit' AND a.actor IS NOT NULL
  WHERE e.relation = 'modified' GROUP BY 1, 2
  UNION ALL SELECT src_id, dst_id, 'co_edited', weight FROM {edg} WHERE relation = 'co_edited'
  UNION ALL SELECT pid, id, 'ran', 1 FROM authored_to WHERE kind = 'ai_session'
  UNION ALL SELECT src_id, dst_id, 'ai_touched', weight FROM {edg} WHERE relation = 'ai_touched_file'
  UNION ALL SELECT source, target, 'about', weight FROM about),
g_edges AS MATERIALIZED (
  SELECT * FROM g_raw WHERE source <> target
    AND source IN (SELECT id FROM g_nodes) AND target IN (SELECT id FROM g_nodes)),
g_degree AS (
  SELECT id, count(*) AS degree FROM
    (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY id),
g_overview AS (
  SELECT * FROM g_nodes WHERE kind <> 'file'
     OR id IN (SELECT target FROM g_edges WHERE relation = 'about')),
g_top AS (
  SELECT n.id, n.kind, n.label, coalesce(d.degree, 0) AS degree FROM g_overview n LEFT JOIN g_degree d USING (id)
  ORDER BY degree DESC, n.id LIMIT 220)"""


DAILY = """
gold_daily_activity AS (
  SELECT strftime(created_at, '%Y-%m-%d') AS day, source, kind, count(*) AS count FROM artifacts GROUP BY 1, 2, 3)"""

HOTSPOTS = """
gold_file_hotspots AS (
  SELECT f.id AS file_id, f.repo, f.path, f.modality, coalesce(m.n, 0) AS times_modified,
         coalesce(t.n, 0) AS ai_touches, coalesce(c.n, 0) AS coedit_degree
  FROM files f
  LEFT JOIN (SELECT file_id AS id, count(*) AS n FROM touch GROUP BY 1) m ON m.id = f.id
  LEFT JOIN (SELECT dst_id AS id, count(*) AS n FROM ai_touched GROUP BY 1) t ON t.id = f.id
  LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM co_edited UNION ALL SELECT dst_id FROM co_edited)
             GROUP BY 1) c ON c.id = f.id)"""

AUTHORS = f"""
gold_author_activity AS (
  SELECT a.src_id AS person_id, any_value(d.name) AS name,
         count(*) FILTER (WHERE a.dst_id LIKE 'commit:%') AS commits,
         count(*) FILTER (WHERE a.dst_id LIKE 'ai_session:%') AS ai_sessions,
         coalesce(any_value(f.n), 0) AS files_touched,
         strftime(min(a.created_at), '%Y-%m-%d') AS first_activity,
         strftime(max(a.created_at), '%Y-%m-%d') AS last_activity
  FROM authored a
  JOIN (SELECT {_person('actor')} AS pid, {_name('actor')} AS name FROM dev WHERE actor IS NOT NULL) d ON d.pid = a.src_id
  LEFT JOIN (SELECT {_person('c.actor')} AS pid, count(DISTINCT t.file_id) AS n
             FROM touch t JOIN commits c ON c.id = t.commit_id WHERE c.actor IS NOT NULL GROUP BY 1) f ON f.pid = a.src_id
  GROUP BY a.src_id)"""

TOPIC_SUMMARY = """
gold_topic_summary AS (
  SELECT h.term AS topic, h.n AS n_artifacts,
         coalesce(p.n, 0) AS n_people, coalesce(f.n, 0) AS n_files, coalesce(s.n, 0) AS n_sessions
  FROM (SELECT term, count(*) AS n FROM hit GROUP BY term) h
  LEFT JOIN (SELECT term, count(*) AS n FROM topic_people WHERE pid IN (SELECT pid FROM authored_to) GROUP BY 1) p USING (term)
  LEFT JOIN (SELECT term, count(*) AS n FROM topic_files GROUP BY 1) f USING (term)
  LEFT JOIN (SELECT term, count(*) AS n FROM topic_sessions GROUP BY 1) s USING (term)
  WHERE h.term IN (SELECT term FROM members))"""

CROSS_SILO = """
about_people AS (SELECT term, pid FROM topic_people WHERE pid IN (SELECT pid FROM authored_to)),
gold_cross_silo AS (
  SELECT person_a, na.name AS person_a_name, person_b, nb.name AS person_b_name, shared_topics, topics FROM (
    SELECT a.pid AS person_a, b.pid AS person_b, count(*) AS shared_topics,
           array_to_string(list_sort(list(a.term)), ', ') AS topics
    FROM about_people a JOIN about_people b ON a.term = b.term AND a.pid < b.pid GROUP BY 1, 2)
  JOIN names na ON na.pid = person_a JOIN names nb ON nb.pid = person_b)"""

TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"

# Cosine of two unit or other vectors, in double precision.
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _cosine(a: str, b: str) -> str:
    ab, aa, bb = (DOT.format(a=x, b=y) for x, y in ((a, b), (a, a), (b, b)))
    return f"({ab}) / (sqrt({aa}) * sqrt({bb}))"


VECTORS = f"""
docs AS (
  SELECT vec_id AS id, embedding, 'label_' || label AS kind, label, coalesce(source, '') AS source, coalesce(lang, '') AS repo,
         substr(regexp_extract(coalesce(text, ''), '^[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*'), 1, 300) AS title,
         coalesce(text, '') AS snippet
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
first_vec AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
questions AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
scored AS (SELECT docs.*, {_cosine('embedding', 'q')} AS raw FROM docs, first_vec),
scored_all AS (SELECT docs.*, query_id, {_cosine('embedding', 'q')} AS raw FROM docs, questions)"""
ROW_QUESTIONS = f"""
row_questions AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
scored_rows AS (SELECT docs.*, query_id, {_cosine('embedding', 'q')} AS raw FROM docs, row_questions)"""
RANK = "row_number() OVER ({part} ORDER BY round(raw, 6) DESC, id)"
SCORE = "round(greatest(raw, 0), 4)"

EVENT_CHANGES = """
  SELECT event_id, user_id, event_type FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
  WHERE prev IS DISTINCT FROM event_type"""

YEARS = """
years AS (
  SELECT strftime(created_at, '%Y') AS snapshot_id, count(*) AS added_records FROM commits GROUP BY 1),
snaps AS (
  SELECT snapshot_id, snapshot_id || '-12-31 00:00:00' AS committed_at, 'append' AS operation, added_records,
         CAST(sum(added_records) OVER (ORDER BY snapshot_id) AS BIGINT) AS total_records FROM years)"""


def _silver(body: str, *ctes: str) -> str:
    """A query over the silver CTEs and those given; topic and graph CTEs start with a comma."""
    extra = "".join(c if c.startswith(",") else "," + c for c in ctes)
    return f"WITH {SILVER}{extra}\n{body}"


def _scoped(repo: str) -> str:
    return f""",
own AS (SELECT * FROM artifacts WHERE repo = '{repo}' AND kind IN ('commit', 'file', 'ai_session')),
s_artifacts AS (
  SELECT * FROM own
  UNION ALL
  SELECT * FROM artifacts WHERE kind = 'ai_message' AND id IN (
    SELECT src_id FROM edges WHERE relation = 'message_of_session' AND dst_id IN (SELECT id FROM own))),
s_edges AS (
  SELECT * FROM edges
  WHERE (src_id LIKE 'person:%' OR src_id IN (SELECT id FROM s_artifacts))
    AND (dst_id LIKE 'person:%' OR dst_id IN (SELECT id FROM s_artifacts)))"""


EDGE4 = "source, target, relation, weight"


def sql() -> dict[str, str]:
    topics, graph = topics_sql(), graph_sql()
    image, code = _list(IMAGE_EXTS), _list(CODE_EXTS)
    ext = "lower(regexp_extract(path, '[^./][^/]*(\\.[^./]*)$', 1))"
    return {
        "file_filter": f"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, octet_length(encode(html)) AS size FROM pages),
e AS (SELECT *, {ext} AS ext,
       len(list_filter(string_split(path, '/')[:-2], lambda d: d IN ({_list(IGNORE_DIRS)}) OR starts_with(d, '.'))) > 0 AS ignored_dir FROM p)
SELECT page_id, path, ext, ignored_dir,
       NOT ignored_dir AND ext NOT IN ({_list(IGNORE_EXTS)}) AND size > 0 AS kept FROM e""",
        "commit_artifacts": _silver(f"""
SELECT id, 'commit' AS kind, 'git' AS source, repo, actor, {TS}, title, message AS text, sha AS content_hash,
       CAST(json_object('hexsha', sha, 'branch', 'main', 'files_changed', files_changed) AS VARCHAR) AS extra FROM commits"""),
        "commits_newest": _silver("""
SELECT repo, sha, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS authored_at FROM commits
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, sha) <= 100"""),
        "file_artifacts": _silver("""
SELECT f.id, f.repo, strftime(f.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, f.path AS title,
       w.text, f.content_hash, 's3://work/blobs/' || f.content_hash AS object_uri, x.extra
FROM files f JOIN file_extra x USING (id) JOIN file_text w USING (id)"""),
        "scan_kind": _silver(f"SELECT id, actor, title, {TS} FROM artifacts WHERE kind = 'ai_message'"),
        "scan_relation": _silver(f"SELECT src_id, dst_id, weight, {TS} FROM edges WHERE relation = 'ai_touched_file'"),
        "lookup_ids": _silver("SELECT id, kind, repo, title FROM artifacts WHERE id IN (SELECT dst_id FROM ai_touched)"),
        "transcript_records": """
SELECT CAST(conv_id AS VARCHAR) AS file, turn AS seq, role AS rtype, CAST(conv_id AS VARCHAR) AS session_id,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS ts,
       sha256(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13))) AS text_digest,
       CASE WHEN role = 'assistant' THEN '/x/' || turn || '.py' ELSE '' END AS paths
FROM conversations WHERE role <> 'system'""",
        "iso_times": """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL
       ELSE strftime(date_trunc('second', ts) - to_hours(CASE event_id % 4 WHEN 1 THEN 2 ELSE 0 END), '%Y-%m-%d %H:%M:%S') END AS parsed
FROM events""",
        "file_bytes": """
WITH b AS (SELECT doc_id, text, doc_id % 5 = 0 AS nul, octet_length(encode(text)) + CAST(doc_id % 5 = 0 AS INTEGER) AS size FROM documents)
SELECT doc_id, CASE WHEN nul THEN 'binary' ELSE 'text' END AS modality, size,
       sha256(CASE WHEN nul THEN '[binary file txt, ' || size || ' bytes]'
                   ELSE coalesce(nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), ''), '') END) AS text_digest FROM b""",
        "json_values": """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
        "blob_resolve": _silver("""
SELECT a.id, a.object_uri, b.size FROM artifacts a
JOIN (SELECT DISTINCT 's3://work/blobs/' || sha256(p_name) AS object_uri, octet_length(encode(p_name)) AS size FROM part) b
  ON a.object_uri = b.object_uri"""),
        "incremental_append": _silver(f"SELECT id, repo, {TS} FROM commits WHERE created_at >= TIMESTAMP '1998-01-01'"),
        "edges_upsert": _silver("""
SELECT c.src_id, c.dst_id, 'co_edited' AS relation, coalesce(l.weight, c.weight) AS weight
FROM co_edited c LEFT JOIN (
  SELECT src_id, dst_id, CAST(count(*) AS DOUBLE) AS weight FROM pairs
  WHERE created_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2) l ON l.src_id = c.src_id AND l.dst_id = c.dst_id"""),
        "content_addressed_blobs": """
SELECT sha256(text) AS content_hash, 's3://work/blobs/' || sha256(text) AS object_uri,
       coalesce(min(source || '/doc%20' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt') FILTER (WHERE source = 'src0'),
                min(source || '/doc%20' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt')) AS filename,
       octet_length(encode(any_value(text))) AS size
FROM documents GROUP BY sha256(text)""",
        "partition_counts": _silver("SELECT strftime(created_at, '%Y-%m') AS created_month, count(*) AS n FROM artifacts GROUP BY 1"),
        "ids_artifact": _silver("SELECT o_orderkey, id FROM commits"),
        "ids_person": """
SELECT c_custkey, 'cust' || c_custkey || '@example.com' AS actor_key,
       'person:' || substr(sha256('person|cust' || c_custkey || '@example.com'), 1, 40) AS person_id FROM customer""",
        "person_names": _silver(f"""
SELECT DISTINCT {_person('actor')} AS person, {_name('actor')} AS name FROM commits WHERE actor IS NOT NULL"""),
        "tokens": f"""
WITH t AS (SELECT doc_id, list_sort({_tokens('text')}) AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS token_digest FROM t""",
        "noise_filter": "SELECT conv_id, turn, role = 'system' AS is_noise FROM conversations",
        "modality_of": f"""
WITH x AS (
  SELECT p_partkey, path, p_size % 6 = 5 AS opaque, {ext} AS ext FROM (
    SELECT *, p_partkey || (CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.png'
              WHEN 3 THEN '.pdf' WHEN 4 THEN '.ipynb' ELSE '.bin' END) AS path FROM part))
SELECT p_partkey, path, ext, CASE WHEN ext IN ({image}) THEN 'image' WHEN ext IN ('.pdf', '.docx', '.pptx') THEN substr(ext, 2)
       WHEN ext = '.ipynb' THEN 'notebook' WHEN opaque THEN 'binary' WHEN ext IN ({code}) THEN 'code' ELSE 'text' END AS modality FROM x""",
        "stubs": f"""
WITH x AS (
  SELECT p_partkey, p_size, ltrim({ext}, '.') AS e FROM (
    SELECT *, p_partkey || (CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.png'
              WHEN 3 THEN '.pdf' WHEN 4 THEN '.ipynb' ELSE '.bin' END) AS path FROM part))
SELECT p_partkey, '[binary file ' || e || ', ' || p_size || ' bytes]' AS binary_stub,
       '[image file ' || e || ']' AS image_stub, '[' || e || ' document, ' || p_size || ' bytes]' AS document_stub FROM x""",
        "artifact_detail": _silver("""
SELECT id, kind, source, repo, actor, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, title,
       object_uri IS NOT NULL AS has_blob,
       CASE WHEN object_uri IS NOT NULL THEN '/artifact/' || id || '/raw' END AS raw_url FROM artifacts"""),
        "edges_authored": _silver(f"SELECT src_id, dst_id, relation, weight, {TS} FROM edges WHERE relation = 'authored'"),
        "edges_modified": _silver(f"SELECT commit_id AS src_id, file_id AS dst_id, {TS} FROM touch"),
        "edges_co_edited": _silver(f"SELECT src_id, dst_id, weight, {TS} FROM co_edited"),
        "edges_co_edited_kept": _silver(f"SELECT src_id, dst_id, weight, {TS} FROM co_edited"),
        "coedit_skipped": _silver("""
SELECT m.max_files, (SELECT count(*) FROM (SELECT commit_id FROM touch GROUP BY 1 HAVING count(*) > m.max_files)) AS skipped
FROM (SELECT unnest([25, 7]) AS max_files) m"""),
        "file_last_touch": _silver("SELECT repo, path, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS last_touch FROM files"),
        "file_commit_titles": _silver("SELECT file_id, array_to_string(titles, '|') AS titles FROM file_titles"),
        "session_header": _silver("""
SELECT session, sid AS session_id, '/work/' || repo AS cwd, 'main' AS branch, CAST(NULL AS VARCHAR) AS ai_title,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at FROM span"""),
        "session_messages": _silver("""
SELECT id, said_by AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, substr(text, 1, 120) AS title,
       text,
       CAST(json_object('session_id', sid, 'role', role, 'uuid', uuid) AS VARCHAR) AS extra, session FROM messages"""),
        "edges_message_of": _silver(f"SELECT src_id, dst_id, relation, {TS} FROM edges WHERE relation = 'message_of_session'"),
        "first_prompt": _silver("SELECT CAST(conv_id AS VARCHAR) AS session_id, first_prompt FROM prompt"),
        "session_artifacts": _silver(f"""
SELECT session AS id, repo, actor, {TS}, substr(title, 1, 200) AS title,
       title || coalesce(chr(10) || chr(10) || first_prompt, '') AS text,
       CAST(json_object('session_id', sid, 'cwd', '/work/' || repo, 'branch', 'main', 'messages', n_messages,
            'ended_at', strftime(ended_at, '%Y-%m-%dT%H:%M:%S+00:00'), 'source_file', sid) AS VARCHAR) AS extra FROM sessions"""),
        "edges_ai_touched": _silver(f"SELECT src_id, dst_id, weight, {TS} FROM ai_touched"),
        "graph_person_file": _silver(f"""
SELECT {_person('c.actor')} AS source, t.file_id AS target, CAST(count(*) AS DOUBLE) AS weight
FROM touch t JOIN commits c ON c.id = t.commit_id WHERE c.actor IS NOT NULL GROUP BY 1, 2"""),
        "graph_ran": _silver("""
SELECT src_id AS source, dst_id AS target, CAST(1 AS DOUBLE) AS weight FROM authored WHERE dst_id LIKE 'ai_session:%'"""),
        "topic_terms": _silver("SELECT term, df, row_number() OVER (ORDER BY df DESC, term) - 1 AS bit FROM terms", topics),
        "topic_members": _silver("SELECT term AS topic, member_kind, member FROM members", topics),
        "graph_nodes": _silver("SELECT id, label, kind, modality, artifact_count FROM g_nodes", graph),
        "graph_members": _silver("""
SELECT pid AS node, id AS artifact FROM authored_to
UNION ALL SELECT id, id FROM artifacts WHERE kind IN ('file', 'ai_session')
UNION ALL SELECT 'topic:' || term, id FROM hit WHERE term IN (SELECT term FROM members)""", topics),
        "graph_about": _silver("SELECT source, target, weight FROM about", topics),
        "graph_edges": _silver(f"SELECT {EDGE4} FROM g_edges", graph),
        "graph_repo_scope": _silver(
            f"SELECT {EDGE4} FROM g_edges", _scoped("BUILDING"), graph_sql("s_artifacts", "s_edges")
        ),
        "graph_focus": _silver(f"""
SELECT {EDGE4} FROM g_edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)""", graph, """
near AS (
  SELECT 'topic:red' AS id UNION SELECT target FROM g_edges WHERE source = 'topic:red'
  UNION SELECT source FROM g_edges WHERE target = 'topic:red')"""),
        "graph_topn": _silver("SELECT id, kind, label, degree FROM g_top", graph),
        "graph_overview": _silver("SELECT id, kind, label, artifact_count FROM g_overview", graph),
        "graph_kinds": _silver(f"""
SELECT {EDGE4} FROM g_edges
WHERE source IN (SELECT id FROM g_top WHERE kind IN ('person', 'topic'))
  AND target IN (SELECT id FROM g_top WHERE kind IN ('person', 'topic'))""", graph),
        "node_artifacts": _silver("""
SELECT id, kind, title FROM artifacts WHERE id IN (SELECT id FROM hit WHERE term = 'red')""", topics),
        "gold_daily_activity": _silver("SELECT * FROM gold_daily_activity", DAILY),
        "gold_file_hotspots": _silver("SELECT * FROM gold_file_hotspots", HOTSPOTS),
        "gold_author_activity": _silver("SELECT * FROM gold_author_activity", AUTHORS),
        "hotspots_kept": _silver("SELECT * FROM gold_file_hotspots", HOTSPOTS),
        "author_activity_kept": _silver("SELECT * FROM gold_author_activity", AUTHORS),
        "gold_topic_summary": _silver("SELECT * FROM gold_topic_summary", topics, TOPIC_SUMMARY),
        "gold_cross_silo": _silver("SELECT * FROM gold_cross_silo", topics, CROSS_SILO),
        "cross_silo_partners": _silver("""
SELECT person_b AS person, person_b_name AS name, shared_topics, topics FROM gold_cross_silo
WHERE person_a = (SELECT min(pid) FROM about_people)""", topics, CROSS_SILO),
        "mart_row_counts": _silver("""
SELECT 'artifacts' AS asset, count(*) AS rows FROM artifacts
UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'gold_daily_activity', count(*) FROM gold_daily_activity
UNION ALL SELECT 'gold_file_hotspots', count(*) FROM gold_file_hotspots
UNION ALL SELECT 'gold_author_activity', count(*) FROM gold_author_activity
UNION ALL SELECT 'gold_topic_summary', count(*) FROM gold_topic_summary
UNION ALL SELECT 'gold_cross_silo', count(*) FROM gold_cross_silo""", topics, DAILY, HOTSPOTS, AUTHORS, TOPIC_SUMMARY, CROSS_SILO),
        "an_totals": _silver("SELECT kind, count(*) AS n FROM artifacts GROUP BY kind"),
        "an_edges_total": _silver("SELECT count(*) AS n FROM edges"),
        "an_top_authors": _silver("""
SELECT name, commits, ai_sessions, files_touched FROM gold_author_activity
ORDER BY commits + files_touched + ai_sessions DESC, person_id LIMIT 10""", AUTHORS),
        "an_top_topics": _silver("""
SELECT topic, n_artifacts, n_people, n_sessions FROM gold_topic_summary ORDER BY n_artifacts DESC, topic LIMIT 12""",
            topics, TOPIC_SUMMARY),
        "an_daily": _silver("SELECT day, CAST(sum(count) AS BIGINT) AS n FROM gold_daily_activity GROUP BY day", DAILY),
        "an_cross_silo": _silver("""
SELECT person_a_name, person_b_name, shared_topics, topics FROM gold_cross_silo
ORDER BY shared_topics DESC, person_a, person_b LIMIT 12""", topics, CROSS_SILO),
        "an_hotspots": _silver("""
SELECT path, modality, times_modified, ai_touches FROM gold_file_hotspots
ORDER BY ai_touches DESC, times_modified DESC, file_id LIMIT 12""", HOTSPOTS),
        "an_modality_mix": _silver("SELECT modality, count(*) AS n FROM gold_file_hotspots GROUP BY modality", HOTSPOTS),
        "an_authors_by_commits": _silver("SELECT name, commits, files_touched, ai_sessions FROM gold_author_activity", AUTHORS),
        "counts": _silver("""
SELECT 'artifacts_total' AS metric, count(*) AS value FROM artifacts
UNION ALL SELECT 'artifacts_' || kind, count(*) FROM artifacts GROUP BY kind
UNION ALL SELECT 'edges_total', count(*) FROM edges"""),
        "counts_repo": _silver("""
SELECT 'artifacts_total' AS metric, count(*) AS value FROM artifacts WHERE repo = 'BUILDING'
UNION ALL SELECT 'artifacts_' || kind, count(*) FROM artifacts WHERE repo = 'BUILDING' GROUP BY kind"""),
        "repos": _silver("""
SELECT repo, count(*) FILTER (WHERE kind = 'commit') AS commits, count(*) FILTER (WHERE kind = 'file') AS files,
       count(*) FILTER (WHERE kind = 'ai_session') AS ai_sessions
FROM artifacts WHERE repo IS NOT NULL GROUP BY repo HAVING count(*) FILTER (WHERE kind IN ('commit', 'file')) > 0"""),
        "relation_counts": _silver("SELECT relation, count(*) AS n FROM edges GROUP BY relation"),
        "console_page": _silver("SELECT day, kind, count AS n FROM gold_daily_activity ORDER BY n DESC, day, kind LIMIT 500", DAILY),
        "console_kinds": _silver("SELECT kind, count(*) AS n FROM artifacts GROUP BY kind"),
        "console_join_inner": _silver("""
SELECT a.repo, e.relation, count(*) AS n, sum(e.weight) AS weight
FROM edges e JOIN artifacts a ON e.dst_id = a.id GROUP BY a.repo, e.relation"""),
        "console_join_left": _silver("""
SELECT a.repo, count(*) AS n_rows, count(e.dst_id) AS n_files
FROM artifacts a LEFT JOIN edges e ON e.src_id = a.id AND e.relation = 'modified' WHERE a.kind = 'commit' GROUP BY a.repo"""),
        "console_join_full": _silver("""
SELECT coalesce(c.day, s.day) AS day, coalesce(c.count, 0) AS commits, coalesce(s.count, 0) AS messages
FROM (SELECT * FROM gold_daily_activity WHERE kind = 'commit') c
FULL OUTER JOIN (SELECT * FROM gold_daily_activity WHERE kind = 'ai_message') s ON c.day = s.day""", DAILY),
        "console_semi_anti": _silver("""
SELECT repo, count(*) AS n FROM artifacts WHERE kind = 'file' AND id IN (SELECT file_id FROM touch)
  AND id NOT IN (SELECT dst_id FROM ai_touched) GROUP BY repo"""),
        "console_theta": _silver("""
SELECT a.person, strftime(a.d, '%Y-%m-%d') AS day, CAST(sum(b.n) AS BIGINT) AS n
FROM act a JOIN act b ON a.person = b.person AND b.d BETWEEN a.d AND a.d + 1 GROUP BY 1, 2""", """
act AS (SELECT src_id AS person, CAST(created_at AS DATE) AS d, count(*) AS n FROM authored GROUP BY 1, 2)"""),
        "range_join": """
SELECT a.user_id, a.event_id AS purchase, b.event_id, b.event_type FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'purchase'""",
        "dq_quarantine": _silver("""
SELECT reason, count(*) AS rows FROM (
  SELECT concat_ws('; ', CASE WHEN role = 'system' THEN 'no id' END,
                   CASE WHEN turn <> 0 AND role NOT IN ('file', 'commit', 'ai_session', 'ai_message') THEN 'kind ' || role END,
                   CASE WHEN turn = 1 THEN 'no time' END) AS reason FROM conversations)
WHERE reason <> '' GROUP BY 1
UNION ALL
SELECT '', (SELECT count(DISTINCT concat_ws(':', conv_id, turn)) FROM conversations WHERE turn = 0 AND role <> 'system')
           + (SELECT count(*) FROM artifacts WHERE kind = 'commit')"""),
        "run_metrics": _silver("""
SELECT b AS batch_id, 'artifacts' AS asset, m AS metric,
       count(*) FILTER (WHERE (m = 'rows' OR m = 'kind:' || kind) AND (kind = 'file') = (b = 'all')) AS value
FROM artifacts, (SELECT unnest(['some', 'all']) AS b), (SELECT unnest(['rows', 'kind:file', 'kind:commit', 'kind:ai_session', 'kind:ai_message']) AS m)
GROUP BY b, m
UNION ALL
SELECT b, 'edges', m, count(*) FILTER (WHERE (m = 'rows' OR m = 'relation:' || relation) AND b = 'all')
FROM edges, (SELECT unnest(['some', 'all']) AS b),
  (SELECT unnest(['rows', 'relation:authored', 'relation:modified', 'relation:co_edited', 'relation:ai_touched_file', 'relation:message_of_session']) AS m)
GROUP BY b, m"""),
        "console_asof": _silver("""
SELECT s.src_id AS person, s.dst_id AS session,
       (SELECT arg_max(c.dst_id, (c.created_at, c.dst_id)) FROM authored c
        WHERE c.src_id = s.src_id AND c.dst_id LIKE 'commit:%' AND c.created_at <= s.created_at) AS last_commit
FROM authored s WHERE s.dst_id LIKE 'ai_session:%'"""),
        "console_rollup": _silver("""
SELECT repo, kind, CAST(grouping(repo) AS INTEGER) AS g_repo, CAST(grouping(kind) AS INTEGER) AS g_kind, count(*) AS n
FROM artifacts GROUP BY ROLLUP (repo, kind)"""),
        "console_cube": _silver("""
SELECT source, kind, CAST(grouping(source) AS INTEGER) AS g_source, CAST(grouping(kind) AS INTEGER) AS g_kind, count(*) AS n
FROM artifacts GROUP BY CUBE (source, kind)"""),
        "console_sets": _silver("""
SELECT repo, kind, source, CAST(grouping(repo) AS INTEGER) AS g_repo, CAST(grouping(kind) AS INTEGER) AS g_kind,
       CAST(grouping(source) AS INTEGER) AS g_source, count(*) AS n
FROM artifacts GROUP BY GROUPING SETS ((repo, source), (kind), ())"""),
        "console_distinct_aggs": _silver("""
SELECT repo, count(DISTINCT actor) AS actors, count(DISTINCT actor) FILTER (WHERE kind = 'commit') AS authors,
       count(*) FILTER (WHERE kind = 'commit') AS commits FROM artifacts GROUP BY repo"""),
        "console_window_rank": _silver("""
SELECT file_id, repo, times_modified, rank() OVER (PARTITION BY repo ORDER BY times_modified DESC) AS rnk,
       dense_rank() OVER (PARTITION BY repo ORDER BY times_modified DESC) AS dense FROM gold_file_hotspots""", HOTSPOTS),
        "console_window_topn": _silver("""
SELECT repo, file_id, times_modified, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY times_modified DESC, file_id) AS rn FROM gold_file_hotspots)
WHERE rn <= 10""", HOTSPOTS),
        "console_window_frame": _silver("""
SELECT day, n, CAST(sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n7,
       n - lag(n, 1, 0) OVER (ORDER BY day) AS change
FROM (SELECT day, CAST(sum(count) AS BIGINT) AS n FROM gold_daily_activity GROUP BY day)""", DAILY),
        "console_setops": _silver("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM ca INTERSECT SELECT * FROM sa)
UNION ALL SELECT 'commits_only', count(*) FROM (SELECT * FROM ca EXCEPT SELECT * FROM sa)
UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM ca UNION SELECT * FROM sa)""", """
ca AS (SELECT src_id FROM authored WHERE dst_id LIKE 'commit:%'),
sa AS (SELECT src_id FROM authored WHERE dst_id LIKE 'ai_session:%')"""),
        "console_subquery": _silver("""
SELECT repo, id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM commits
QUALIFY created_at = max(created_at) OVER (PARTITION BY repo)"""),
        "embed_todo": _silver("""
SELECT id, coalesce(nullif(text, ''), title, '') AS said FROM artifacts WHERE kind <> 'ai_session'"""),
        "embed_vectors": """
SELECT doc_id, CAST(384 AS BIGINT) AS dim,
       CASE WHEN len(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9_+#-]{2,}')) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM documents""",
        "vector_topk": f"""WITH {VECTORS}
SELECT rank, id, score, kind, source, title, snippet FROM (
  SELECT *, {RANK.format(part='')} AS rank, {SCORE} AS score FROM scored) WHERE rank <= 10""",
        "vector_topk_filtered": f"""WITH {VECTORS}
SELECT rank, id, score, kind, repo FROM (
  SELECT *, {RANK.format(part='')} AS rank, {SCORE} AS score FROM scored WHERE kind = 'label_3' AND repo = 'en') WHERE rank <= 10""",
        "vector_topk_batch": f"""WITH {VECTORS}
SELECT query_id, rank, id, score FROM (
  SELECT *, {RANK.format(part='PARTITION BY query_id')} AS rank, {SCORE} AS score FROM scored_all) WHERE rank <= 10""",
        "rag_context": f"""WITH {VECTORS}
SELECT query_id, count(*) AS n_hits,
       string_agg('[' || rank || '] id=' || id || ' kind=' || kind || ' source=' || source || chr(10) || '    title: ' || title
                  || chr(10) || '    text: ' || snippet, chr(10) || chr(10) ORDER BY rank) AS context
FROM (SELECT *, {RANK.format(part='PARTITION BY query_id')} AS rank FROM scored_all) WHERE rank <= 6 GROUP BY query_id""",
        "vector_topk_rows": f"""WITH {VECTORS}, {ROW_QUESTIONS}
SELECT query_id, rank, id, score FROM (
  SELECT *, {RANK.format(part='PARTITION BY query_id')} AS rank, {SCORE} AS score FROM scored_rows) WHERE rank <= 10""",
        "vector_index_exact": f"""WITH {VECTORS}, {ROW_QUESTIONS}
SELECT query_id, rank, id, score FROM (
  SELECT *, {RANK.format(part='PARTITION BY query_id')} AS rank, {SCORE} AS score FROM scored_rows) WHERE rank <= 10""",
        "vector_index_hits": """
SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings)) AS hits, TRUE AS "right", TRUE AS falling FROM embeddings WHERE vec_id % 50 = 0""",
        "vector_index_recall": """
SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, count(*) FILTER (WHERE vec_id % 50 = 0) * least(10, count(*)) AS hits,
       TRUE AS recall_90, TRUE AS lists_skipped FROM embeddings""",
        "rag_context_rows": f"""WITH {VECTORS}, {ROW_QUESTIONS}
SELECT query_id, count(*) AS n_hits,
       string_agg('[' || rank || '] id=' || id || ' kind=' || kind || ' source=' || source || chr(10) || '    title: ' || title
                  || chr(10) || '    text: ' || snippet, chr(10) || chr(10) ORDER BY rank) AS context
FROM (SELECT *, {RANK.format(part='PARTITION BY query_id')} AS rank FROM scored_rows) WHERE rank <= 6 GROUP BY query_id""",
        "dq_embedding_coverage": """
SELECT (SELECT count(*) FROM documents) AS artifacts, (SELECT count(*) FROM embeddings) AS embedded,
       (SELECT count(*) FROM embeddings) >= (SELECT count(*) FROM documents) AS passed""",
        "dq_enums": """
SELECT 'kind' AS field, role AS value, count(*) AS rows FROM conversations GROUP BY role
UNION ALL SELECT 'relation', event_type, count(*) FROM events GROUP BY event_type""",
        "dq_artifacts": _silver("""
SELECT (SELECT count(*) FROM conversations WHERE role = 'system') AS null_ids,
       (SELECT count(*) FROM conversations) AS bad_kinds,
       (SELECT count(*) FROM artifacts) + (SELECT count(*) FROM conversations) AS rows"""),
        "dq_dangling_edges": _silver("""
SELECT 'all' AS scope, count(*) FILTER (WHERE NOT (s AND d)) AS dangling_edges, count(*) AS edges FROM (
  SELECT src_id LIKE 'person:%' OR src_id IN (SELECT id FROM artifacts) AS s, dst_id IN (SELECT id FROM artifacts) AS d FROM edges)
UNION ALL
SELECT 'no_files', count(*) FILTER (WHERE relation IN ('modified', 'co_edited', 'ai_touched_file')), count(*) FROM edges"""),
        "snapshot_history": _silver("SELECT * FROM snaps", YEARS),
        "snapshot_recent": _silver("SELECT * FROM snaps ORDER BY snapshot_id DESC LIMIT 4", YEARS),
        "as_of": _silver("""
SELECT repo, count(*) AS n FROM commits WHERE year(created_at) <= 1995 GROUP BY repo"""),
        "cdc_changes": EVENT_CHANGES,
        "stream_cdc": EVENT_CHANGES,
        "stream_dedup": f"""
SELECT {_h('file', 'git', "'events:' || user_id || '.json'")} AS id, 'events' AS repo, user_id || '.json' AS title,
       strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS created_at
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
        "stream_daily": """
SELECT strftime(ts, '%Y-%m-%d') AS day, 'git' AS source, event_type AS kind, count(*) AS count FROM events GROUP BY 1, 2, 3""",
    }
