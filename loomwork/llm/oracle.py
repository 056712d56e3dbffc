"""SQL counterparts of the queries that SQL can express on whole small tables."""

from __future__ import annotations

from loomwork.llm import secrets

LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(ids: str, links: str) -> str:
    """CTE ``least``: for each id of ``ids`` the smallest one reachable over ``links`` (a, b)."""
    return f"""
reach AS (
  SELECT id AS v, id AS c FROM {ids}
  UNION
  SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.v),
least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v)"""


OP1 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id AS id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_components('u', 'links')}
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(l.component_id, v.vec_id) AS component_id,
       coalesce(l.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN least l ON l.v = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id"""

OP2_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
WITH item AS (SELECT item_id, {OP2_WORDS.format(t=LOWER.format(t='text'))} AS w FROM benchmark WHERE text IS NOT NULL),
shape AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
window_ AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS said
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM shape)),
doc AS (SELECT doc_id, coalesce({OP2_WORDS.format(t=LOWER.format(t='text'))}, []) AS w FROM documents),
spot AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM window_))),
found AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM spot s JOIN window_ x ON x.n = s.n AND x.said = s.said),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)"""


def _rule_sql(order: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS kind_no, '{rule.kind}' AS kind, pos AS first_at, pos + length(m[i]) AS last_at FROM (
  SELECT doc_id, m, v, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v,
           string_split_regex(t, '{pattern}') AS g FROM doc WHERE regexp_matches(t, '{pattern}'))))
WHERE length(v[i]) >= {rule.least}"""


def _op3() -> str:
    spans = "\nUNION ALL".join(_rule_sql(i, r) for i, r in enumerate(secrets.RULES))
    base = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind_no = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    shown = "kind || ':' || first_at || ':' || last_at"
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
span AS ({spans}),
told AS (
  SELECT doc_id, {counts},
         string_agg({shown}, ',' ORDER BY first_at, kind_no) FILTER (WHERE kind_no < {base}) AS base,
         string_agg({shown}, ',' ORDER BY first_at, kind_no) AS spans
  FROM span GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN told USING (doc_id)"""


OP7 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id AS id, coalesce(regexp_extract_all({LOWER.format(t='text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
word AS (SELECT id, len(w) AS words, unnest(w) AS said, generate_subscripts(w, 1) AS i FROM doc),
gram AS (
  SELECT DISTINCT id, concat_ws(' ', said, lead(said, 1) OVER o, lead(said, 2) OVER o, lead(said, 3) OVER o, lead(said, 4) OVER o) AS said
  FROM word WINDOW o AS (PARTITION BY id ORDER BY i) QUALIFY i <= greatest(words - 4, 1)),
sets AS MATERIALIZED (SELECT doc.id, coalesce(n, 0) AS n FROM doc LEFT JOIN (SELECT id, count(*) AS n FROM gram GROUP BY id) g USING (id)),
one AS MATERIALIZED (SELECT gram.id, n, hash(said) AS said FROM gram JOIN sets USING (id) QUALIFY count(*) OVER (PARTITION BY said) > 1),
pairs AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS common
    FROM one p JOIN one q ON p.said = q.said AND p.id < q.id AND 100 * p.n >= 85 * q.n AND 100 * q.n >= 85 * p.n
    GROUP BY p.id, q.id)
  WHERE 100 * common >= 85 * (na + nb - common)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
{_components('sets', 'links')}
SELECT s.id AS doc_id, s.n AS n_shingles, l.component_id, l.component_id = s.id AS kept
FROM sets s JOIN least l ON l.v = s.id"""


OP8 = """
WITH doc AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p - 1, 100) AS said FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS p FROM doc)),
repeated AS MATERIALIZED (SELECT said, min(doc_id) AS first_id FROM win GROUP BY said HAVING min(doc_id) <> max(doc_id)),
covered AS (SELECT w.doc_id, w.p FROM win w JOIN repeated r USING (said) WHERE r.first_id < w.doc_id),
marked AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, 0) AS opens FROM covered),
run AS (
  SELECT doc_id, min(p) AS first_at, max(p) + 49 AS last_at
  FROM (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM marked) GROUP BY doc_id, no),
gap AS (SELECT *, coalesce(lag(last_at) OVER (PARTITION BY doc_id ORDER BY first_at), 0) AS from_at FROM run),
told AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(last_at - first_at + 1) AS n_removed, max(last_at) AS end_at,
         string_agg(substr(h, 2 * from_at + 1, 2 * (first_at - 1 - from_at)), '' ORDER BY first_at) AS head
  FROM gap g JOIN doc USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(end_at, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN told USING (doc_id)"""


def _crc_step(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of the UTF-8 bytes of a text."""
    table = ", ".join(str(_crc_step(b)) for b in range(256))
    hexed = f"hex(encode({text}))"
    data = f"list_transform(range(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, i, 2) AS BIGINT))"
    step = f"xor(c >> 8, ([{table}])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: {step}), 4294967295)"


_WRITTEN = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_WRITTEN.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs ``name`` (tree, level, place, digest, size) and ``name_sibs``: siblings of each node by its place."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, place, digest, count(*) OVER (PARTITION BY tree) AS size FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 7) // 8
  FROM {name} WHERE size > 1 GROUP BY tree, level, place // 8),
{name}_sibs AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8
  WHERE a.size > 1 GROUP BY a.tree, a.level, a.place)"""


OP11 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS digest,
         CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(LOWER.format(t='text'))} ELSE {_leaf('text')} END AS shown FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest, shown) - 1 AS place FROM doc),
{_tree('node', 'leaf')},
subroot AS (SELECT tree AS name, digest, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place FROM node WHERE size = 1),
{_tree('high', 'subroot')},
step AS (
  SELECT l.doc_id, l.tree, l.place AS leaf_no, s.level, s.before, s.after
  FROM leaf l JOIN node_sibs s ON s.tree = l.tree AND s.place = l.place // CAST(pow(8, s.level) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.tree, l.place, 100 + s.level, s.before, s.after
  FROM leaf l JOIN subroot r ON r.name = l.tree JOIN high_sibs s ON s.place = r.place // CAST(pow(8, s.level) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_no ORDER BY level) AS turn FROM step),
fold AS (
  SELECT tree, place AS leaf_no, 0 AS turn, shown AS digest FROM leaf
  UNION ALL
  SELECT f.tree, f.leaf_no, p.turn, sha256(p.before || f.digest || p.after)
  FROM fold f JOIN path p ON p.tree = f.tree AND p.leaf_no = f.leaf_no AND p.turn = f.turn + 1),
folded AS (SELECT tree, leaf_no, arg_max(digest, turn) AS digest FROM fold GROUP BY tree, leaf_no),
proof AS (SELECT tree, leaf_no, sha256(string_agg(before || after, '' ORDER BY turn)) AS proof FROM path GROUP BY tree, leaf_no)
SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, h.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = h.digest AS verified
FROM leaf l JOIN subroot r ON r.name = l.tree JOIN high h ON h.size = 1
  JOIN folded f ON f.tree = l.tree AND f.leaf_no = l.place LEFT JOIN proof p ON p.tree = l.tree AND p.leaf_no = l.place"""


OP12_RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
OP12 = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, {LOWER.format(t=f"unnest(regexp_extract_all(text, '{OP12_RUN}'))")} AS r FROM documents),
drawn AS (
  SELECT r, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h
  FROM (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY doc_id, r)),
said AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM drawn),
vocab AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
fewer AS (SELECT DISTINCT c.word, c.n, v.word AS less, v.n AS less_n FROM cut c JOIN vocab v ON v.word = c.less),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word, less, less_n FROM fewer
  UNION ALL SELECT less, word, n FROM fewer),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
told AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word),
way AS (
  SELECT word, word AS root, 0 AS steps FROM told
  UNION ALL SELECT w.word, t.form, w.steps + 1 FROM way w JOIN told t ON t.word = w.root WHERE t.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM way GROUP BY word)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN ends ON ends.word = told.word"""


def sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": OP1, "op2_decontamination": OP2, "op3_secret_scan": _op3(), "op7_minhash_dedup": OP7, "op8_suffix_dedup": OP8,
        "op11_merkle_manifest": OP11, "op12_spelling_variants": OP12,
    }
