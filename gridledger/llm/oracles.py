"""SQL for DuckDB over the same tables, one statement per query that SQL can express."""

from __future__ import annotations

from gridledger.llm import divergence, manifest, secrets
from gridledger.llm.mixing import SEED

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, order: int, pattern: str, value_at_least: int = 0) -> str:
    """Spans of a pattern from the lengths of the pieces between its matches."""
    rx = _quoted(pattern)
    keep = f"WHERE length(values_[i]) >= {value_at_least}" if value_at_least else ""
    values = f"regexp_extract_all(t, {rx}, 2)" if value_at_least else "[]"
    return f"""
    SELECT doc_id, {_quoted(kind)} AS kind, {order} AS ord, hits[i] AS v,
           (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT doc_id, hits, gaps, values_, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, {rx}) AS hits, string_split_regex(t, {rx}) AS gaps, {values} AS values_
        FROM d WHERE regexp_matches(t, {rx}))) {keep}"""


def _op1() -> str:
    simple = r"[0-9A-Za-z+/_-]{20,}"
    window = secrets.WINDOW
    classes = "\nUNION ALL\n".join(
        f"SELECT *, {_quoted(kind)} AS hot_kind, {order} AS hot_ord, {bits} AS bits FROM candidates "
        f"WHERE regexp_matches(v, {_quoted(consists)})"
        for order, (kind, consists, _, bits) in enumerate(secrets.CLASSES, 3))
    allowed = " AND ".join(f"NOT regexp_matches(v, {_quoted(p)})" for p in secrets.ALLOWED)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_found("assign", 0, secrets.ASSIGN, secrets.ASSIGN_VALUE)}
    UNION ALL {_found("access", 1, secrets.ACCESS)}
    UNION ALL {_found("hex", 2, secrets.HEX)}),
base_spans AS (SELECT doc_id, kind, ord, s, s + length(v) AS e FROM base),
candidates AS (SELECT doc_id, s, v FROM ({_found("candidate", 9, simple)})
    WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {allowed}),
classed AS ({classes}),
windows AS (SELECT doc_id, hot_kind, hot_ord, bits, s, v, unnest(range(0, length(v) - {window} + 1)) AS pos FROM classed),
hot AS (SELECT * FROM windows
    WHERE round(list_aggregate(string_split(substring(v, pos + 1, {window}), ''), 'entropy'), 9) >= bits),
breaks AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, hot_kind, s ORDER BY pos) <= {window} THEN 0 ELSE 1 END
    AS opens FROM hot),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, hot_kind, s ORDER BY pos) AS run FROM breaks),
hot_spans AS (SELECT doc_id, hot_kind AS kind, hot_ord AS ord, runs.s + min(pos) AS s, runs.s + max(pos) + {window} AS e
    FROM runs GROUP BY doc_id, hot_kind, hot_ord, runs.s, run),
added AS (SELECT * FROM hot_spans h WHERE NOT EXISTS (
    SELECT 1 FROM base_spans b WHERE b.doc_id = h.doc_id AND b.s <= h.s AND b.e >= h.e)),
listed AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
    count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
    count(*) FILTER (ord > 2) AS n3
    FROM (SELECT * FROM base_spans UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
    coalesce(n3, 0) AS n_added, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP2 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w
    FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.x, p.y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id) p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y
    WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d JOIN reach r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_OP5 = f"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)"""

_OP6 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM src),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
        ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM lev),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (SELECT *, target - epochs * source_size AS extra FROM p),
r AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.epochs, x.extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
    FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN before + size <= extra THEN size
    WHEN before <= extra THEN floor(extra - before) ELSE 0 END)::BIGINT AS taken FROM r"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, byte by byte over the table of its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, b: xor(crc >> 8, ({table}::BIGINT[])[(xor(crc, b) & 255) + 1])))"""


def _leaf(text: str) -> str:
    fields = [*manifest.FIELDS[:-1], text]
    return "sha256(" + " || ".join(
        f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


def _op11() -> str:
    fan = manifest.FANOUT
    lowered = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"

    def merged(name: str, start: str) -> str:
        return f"""{name} AS ({start} UNION ALL
    SELECT tree, level + 1, pos // {fan}, (max(width) + {fan} - 1) // {fan}, sha256(string_agg(digest, '' ORDER BY pos))
    FROM {name} WHERE width > 1 GROUP BY tree, level, pos // {fan})"""

    def step(name: str) -> str:
        side = f"string_agg(digest, '') OVER (PARTITION BY tree, level, pos // {fan} ORDER BY pos ROWS BETWEEN"
        return f"""{name}_steps AS (SELECT tree, level, pos, width, coalesce({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name})"""

    def climbed(name: str, start: str, steps: str) -> str:
        return f"""{name} AS ({start} UNION ALL
    SELECT rid, c.tree, c.level + 1, c.pos // {fan}, (c.width + {fan} - 1) // {fan}, proof || before || after,
        sha256(before || acc || after)
    FROM {name} c JOIN {steps} s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos WHERE c.width > 1)"""

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % {manifest.TAMPERED} = 0 THEN {_leaf(lowered)} END AS altered FROM documents),
placed AS (SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY tree) AS width,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{merged("nodes", "SELECT tree, 0 AS level, pos, width, leaf AS digest FROM placed")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS width FROM nodes WHERE width = 1),
{merged("tops", "SELECT '#' AS tree, 0 AS level, pos, width, digest FROM subroots")},
{step("nodes")}, {step("tops")},
{climbed("below", "SELECT rid, tree, 0 AS level, pos, width, '' AS proof, coalesce(altered, leaf) AS acc FROM placed", "nodes_steps")},
{climbed("above", """SELECT rid, '#' AS tree, 0 AS level, s.pos, s.width, proof, acc
    FROM below b JOIN subroots s ON s.tree = b.tree WHERE b.width = 1""", "tops_steps")},
root AS (SELECT digest FROM tops WHERE width = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(a.proof) AS proof_sha256, a.acc AS folded_root,
    a.acc = root.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN above a ON a.rid = p.rid AND a.width = 1, root"""


def _op12() -> str:
    def share(n: str, total: str) -> str:
        return f"(1 + ({divergence.SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * v))::BIGINT"

    order = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term
    HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS all_of FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source)
    GROUP BY lang, source),
cell AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "own")} AS p, {share("total", "all_of")} AS q
    FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
typical AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {order} FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {order} FROM typical) WHERE rank <= {divergence.TOP_TERMS}"""


ORACLES = {
    "op1_secret_scan": _op1(),
    "op2_near_dedup": _OP2,
    "op5_exact_dedup": _OP5,
    "op6_source_mixing": _OP6,
    "op11_merkle_manifest": _op11(),
    "op12_source_divergence": _op12(),
}
