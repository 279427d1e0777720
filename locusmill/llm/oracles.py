"""DuckDB SQL for those operators' queries that SQL can express."""

from locusmill.llm import sharding

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, lengths WHERE len(w) >= n
),
hits AS (SELECT DISTINCT doc_id, pos, dw.n AS n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = array_to_string(w[pos : pos + dw.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def _op10() -> str:
    size, shards = sharding.SIZE, len(sharding.SHARDS)
    number = lambda salt, text: f"CAST('0x' || substr(md5('{salt}' || {text}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard FROM range({shards}) r(i)),
steps AS (SELECT i, {number("offset:", "shard")} % {size} AS o, {number("skip:", "shard")} % {size - 1} + 1 AS s FROM names),
orders AS (SELECT list(list_transform(range({size}), lambda j: (o + j * s) % {size}) ORDER BY i) AS prefs FROM steps),
fill(t, slot, taken) AS (
  SELECT 0, prefs[1][1], [prefs[1][1]] FROM orders
  UNION ALL
  SELECT t + 1, pick, list_append(taken, pick) FROM (
    SELECT t, taken, list_filter(prefs[(t + 1) % {shards} + 1], lambda x: NOT list_contains(taken, x))[1] AS pick
    FROM fill, orders WHERE t + 1 < {size})
)
SELECT doc_id, CAST(fill.slot AS INTEGER) AS slot, shard
FROM (SELECT doc_id, {number("key:", "coalesce(CAST(doc_id AS VARCHAR), '')")} % {size} AS slot FROM documents) d
JOIN fill ON fill.slot = d.slot JOIN names ON names.i = fill.t % {shards}
"""


OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

OP11 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: Levels of the SQL for op13: up to 8^7 documents of a lang, and 8^7 langs.
OP13_LEVELS = 7


def _crc32(text: str) -> str:
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ord({text}[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295)"


def _op13() -> str:
    framed = lambda x: f"coalesce(CAST(octet_length(encode({x})) AS VARCHAR) || ':' || {x}, '-')"
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
    leaf = lambda text: "sha256(" + " || ".join(map(framed, [*fields, text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = f"CASE WHEN {_crc32('s')} % 3 = 0 THEN {lower} ELSE text END"
    parts = [
        f"d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, lang AS grp FROM documents)",
        f"n0 AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS at, count(*) OVER (PARTITION BY grp) - 1 AS most, {leaf('text')} AS node, {leaf(changed)} AS tampered FROM d)",
    ]
    # Each level has one row for each node; a group that is down to one node keeps it.
    for name, below in (("n", "n0"), ("t", "t0")):
        for k in range(1, OP13_LEVELS + 1):
            parts.append(
                f"{name}{k} AS (SELECT grp, at // 8 AS at, max(most) // 8 AS most, CASE WHEN max(most) = 0 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY at)) END AS node,"
                f" CASE WHEN max(most) = 0 THEN '' ELSE string_agg(node, '' ORDER BY at) END AS preimage FROM {name}{k - 1} GROUP BY grp, at // 8)".replace(f"at // 8 AS at, max", f"{name}{k - 1}.at // 8 AS at, max").replace("ORDER BY at)", f"ORDER BY {name}{k - 1}.at)").replace("grp, at // 8)", f"grp, {name}{k - 1}.at // 8)")
            )
        if name == "n":
            parts.append(f"t0 AS (SELECT 0 AS grp, grp AS lang, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS at, count(*) OVER () - 1 AS most, node FROM n{OP13_LEVELS})")
    columns, joins = [], []
    for name, group, place in (("n", "n0.grp", "n0.at"), ("t", "0", "t0.at")):
        if name == "t":
            joins.append("JOIN t0 ON t0.lang IS NOT DISTINCT FROM n0.grp")
        for k in range(1, OP13_LEVELS + 1):
            joins.append(f"JOIN {name}{k} ON {name}{k}.grp IS NOT DISTINCT FROM {group} AND {name}{k}.at = {place} // {8**k}")
            columns.append((f"{name}{k}.preimage", f"({place} // {8 ** (k - 1)}) % 8"))
    siblings, fold = [], "tampered"
    for i, (preimage, slot) in enumerate(columns):
        siblings.append(f"left({preimage}, CAST(64 * ({slot}) AS BIGINT)) || substr({preimage}, CAST(64 * ({slot}) + 65 AS BIGINT))")
    siblings = " || ".join(siblings)
    steps = []
    for i, (preimage, slot) in enumerate(columns):
        held = "tampered" if i == 0 else f"f{i - 1}"
        steps.append(f"SELECT *, CASE WHEN p{i} = '' THEN {held} ELSE sha256(left(p{i}, CAST(64 * s{i} AS BIGINT)) || {held} || substr(p{i}, CAST(64 * s{i} + 65 AS BIGINT))) END AS f{i} FROM ")
    inner = f"(SELECT doc_id, n0.node AS leaf, n{OP13_LEVELS}.node AS subroot, t{OP13_LEVELS}.node AS root, sha256({siblings}) AS proof_sha256, tampered, " + ", ".join(
        f"{p} AS p{i}, {s} AS s{i}" for i, (p, s) in enumerate(columns)
    ) + " FROM n0 " + " ".join(joins) + ")"
    for step in steps:
        inner = f"({step}{inner})"
    last = f"f{len(columns) - 1}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM {inner}"


ORACLES = {"op11_bloom_line_dedup": OP11, "op13_merkle_manifest": _op13(), "op2_warc_zstd": OP2, "op4_winnowing_decontamination": OP4, "op7_exact_dedup": OP7, "op10_lookup_sharding": _op10()}
