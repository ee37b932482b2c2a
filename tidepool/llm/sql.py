"""SQL that the queries of this subpackage must equal, where SQL can express them.

The others rest on models, signatures or token ids that SQL doesn't have; the
tests hold them against brute force, held-out labels or exact round trips, and
what SQL can say of op1 and op6 has queries of its own.
"""

import xxhash

#: The kinds of base spans, their patterns, the group whose length counts, and its least length.
_BASE = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]

#: Base spans: places from the lengths of matches and of the pieces between them.
SECRETS_BASE = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\nfound AS ("
    + " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, {least} AS least, string_split_regex(t, '{pattern}') AS g FROM d" for k, (kind, pattern, group, least) in enumerate(_BASE))
    + r"""),
spans AS (SELECT r, k, kind, m, v, least, g, unnest(generate_series(1, len(m))) AS i FROM found),
placed AS (SELECT r, k, kind, length(m[i]) AS n, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM spans WHERE length(v[i]) >= least),
said AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans FROM placed GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN said ON d.r = said.r
"""
)

# The primes of xxHash64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _wrap(x: str) -> str:
    """A sum or product of 64-bit values without its overflow."""
    return f"CAST(({x}) % 18446744073709551616 AS UBIGINT)"


def _wide(x) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _turn(x: str, n: int) -> str:
    return f"({_wrap(f'{_wide(x)} * {1 << n}')} | ({x} >> {64 - n}))"


def _xxhash64(out: str, seed: str, value: str) -> str:
    """Columns that lead to ``out``, the hash of one 64-bit value; a null leaves the seed."""
    steps = [
        (f"{out}_1", _wrap(f"{_wide(value)} * {_P2}")),
        (f"{out}_2", _wrap(f"{_wide(_turn(f'{out}_1', 31))} * {_P1}")),
        (f"{out}_3", f"xor({_wrap(f'{_wide(seed)} + {_P5 + 8}')}, {out}_2)"),
        (f"{out}_4", _wrap(f"{_wide(_turn(f'{out}_3', 27))} * {_P1} + {_P4}")),
        (f"{out}_5", _wrap(f"{_wide(f'xor({out}_4, {out}_4 >> 33)')} * {_P2}")),
        (f"{out}_6", _wrap(f"{_wide(f'xor({out}_5, {out}_5 >> 29)')} * {_P3}")),
        (out, f"coalesce(xor({out}_6, {out}_6 >> 32), {seed})"),
    ]
    return ", ".join(f"{x} AS {name}" for name, x in steps)


def _tree() -> str:
    """parent, name, weight and the hash of the name: two regions of two racks of two shards, and once more with a ninth shard beside them."""
    rows = [(top, f"region-{r}", 4.0) for top in ("root", "grown") for r in range(2)] + [("grown", "region-2", 1.0)]
    rows += [(f"region-{r}", f"region-{r}/rack-{k}", 2.0) for r in range(2) for k in range(2)]
    rows += [(f"region-{r}/rack-{k}", f"shard-{4 * r + 2 * k + x}", 1.0) for r in range(2) for k in range(2) for x in range(2)]
    return ", ".join(f"('{parent}', '{name}', {weight}, CAST({xxhash.xxh64(name.encode(), seed=42).intdigest()} AS UBIGINT))" for parent, name, weight in rows)


#: Sizes, checksums by a table, draws of every node of the tree, and the way down along the smallest; slots in the order of hash buckets.
OP3 = f"""
WITH remainders AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(generate_series(0, 255)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, CAST(CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE doc_id END AS UBIGINT) AS id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
sized AS (SELECT r, doc_id, id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS BIGINT) AS crc FROM d, remainders),
tree(parent, name, weight, seed) AS (VALUES {_tree()}),
hashed AS (SELECT r, parent, name, weight, {_xxhash64("h", "seed", "id")} FROM sized, tree),
won AS (SELECT r, parent, arg_min(name, -ln((CAST(h >> 11 AS DOUBLE) + 0.5) * pow(2.0, -53)) / weight) AS child FROM hashed GROUP BY r, parent),
placed AS (SELECT sized.*, CAST(substring(c.child, 7) AS INTEGER) AS shard, g.child = 'region-2' AS moves FROM sized JOIN won a ON a.r = sized.r AND a.parent = 'root' JOIN won b ON b.r = sized.r AND b.parent = a.child JOIN won c ON c.r = sized.r AND c.parent = b.child JOIN won g ON g.r = sized.r AND g.parent = 'grown'),
dealt AS (SELECT *, {_xxhash64("first", "CAST(42 AS UBIGINT)", "id")}, {_xxhash64("bucket", "first", "crc")} FROM placed)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket & 4095, doc_id NULLS FIRST, crc, size) - 1 AS slot, CASE WHEN moves THEN 8 ELSE shard END AS grown_shard FROM dealt
"""

#: Texts whose second half is the beginning of the next one.
FINGERPRINT_EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text, 1, first_text) OVER (ORDER BY doc_id), '') AS following FROM documents, (SELECT arg_min(coalesce(text, ''), doc_id) AS first_text FROM documents))
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(following, 1, length(t) // 2)) AS edited_sha256 FROM d
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Pairs of at least 0.8, followed to the smallest document that they reach.
OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_FOLDED} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places UNION ALL SELECT doc_id, ' ' || text AS s FROM d WHERE len(w) = 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE CAST(both_have AS DOUBLE) / (p.n + q.n - both_have) >= 0.8),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x)
SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id
"""

#: Windows of twenty words in order; all but the first of equal ones cover words that go.
OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS i, unnest(list_transform(generate_series(1, len(w) - 19), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM d),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM places),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM ranked, (SELECT unnest(generate_series(0, 19)) AS j) WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS said, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: Windows of ten folded words, or fewer of short items, looked up in the benchmark's.
OP5 = rf"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
items AS (SELECT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM items))),
hits AS (SELECT DISTINCT doc_id, places.k, i, item_id FROM places JOIN items ON places.k = items.k AND places.s = items.s),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""

#: For pages whose main text is one article element of headings and paragraphs, as it is in the tables: its blocks, without tags, with the character references that occur there.
OP10 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
said AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1)>'), lambda b: regexp_replace(replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g')) AS blocks FROM a),
plain AS (SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM said)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM plain
"""

ORACLE: dict[str, str] = {"secrets_base": SECRETS_BASE, "fingerprint_edits": FINGERPRINT_EDITS, "op2_minhash": OP2, "fingerprint_classes": OP2, "op3_sharding": OP3, "op4_substring": OP4, "op5_decontaminate": OP5, "op10_extract": OP10}
