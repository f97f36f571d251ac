"""DuckDB SQL of the contracts, and the parameters that queries and SQL share."""

DOMAINS = ("books", "code", "web")
DOMAIN_WEIGHTS = {"books": 3, "code": 2, "web": 5}
LANG_WEIGHTS = {"de": 2, "en": 5, "es": 2, "fr": 2}
EPOCHS = 4
SEED = 7

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_LABELS = ("cheap-pills", "casino-win", "ads-track", "free-bets", "spam-farm", "adult-x")


def _case(column: str, weights: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _fill(source: str, parent: str, name: str) -> str:
    """Children with budgets: the level at which the pot runs out is found over the sorted ratios."""
    return f"""
  SELECT *, CASE WHEN full_ THEN cap ELSE part + CASE WHEN rn <= left_ - used THEN 1 ELSE 0 END END AS budget FROM (
    SELECT *, sum(CASE WHEN full_ THEN 0 ELSE part END) OVER (PARTITION BY {parent}) AS used,
           row_number() OVER (PARTITION BY {parent}, full_ ORDER BY {name} NULLS FIRST) AS rn FROM (
      SELECT *, CASE WHEN full_ THEN cap ELSE (weight * left_) // nullif(open_, 0) END AS part FROM (
        SELECT *, pot - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS left_,
               sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_ FROM (
          SELECT *, cap * weights <= weight * (pot - before) AS full_ FROM (
            SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} NULLS FIRST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} NULLS FIRST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM ({source}))))))"""


_WORDS = r"[^\x20\x09-\x0D]+"

MIXING = f"""
WITH d AS (
  SELECT doc_id, lang, source, md5(coalesce(text, '')) AS text,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> '' THEN
           list_extract({list(DOMAINS)!r}, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % {len(DOMAINS)} + 1) END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, ({EPOCHS} * sum(n_tokens))::BIGINT AS cap,
                {_case('domain', DOMAIN_WEIGHTS)} AS wd, {_case('lang', LANG_WEIGHTS)} AS wl
         FROM d WHERE n_tokens > 0 GROUP BY ALL),
one AS ({_fill('''SELECT 0 AS root, domain, wd AS weight, sum(cap)::HUGEINT AS cap,
               (SELECT least(sum(supply), sum(cap)) FROM leaf) AS pot FROM leaf GROUP BY domain, wd''', 'root', 'domain')}),
two AS ({_fill('''SELECT n.domain, n.lang, n.wl AS weight, n.cap, one.budget AS pot FROM
              (SELECT domain, lang, wl, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL) n
              JOIN one ON n.domain IS NOT DISTINCT FROM one.domain''', 'domain', 'lang')}),
three AS ({_fill('''SELECT n.domain, n.lang, n.source, n.supply, 1 AS weight, n.cap::HUGEINT AS cap, two.budget AS pot FROM leaf n
              JOIN two ON n.domain IS NOT DISTINCT FROM two.domain AND n.lang IS NOT DISTINCT FROM two.lang''',
               'domain, lang', 'source')}),
plan AS (SELECT domain, lang, source, (budget // supply)::BIGINT AS n_epochs, (budget % supply)::BIGINT AS rest FROM three),
placed AS (
  SELECT d.*, n_epochs, rest, coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
    ORDER BY md5('{SEED}:' || n_epochs || ':' || doc_id), n_tokens, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past
  FROM d LEFT JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, n_epochs, n_prefix, n_epochs * n_tokens + n_prefix AS n_taken FROM (
  SELECT *  REPLACE (CASE WHEN n_tokens > 0 THEN coalesce(n_epochs, 0) ELSE 0 END AS n_epochs),
         greatest(0, least(n_tokens, coalesce(rest, 0) - past))::BIGINT AS n_prefix FROM placed)"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda t: t[1] * t[2]))::BIGINT AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_BENCH_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, g.n, s, item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

URL_FILTER = f"""
WITH p AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_fits(h, q)} THEN '{h + q}'" for _, h, q in _LONGEST)} END AS rule,
       CASE {' '.join(f"WHEN {_fits(h, q)} THEN '{v}'" for v, h, q in _LONGEST)}
            WHEN {' OR '.join(f"contains('.' || host, '.{x}.')" for x in LISTED_LABELS)} THEN 'block' ELSE 'allow' END AS verdict
FROM p"""

WORD_REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM
        (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM late) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words
         ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS x FROM
        (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN root USING (doc_id)"""


# ---------------------------------------------------------------- rounds of CRC-32, Feistel, trees

_CRC = """t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc)"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of byte values; the query has to name the table ``t``."""
    return f"xor(4294967295, list_reduce({codes}, lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1]), 4294967295))"


def _crc32_digits(number: str) -> str:
    d = f"CAST({number} AS VARCHAR)"
    return _crc32(f"list_transform(range(1, length({d}) + 1), lambda p: ascii(substr({d}, p, 1))::BIGINT)")


TRIE = f"""
WITH RECURSIVE {_CRC},
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k[:32]) AS r FROM (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS len,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL)),
cs AS (SELECT c, c - c % 100 AS b, {_crc32_digits('c')} % 6 AS h FROM (SELECT DISTINCT c FROM o), t),
heads AS (SELECT cs.c, o.r AS pos, o.k, o.len FROM cs JOIN o ON o.c = cs.b AND o.r <= cs.h),
kept AS (SELECT c, count(*) AS m FROM heads GROUP BY c),
seq AS (SELECT * FROM heads UNION ALL
  SELECT o.c, coalesce(m, 0) + o.r - h, o.k, o.len FROM o JOIN cs USING (c) LEFT JOIN kept USING (c) WHERE o.r > h),
path AS (SELECT c, pos, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS node, len FROM seq
  UNION ALL SELECT c, 0, '', 0 FROM cs),
size AS (SELECT c, max(pos) AS last FROM path GROUP BY c),
node AS (SELECT node, any_value(pos) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
                CASE WHEN any_value(pos) > 0 THEN node[:length(node) - 64] END AS parent FROM path GROUP BY node),
fan AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN fan USING (node)),
below AS (SELECT p.node, sum((w.n_convs - 1) * w.len) AS saved, count(*) FILTER (w.n_children = 0) AS leaves
          FROM whole w JOIN path p ON p.c = w.conv_id AND p.pos <= w.depth GROUP BY p.node),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM path JOIN size USING (c) WHERE pos = last GROUP BY node)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole w JOIN below USING (node) LEFT JOIN ends USING (node) LEFT JOIN node up ON up.node = w.parent"""


def _permuted(source: str, keys: list[int], times: tuple[int, int]) -> str:
    """A keyed Feistel network over column ``v`` of halves below ``m``."""
    sql = f"SELECT *, v // m AS l, v % m AS r FROM ({source})"
    for k in keys:
        x = f"((r::HUGEINT * {times[0]} + {k}) % 18446744073709551616)"
        f = f"((xor(({x} // 4294967296)::BIGINT, ({x} % 4294967296)::BIGINT)::HUGEINT * {times[1]}) % 18446744073709551616) // (18446744073709551616 // m)"
        sql = f"SELECT * REPLACE (r AS l, xor(l, ({f})::BIGINT) AS r) FROM ({sql})"
    return f"SELECT id, n, m, l * m + r AS v FROM ({sql})"


def sharding(shards: int, keys: list[int], times: tuple[int, int]) -> str:
    """Row numbers, permuted until they are row numbers again."""
    return f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, {_crc32("list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)")} AS text_crc32 FROM d, t),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id, count(*) OVER () AS n FROM c),
s AS (SELECT id, n, 1::BIGINT << greatest(1, (CASE WHEN n > 1 THEN length(ltrim(bin(n - 1), '0')) ELSE 0 END + 1) // 2)::INT AS m, id AS v FROM o),
w AS ({_permuted('SELECT * FROM s', keys, times)} UNION ALL {_permuted('SELECT * FROM w WHERE v >= n', keys, times)})
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, (v // {shards})::BIGINT AS slot,
       NULL::INT AS grown_shard, o.id AS row, v AS place
FROM o JOIN w ON o.id = w.id AND w.v < w.n"""


def _hashed(text: str) -> str:
    cols = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in cols) + ")"


def _levels(name: str, bottom: str) -> str:
    """Nodes (tree, l, i, d, n) of all levels, and (tree, l, i, a, z): the siblings before and after each node."""
    return f"""
{name} AS ({bottom} UNION ALL
  SELECT tree, l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, l, i // 3, n),
{name}_side AS (SELECT x.tree, x.l, x.i, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a,
                       coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS z
  FROM {name} x LEFT JOIN {name} y ON x.tree = y.tree AND x.l = y.l AND x.i // 3 = y.i // 3 AND x.i <> y.i
  WHERE x.n > 1 GROUP BY x.tree, x.l, x.i)"""


MANIFEST = f"""
WITH RECURSIVE {_CRC},
h AS (SELECT doc_id, source, {_hashed('text')} AS leaf, CASE WHEN {_crc32_digits('doc_id')} % 2 = 0 THEN
        {_hashed("replace(text, chr(10), '')")} ELSE {_hashed('text')} END AS found FROM documents, t),
leaf AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS i FROM h),
{_levels('low', 'SELECT tree, 0 AS l, i, leaf AS d, n FROM leaf')},
{_levels('top', 'SELECT 0 AS tree, 0 AS l, tree AS i, d, (SELECT max(tree) + 1 FROM leaf) AS n FROM low WHERE n = 1')},
step AS (SELECT leaf.tree, leaf.i, s.l, s.a, s.z FROM leaf JOIN low_side s ON s.tree = leaf.tree AND s.i = leaf.i // (3 ** s.l)::BIGINT
  UNION ALL SELECT leaf.tree, leaf.i, 1000 + s.l, s.a, s.z FROM leaf JOIN top_side s ON s.i = leaf.tree // (3 ** s.l)::BIGINT),
way AS (SELECT tree, i, string_agg(a || z, '' ORDER BY l) AS proof, list(a || '|' || z ORDER BY l) AS steps FROM step GROUP BY tree, i),
done AS (SELECT leaf.*, sub.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(coalesce(steps, []), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2)), found) AS folded_root
  FROM leaf LEFT JOIN way USING (tree, i) JOIN low sub ON sub.tree = leaf.tree AND sub.n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""
