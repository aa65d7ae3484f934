"""SQL counterparts of the queries, for DuckDB. Tokenizers, hashes of shingles, trained models and packings
have none; these queries are tested against brute-force versions and held-out rows."""

ORACLES: dict[str, str] = {}

ORACLES["op11_resampling"] = r"""
WITH RECURSIVE shifts AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
),
texts AS (
    SELECT 'ours' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark
),
split AS (
    SELECT side, row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
),
places AS (SELECT side, row, unnest(words) AS one, unnest(range(len(words))) AS pos FROM split),
runs AS (
    SELECT side, row, one, lead(one) OVER following AS two, lead(one, 2) OVER following AS three
    FROM places WINDOW following AS (PARTITION BY side, row ORDER BY pos)
),
grams AS (
    SELECT side, row, gram, count(*) AS n
    FROM (SELECT side, row, unnest([one, one || ' ' || two, one || ' ' || two || ' ' || three]) AS gram FROM runs)
    WHERE gram IS NOT NULL GROUP BY ALL
),
crcs AS (
    SELECT gram, xor(4294967295, list_reduce(
        list_transform(range(octet_length(encode(gram))), lambda i: CAST('0x' || substr(hex(encode(gram)), 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT gram FROM grams), shifts
),
coded AS (SELECT side, row, bucket, sum(n) AS n FROM grams JOIN crcs USING (gram) GROUP BY ALL),
buckets AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'ours'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'target'), 0)::DOUBLE AS t
    FROM coded GROUP BY bucket
),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM buckets, sums
),
weights AS (
    SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM coded JOIN gains USING (bucket) WHERE side = 'ours' GROUP BY row
),
scores AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words)::BIGINT AS n_words,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (CAST('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM split LEFT JOIN weights USING (row) WHERE side = 'ours'
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
        count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS drawn
    FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank, n_words FROM placed
"""

ORACLES["op12_exact_dedup"] = """
WITH bodies AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body)
"""

_WRITTEN = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(concat(" + ", ".join(_WRITTEN.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + "))"
_TAMPERED = """n_chars + coalesce((xor(4294967295, list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295)) % 7 = 0)::BIGINT, 0)"""

# Trees of two: the languages' trees have their lang as name, the tree of their roots has none and comes after them.
ORACLES["op13_manifest"] = f"""
WITH RECURSIVE shifts AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
),
hashed AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n_chars="n_chars")} AS leaf,
        {_LEAF.format(n_chars="(" + _TAMPERED + ")")} AS claimed
    FROM documents, shifts
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos FROM hashed
),
nodes AS (
    SELECT tree, 0 AS level, pos, leaf AS node FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 2, pair FROM (
        SELECT tree, level, pos, sha256(node || coalesce(lead(node) OVER (PARTITION BY tree ORDER BY pos), '')) AS pair,
            count(*) OVER (PARTITION BY tree) AS size
        FROM nodes
    ) WHERE size > 1 AND pos % 2 = 0
),
subroots AS (
    SELECT tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, level AS height
    FROM nodes n WHERE level = (SELECT max(level) FROM nodes m WHERE m.tree = n.tree)
),
top AS (
    SELECT 0 AS level, pos, node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, pair FROM (
        SELECT level, pos, sha256(node || coalesce(lead(node) OVER (ORDER BY pos), '')) AS pair, count(*) OVER () AS size FROM top
    ) WHERE size > 1 AND pos % 2 = 0
),
root AS (SELECT node AS root, level AS height FROM top ORDER BY level DESC LIMIT 1),
steps AS (
    SELECT l.tree, l.pos, n.level, (l.pos >> n.level) % 2 = 1 AS on_the_right, s.node AS sibling
    FROM leaves l JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM nodes) n ON n.level < r.height
    LEFT JOIN nodes s ON s.tree = l.tree AND s.level = n.level AND s.pos = xor(l.pos >> n.level, 1)
    UNION ALL
    SELECT l.tree, l.pos, r.height + n.level, (r.pos >> n.level) % 2 = 1, s.node
    FROM leaves l JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM top) n ON n.level < (SELECT height FROM root)
    LEFT JOIN top s ON s.level = n.level AND s.pos = xor(r.pos >> n.level, 1)
),
paths AS (
    SELECT tree, pos, list(CASE WHEN on_the_right THEN coalesce(sibling, '') ELSE '' END ORDER BY level) AS before,
        list(CASE WHEN on_the_right THEN '' ELSE coalesce(sibling, '') END ORDER BY level) AS after
    FROM steps GROUP BY tree, pos
),
told AS (
    SELECT l.doc_id, l.leaf, l.claimed, r.node AS subroot, root.root, coalesce(p.before, []) AS before, coalesce(p.after, []) AS after
    FROM leaves l JOIN subroots r USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos, root
),
folds AS (
    SELECT *, list_reduce(range(1, len(before) + 1), lambda below, i: sha256(concat(before[i], below, after[i])), claimed) AS folded_root,
        sha256(array_to_string(list_transform(range(1, len(before) + 1), lambda i: before[i] || after[i]), '')) AS proof_sha256
    FROM told
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""
