"""The same queries in SQL, where SQL can express them."""

from __future__ import annotations

from prefdeck.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS

WORDS = r"[^\x20\x09-\x0D]+"
# The reflected polynomial of crc32, bit by bit over the decimal digits.
CRC = (
    "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _climb(nodes: str, walk: str, levels: int, name: str) -> tuple[list[str], str, str]:
    """Tables that shrink ``nodes (tree, pos, node)`` level by level and lead ``walk (tree, pos, ..., proof,
    folded)`` up with them; their last names."""
    tables = []
    for k in range(levels):
        runs, above, higher = (f"{name}_{kind}{k}" for kind in ("runs", "nodes", "walk"))
        left, right = "r.nodes[1 : (w.pos % 8)]", "r.nodes[(w.pos % 8) + 2 :]"
        tables += [
            f"{runs} AS (SELECT tree, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM "
            f"(SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) WHERE n > 1 GROUP BY tree, pos // 8)",
            f"{above} AS (SELECT tree, run AS pos, sha256(array_to_string(nodes, '')) AS node FROM {runs} UNION ALL "
            f"SELECT tree, pos, node FROM {nodes} WHERE tree NOT IN (SELECT tree FROM {runs}))",
            f"{higher} AS (SELECT w.* EXCLUDE (pos, proof, folded), w.pos // 8 AS pos, "
            f"w.proof || coalesce(array_to_string({left} || {right}, ''), '') AS proof, CASE WHEN r.run IS NULL THEN w.folded "
            f"ELSE sha256(array_to_string({left} || [w.folded] || {right}, '')) END AS folded "
            f"FROM {walk} w LEFT JOIN {runs} r ON r.tree = w.tree AND r.run = w.pos // 8)",
        ]
        nodes, walk = above, higher
    return tables, nodes, walk


def merkle(levels: int = 7, top_levels: int = 3) -> str:
    """For languages of up to 8 ** levels documents, and 8 ** top_levels languages."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first, roots, walked = _climb("leaves", "start", levels, "g")
    second, root, done = _climb("tops", "middle", top_levels, "t")
    tables = [
        f"hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS node, "
        f"CASE WHEN {CRC} % 3 = 0 THEN {_leaf(lower)} END AS claimed FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM hashed)",
        "start AS (SELECT tree, pos, doc_id, node AS leaf, '' AS proof, coalesce(claimed, node) AS folded FROM leaves)",
        *first,
        f"tops AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, tree AS name FROM {roots})",
        "middle AS (SELECT '' AS tree, t.pos, w.doc_id, w.leaf, t.node AS subroot, w.proof, w.folded "
        f"FROM {walked} w JOIN tops t ON t.name = w.tree)",
        *second,
    ]
    return (
        f"WITH {', '.join(tables)} SELECT w.doc_id, w.leaf, w.subroot, r.node AS root, sha256(w.proof) AS proof_sha256, "
        f"w.folded AS folded_root, w.folded = r.node AS verified FROM {done} w JOIN {root} r ON r.tree = w.tree"
    )


def mixing() -> str:
    """The common level below which sources are not stopped, in closed form: sources in the order of cap
    over weight, and the first level that the next one bears."""
    n = len(MIX_WEIGHTS)
    weight = f"list_element([{', '.join(f'{w}::DOUBLE' for w in MIX_WEIGHTS)}], ((place % {n}) + 1)::INT)"
    return f"""
WITH parts AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN length(translate(text, '#*$%&|<>{{}}~^', '')) / length(text) ELSE 1.0::DOUBLE END AS plain,
    ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS bits
  FROM documents),
drawn AS (
  SELECT doc_id, source, size,
    -ln((bits + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(plain * plain * plain * plain, 0.05::DOUBLE) AS draw
  FROM parts),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
shares AS (SELECT *, {weight} AS share, source_size * {MIX_EPOCHS}::DOUBLE AS cap FROM placed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / sum(share) OVER later AS level
  FROM shares
  WINDOW earlier AS (ORDER BY cap / share, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY cap / share, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
common AS (SELECT coalesce(first(level ORDER BY cap / share, place) FILTER (share * level <= cap), 0) AS level FROM levels),
aims AS (SELECT source, source_size, least(cap, share * (SELECT level FROM common)) AS target FROM shares),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM drawn),
budget AS (
  SELECT s.doc_id, s.size, s.before, a.source_size, a.target,
    CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size)::BIGINT ELSE 0 END AS epochs
  FROM summed s JOIN aims a ON a.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(least(floor(target - epochs * source_size)::BIGINT - before, size), 0))::BIGINT AS taken
FROM budget"""


AUDIT = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failed AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM split),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS r(step))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM cells, steps GROUP BY part, filter_order, step"""

# Tokenizers, XXH64, learned scores, byte matches and archives are beyond SQL.
ORACLE = {"op11_merkle_manifest": merkle(), "op12_source_mixing": mixing(), "op13_filter_audit": AUDIT}
