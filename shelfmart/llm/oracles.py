"""SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


CONTAMINATION_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE_WORD = r"[^\x20\x09-\x0D]+"


def _nearest(books: str) -> str:
    """The nearest entry of each part, and its squared distance."""
    return f"""
  SELECT r, part, any_value(s) AS s, min({{'d': d, 'e': entry}}) AS best FROM (
    SELECT r, p.part, p.s, entry,
           list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts p JOIN {books} b ON p.part = b.part)
  GROUP BY r, part"""


def _moved(books: str, near: str) -> str:
    """Each entry at the mean of its parts, rounded down; without parts it stays."""
    return f"""
  SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM {books} b LEFT JOIN (
    SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS s FROM (
      SELECT part, best.e AS entry, i, sum(s[i]) AS total, count(*) AS n
      FROM (SELECT part, best, s, unnest(range(1, len(s) + 1)) AS i FROM {near}) GROUP BY ALL)
    GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry"""


def _crc32(text: str) -> str:
    """Check sum of ASCII text, a bit at a time."""
    step = "lambda c, bit: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, b: list_reduce(range(8), {step}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL: dict[str, str] = {
    "op12_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (SELECT *, row_number() OVER (ORDER BY vec_id, q) AS r FROM kept),
parts AS (
  SELECT r, part, list_slice(q, part * (len(q) // 16) + 1, (part + 1) * (len(q) // 16)) AS s
  FROM vectors, (SELECT unnest(range(16)) AS part)),
book0 AS (SELECT part, r - 1 AS entry, s FROM parts WHERE r <= 64),
near0 AS ({_nearest("book0")}), book1 AS ({_moved("book0", "near0")}),
near1 AS ({_nearest("book1")}), book2 AS ({_moved("book1", "near1")}),
near2 AS ({_nearest("book2")}),
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near2 GROUP BY r),
books AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM vectors JOIN coded USING (r), books""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('s' || source, '-') AS tree, {_leaf("text")} AS leaf,
         {_leaf(f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other
  FROM documents),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM docs),
trees AS (
  SELECT 0 AS level, tree, pos, n, leaf AS h FROM rows
  UNION ALL
  SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM trees WHERE n > 1 GROUP BY level, tree, n, pos // 3),
subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, n, pos // 3),
beside AS (
  SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM trees a JOIN trees b ON a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3 AND a.n > 1
  GROUP BY ALL),
beside_top AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.n > 1
  GROUP BY ALL),
climb AS (
  SELECT tree AS source_tree, pos AS row, 0 AS level, pos, n, '' AS siblings, other AS folded FROM rows
  UNION ALL
  SELECT c.source_tree, c.row, c.level + 1, c.pos // 3, (c.n + 2) // 3, c.siblings || s.l || s.r,
         sha256(s.l || c.folded || s.r)
  FROM climb c JOIN beside s ON s.tree = c.source_tree AND s.level = c.level AND s.pos = c.pos WHERE c.n > 1),
climb_top AS (
  SELECT c.source_tree, c.row, 0 AS level, s.pos, s.n, c.siblings, c.folded, s.h AS subroot
  FROM climb c JOIN subroots s ON s.tree = c.source_tree WHERE c.n = 1
  UNION ALL
  SELECT c.source_tree, c.row, c.level + 1, c.pos // 3, (c.n + 2) // 3, c.siblings || s.l || s.r,
         sha256(s.l || c.folded || s.r), c.subroot
  FROM climb_top c JOIN beside_top s ON s.level = c.level AND s.pos = c.pos WHERE c.n > 1)
SELECT d.doc_id, d.leaf, c.subroot, t.h AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root,
       c.folded = t.h AS verified
FROM rows d JOIN climb_top c ON c.source_tree = d.tree AND c.row = d.pos AND c.n = 1
JOIN (SELECT h FROM top WHERE n = 1) t ON true""",
    "op4_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", CONTAMINATION_WORD)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words("text", CONTAMINATION_WORD)} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, s.n, item FROM spots s JOIN windows v ON s.n = v.n AND s.g = v.g),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY doc_id),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words("text", SHINGLE_WORD)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id""",
}
