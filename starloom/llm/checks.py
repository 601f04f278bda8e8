"""The same questions as SQL, for the operators that SQL can express."""

_RULES = (
    ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/", "block"),
    ("com", "/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def _case(value) -> str:
    fits = "\n".join(
        f"      WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN {value(host, path, verdict)}"
        for host, path, verdict in _RULES
    )
    return f"CASE\n{fits}\n      END"


# CRC-32 of a list of bytes, by a table made from its polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS crc FROM range(256) r(i)
)"""


def _crc32(octets: str) -> str:
    step = "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}))"


# Bytes of a text whose characters are below U+0800.
def _octets(text: str) -> str:
    split = "CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [(192 | (ord(x) >> 6))::BIGINT, (128 | (ord(x) & 63))::BIGINT] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda x: {split}))"


def _framed(field: str) -> str:
    return f"coalesce(strlen(({field})::VARCHAR) || ':' || ({field})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(map(_framed, ("doc_id", "source", "lang", n_chars, "text"))) + "))"


CHECKS = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS idx,
    (count(*) OVER (PARTITION BY lang))::BIGINT AS n, {_leaf("n_chars")} AS leaf,
    {_leaf(f"n_chars + ({_crc32(_octets('doc_id::VARCHAR'))} % 7 = 0)::INT")} AS given
  FROM documents, crc_table
), nodes AS (
  SELECT lang, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes
  WHERE n > 1 GROUP BY lang, lvl, idx // 2, n
), trees AS (
  SELECT lang, h AS subroot, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS idx, (count(*) OVER ())::BIGINT AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM trees
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lvl, idx // 2, n
), walk AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, idx, n, given AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.idx // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.idx % 2 = 0 THEN concat(w.h, s.h) ELSE concat(s.h, w.h) END), concat(w.proof, s.h)
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
), top_walk AS (
  SELECT w.doc_id, w.leaf, t.subroot, 0 AS lvl, t.idx, t.n, w.h, w.proof
  FROM walk w JOIN trees t ON t.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.lvl + 1, w.idx // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.idx % 2 = 0 THEN concat(w.h, s.h) ELSE concat(s.h, w.h) END), concat(w.proof, s.h)
  FROM top_walk w LEFT JOIN tops s ON s.lvl = w.lvl AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM top_walk, (SELECT h AS root FROM tops WHERE n = 1) WHERE n = 1
""",
    "op12_exact_dedup": r"""
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM normal WINDOW same AS (PARTITION BY text_sha256)
""",
    "op13_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {_crc32(_octets("concat(doc_id, ':', run)"))} AS h FROM counted, crc_table
), thinned AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), holed AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM places
), shorter AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holed a JOIN holed b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL
  SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.less
  UNION ALL
  SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.less
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -other_n, b := other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), followed AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT x.word, f.form FROM followed x JOIN forms f ON f.word = x.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, x.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN followed x ON x.word = f.word JOIN forms l ON l.word = x.at WHERE l.form IS NULL
""",
    "op6_url_filter": f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
)
SELECT page_id, host, path,
  {_case(lambda h, p, v: f"'{h}{p}'")} AS rule,
  coalesce({_case(lambda h, p, v: f"'{v}'")}, 'allow') AS verdict
FROM parts
""",
}
