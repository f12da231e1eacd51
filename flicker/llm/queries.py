"""The queries opN_<name> of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import rotate
from .common import read
from .imatch import PARTS, fingerprint_edits
from .langid import predict_languages
from .merkle import document_manifest
from .mixing import mix_counts
from .neighbours import nearest
from .ngram_join import jaccard_components
from .packing import pack_documents
from .records import encode_and_read
from .sharding import shard_by_key
from .toxicity import score_toxicity
from .trie import prefix_trie
from .warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    """The vocabulary file that the contract names; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS node FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query
def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


_IMATCH_PARTS = "[" + ", ".join(f"{{s: {s}, m: {m}, v: {v}}}" for s, m, v in PARTS) + "]"
SQL["op3_imatch_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt, row_number() OVER w AS r
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, encode(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), f AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM e
), t AS (
  SELECT r, 0 AS kind, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'))) AS term FROM f
  UNION ALL SELECT r, 1, unnest(list_distinct(regexp_extract_all(lower(edited), '[\p{L}\p{M}\p{N}]+'))) FROM f
), lex AS (
  SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS code
  FROM t WHERE kind = 0 GROUP BY term HAVING count(*) * 1000 >= (SELECT count(*) FROM d) AND count(*) * 10 <= (SELECT count(*) FROM d)
), codes AS (SELECT r, kind, list_sort(list(DISTINCT code)) AS codes FROM t JOIN lex USING (term) GROUP BY r, kind
), texts AS (SELECT r, 0 AS kind, md5(text) AS plain FROM f UNION ALL SELECT r, 1, md5(edited) FROM f
), prints AS (
  SELECT r, kind, CASE WHEN codes IS NULL THEN list_transform(parts, lambda p: substr(plain, 1, 8)) ELSE list_transform(parts, lambda p:
    CASE WHEN len(list_filter(codes, lambda c: (c >> p.s) & p.m = p.v)) = 0 THEN '........'
      ELSE substr(md5(array_to_string(list_filter(codes, lambda c: (c >> p.s) & p.m = p.v), ',')), 1, 8) END) END AS fp
  FROM texts LEFT JOIN codes USING (r, kind) CROSS JOIN (SELECT PARTS AS parts)
), g AS (
  SELECT f.doc_id, f.n, f.edited, a.fp AS x, b.fp AS y, coalesce(lead(a.fp) OVER w, first_value(a.fp) OVER w) AS z
  FROM f JOIN prints a ON a.r = f.r AND a.kind = 0 JOIN prints b ON b.r = f.r AND b.kind = 1
  WINDOW w AS (ORDER BY f.r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), h AS (
  SELECT *, list_filter(list_zip(x, y), lambda p: p[1] <> '........' OR p[2] <> '........') AS hy, list_filter(list_zip(x, z), lambda p: p[1] <> '........' OR p[2] <> '........') AS hz FROM g
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(x, '') AS fingerprint, array_to_string(y, '') AS edited_fingerprint,
  CASE WHEN x = y THEN 1.0 ELSE coalesce(len(list_filter(hy, lambda p: p[1] = p[2]))::DOUBLE / nullif(len(hy), 0), 0.0) END::DOUBLE AS near_edited,
  CASE WHEN x = z THEN 1.0 ELSE coalesce(len(list_filter(hz, lambda p: p[1] = p[2]))::DOUBLE / nullif(len(hz), 0), 0.0) END::DOUBLE AS near_next
FROM h
""".replace("PARTS", _IMATCH_PARTS)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(read(spark, sf_dir, "conversations"))


SQL["op5_chat_formatting"] = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'
), r AS (
  SELECT m.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM m JOIN people ON m.conv_id IS NOT DISTINCT FROM people.conv_id
), h AS (
  SELECT *, '<|' || chat_role || CASE WHEN chat_role = 'user' THEN ':' || replace(speaker, '<|', '< |') ELSE '' END || '|>' || chr(10) AS head FROM r
), s AS (SELECT *, head || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS segment FROM h
), p AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS message,
    CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, encode(speaker), encode(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, encode(speaker), encode(text))
)
SELECT conv_id, perspective, turn, message, speaker, chat_role, segment, start,
  CASE WHEN chat_role = 'assistant' THEN start + length(head) END AS train_start,
  CASE WHEN chat_role = 'assistant' THEN start + length(segment) END AS train_end
FROM p
"""


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read(spark, sf_dir, "documents"))


@query
def op7_warc_from_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


SQL["op7_warc_from_legacy_archives"] = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


@query
def op9_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


@query
def op10_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_key(read(spark, sf_dir, "documents"))


SQL["op10_jump_hash_sharding"] = r"""
WITH RECURSIVE steps AS (
  SELECT doc_id, n, CAST(coalesce(doc_id, 0) AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN (VALUES (16), (17)) t(n)
  UNION ALL
  SELECT doc_id, n, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592 AS DOUBLE) + 1.0))) AS BIGINT)
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM steps WHERE j < n)
), s AS (SELECT doc_id, CAST(max(b) FILTER (n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 17) AS INTEGER) AS grown_shard FROM steps GROUP BY doc_id
), tab AS (
  SELECT list_transform(range(16), lambda i: list_reduce([0, 1, 2, 3], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), crc AS ( -- four bits at a time, the lower half of a byte first
  SELECT doc_id, text, xor(list_reduce(
    list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), ''), lambda d: CAST(strpos('123456789ABCDEF', d) AS BIGINT)),
    lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS v
  FROM documents CROSS JOIN tab
)
SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) + 1 AS BIGINT) AS size, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE v END AS text_crc32, 'key' AS law, shard, grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, strlen(coalesce(d.text, '')), v) - 1 AS BIGINT) AS slot
FROM crc d JOIN s ON s.doc_id IS NOT DISTINCT FROM d.doc_id
"""


@query
def op11_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(read(spark, sf_dir, "documents"), tokenizer_path(), 1)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(read(spark, sf_dir, "documents"))


def _merkle_sql(levels: int, top_levels: int) -> str:
    """Level by level, for up to 8 ** levels leaves of a language and 8 ** top_levels languages."""
    ctes = []

    def tree(t: str, most: int) -> None:
        for k in range(most):
            ctes.append(f"{t}r{k} AS (SELECT g, idx // 8 AS idx, list(hash ORDER BY idx) AS run FROM {t}{k} WHERE height > {k} GROUP BY g, idx // 8)")
            ctes.append(f"{t}{k + 1} AS (SELECT g, idx, sha256(array_to_string(run, '')) AS hash, height FROM {t}r{k} JOIN {t}h USING (g))")

    def climb(name: str, source: str, t: str, g: str, idx: str, most: int) -> str:
        for k in range(most):
            at = f"({idx} // {8**k})"
            left, right = f"array_to_string(run[1:{at} % 8], '')", f"array_to_string(run[{at} % 8 + 2:], '')"
            ctes.append(f"{name}{k} AS (SELECT s.* REPLACE (CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN run IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur) FROM {source} s LEFT JOIN {t}r{k} r ON r.g = s.{g} AND r.idx = {idx} // {8 ** (k + 1)})")
            source = f"{name}{k}"
        return source

    height = lambda most: " + ".join(f"CAST(count(*) > {8**k} AS INTEGER)" for k in range(most))
    root = lambda t, most: " UNION ALL ".join(f"SELECT g, hash FROM {t}{k} WHERE height = {k}" for k in range(most + 1))
    ctes.append("lh AS (SELECT g, " + height(levels) + " AS height FROM leaves GROUP BY g)")
    ctes.append("l0 AS (SELECT g, idx, leaf AS hash, height FROM leaves JOIN lh USING (g))")
    tree("l", levels)
    ctes.append(f"subroots AS ({root('l', levels)})")
    ctes.append("tops AS (SELECT '' AS g, g AS lang_key, hash, row_number() OVER (ORDER BY encode(g)) - 1 AS idx FROM subroots)")
    ctes.append("th AS (SELECT g, " + height(top_levels) + " AS height FROM tops GROUP BY g)")
    ctes.append("t0 AS (SELECT g, idx, hash, height FROM tops JOIN th USING (g))")
    tree("t", top_levels)
    ctes.append(f"root AS (SELECT hash AS root FROM ({root('t', top_levels)}))")
    ctes.append("s AS (SELECT v.doc_id, v.g, v.idx, v.leaf, '' AS top, tops.hash AS subroot, tops.idx AS tidx, '' AS proof, tampered AS cur FROM leaves v JOIN tops ON tops.lang_key = v.g)")
    last = climb("u", climb("p", "s", "l", "g", "s.idx", levels), "t", "top", "s.tidx", top_levels)
    return r"""
WITH tab AS (
  SELECT list_transform(range(16), lambda i: list_reduce([0, 1, 2, 3], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), f AS ( -- crc32 of the decimal id, four bits at a time, the lower half of a byte first
  SELECT doc_id, coalesce('.' || lang, '-') AS g, text,
    list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS fields,
    xor(list_reduce(
      list_transform(string_split(regexp_replace(hex(encode(CAST(doc_id AS VARCHAR))), '(.)(.)', '\2\1', 'g'), ''), lambda d: CAST(strpos('123456789ABCDEF', d) AS BIGINT)),
      lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0 AS tampered
  FROM documents CROSS JOIN tab
), e AS (
  SELECT doc_id, g, tampered, sha256(array_to_string(fields, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(fields, '') || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other FROM f
), leaves AS (
  SELECT doc_id, g, leaf, CASE WHEN tampered THEN other ELSE leaf END AS tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM e
), """ + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM {last} CROSS JOIN root
"""


SQL["op12_merkle_manifest"] = _merkle_sql(7, 4)


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


SQL["op13_conversation_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(coalesce(role, '')), encode(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), tab AS (
  SELECT list_transform(range(16), lambda i: list_reduce([0, 1, 2, 3], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), c AS ( -- crc32 of the decimal id, four bits at a time, the lower half of a byte first
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_transform(string_split(regexp_replace(hex(encode(CAST(conv_id AS VARCHAR))), '(.)(.)', '\2\1', 'g'), ''), lambda d: CAST(strpos('123456789ABCDEF', d) AS BIGINT)),
    lambda c, d: xor(c >> 4, t[(xor(c, d) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) CROSS JOIN tab
), r AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), p AS (
  SELECT c.conv_id, coalesce(s, []) AS s, coalesce(len(s), 0) AS n FROM c LEFT JOIN (
    SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) || '/' || length(text) ORDER BY own, i) AS s FROM r GROUP BY conv_id) USING (conv_id)
), m AS (SELECT conv_id, s, n, unnest(range(0, n + 1)) AS d FROM p
), nodes AS (
  SELECT d, s[1:d] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE CAST(string_split(any_value(s[d]), '/')[2] AS BIGINT) END AS saves
  FROM m GROUP BY d, s[1:d]
), kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), whole AS (
  SELECT u.path[1:u.k] AS path, sum(u.saves) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM (SELECT path, saves, unnest(range(0, d + 1)) AS k FROM nodes) u LEFT JOIN kids ON kids.path = u.path GROUP BY 1
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
  CAST(whole.leaves AS BIGINT) AS n_leaves, CAST(whole.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN whole ON whole.path = v.path LEFT JOIN kids ON kids.path = v.path LEFT JOIN nodes up ON up.d = v.d - 1 AND up.path = v.path[1:v.d - 1]
"""
