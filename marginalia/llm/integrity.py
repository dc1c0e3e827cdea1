"""Queries over the manifest of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import leaf_digest, manifest, proof_text
from .registry import query, table

_FIELDS = ("doc_id", "source", "lang", "n_chars")


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join([*map(_field, _FIELDS), _field(text)])})"


# DuckDB has no crc32: the bits of a decimal id are folded one character after the other, by a table of 256 values
# that is made from the polynomial.
_CRC = """bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""

MANIFEST_SQL = f"""
WITH RECURSIVE {_CRC},
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
         CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claimed
  FROM documents LEFT JOIN crc USING (doc_id)),
places AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM places
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
tops AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM above WHERE n > 1 GROUP BY level, pos // 3),
high AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
steps AS (
  SELECT p.tree, p.pos AS place, o.level, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < p.pos // (3 ** o.level)::BIGINT), '') AS l,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > p.pos // (3 ** o.level)::BIGINT), '') AS r
  FROM places p JOIN nodes o ON o.tree = p.tree AND o.n > 1 AND o.pos // 3 = p.pos // (3 ** (o.level + 1))::BIGINT GROUP BY ALL),
high_steps AS (
  SELECT p.tree, o.level, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < p.pos // (3 ** o.level)::BIGINT), '') AS l,
         coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > p.pos // (3 ** o.level)::BIGINT), '') AS r
  FROM tops p JOIN above o ON o.n > 1 AND o.pos // 3 = p.pos // (3 ** (o.level + 1))::BIGINT GROUP BY ALL),
path AS (
  SELECT tree, place, level, l, r FROM steps
  UNION ALL SELECT p.tree, p.pos, h.levels + s.level, l, r FROM places p JOIN high h USING (tree) JOIN high_steps s USING (tree)),
proofs AS (SELECT tree, place, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY ALL),
folds AS (
  SELECT tree, pos, claimed AS node, 0 AS level FROM places
  UNION ALL SELECT f.tree, f.pos, sha256(p.l || f.node || p.r), f.level + 1
  FROM folds f JOIN path p ON p.tree = f.tree AND p.place = f.pos AND p.level = f.level),
folded AS (SELECT tree, pos, arg_max(node, level) AS folded_root FROM folds GROUP BY ALL)
SELECT doc_id, leaf, subroot, a.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = a.node AS verified
FROM places p JOIN tops USING (tree) JOIN folded f ON f.tree = p.tree AND f.pos = p.pos
LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.pos, (SELECT node FROM above WHERE n = 1) a"""


@query(MANIFEST_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and where the proof leads after half of them lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in _FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    edited = F.when(even & F.contains("text", F.lit("\n")), leaf_digest(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    proved = manifest(docs, leaf_digest(*fields, F.col("text")), claimed=edited)
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
