"""The registered queries ``opN_<name>`` and ``pipeline``, and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, erasure, jaccard, licenses, merkle, mixing, pieces, pii, quality_model, quality_rules, tokens, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


#: Keys of sessions that name none, made at random and kept nowhere else.
_KEYS: dict[str, str] = {}


def pii_key(spark: SparkSession) -> pii.Pseudonyms:
    """Pseudonyms under the key in ``spark.pagemill.pii.key``.

    Without the setting the key is a random one of this application: equal
    values still get equal pseudonyms in all its runs, but nobody can undo them
    and no other application makes the same.
    """
    own = _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return pii.Pseudonyms(spark.conf.get("spark.pagemill.pii.key", None) or own)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), pii_key(spark))
    kinds = F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"])))
    return out.select("doc_id", "text", F.size("pii").alias("n_pii"), kinds.alias("kinds"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op5_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(_table(spark, sf_dir, "embeddings"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (_table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines"))
    return erasure.erased(*tables, erasure.new_folder(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_pii": op2_pii,
        "op3_bpe": op3_bpe,
        "op4_token_shards": op4_token_shards,
        "op5_embedding_range_join": op5_embedding_range_join,
        "op6_jaccard": op6_jaccard,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_warc": op9_warc,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_pieces": op12_pieces,
        "op13_erasure": op13_erasure,
    }


_REACH = """
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)"""

OP5_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = x LEFT JOIN n ON vec_id = a"""

OP6_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE [array_to_string(l[i:i + 4], ' ') FOR i IN range(1, len(l) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS o FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = x"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h AS d, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
    CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON h = d"""



def _merkle_sql(source_levels: int = 14, levels: int = 7) -> str:
    """The manifest in SQL, with the levels unrolled: up to 3 ** 14 rows of a source, 3 ** 7 sources.

    A tree that has one node left stays as it is. ``lft`` and ``rgt`` are the
    siblings of a node in its run.
    """
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {step}), 4294967295)"
    run = "OVER (PARTITION BY key, pos // 3 ORDER BY pos ROWS BETWEEN"
    with_siblings = f"SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM "

    def tree(p: str, first: str, upto: int) -> list[str]:
        out = [f"{p}0 AS ({with_siblings}({first}))"]
        for i in range(upto):
            up = f"SELECT key, pos // 3 AS pos, CAST(ceil(any_value(n) / 3.0) AS BIGINT) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {p}{i} GROUP BY key, pos // 3"
            out.append(f"{p}{i + 1} AS ({with_siblings}({up}))")
        return out

    ctes = [
        f"d0 AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS altered FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d0)",
        *tree("a", "SELECT source AS key, pos, n, leaf AS h FROM d", source_levels),
        f"t AS (SELECT key AS source, h FROM a{source_levels})",
        *tree("b", "SELECT 0 AS key, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM t", levels),
        "s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos FROM t)",
        f"f0 AS (SELECT d.*, subroot, spos, altered AS f, '' AS proof, (SELECT h FROM b{levels}) AS root FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
    ]
    at = 0
    for p, key, pos, upto in (("a", "source", "pos", source_levels), ("b", "0", "spos", levels)):
        for i in range(upto):
            ctes.append(f"f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN g.n = 1 THEN f ELSE sha256(lft || f || rgt) END AS f, proof || lft || rgt AS proof) FROM f{at} f JOIN {p}{i} g ON {key if key == '0' else 'f.source'} IS NOT DISTINCT FROM g.key AND f.{pos} // {3**i} = g.pos)")
            at += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{at}"


OP11_SQL = _merkle_sql()


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others have tests."""
    return {"op5_embedding_range_join": OP5_SQL, "op6_jaccard": OP6_SQL, "op9_warc": OP9_SQL, "op11_merkle_manifest": OP11_SQL}
