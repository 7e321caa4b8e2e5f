"""Registered queries of the operators: the whole intended table with production parameters."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm import byte_bpe, decontaminate, embedding_dedup, language_id, merkle, order_minhash, periodic_runs, pii, quality_gam, simhash, suffix_dedup, token_files, url_filter
from fundflow.llm.common import id_remainder, table
from fundflow.llm.order_minhash import WORD, let
from fundflow.llm.url_filter import ALLOW, BLOCK, Rule

#: The end id of operator 1's documents.
END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=13)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: Operator 4's rules.
URL_RULES = [Rule(ALLOW, "org", "/"), Rule(BLOCK, "example.org", "/es/"), Rule(BLOCK, "example.org", "/en/1"),
             Rule(ALLOW, "com", "/fr/"), Rule(BLOCK, "com", "/de/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), words=3, max_bits=3)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


#: Operator 11's fields of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf_of([lowered if c == "text" else F.col(c) for c in LEAF])
    leaves = docs.select("doc_id", "lang", merkle.leaf_of([F.col(c) for c in LEAF]).alias("leaf"),
                         F.when(id_remainder(F.col("doc_id"), 3) == 0, tampered).alias("tampered"))
    rows = merkle.manifest(leaves, "lang", ["doc_id"])
    found = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """Operator 12's texts: in every tenth document (by the crc32 of its id) the words from one on are a repeated stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return let(a, lambda a: let(p, lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), let(words, tail)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(table(spark, sf_dir, "documents"), repeated_tail(F.col("doc_id"), F.col("text")))
    none = F.lit(None).cast(periodic_runs.RUNS)[0]
    best = F.aggregate("runs", none, lambda a, r: F.when(
        a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    found = found.withColumn("best", best)
    milli = 1000 * F.col("best.length")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        ((milli - milli % F.col("best.period")) / F.col("best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text").cast("long"), F.floor(F.length("text") / 2).cast("int")
    slots = docs.withColumn("slots", order_minhash.slots(F.col("text")))
    pairs = order_minhash.with_next(slots, {"next_text": "text", "next_slots": "slots"})
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    both = edited.withColumn("edited_slots", order_minhash.slots(F.col("edited")))
    return both.select("doc_id", n.alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       order_minhash.written(F.col("slots")).alias("fingerprint"),
                       order_minhash.written(F.col("edited_slots")).alias("edited_fingerprint"),
                       order_minhash.likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
                       order_minhash.likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_suffix_dedup, op3_byte_bpe, op4_url_filter, op5_embedding_dedup, op6_simhash, op7_decontaminate, op8_pii, op9_quality, op10_language_id, op11_merkle, op12_periodic_runs, op13_order_minhash)}

#: Operator 5 by brute force. The components are the closure of the links; small tables only.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

#: Operator 2 word by word, for tables whose doc_id is a key.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM (
    SELECT doc_id, i, unnest(range(0, 13)) AS j FROM windows JOIN firsts USING (k) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (WHERE g.p IS NULL) AS left_over
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""



def merkle_sql(levels: int = 10, group_levels: int = 3) -> str:
    """Operator 11 level by level: trees of at most 8 ** levels documents a lang and 8 ** group_levels langs."""
    said = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in LEAF)
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    #: crc32 of the decimal id, bit by bit (3988292384 is the reversed polynomial).
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""
    parts = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256(concat({said})) AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256(concat({said.replace("text::VARCHAR", lowered)})) END AS tampered FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)""",
             "n0 AS (SELECT g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves)"]

    def grown(t: str, count: int) -> None:
        for j in range(count):
            parts.append(f"""{t}{j + 1} AS (SELECT g, p // 8 AS p, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, (n + 7) // 8 AS n
      FROM {t}{j} GROUP BY g, p // 8, n)""")
            parts.append(f"""{t}s{j} AS (SELECT g, p, n, coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}{j})""")

    grown("n", levels)
    parts.append(f"m0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n, g AS lang FROM n{levels})")
    grown("m", group_levels)
    parts.append(f"""f0 AS (SELECT doc_id, leaf, leaves.g, leaves.p, m0.p AS gp, m0.h AS subroot, coalesce(tampered, leaf) AS f, '' AS proof
      FROM leaves JOIN m0 ON leaves.g = m0.lang)""")
    for i, (t, g, p, j) in enumerate([("ns", "f.g", "f.p", j) for j in range(levels)] + [("ms", "''", "f.gp", j) for j in range(group_levels)]):
        parts.append(f"""f{i + 1} AS (SELECT doc_id, leaf, f.g, f.p, gp, subroot, CASE WHEN s.n = 1 THEN f ELSE sha256(s.l || f || s.r) END AS f,
      CASE WHEN s.n = 1 THEN proof ELSE proof || s.l || s.r END AS proof FROM f{i} f JOIN {t}{j} s ON s.g = {g} AND s.p = {p} // {8 ** j})""")
    return f"""WITH {", ".join(parts)}
    SELECT doc_id, leaf, subroot, m{group_levels}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m{group_levels}.h AS verified
    FROM f{levels + group_levels}, m{group_levels}"""


ORACLE: dict[str, str] = {"op2_suffix_dedup": OP2_SQL, "op5_embedding_dedup": OP5_SQL, "op11_merkle": merkle_sql()}
