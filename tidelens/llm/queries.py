"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens.llm import (chat, collocations, decontaminate, fingerprint, language, near_dup, packing, periodic, pieces, quality, suffixes,
                          token_count, url_rules)
from tidelens.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for mining: the page's document is of low quality or toxic."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    known = pages.join(labels, pages.page_id == labels.doc_id).select(
        "url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    judged = url_rules.judge_urls(pages, URL_RULES, url_rules.mine_rules(known))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.where(~held_out()))
    scored = quality.score_quality(docs, net).withColumn("held_out", held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of turns is a tree whose messages each answer the one before."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = turns.withColumn("msg_id", n).withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn(
        "score", F.length("text"))
    return chat.read_back(chat.format_trees(messages, tree="conv_id"), tree="conv_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out()))
    found = language.detect(docs.select("doc_id", "text"), model).withColumn("held_out", held_out())
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.repeated_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.longest_run())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_url_filter, op3_quality, op4_chat_format, op5_decontamination,
                                     op6_token_counts, op7_language, op8_repeated_strings, op9_near_duplicates,
                                     op10_pieces, op11_packing, op12_periodic_runs, op13_collocations)}

_OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
l AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM l),
u AS (SELECT lang, w[i] AS phrase, '' AS head, '' AS tail, 1 AS k, w[i] AS first, w[i] AS last FROM g
      UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], w[i], w[i + 1], 2, w[i], w[i + 1] FROM g WHERE i + 1 <= len(w)
      UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], w[i] || ' ' || w[i + 1], w[i + 1] || ' ' || w[i + 2], 3, w[i], w[i + 2]
      FROM g WHERE i + 2 <= len(w)),
f AS (SELECT lang, phrase, k, head, tail, first, last, count(*) AS f FROM u GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.phrase, c.k, c.f AS a, x.cut, x.l, x.r, (1000000::HUGEINT * c.f * c.f) // (x.l::HUGEINT * x.r) AS score FROM c JOIN (
      SELECT c.lang, c.phrase, 1 AS cut, a.f AS l, b.f AS r FROM c JOIN f a ON a.lang = c.lang AND a.phrase = c.first AND a.k = 1
        JOIN f b ON b.lang = c.lang AND b.phrase = c.tail AND b.k = c.k - 1
      UNION ALL SELECT c.lang, c.phrase, 2, a.f, b.f FROM c JOIN f a ON a.lang = c.lang AND a.phrase = c.head AND a.k = 2
        JOIN f b ON b.lang = c.lang AND b.phrase = c.last AND b.k = 1 WHERE c.k = 3) x ON x.lang = c.lang AND x.phrase = c.phrase),
weak AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM weak w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = 3 AND w.k = 2 AND c.lang = w.lang
      AND (c.head = w.phrase OR c.tail = w.phrase) AND 100 * c.f >= 50 * w.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score::BIGINT AS score FROM ranked r JOIN n USING (lang) WHERE r.rank <= 2000
"""
ORACLE_SQL: dict[str, str] = {"op13_collocations": _OP13_SQL}
