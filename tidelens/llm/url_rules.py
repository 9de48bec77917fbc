"""Allow and block decisions for addresses: written rules first, mined token rules for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import stored

BLOCK = "label=block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def written_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one replaces what came before
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of an address: each domain above and at the host, host words, path words, query keys."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.reverse(F.split(host, r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(
        F.lit("host="), F.array_join(F.reverse(F.slice(labels, 1, n)), ".")))
    words = F.transform(F.split(host, r"[.\-_]+"), lambda w: F.concat(F.lit("word="), w))
    steps = F.transform(F.split(F.lower(path), r"[/.\-_]+"), lambda w: F.concat(F.lit("path="), F.regexp_replace(w, "[0-9]+", "0")))
    keys = F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("key="), F.regexp_extract(p, "^[^=]*", 0)))
    every = F.array_distinct(F.concat(domains, words, steps, keys))
    return F.filter(every, lambda t: ~t.endswith("="))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.7) -> DataFrame:
    """Rules (tokens array, confidence, support) that tell blocked addresses, from rows (url, blocked).

    Tokens rarer than the support cannot be in a rule and go first; what stays is at most the mean
    number of tokens divided by ``min_support`` and may be listed on the driver. Whole addresses
    are mined. Tokens that are in the same rows stand as one while mining, so a repeated long
    address does not yield all its token sets, and a rule then comes once for each choice of one
    token of each such class. Rules keep confidence and support at the minimum or above. Null labels and addresses without tokens are passed over; without any
    labelled row there is no rule.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.col("blocked").isNotNull()).select(tokens_of(F.col("url")).alias("tokens"), F.col("blocked").cast("int").alias("y"))
                  .where(F.size("tokens") > 0))
    total, bad = rows.agg(F.count("*"), F.sum("y")).first()
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    if not total or not bad:
        return none
    least = min_support * total
    at = [F.xxhash64("tokens", F.lit(k)).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)]
    frequent = (rows.select(F.explode("tokens").alias("t"), "y", *at).groupBy("t")
                .agg(F.count("*").alias("n"), F.sum("y").alias("b"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
                .where((F.col("n") >= least) & (F.col("b") >= least)).collect())
    if not frequent:
        return none
    classes: dict[tuple, list[str]] = {}
    for r in sorted(frequent, key=lambda r: r["t"]):
        classes.setdefault((r["n"], r["b"], r["h1"], r["h2"]), []).append(r["t"])
    stand_in = F.lit([c[0] for c in classes.values()])
    baskets = rows.select(F.concat(F.array_intersect("tokens", stand_in), F.when(F.col("y") == 1, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets.where(F.size("items") > 0))
    same = spark.createDataFrame([(c[0], c) for c in classes.values()], "token string, alike array<string>")
    rules = (model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select("antecedent", "confidence", "support")
             .withColumn("token", F.explode("antecedent")).join(F.broadcast(same), "token")
             .groupBy("antecedent").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.collect_list("alike").alias("alike")))
    choices = F.aggregate("alike", F.array(F.array().cast("array<string>")),
                          lambda acc, alike: F.flatten(F.transform(acc, lambda own: F.transform(alike, lambda t: F.concat(own, F.array(t))))))
    return rules.select(F.explode(choices).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Distinct matched addresses with their best mined rule (confidence, then support, then text).

    Inverted index: a rule stands under its last token only (domains and words come after keys in
    order of text); an address looks up its own tokens and keeps rules whose tokens it all has.
    """
    index = rules.select(F.element_at("tokens", -1).alias("_token"), "tokens", "confidence", "support")
    seen = urls.select(F.col(url).alias("_url"), tokens_of(F.col(url)).alias("_own"))
    hits = (seen.withColumn("_token", F.explode("_own")).join(index, "_token")
            .where(F.size(F.array_except("tokens", "_own")) == 0))
    return hits.groupBy("_url").agg(F.max(F.struct("confidence", "support", F.array_join("tokens", " ").alias("rule"))).alias("_best"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], mined: DataFrame, url: str = "url") -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict and mined_rule.

    The longest written rule decides; else a matching mined rule blocks, and an address that
    matches none is allowed. Null addresses have empty host and path and are allowed. Repeated
    rows stay; ``host``, ``path``, ``rule``, ``verdict`` and ``mined_rule`` replace columns of these names.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined_rule")]
    best = match_rules(pages.where(F.col(url).isNotNull()), mined, url)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    joined = pages.select(*kept).join(best, F.col(url) == F.col("_url"), "left")
    return (joined.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("_best").isNotNull(), "block").otherwise("allow")))
            .withColumn("mined_rule", F.col("_best.rule")).drop("_url", "_best"))
