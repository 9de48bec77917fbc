"""Catalogue reads, species ranking, ingest and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.functions import text as X
from tidelens.operators import catalog as C
from tidelens.operators import keyed as K
from tidelens.sources import payloads as P
from tidelens.suite.registry import query


@query("prj_14_catalogue_filter", """
    SELECT beach_id FROM beaches_v WHERE (list_contains(activities, 'Surfing') OR list_contains(activities, 'Diving')) AND lower(entrance_fee) LIKE '%free%'
    AND beach_id % 6 IN (0, 1, 2, 4) AND contains(lower(translate(beach_name, 'áéíóúñ', 'aeioun')), 'playa') AND (CASE WHEN beach_id % 3 = 0 THEN 'none' ELSE 'low' END) IN ('none', 'low') AND beach_id % 4 <> 3""", "beaches_v")
def catalogue_filter(v):
    b = v.beaches.withColumn("risk_level", F.when(F.col("beach_id") % 3 == 0, "out").otherwise("low")).withColumn(
        "rating", F.when(F.col("beach_id") % 4 != 3, "good")).withColumn("is_spot", F.lit(True))
    return C.filter_beaches(b, activities=("Surfing", "Diving"), free_only=True, month=12, search=" Playá ", risks=("none", "low"), spots_only=True, ratings=("good", "epic")).select("beach_id")


@query("prj_15_list_by_region", """
    SELECT beach_name, province FROM beaches_v WHERE region = 'Samaná Peninsula' ORDER BY beach_name""", "beaches_v")
def list_by_region(v):
    return C.list_beaches(v.beaches, region="Samaná Peninsula").select("beach_name", "province")


@query("agg_21_distinct_lists", """
    SELECT 'province' AS kind, province AS value FROM beaches_v GROUP BY 2 UNION ALL SELECT DISTINCT 'activity', a FROM (SELECT unnest(activities) AS a FROM beaches_v)
    UNION ALL SELECT DISTINCT 'region', region FROM beaches_v""", "beaches_v")
def distinct_lists(v):
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), F.col(df.columns[0]).alias("value"))
    return kind(C.provinces(v.beaches), "province").unionByName(kind(C.all_activities(v.beaches), "activity")).unionByName(kind(C.regions_in_order(v.beaches), "region"))


@query("srt_04_recommendations", """
    SELECT beach_id, beach_name, CAST(rank AS INT) AS rank, other, CAST(shared AS INT) AS shared FROM (SELECT a.beach_id, a.beach_name, b.beach_name AS other, len(list_intersect(a.activities, b.activities)) AS shared,
      row_number() OVER (PARTITION BY a.beach_id ORDER BY len(list_intersect(a.activities, b.activities)) DESC, b.beach_id) AS rank
      FROM beaches_v a JOIN beaches_v b ON a.region = b.region AND a.beach_id <> b.beach_id) WHERE rank <= 3""", "beaches_v")
def recommendations(v):
    return C.recommend(v.beaches)


@query("set_03_shared_activities", """
    SELECT beach_id, CAST(len(list_intersect(activities, ['Surfing', 'Diving'])) AS INT) AS n, len(list_intersect(activities, ['Foiling'])) > 0 AS any_ FROM beaches_v""", "beaches_v")
def shared_activities(v):
    return v.beaches.select("beach_id", F.size(F.array_intersect("activities", F.array(F.lit("Surfing"), F.lit("Diving")))).alias("n"), F.arrays_overlap("activities", F.array(F.lit("Foiling"))).alias("any_"))


@query("arr_03_array_membership", """
    SELECT province, array_to_string(list_sort(list_distinct(flatten(list(activities)))), ',') AS activities, count(*) FILTER (list_contains(activities, 'Diving')) AS diving FROM beaches_v GROUP BY province""", "beaches_v")
def array_membership(v):
    pairs = v.beaches.select("province", F.explode("activities").alias("a")).distinct().groupBy("province").agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("activities"))
    return pairs.join(v.beaches.groupBy("province").agg(F.count_if(F.array_contains("activities", "Diving")).alias("diving")), "province")


@query("jon_18_translated_terms", """
    SELECT id, CASE source WHEN 'click' THEN 'pulsar' WHEN 'purchase' THEN 'compra' ELSE source END AS term FROM detections_v""", "detections_v")
def translated_terms(v):
    vocab = v.detections.select("source").distinct().withColumn("es", F.when(F.col("source") == "click", "pulsar").when(F.col("source") == "purchase", "compra")).where("es is not null")
    return C.translate_terms(v.detections, "source", vocab, "source", "es", "term").select("id", "term")


def choices(v):
    t = v.taxa.groupBy("beach").agg(F.min("taxon_id").alias("a"), F.max("taxon_id").alias("b"))
    return t.select("beach", F.array("b", "a", "b", F.lit(-5)).alias("pinned"), F.when(F.col("beach") % 2 == 0, F.array("a")).otherwise(F.array(F.lit(-1))).cast("array<bigint>").alias("hidden"))


RANK = """
    ch AS (SELECT beach, min(taxon_id) AS a, max(taxon_id) AS b FROM taxa_v GROUP BY 1),
    vis AS (SELECT t.*, CASE WHEN taxon_id = b THEN 1 WHEN taxon_id = a THEN 2 END AS pin, CASE WHEN NOT photo THEN 2 WHEN marine THEN 0 ELSE 1 END AS tier
      FROM taxa_v t JOIN ch USING (beach) WHERE NOT (beach % 2 = 0 AND taxon_id = a)),
    pins AS (SELECT beach, count(*) AS n_pin FROM vis WHERE pin IS NOT NULL GROUP BY 1),
    pg AS (SELECT beach, "group", count(*) AS n FROM vis WHERE pin IS NOT NULL GROUP BY 1, 2),
    oth AS (SELECT v.*, row_number() OVER (PARTITION BY v.beach, v."group" ORDER BY tier, observation_count DESC, name) AS gr FROM vis v WHERE pin IS NULL),
    elig AS (SELECT o.*, gr <= (CASE WHEN o."group" = 'Plantae' THEN 1 ELSE 2 END) - coalesce(pg.n, 0) AS may, greatest(0, 3 - coalesce(n_pin, 0)) AS free
      FROM oth o LEFT JOIN pg ON pg.beach = o.beach AND pg."group" = o."group" LEFT JOIN pins ON pins.beach = o.beach),
    lead AS (SELECT *, row_number() OVER (PARTITION BY beach, may ORDER BY tier, observation_count DESC, name) AS ln FROM elig),
    blk AS (SELECT beach, taxon_id, name, "group", observation_count, tier, NULL AS pin, CASE WHEN may AND ln <= free THEN 1 ELSE 2 END AS block FROM lead
      UNION ALL SELECT beach, taxon_id, name, "group", observation_count, tier, pin, 0 FROM vis WHERE pin IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY beach ORDER BY block, pin, tier, observation_count DESC, name) AS rank FROM blk)"""


@query("win_10_species_ranking", f"""
    WITH {RANK} SELECT beach, CAST(rank AS INT) AS rank, taxon_id, name, "group" FROM ranked WHERE rank <= 8""", "taxa_v")
def species_ranking(v):
    return C.rank_taxa(v.taxa, choices(v), "beach").select("beach", "rank", "taxon_id", "name", "group")


@query("win_09_candidates_per_beach", """
    SELECT beach, taxon_id, CAST(rank AS INT) AS rank FROM (SELECT beach, taxon_id, row_number() OVER (PARTITION BY beach ORDER BY observation_count DESC, taxon_id) AS rank FROM taxa_v) WHERE rank <= 12""", "taxa_v")
def candidates_per_beach(v):
    return K.top_n(v.taxa, ["beach"], [F.desc("observation_count"), F.col("taxon_id")], 12).select("beach", "taxon_id", "rank")


@query("set_05_first_order_distinct", """
    SELECT beach, array_to_string([b, a, -5], ',') AS pinned FROM (SELECT beach, min(taxon_id) AS a, max(taxon_id) AS b FROM taxa_v GROUP BY 1)""", "taxa_v")
def first_order(v):
    return choices(v).select("beach", F.array_join(F.transform(F.array_distinct("pinned"), lambda x: x.cast("string")), ",").alias("pinned"))


@query("scl_16_marine_override", """
    SELECT taxon_id, beach, CASE WHEN taxon_id % 50 = 0 THEN taxon_id % 100 = 0 ELSE marine END AS marine FROM taxa_v""", "taxa_v")
def marine_override(v):
    over = v.table("part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("taxon_id"), (F.col("p_partkey") % 100 == 0).alias("marine"))
    return C.effective_marine(v.taxa, over).select("taxon_id", "beach", "marine")


@query("jon_24_beach_species", """
    SELECT t.beach, t.taxon_id, CASE WHEN p_partkey % 50 = 0 THEN p_partkey % 100 = 0 ELSE p_size % 3 = 0 END AS marine, CASE WHEN (t.beach + t.taxon_id) % 7 = 0 THEN 'note ' || t.taxon_id END AS blurb
    FROM taxa_v t JOIN part ON p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1000000000 ELSE 0 END = t.taxon_id""", "taxa_v")
def beach_species(v):
    """Every eleventh taxon stands under an id that no beach refers to."""
    part = v.table("part")
    moved = F.col("p_partkey") + F.when(F.col("p_partkey") % 11 == 0, 1_000_000_000).otherwise(0)
    taxa = part.select(moved.alias("taxon_id"), (F.col("p_size") % 3 == 0).alias("marine"))
    over = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("taxon_id"), (F.col("p_partkey") % 100 == 0).alias("marine"))
    refs = v.taxa.select("beach", "taxon_id")
    notes = refs.where("(beach + taxon_id) % 7 = 0").select("beach", "taxon_id", F.concat(F.lit("note "), F.col("taxon_id").cast("string")).alias("blurb"))
    return C.beach_species(refs, taxa, over, notes).select("beach", "taxon_id", "marine", "blurb")


@query("jon_25_dangling_references", """
    WITH r AS (SELECT DISTINCT l_partkey * 2 AS k FROM lineitem), s AS (SELECT p_partkey * 3 AS k FROM part)
    SELECT k AS taxon_id, 'dangling reference' AS problem FROM r WHERE k NOT IN (SELECT k FROM s)
    UNION ALL SELECT k, 'not referenced' FROM s WHERE k NOT IN (SELECT k FROM r)""")
def dangling(v):
    """Keys times two against keys times three, so that either side has some the other lacks."""
    refs = v.table("lineitem").select((F.col("l_partkey") * 2).alias("taxon_id"))
    stored = v.table("part").select((F.col("p_partkey") * 3).alias("taxon_id"))
    return K.dangling(refs, stored, "taxon_id")


@query("set_04_key_difference", """
    SELECT p_partkey AS taxon_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey * 2 FROM lineitem)""")
def key_difference(v):
    refs = v.table("lineitem").select((F.col("l_partkey") * 2).alias("taxon_id"))
    stored = v.table("part").select(F.col("p_partkey").alias("taxon_id"))
    return K.dangling(refs, stored, "taxon_id").where("problem = 'not referenced'").select("taxon_id")


@query("set_02_union_of_keys", """
    SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT o_custkey % 60 FROM orders""")
def union_of_keys(v):
    return K.union_keys(v.table("customer").select(F.col("c_nationkey").cast("bigint").alias("k")), v.table("supplier").select(F.col("s_nationkey").cast("bigint").alias("k")),
                        v.table("orders").select((F.col("o_custkey") % 60).alias("k")))


@query("set_06_overlay", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer""")
def overlay(v):
    old = v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"))
    return K.overlay(old, old.where("k % 5 = 0").withColumn("value", F.lit("new")), ["k"])


@query("set_08_orphan_files", """
    SELECT 'f' || p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT l_partkey * 3 FROM lineitem)""")
def orphan_files(v):
    used = v.table("lineitem").select(F.concat(F.lit("f"), (F.col("l_partkey") * 3).cast("string")).alias("file"))
    return C.orphan_files(used, v.table("part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file")))


@query("prj_24_fresh_beaches", """
    SELECT l_suppkey AS beach, bool_and(coalesce(p_partkey % 13 <> 0 AND date_diff('day', DATE '2024-01-01' + CAST(p_partkey % 20 AS INT), DATE '2024-02-05') <= 34, FALSE)) AS fresh
    FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1""")
def fresh_beaches(v):
    refs = v.table("lineitem").select(F.col("l_suppkey").alias("beach"), F.col("l_partkey").alias("taxon_id")).distinct()
    taxa = v.table("part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("taxon_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 20).cast("int")).cast("string").alias("fetched_at"))
    return C.fresh_beaches(refs, taxa, F.lit("2024-02-05").cast("date"), 34)


@query("prj_28_selected_and_unknown", """
    SELECT beach_id, TRUE AS known FROM beaches_v WHERE beach_id % 4 = 0 UNION ALL SELECT s_suppkey + 100000, FALSE FROM supplier WHERE s_suppkey % 10 = 0""", "beaches_v")
def selected(v):
    wanted = v.table("supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("beach_id")).unionByName(
        v.table("supplier").where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 100000).alias("beach_id")))
    have, missing = K.select_known(v.beaches, wanted, "beach_id")
    return have.select("beach_id", F.lit(True).alias("known")).unionByName(missing.select("beach_id", F.lit(False).alias("known")))


def species_bodies(v):
    k = F.col("taxon_id")
    photo = lambda host, lic: F.struct(k.alias("id"), lic.alias("license_code"), F.concat(F.lit(f"https://{host}/photos/"), k.cast("string"), F.lit("/square.jpg")).alias("square_url"), F.lit("x").alias("attribution"), F.lit("Ana").alias("attribution_name"))
    lic = F.when(k % 3 == 0, "cc-by").when(k % 3 == 1, "cc-by-nc").otherwise("cc0")
    body = F.struct(F.when(k % 17 != 0, F.col("observation_count")).otherwise(0).alias("count"), F.struct(
        F.when(k % 19 != 0, k).alias("id"), F.concat(F.lit("<i>"), F.col("name"), F.lit("</i>")).alias("name"), F.col("name").alias("preferred_common_name"), F.lit("").alias("english_common_name"), F.col("group").alias("iconic_taxon_name"),
        photo(X.IMAGE_HOST, lic).alias("default_photo")).alias("taxon"))
    return v.taxa.select("beach", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


OKTAX = "taxon_id % 17 <> 0 AND taxon_id % 19 <> 0"


@query("src_10_species_counts", f"""
    SELECT beach, taxon_id, name AS scientific_name, upper(substr(name, 1, 1)) || substr(name, 2) AS name_es, observation_count FROM taxa_v WHERE {OKTAX}""", "taxa_v")
def species_counts(v):
    return P.species_counts(species_bodies(v)).select("beach", "taxon_id", "scientific_name", "name_es", "observation_count")


def details(v):
    k = F.col("p_partkey")
    st = lambda g, pid: F.struct(g.alias("geoprivacy"), F.lit(None).cast("struct<id:bigint>").alias("place"), pid.cast("bigint").alias("place_id"))
    status = F.when(k % 5 == 0, F.array(st(F.lit("obscured"), F.lit(6931)))).when(k % 5 == 1, F.array(st(F.lit("private"), F.lit(1)))).when(k % 5 == 2, F.array(st(F.lit("obscured"), F.lit(None)))).when(
        k % 5 == 3, F.array(st(F.lit("open"), F.lit(6931))))
    photo = F.struct(F.struct((k + 7).alias("id"), F.when(k % 2 == 0, "cc-by-sa").otherwise("arr").alias("license_code"), F.concat(F.lit(f"https://{X.IMAGE_HOST}/photos/"), (k + 7).cast("string"), F.lit("/square.png")).alias("square_url"),
                              F.lit("Luis").alias("attribution"), F.lit(None).cast("string").alias("attribution_name"), F.lit("unread").alias("extra")).alias("photo"))
    return v.table("part").select(k.alias("taxon_id"), status.alias("conservation_statuses"), F.array(photo).alias("taxon_photos"), F.lit("unread").alias("summary"))


@query("src_11_slim_details", """
    SELECT p_partkey AS taxon_id, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST(1 AS INT) END AS statuses, p_partkey + 7 AS photo_id FROM part""")
def slim_details(v):
    return P.slim_details(details(v)).select("taxon_id", F.size("conservation_statuses").alias("statuses"), F.col("taxon_photos")[0]["id"].alias("photo_id"))


@query("prj_19_privacy_reason", """
    SELECT p_partkey AS taxon_id, CASE p_partkey % 5 WHEN 0 THEN 'status' WHEN 2 THEN 'status' WHEN 4 THEN 'lookup_failed' END AS reason FROM part""")
def privacy_reason(v):
    none = F.lit(None).cast("struct<geoprivacy:string,place:struct<id:bigint>,place_id:bigint>")
    return details(v).select("taxon_id", P.privacy_reason(F.col("conservation_statuses"), none).alias("reason"))


def eligible(v):
    c = P.species_counts(species_bodies(v)).join(P.slim_details(details(v)), "taxon_id", "left")
    return (c.withColumn("reason", P.privacy_reason(F.col("conservation_statuses"), F.col("summary_status"))).withColumn("photo", P.choose_photo(F.col("default_photo"), F.col("taxon_photos")))
            .withColumn("off_bucket", P.off_bucket(F.col("default_photo")).cast("int")).withColumn("marine", F.col("taxon_id") % 4 == 0))


@query("prj_20_chosen_photo", f"""
    SELECT beach, taxon_id, CASE WHEN taxon_id % 3 <> 1 THEN 'default_photo' WHEN taxon_id % 2 = 0 THEN 'taxon_photos' END AS origin, CASE WHEN taxon_id % 3 <> 1 THEN 'Ana' WHEN taxon_id % 2 = 0 THEN 'Luis' END AS attribution FROM taxa_v WHERE {OKTAX}""", "taxa_v")
def chosen_photo(v):
    return eligible(v).select("beach", "taxon_id", "photo.origin", "photo.attribution")


@query("agg_22_ingest_summary", f"""
    WITH t AS (SELECT *, CASE taxon_id % 5 WHEN 0 THEN 'status' WHEN 2 THEN 'status' WHEN 4 THEN 'lookup_failed' END AS reason FROM taxa_v WHERE {OKTAX})
    SELECT beach, count(*) AS total, count(*) FILTER (reason IS NULL) AS eligible, count(*) FILTER (reason = 'status') AS excluded_status, count(*) FILTER (reason = 'lookup_failed') AS excluded_lookup,
      count(*) FILTER (reason IS NULL AND taxon_id % 3 <> 1) AS photos_default, count(*) FILTER (reason IS NULL AND taxon_id % 3 = 1 AND taxon_id % 2 = 0) AS photos_listed,
      count(*) FILTER (reason IS NULL AND taxon_id % 4 = 0) AS marine, CAST(0 AS BIGINT) AS off_bucket FROM t GROUP BY beach""", "taxa_v")
def ingest_summary(v):
    return P.ingest_summary(eligible(v))


@query("src_12_marine_tags", """
    SELECT name, flag AS marine FROM (SELECT name, flag, row_number() OVER (PARTITION BY name ORDER BY o DESC) AS rn FROM (
      SELECT 'sp' || (l_partkey % 300) AS name, l_orderkey * 10 + l_linenumber + l_partkey * 1000000 AS o, l_quantity > 25 OR l_discount > 0.05 AS flag FROM lineitem
      UNION ALL SELECT 'ac' || (l_suppkey % 40), l_orderkey * 10 + l_linenumber + l_partkey * 1000000, l_quantity > 25 OR l_discount > 0.05 FROM lineitem)) WHERE rn = 1""")
def marine_tags(v):
    x = v.lineitem.select(F.concat(F.lit("sp"), (F.col("l_partkey") % 300).cast("string")).alias("scientificName"), F.concat(F.lit("ac"), (F.col("l_suppkey") % 40).cast("string")).alias("acceptedNameUsage"),
                          (F.col("l_quantity") > 25).alias("is_marine"), F.when(F.col("l_discount") > 0.05, True).alias("is_brackish"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") * 1000000).alias("o"))
    return P.marine_tags(x, "o")


@query("prj_30_lookup_provenance", """
    SELECT taxon_id, beach, marine AND taxon_id % 7 <> 0 AND taxon_id % 5 = 1 AS marine, CASE WHEN taxon_id % 7 <> 0 THEN 'obis' END AS marine_source FROM taxa_v""", "taxa_v")
def lookup_provenance(v):
    c = v.taxa.select("taxon_id", "beach", F.col("name").alias("scientific_name"))
    names = v.taxa.select("taxon_id", "name", "marine").dropDuplicates(["taxon_id"])
    tags = names.where("taxon_id % 5 = 1").select("name", "marine")
    looked = names.where("taxon_id % 7 <> 0").select(F.col("name").alias("scientific_name"))
    return P.tag_marine(c, tags, looked, F.lit("2024-01-01")).select("taxon_id", "beach", "marine", "marine_source")


def media(v):
    k, p = F.col("page_id"), F.col("page_id").cast("string")
    lic = F.when(k % 7 == 3, "Public domain").when(k % 7 == 4, "CC BY 2.0").otherwise("CC BY 4.0")
    return v.table("pages").select(
        "page_id", F.concat(F.lit("File:P "), p).alias("title"), F.when(k % 7 == 0, "image/tiff").otherwise("image/jpeg").alias("mime"), F.when(k % 7 == 1, 700).otherwise(1200).alias("width"), F.lit(900).alias("height"),
        F.concat(F.when(k % 7 == 2, "https://example.org/wiki/File:P_").otherwise("https://commons.wikimedia.org/wiki/File:P_"), p).alias("descriptionurl"),
        F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P_"), p, F.when(k % 7 == 6, ".jpg/640px-P.jpg").otherwise(".jpg/500px-P.jpg")).alias("thumburl"), F.when(k % 7 == 6, 640).otherwise(500).alias("thumbwidth"),
        lic.alias("license_name"), F.when(k % 7 == 3, "https://example.org").otherwise("https://creativecommons.org/licenses/by/4.0/").alias("license_url"), F.lit("<b>Ana</b>").alias("artist"), F.lit("2019-05-01").alias("date_text"))


@query("src_13_media_pages", """
    SELECT page_id, CASE page_id % 7 WHEN 5 THEN 'candidate' WHEN 4 THEN 'manual' ELSE 'refused' END AS status, CASE page_id % 7 WHEN 0 THEN 'file type' WHEN 1 THEN 'under 800 px wide' WHEN 2 THEN 'bad file page URL'
      WHEN 3 THEN 'licence not allowed' WHEN 4 THEN 'manual check' WHEN 6 THEN 'non-standard thumbnail width' END AS reason, CAST(2019 AS INT) AS year FROM pages""")
def media_pages(v):
    return P.media_pages(media(v), 2026).select("page_id", "status", "reason", "year")


@query("agg_23_candidate_report", """
    WITH s AS (SELECT page_id % 8 AS beach, CASE page_id % 7 WHEN 5 THEN 'tagged' WHEN 4 THEN 'manual' ELSE 'refused' END AS status FROM pages), g AS (SELECT beach, status, count(*) AS n FROM s GROUP BY 1, 2),
    c AS (SELECT *, CASE WHEN status = 'tagged' THEN least(n, 3) ELSE n END AS kept FROM g)
    SELECT beach, status, n, kept, n - kept AS over FROM c UNION ALL SELECT NULL, status, sum(n)::BIGINT, sum(kept)::BIGINT, sum(n - kept)::BIGINT FROM c GROUP BY status""")
def candidate_report(v):
    m = P.media_pages(media(v), 2026).select((F.col("page_id") % 8).alias("beach"), F.when(F.col("status") == "candidate", "tagged").otherwise(F.col("status")).alias("status"))
    return C.candidate_report(m, 3)


@query("src_14_merged_pages", """
    SELECT l_orderkey AS pageid, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS categories, CAST(arg_min(l_partkey, o) AS BIGINT) AS rank FROM (SELECT *, l_linenumber * 100000000 + l_partkey AS o FROM lineitem) GROUP BY 1""")
def merged_pages(v):
    x = v.lineitem.select(F.col("l_orderkey").alias("pageid"), F.array(F.concat("l_returnflag", "l_linestatus")).alias("categories"), F.lit("t").alias("title"), F.col("l_partkey").alias("rank"),
                          (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("o"))
    return P.merge_pages(x, "o").select("pageid", F.array_join(F.array_sort("categories"), ",").alias("categories"), "rank")


@query("src_15_versioned_documents", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 3 = 1""")
def versioned(v):
    ver = F.when(F.col("event_id") % 3 == 1, "1").when(F.col("event_id") % 3 == 2, "2").otherwise('"x"')
    body = F.concat(F.lit('{"schema_version": '), ver, F.lit(', "taxa": '), F.col("props"), F.lit("}"))
    return P.versioned_json(v.events.select("event_id", body.alias("body")), "taxa struct<k:int>").select("event_id", "taxa.k")


@query("src_16_stored_runs", """
    SELECT id, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN id % 9 = 0 THEN 0.0 ELSE area_km2 END AS area_km2, CAST(CASE WHEN id % 2 = 0 THEN date_trunc('second', observed_at) ELSE run_at END AS VARCHAR) AS observed_at
    FROM detections_v WHERE run_at >= TIMESTAMP '2024-01-10 00:00:00' AND id % 11 <> 0""", "detections_v")
def stored_runs(v):
    d = v.detections.select("id", "run_at", F.when(F.col("id") % 9 != 0, F.col("area_km2")).alias("area_km2"), F.lit(None).cast("double").alias("covered_km2"), "source",
                            F.when(F.col("id") % 2 == 0, F.date_trunc("second", "observed_at")).alias("observed_at"),
                            F.when(F.col("id") % 11 == 0, "POLYGON((0 0))").otherwise(F.concat(F.lit("SRID=4326;POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))).alias("centroid"))
    s = P.stored_runs(d, F.lit("2024-01-10").cast("timestamp"))
    return s.select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "area_km2", F.col("observed_at").cast("string").alias("observed_at"))


@query("agg_30_retention_merge", """
    WITH old AS (SELECT beach, taxon_id FROM taxa_v WHERE taxon_id % 2 = 0), nw AS (SELECT beach, taxon_id FROM taxa_v WHERE beach % 3 = 0 AND taxon_id % 3 = 0),
    refs AS (SELECT * FROM old WHERE beach NOT IN (SELECT beach FROM nw) UNION ALL SELECT * FROM nw)
    SELECT p_partkey AS taxon_id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN 'pn' WHEN p_partkey % 2 = 0 THEN 'po' END AS photo
    FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey IN (SELECT taxon_id FROM refs)""", "taxa_v")
def retention_merge(v):
    refs = v.taxa.select("beach", "taxon_id")
    part = v.table("part").select(F.col("p_partkey").alias("taxon_id"))
    old_t = part.where("taxon_id % 2 = 0").select("taxon_id", F.lit("old").alias("v"), F.lit("po").alias("photo"))
    new_t = part.where("taxon_id % 3 = 0").select("taxon_id", F.lit("new").alias("v"), F.when(F.col("taxon_id") % 4 == 0, "pn").alias("photo"))
    return C.merge_species(refs.where("taxon_id % 2 = 0"), refs.where("beach % 3 = 0 and taxon_id % 3 = 0"), old_t, new_t)[1]


@query("arr_04_record_problems", """
    SELECT p_partkey AS taxon_id, unnest(list_filter([CASE WHEN p_partkey % 4 = 1 THEN 'taxon.method: not an allowed method here' END, CASE WHEN p_partkey % 5 = 2 THEN 'taxon.fetched_at: must be an ISO date' END,
      CASE WHEN p_partkey % 6 = 3 THEN 'taxon.scientific_name: has markup or control characters' WHEN p_partkey % 6 = 4 THEN 'taxon.scientific_name: must be non-empty text' WHEN p_partkey % 6 = 5 THEN 'taxon.scientific_name: 100 chars exceeds the 80 budget' END], lambda x: x IS NOT NULL)) AS problem FROM part""")
def record_problems(v):
    k = F.col("p_partkey")
    r = F.struct(k.alias("taxon_id"), F.lit(True).alias("marine"), F.when(k % 4 == 1, "hand").otherwise("api:inaturalist").alias("method"), F.when(k % 5 == 2, "2024-13-01").otherwise("2024-01-01").alias("fetched_at"),
                 F.lit("Aves").alias("iconic_group"), F.when(k % 6 == 3, "<b>").when(k % 6 == 4, "  ").when(k % 6 == 5, F.repeat(F.lit("x"), 100)).otherwise("ok").alias("scientific_name"))
    return C.explode_problems(v.table("part").select(k.alias("taxon_id"), C.taxon_problems(r).alias("problems")), ["taxon_id"])


@query("arr_04_key_problems", """
    SELECT event_id, problem FROM (SELECT event_id, unnest(list_filter(['rec: missing b', CASE WHEN event_id % 2 = 0 THEN 'rec: unexpected key ''z''' END], lambda x: x IS NOT NULL)) AS problem FROM events)""")
def key_problems(v):
    body = F.when(F.col("event_id") % 2 == 0, '{"k": 1, "z": 2}').otherwise('{"k": 1}')
    return C.explode_problems(v.events.select("event_id", C.key_problems("rec", body, ("k", "b")).alias("problems")), ["event_id"])


@query("jon_31_prj_29_knowledge_rows", f"""
    WITH {RANK}, sp AS (SELECT beach, string_agg(name, '|' ORDER BY rank) AS species, count(*) AS n FROM ranked WHERE rank <= 8 GROUP BY 1)
    SELECT s_suppkey AS beach, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 2 = 0 THEN 'teaser' END AS teaser, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 THEN 'rock' || s_suppkey % 5 END AS rock,
      CASE WHEN s_suppkey % 3 = 0 THEN 'f' || s_suppkey END AS photo, CAST(coalesce(n, 0) AS INT) AS n_species, species, s_suppkey % 3 = 0 AS has_photo, coalesce(n, 0) > 0 AS has_life,
      s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AS has_rock, s_suppkey % 4 <> 0 AND s_suppkey % 7 = 0 AS has_history FROM supplier LEFT JOIN sp ON sp.beach = s_suppkey""", "taxa_v")
def knowledge_rows(v):
    s = v.table("supplier").select(F.col("s_suppkey").alias("beach"))
    b = F.col("beach")
    profiles = s.select("beach", (b % 5).cast("string").alias("coastal_unit"), F.when(b % 2 == 0, "teaser").alias("teaser"), F.when(b % 7 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("history"), (b % 4 != 0).alias("valid"))
    units = s.select((b % 5).cast("string").alias("coastal_unit"), F.concat(F.lit("rock"), (b % 5).cast("string")).alias("rock"), (b % 5 != 0).alias("valid")).distinct()
    photos = s.where("beach % 3 = 0").select("beach", F.concat(F.lit("f"), b.cast("string")).alias("file"), F.lit(True).alias("valid"))
    return C.knowledge_rows(s, profiles, units, C.rank_taxa(v.taxa, choices(v), "beach"), photos)
