"""Names, messages, markup, licences and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.functions import dates as D
from tidelens.functions import text as X
from tidelens.operators import catalog as C
from tidelens.suite.registry import query
from tidelens.suite.sqlbits import fold, unaccent


@query("str_01_fold", f"""
    SELECT doc_id, md5({fold('text')}) AS folded FROM documents""")
def folded(v):
    return v.table("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("str_02_accent_hint", f"""
    SELECT beach_id, array_to_string(list_transform(list_filter(string_split(beach_name, ' '), lambda w: {unaccent('w')} <> w), lambda w: {unaccent('w')}), ' ') AS hint FROM beaches_v""", "beaches_v")
def accent_hint(v):
    return v.beaches.select("beach_id", X.accent_hint(F.col("beach_name")).alias("hint"))


@query("str_03_slug", f"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower({unaccent('url')}), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages""")
def slug(v):
    return v.table("pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query("str_04_words", f"""
    SELECT item_id, array_to_string(regexp_extract_all(lower({unaccent('text')}), '[\\p{{L}}\\p{{N}}]+'), ' ') AS words FROM benchmark""")
def words(v):
    return v.table("benchmark").select("item_id", F.array_join(X.words(F.col("text")), " ").alias("words"))


@query("str_04_document_word_counts", f"""
    SELECT lang, sum(len(regexp_extract_all(lower({unaccent('text')}), '[\\p{{L}}\\p{{N}}]+')))::BIGINT AS words FROM documents GROUP BY lang""")
def document_words(v):
    return v.table("documents").groupBy("lang").agg(F.sum(F.size(X.words(F.col("text")))).alias("words"))


@query("str_05_contiguous_words", f"""
    SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower({unaccent('text')}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' of the ')""")
def contiguous(v):
    return v.table("documents").where(X.contains_run(X.words(F.col("text")), F.array(F.lit("of"), F.lit("the")))).select("doc_id")


CATS = "list_value('Playas de ' || province, beach_name || ' ' || province, CASE beach_id % 4 WHEN 0 THEN 'Hotels' WHEN 1 THEN 'Sea' WHEN 2 THEN 'Diving sites' ELSE 'Liverpool' END)"


@query("str_06_category_class", """
    SELECT beach_id, CASE WHEN beach_id % 3 = 0 THEN CASE WHEN beach_id % 4 IN (0, 2) THEN 'mixed' ELSE 'tagged' END
      WHEN beach_id % 3 = 1 THEN CASE WHEN beach_id % 4 IN (0, 2) THEN 'mixed' ELSE 'tagged' END ELSE 'not_tagged' END AS kind FROM beaches_v""", "beaches_v")
def category_class(v):
    b = v.beaches.join(C.name_rules(v.beaches), "beach_name")
    k = F.col("beach_id")
    extra = F.when(k % 4 == 0, "Hotels").when(k % 4 == 1, "Sea").when(k % 4 == 2, "Diving sites").otherwise("Liverpool")
    first = F.when(k % 3 == 0, "Playas of somewhere").when(k % 3 == 1, F.concat(F.lit("View of "), F.col("beach_name"), F.lit(" at dawn"))).otherwise("Road 5")
    return b.select("beach_id", X.classify_categories(F.array(first, extra), F.col("words"), F.col("context")).alias("kind"))


@query("str_07_beach_match", f"""
    WITH q AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN 'rincon ' || (id % 60) WHEN 1 THEN 'PLAYA Cosón ' || (id % 60) ELSE 'cayo levantado ' || (id % 7) END AS q FROM detections_v),
    f AS (SELECT q, trim(regexp_replace({fold('q')}, '^playa ', '')) AS k FROM q),
    n AS (SELECT beach_name AS n, {fold('beach_name')} AS f, regexp_replace({fold('beach_name')}, '^playa ', '') AS g FROM beaches_v),
    m AS (SELECT q, count(*) FILTER (k = f OR k = g) AS ne, max(n) FILTER (k = f OR k = g) AS e, count(*) FILTER (contains(f, k)) AS np, max(n) FILTER (contains(f, k)) AS p,
      list(n ORDER BY n) FILTER (k = f OR k = g) AS le, list(n ORDER BY n) FILTER (contains(f, k)) AS lp FROM f, n GROUP BY q)
    SELECT q, CASE WHEN ne = 1 THEN 'exact' WHEN np = 1 THEN 'partial' WHEN ne > 0 OR np > 0 THEN 'ambiguous' ELSE 'unknown' END AS status,
      CASE WHEN ne = 1 THEN e WHEN np = 1 THEN p END AS "match", CASE WHEN ne = 1 OR np = 1 THEN '' WHEN ne > 0 THEN array_to_string(le[1:8], '|') ELSE coalesce(array_to_string(lp[1:8], '|'), '') END AS candidates FROM m""", "detections_v beaches_v")
def beach_match(v):
    k = F.col("id")
    text = (F.when(k % 3 == 0, F.concat(F.lit("rincon "), (k % 60).cast("string"))).when(k % 3 == 1, F.concat(F.lit("PLAYA Cosón "), (k % 60).cast("string")))
            .otherwise(F.concat(F.lit("cayo levantado "), (k % 7).cast("string"))))
    return C.match_names(v.detections.select(text.alias("q")), "q", v.beaches, "beach_name").withColumn("candidates", F.array_join("candidates", "|"))


@query("srt_06_ambiguous_candidates", f"""
    WITH q AS (SELECT DISTINCT CASE id % 2 WHEN 0 THEN 'rincon' ELSE 'aguila' END AS q FROM detections_v), n AS (SELECT beach_name AS n, {fold('beach_name')} AS f FROM beaches_v)
    SELECT q, array_to_string(list(n ORDER BY n)[1:8], '|') AS candidates FROM q, n WHERE contains(f, q) GROUP BY q""", "detections_v beaches_v")
def ambiguous(v):
    q = v.detections.select(F.when(F.col("id") % 2 == 0, "rincon").otherwise("aguila").alias("q"))
    return C.match_names(q, "q", v.beaches, "beach_name").select("q", F.array_join("candidates", "|").alias("candidates"))


@query("str_08_amount_words", """
    SELECT id, CASE id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'high' END AS level FROM detections_v""", "detections_v")
def amount_words(v):
    ws = F.array(*[F.lit(x) for x in ("Limpia", "POQUITO", "moderado", "muchísimo", "High", "enough")])
    return v.detections.select("id", X.amount_level(F.get(ws, (F.col("id") % 6).cast("int"))).alias("level"))


@query("str_09_report_messages", """
    SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'high' WHEN 4 THEN 'none' END AS amount,
      CASE WHEN conv_id % 5 = 3 THEN NULL WHEN turn % 7 = 0 THEN 'Rincon ' || (conv_id % 40) ELSE 'Cosón ' || (conv_id % 40) END AS beach
    FROM conversations WHERE turn % 7 IN (0, 3)""")
def report_messages(v):
    m = v.messages.where(X.command_of(F.col("text")) == "report")
    r = X.parse_report(F.col("text"))
    return m.select("conv_id", "turn", r["amount"].alias("amount"), r["beach"].alias("beach"))


@query("str_10_command_routing", """
    SELECT CASE turn % 7 WHEN 0 THEN 'report' WHEN 1 THEN 'subscribe' WHEN 2 THEN 'status' WHEN 3 THEN 'report' WHEN 4 THEN 'stop' WHEN 5 THEN 'start' ELSE 'unknown' END AS command, count(*) AS n
    FROM conversations GROUP BY 1""")
def command_routing(v):
    return v.messages.groupBy(X.command_of(F.col("text")).alias("command")).agg(F.count("*").alias("n"))


@query("jon_23_typed_zone_names", """
    SELECT conv_id, turn, (SELECT min(zone_id) FROM zones_v z WHERE contains(lower(z.name), CASE conv_id % 4 WHEN 0 THEN 'an' WHEN 1 THEN 'ira' WHEN 2 THEN 'zzz' ELSE 'unit' END)) AS zone_id
    FROM conversations WHERE turn % 7 = 1""", "zones_v")
def typed_zones(v):
    m = v.messages.where(X.command_of(F.col("text")) == "subscribe").withColumn("typed", F.substring_index(F.trim("text"), " ", -1))
    return C.resolve_zone_names(m, "typed", v.zones).select("conv_id", "turn", "zone_id")


@query("str_11_clean_text", """
    SELECT page_id, md5(coalesce(nullif(trim(substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[<>\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100000000)), ''), '')) AS text FROM pages""")
def clean_text(v):
    return v.table("pages").select("page_id", F.md5(F.coalesce(X.clean_text(F.col("html"), 100_000_000), F.lit(""))).alias("text"))


HTML = ("trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), "
        "'<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\xa0]+', ' ', 'g'))")


@query("str_12_strip_html_sql", f"""
    SELECT page_id, md5({HTML}) AS text FROM pages""")
def strip_html_sql(v):
    return v.table("pages").select("page_id", F.md5(X.strip_html_sql(F.col("html"))).alias("text"))


# Written apart from the expression: markup out step by step, then the entities that the pages hold, "&" last.
BARE = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?(</script\\s*>|\\z)', ' ', 'gis'), '<style\\b[^>]*>.*?(</style\\s*>|\\z)', ' ', 'gis'), "
        "'<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')")
for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0")):
    BARE = f"regexp_replace({BARE}, '&{name};', '{char}', 'g')"


@query("str_12_strip_html_parser", f"""
    SELECT page_id, length(t) AS chars, md5(t) AS text FROM (
      SELECT page_id, trim(regexp_replace(regexp_replace({BARE}, '&amp;?', '&', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g')) AS t FROM pages)""")
def strip_html(v):
    """The text that markup leaves, every entity decoded."""
    bare = v.table("pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return bare.select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("text"))


@query("str_13_author_text", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'Ana & Co ' || page_id END AS author FROM pages""")
def author_text(v):
    p = F.col("page_id").cast("string")
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.repeat(F.lit("long name "), 20), p)).otherwise(F.concat(F.lit('<a href="x">Ana</a> &amp;\n<b>Co</b> '), p))
    return v.table("pages").select("page_id", X.parse_author(html).alias("author"))


@query("str_14_photo_year", """
    SELECT id, CASE WHEN id % 5 = 0 THEN CAST(1950 + id % 70 AS INT) WHEN id % 5 = 4 AND (1900 + id % 200) <= 2026 THEN CAST(1900 + id % 200 AS INT) END AS year FROM detections_v""", "detections_v")
def photo_year(v):
    k = F.col("id")
    a, b = (F.lit(1950) + k % 70).cast("string"), (F.lit(1900) + k % 200).cast("string")
    text = (F.when(k % 5 == 0, F.concat(a, F.lit("-05-01"))).when(k % 5 == 1, F.concat(F.lit("circa "), a)).when(k % 5 == 2, F.concat(a, F.lit(" to 1800")))
            .when(k % 5 == 3, F.concat(F.lit("no"), a, F.lit("x"))).otherwise(F.concat(F.lit("taken "), b, F.lit(", "), b)))
    return v.detections.select("id", X.parse_year(text, 2026).alias("year"))


@query("str_15_licence_decision", """
    SELECT id, CASE id % 6 WHEN 0 THEN 'cc-by-sa 4.0' WHEN 1 THEN 'cc0 1.0' END AS licence, CASE id % 6 WHEN 0 THEN 'allowed' WHEN 1 THEN 'allowed' WHEN 2 THEN 'manual' WHEN 3 THEN 'manual' WHEN 4 THEN 'manual' ELSE 'refused' END AS status
    FROM detections_v""", "detections_v")
def licence_decision(v):
    k = (F.col("id") % 6).cast("int")
    names = F.array(*[F.lit(x) for x in ("CC BY-SA 4.0", "CC0", "CC BY 3.0", "Public domain", "CC BY 2.0", "CC BY-NC 4.0")])
    urls = F.array(*[F.lit(x) for x in ("https://creativecommons.org/licenses/by-sa/4.0/deed.en", "http://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/licenses/by/4.0",
                                        "https://creativecommons.org/licenses/by/4.0/", "https://example.org/", "https://creativecommons.org/licenses/by-nc/4.0/")])
    d = X.licence_decision(F.get(names, k), F.get(urls, k))
    return v.detections.select("id", d["licence"].alias("licence"), d["status"].alias("status"))


@query("str_16_url_checks", """
    SELECT page_id, regexp_matches(url, '^https://[^\\s/?#@\\\\<>"]+([/?#][^\\s\\\\<>"]*)?$') AND NOT regexp_matches(url, '^https://[^/?#]*:[^0-9/?#]') AND length(url) <= 300 AS safe,
      CASE page_id % 4 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P_' || page_id || '.jpg/500px-P.jpg' END AS thumb,
      CASE page_id % 4 WHEN 1 THEN 'no usable thumbnail URL' WHEN 2 THEN 'non-standard thumbnail width' WHEN 3 THEN 'no usable thumbnail URL' END AS reason FROM pages""")
def url_checks(v):
    k, p = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = lambda px: F.concat(F.lit("/wikipedia/commons/thumb/a/ab/P_"), p, F.lit(f".jpg/{px}px-P.jpg"))
    url = (F.when(k == 0, F.concat(F.lit("https://thumb.wikimedia.org"), path(500))).when(k == 1, F.concat(F.lit("https://evil.org"), path(500)))
           .when(k == 2, F.concat(F.lit("https://upload.wikimedia.org"), path(640))).otherwise(F.concat(F.lit("http://upload.wikimedia.org"), path(500))))
    t = X.thumbnail(url, F.when(k == 2, 640).otherwise(500))
    return v.table("pages").select("page_id", X.is_safe_url(F.col("url")).alias("safe"), t["url"].alias("thumb"), t["reason"].alias("reason"))


@query("str_17_file_titles", """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'File:Beach photo ' || page_id || '.jpg' END AS title FROM pages""")
def file_titles(v):
    p = F.col("page_id").cast("string")
    t = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" File:beach_photo_"), p, F.lit(".jpg "))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("File:a|b"), p)).otherwise(F.concat(F.lit("Image:x"), p)))
    return v.table("pages").select("page_id", X.file_title(t).alias("title"))


@query("str_19_links", """
    SELECT beach_id, 'https://www.google.com/maps/search/?api=1&query=' || printf('%.2f', latitude) || ',' || printf('%.2f', longitude) AS map FROM beaches_v""", "beaches_v")
def links(v):
    return v.beaches.select("beach_id", X.map_url(F.format_string("%.2f", "latitude"), F.format_string("%.2f", "longitude")).alias("map"))


@query("str_21_name_rules", f"""
    WITH b AS (SELECT beach_id, province, CASE WHEN beach_id % 2 = 0 THEN 'Playa Blanca (' || province || ' Bay)' ELSE beach_name END AS n FROM beaches_v),
    w AS (SELECT *, trim(regexp_replace(n, '\\s*\\([^)]*\\)', '', 'g')) AS base, regexp_extract(n, '\\(([^)]*)\\)', 1) AS suffix FROM b), c AS (SELECT base, count(*) AS sharing FROM w GROUP BY 1)
    SELECT n AS beach_name, {fold('base')} AS words, sharing, CASE WHEN sharing > 1 THEN {fold("replace(CASE WHEN suffix <> '' THEN suffix ELSE province END, '_', ' ')")} ELSE '' END AS context, count(*) AS rows FROM w JOIN c USING (base) GROUP BY ALL""", "beaches_v")
def name_rules(v):
    n = F.when(F.col("beach_id") % 2 == 0, F.concat(F.lit("Playa Blanca ("), F.col("province"), F.lit(" Bay)"))).otherwise(F.col("beach_name"))
    r = C.name_rules(v.beaches.withColumn("beach_name", n))
    return r.select("beach_name", F.array_join("words", " ").alias("words"), "sharing", F.array_join("context", " ").alias("context")).groupBy("beach_name", "words", "sharing", "context").agg(F.count("*").alias("rows"))


@query("agg_28_shared_names", """
    SELECT base, count(*) AS n FROM (SELECT regexp_replace(beach_name, ' [0-9]+$', '') AS base FROM beaches_v) GROUP BY base""", "beaches_v")
def shared_names(v):
    b = v.beaches.withColumn("beach_name", F.concat(F.regexp_replace("beach_name", " [0-9]+$", ""), F.lit(" ("), F.col("beach_id").cast("string"), F.lit(")")))
    base = v.beaches.select(F.regexp_replace("beach_name", " [0-9]+$", "").alias("base")).distinct().withColumn("k", F.array_join(X.words(F.col("base")), " "))
    r = C.name_rules(b).select(F.array_join("words", " ").alias("k"), F.col("sharing").alias("n")).distinct()
    return r.join(base, "k").select("base", "n")


@query("dat_06_season_months", """
    SELECT beach_id, CAST(m AS INT) AS month, CASE beach_id % 6 WHEN 0 THEN m IN (12, 1, 2, 3, 4) WHEN 1 THEN TRUE WHEN 2 THEN m IN (6, 7, 8, 12, 1, 2) WHEN 3 THEN m = 5 WHEN 4 THEN TRUE ELSE m IN (3, 4, 5, 6, 11) END AS good
    FROM beaches_v, (SELECT unnest(range(1, 13)) AS m)""", "beaches_v")
def season_months(v):
    b = v.beaches.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return b.select("beach_id", "month", D.good_in_month(F.col("best_time_to_visit"), F.col("month")).alias("good"))
