"""Catalogue reads: filters, recommendations, name matching, species ranking and knowledge rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import dates as D
from tidelens.functions import risk as R
from tidelens.functions import text as X
from tidelens.operators.keyed import pick_one, top_n


def list_beaches(beaches: DataFrame, province: str | None = None, region: str | None = None) -> DataFrame:
    """PRJ-15: catalogue by optional province and region, ordered by name."""
    out = beaches
    if province:
        out = out.where(F.col("province") == province)
    if region:
        out = out.where(F.col("region") == region)
    return out.orderBy("beach_name")


def filter_beaches(beaches: DataFrame, regions: Sequence[str] = (), provinces: Sequence[str] = (),
                   activities: Sequence[str] = (), protected_only: bool = False, free_only: bool = False,
                   month: int | None = None, search: str = "", risks: Sequence[str] = (), spots_only: bool = False,
                   ratings: Sequence[str] = ()) -> DataFrame:
    """PRJ-14: conjunction of the catalogue filters. ``risk_level``, ``is_spot`` and ``rating`` are
    columns the caller joined; no rating means no match, an outside level counts as none."""
    cond = F.lit(True)
    if regions:
        cond &= F.col("region").isin(*regions)
    if provinces:
        cond &= F.col("province").isin(*provinces)
    if activities:
        cond &= F.arrays_overlap("activities", F.array(*[F.lit(a) for a in activities]))
    if protected_only:
        cond &= F.col("protected_area")
    if free_only:
        cond &= F.lower("entrance_fee").contains("free")
    if month is not None:
        cond &= D.good_in_month(F.col("best_time_to_visit"), month)
    if search.strip():
        cond &= X.fold(F.col("beach_name")).contains(X.fold(F.lit(search.strip())))
    if risks:
        level = F.coalesce(F.col("risk_level"), F.lit("none"))
        cond &= F.when(level == "out", "none").otherwise(level).isin(*risks)
    if spots_only:
        cond &= F.col("is_spot")
    if ratings:
        cond &= F.coalesce(F.col("rating").isin(*ratings), F.lit(False))
    return beaches.where(cond)


def provinces(beaches: DataFrame, regions: Sequence[str] = ()) -> DataFrame:
    """AGG-21: sorted distinct provinces, optionally of some regions."""
    src = beaches.where(F.col("region").isin(*regions)) if regions else beaches
    return src.select("province").distinct().orderBy("province")


def all_activities(beaches: DataFrame) -> DataFrame:
    """AGG-21: sorted distinct activities."""
    return beaches.select(F.explode("activities").alias("activity")).distinct().orderBy("activity")


def regions_in_order(beaches: DataFrame) -> DataFrame:
    """AGG-21: present regions in geographic order."""
    order = F.array_position(F.array(*[F.lit(r) for r in S.REGION_ORDER]), F.col("region"))
    return (beaches.select("region").distinct().withColumn("position", order.cast("int"))
            .where(F.col("position") > 0).orderBy("position"))


def recommend(beaches: DataFrame, n: int = 3) -> DataFrame:
    """SRT-04: per beach the beaches of its region sharing most activities; ties by catalogue order.

    Activities are drawn from a closed vocabulary, so beaches of a region are first grouped by
    their activity set (a few distinct sets), pairs are built between sets, and a set contributes
    only its first n+1 beaches: no all-pairs join inside a region.
    """
    sets = beaches.withColumn("acts", F.array_sort(F.array_distinct("activities")))
    heads = top_n(sets.select("region", "acts", "beach_id", "beach_name"), ["region", "acts"], [F.col("beach_id")], n + 1, "_r")
    kinds = sets.select("region", "acts").distinct()
    a = kinds.select("region", F.col("acts").alias("mine"))
    pairs = (a.join(kinds, "region")
             .withColumn("shared", F.size(F.array_intersect("mine", "acts"))))
    options = pairs.join(heads, ["region", "acts"]).select(
        "region", "mine", "shared", F.col("beach_id").alias("other_id"), F.col("beach_name").alias("other_name"))
    best = top_n(options, ["region", "mine"], [F.desc("shared"), F.col("other_id")], n + 1, "_o").drop("_o")
    lists = best.groupBy("region", "mine").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("k"), "other_id", "other_name", "shared"))).alias("opts"))
    own = sets.join(lists, (sets["region"] == lists["region"]) & (sets["acts"] == lists["mine"])).select(
        "beach_id", "beach_name",
        F.slice(F.filter("opts", lambda o: o["other_id"] != F.col("beach_id")), 1, n).alias("opts"))
    return own.select("beach_id", "beach_name", F.posexplode("opts").alias("p", "o")).select(
        "beach_id", "beach_name", (F.col("p") + 1).alias("rank"), F.col("o.other_name").alias("other"),
        F.col("o.shared").alias("shared"))


def translate_terms(rows: DataFrame, column: str, vocabulary: DataFrame, key: str, target: str, out: str) -> DataFrame:
    """JON-18: translation of a value, the value itself when the vocabulary lacks it."""
    v = vocabulary.select(F.col(key).alias(column), F.col(target).alias("_t"))
    return rows.join(v, column, "left").withColumn(out, F.coalesce("_t", column)).drop("_t")


def translate_array(column: str, vocabulary: dict[str, str]) -> Column:
    """JON-18 for arrays: translated through a literal map, empty shown as N/A."""
    pairs = [F.lit(x) for kv in vocabulary.items() for x in kv]
    m = F.create_map(*pairs)
    text = F.array_join(F.transform(column, lambda a: F.coalesce(F.try_element_at(m, a), a)), ", ")
    return F.when(F.size(F.coalesce(F.col(column), F.array())) == 0, "N/A").otherwise(text)


def _grams(text: Column) -> Column:
    """Distinct pieces of one, two and three letters of a text."""
    start = F.sequence(F.lit(1), F.length(text))
    pieces = F.flatten(F.transform(start, lambda i: F.array(*[F.substr(text, i, F.lit(n)) for n in (1, 2, 3)])))
    return F.when(F.length(text) > 0, F.array_distinct(pieces))


def _containing(needles: DataFrame, needle: str, names: DataFrame, folded: str) -> DataFrame:
    """Pairs of a needle and a row of ``names`` whose folded text holds it.

    A text that holds a needle holds the needle's first letters; needles and names meet on those
    (three, or as many as the needle has), and only such pairs are compared.
    """
    own = needles.withColumn("_gram", F.substring(needle, 1, 3)).where(F.length(needle) > 0)
    index = names.withColumn("_gram", F.explode(_grams(F.col(folded))))
    return own.join(index, "_gram").where(F.col(folded).contains(F.col(needle))).drop("_gram")


def match_names(queries: DataFrame, query: str, names: DataFrame, name: str, limit: int = 8) -> DataFrame:
    """STR-07 / SRT-06: distinct query text to (status, match, candidates).

    Exact match on the folded name with or without its leading "playa "; else a unique substring;
    else ambiguous, with the first names in order. Query texts are reduced to distinct ones and
    meet the names through an index of short letter pieces; of each query's matches only a count
    and the first names are kept.
    """
    folded = X.fold(F.col(name))
    cat = names.select(F.col(name).alias("n"), folded.alias("f"), F.regexp_replace(folded, "^playa ", "").alias("g"))
    q = queries.select(query).distinct().withColumn(
        "_q", F.trim(F.regexp_replace(X.fold(F.col(query)), "^playa ", "")))
    found = _containing(q.select("_q").distinct(), "_q", cat, "f").withColumn("_e", (F.col("f") == F.col("_q")) | (F.col("g") == F.col("_q")))
    first = (found.withColumn("_r", F.row_number().over(W.partitionBy("_q", "_e").orderBy("n"))).where(F.col("_r") <= limit)
             .groupBy("_q", "_e").agg(F.array_sort(F.collect_list("n")).alias("some")))
    counted = found.groupBy("_q", "_e").agg(F.count("*").alias("k")).join(first, ["_q", "_e"])
    pick = lambda c, e: F.first(F.when(F.col("_e") == e, F.col(c)), ignorenulls=True)
    per = counted.groupBy("_q").agg(pick("k", True).alias("ne"), pick("some", True).alias("se"), F.sum("k").alias("np"),
                                    F.flatten(F.collect_list("some")).alias("sp"))
    status = (F.when(F.col("_q") == "", "empty").when(F.col("ne") == 1, "exact").when(F.col("np") == 1, "partial")
              .when(F.col("np") > 0, "ambiguous").otherwise("unknown"))
    q = q.join(per, "_q", "left").withColumn("status", status)
    options = F.when(F.col("ne") > 0, F.col("se")).otherwise(F.col("sp"))
    return q.select(
        query, "status",
        F.when(F.col("status") == "exact", F.get("se", F.lit(0))).when(F.col("status") == "partial", F.get("sp", F.lit(0))).alias("match"),
        F.when(F.col("status") == "ambiguous", F.slice(F.array_sort(options), 1, limit)).otherwise(F.array().cast("array<string>")).alias("candidates"))


def resolve_zone_names(messages: DataFrame, text: str, zones: DataFrame) -> DataFrame:
    """JON-23: lowest zone id whose name contains the typed text, ignoring case; null when none does."""
    typed = F.lower(F.trim(F.col(text)))
    found = _containing(messages.select(typed.alias("_t")).distinct(), "_t", zones.select(F.col("zone_id"), F.lower("name").alias("_n")), "_n")
    best = found.groupBy("_t").agg(F.min("zone_id").alias("zone_id"))
    return messages.join(best, typed == F.col("_t"), "left").drop("_t")


def day_summary(beaches: DataFrame, picks: int = 3) -> DataFrame:
    """AGG-20: one row: clear and at-risk counts, worst level, best picks.

    Needs beach_name, risk_level, possible, in_season, dist_km. The picks are a top-n sort.
    """
    clear = (F.col("risk_level") == "none") & ~F.col("possible")
    n = R.level_to_int(F.col("risk_level"))
    counts = beaches.agg(F.count_if(clear).alias("clear"), F.count_if(n >= 1).alias("at_risk"),
                         F.when(F.max(n) >= 1, R.int_to_level(F.max(n))).alias("worst"))
    top = (beaches.where(clear).orderBy(F.desc("in_season"), F.desc(F.coalesce("dist_km", F.lit(1e6))), "beach_name")
           .limit(picks))
    order = F.struct((~F.col("in_season")).alias("a"), (-F.coalesce("dist_km", F.lit(1e6))).alias("b"), "beach_name")
    names = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["beach_name"]), "|")).scalar()
    return counts.withColumn("picks", names)


def rank_taxa(taxa: DataFrame, choices: DataFrame, key: str, n: int = S.SPECIES_TOTAL,
              slots: int = S.FEATURED) -> DataFrame:
    """WIN-10 / SET-05: first ``n`` species per key: pinned in author order, then by tier, count and
    name, with a cap per group in the first ``slots``. Hidden wins over pinned.

    Taxa are (key, taxon_id, name, group, observation_count, marine, photo); choices are (key,
    pinned, hidden). The greedy cap equals a per-group rank: a species may lead when its rank in its
    group fits what the pins left over, and the first free slots go to those. Groups are cut to the
    ``n`` best before the shuffle, so a hot key stays small.
    """
    no = F.array().cast("array<bigint>")
    t = taxa.join(choices, key, "left").withColumn("pinned", F.coalesce("pinned", no)).withColumn("hidden", F.coalesce("hidden", no))
    t = t.where(~F.array_contains("hidden", F.col("taxon_id")))
    pos = F.array_position(F.array_distinct("pinned"), F.col("taxon_id"))
    tier = F.when(~F.col("photo"), 2).when(F.col("marine"), 0).otherwise(1)
    t = (t.withColumn("pin", F.when(pos > 0, pos)).withColumn("tier", tier)
         .withColumn("is_pin", F.col("pin").isNotNull()).drop("pinned", "hidden"))
    order = [F.col("tier"), F.desc("observation_count"), F.col("name"), F.col("taxon_id")]
    t = top_n(t, [key, "is_pin", "group"], [F.col("pin").asc_nulls_last(), *order], n, "g_rank")
    wk = W.partitionBy(key)
    t = t.withColumn("pin_rank", F.row_number().over(W.partitionBy(key, "is_pin").orderBy(F.col("pin"), *order)))
    lead_pin = F.col("is_pin") & (F.col("pin_rank") <= slots)
    t = (t.withColumn("n_pin", F.sum(F.col("is_pin").cast("int")).over(wk))
         .withColumn("pins_in_group", F.sum(lead_pin.cast("int")).over(W.partitionBy(key, "group"))))
    cap = F.when(F.col("group") == S.PLANT_GROUP, S.PLANTS_IN_TOP).otherwise(S.SAME_GROUP_IN_TOP)
    free = F.greatest(F.lit(0), F.lit(slots) - F.col("n_pin"))
    may = ~F.col("is_pin") & (F.col("g_rank") <= cap - F.col("pins_in_group"))
    t = t.withColumn("may", may).withColumn("free", free)
    t = t.withColumn("lead_no", F.row_number().over(W.partitionBy(key, "may").orderBy(*order)))
    block = F.when(F.col("is_pin"), 0).when(F.col("may") & (F.col("lead_no") <= F.col("free")), 1).otherwise(2)
    t = t.withColumn("block", block)
    w = W.partitionBy(key).orderBy("block", F.col("pin").asc_nulls_last(), *order)
    return (t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(key, "rank", "taxon_id", "name", "group", "observation_count", "marine", "photo"))


def effective_marine(taxa: DataFrame, overrides: DataFrame) -> DataFrame:
    """SCL-16: the marine tag, unless a curated override corrects it."""
    o = overrides.select("taxon_id", F.col("marine").alias("_o"))
    return taxa.join(o, "taxon_id", "left").withColumn("marine", F.coalesce("_o", "marine")).drop("_o")


def beach_species(refs: DataFrame, taxa: DataFrame, overrides: DataFrame, notes: DataFrame) -> DataFrame:
    """JON-24: references joined to shared taxa, overrides and notes; dangling references vanish."""
    merged = effective_marine(refs.join(taxa, "taxon_id"), overrides)
    return merged.join(notes.select("beach", "taxon_id", "blurb"), ["beach", "taxon_id"], "left")


def knowledge_rows(keys: DataFrame, profiles: DataFrame, units: DataFrame, species: DataFrame,
                   photos: DataFrame) -> DataFrame:
    """JON-31 / PRJ-29: per beach its valid parts and content flags; an invalid part drops only itself.

    Each part carries ``valid``; species must already be ranked and capped per beach, so the list
    folded into a row is short.
    """
    p = profiles.where("valid").select("beach", "coastal_unit", "teaser", "history")
    u = units.where("valid").select("coastal_unit", "rock")
    s = species.groupBy("beach").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("species"))
    ph = photos.where("valid").select("beach", F.col("file").alias("photo"))
    out = (keys.join(p, "beach", "left").join(u, "coastal_unit", "left").join(s, "beach", "left").join(ph, "beach", "left"))
    return out.select("beach", "teaser", "rock", "photo",
                      F.coalesce(F.size("species"), F.lit(0)).alias("n_species"),
                      F.array_join(F.transform("species", lambda x: x["name"]), "|").alias("species"),
                      F.col("photo").isNotNull().alias("has_photo"),
                      F.coalesce(F.size("species") > 0, F.lit(False)).alias("has_life"),
                      F.col("rock").isNotNull().alias("has_rock"),
                      F.coalesce(F.size("history") > 0, F.lit(False)).alias("has_history"))


def text_problem(path: str, value: Column, limit: int) -> Column:
    """ARR-04 part: what is wrong with a text field, null when nothing is."""
    return (F.when(value.isNull() | (F.trim(value) == ""), F.lit(f"{path}: must be non-empty text"))
            .when(value.rlike(X.FORBIDDEN), F.lit(f"{path}: has markup or control characters"))
            .when(F.length(value) > limit,
                  F.concat(F.lit(f"{path}: "), F.length(value).cast("string"), F.lit(f" chars exceeds the {limit} budget"))))


def date_problem(path: str, value: Column) -> Column:
    ok = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & value.try_cast("date").isNotNull()
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{path}: must be an ISO date"))


def member_problem(path: str, value: Column, allowed: Sequence[str], message: str) -> Column:
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), F.lit(f"{path}: {message}"))


def range_problem(path: str, value: Column, low, high, message: str) -> Column:
    return F.when(~F.coalesce(value.between(low, high), F.lit(False)), F.lit(f"{path}: {message}"))


def key_problems(path: str, record: Column, required: Sequence[str], optional: Sequence[str] = ()) -> Column:
    """ARR-04 part: missing and unexpected keys of a JSON object, in order."""
    keys = F.json_object_keys(record)
    known = F.array(*[F.lit(k) for k in (*required, *optional)])
    missing = F.transform(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), keys)),
                          lambda k: F.concat(F.lit(f"{path}: missing "), k))
    extra = F.transform(F.array_sort(F.array_except(keys, known)),
                        lambda k: F.concat(F.lit(f"{path}: unexpected key '"), k, F.lit("'")))
    bad = F.array(F.lit(f"{path}: must be an object"))
    return F.when(keys.isNull(), bad).otherwise(F.concat(missing, extra))


def problems(*rules: Column) -> Column:
    """ARR-04: the rules that fired, as a list; an empty list means the record may ship."""
    return F.array_compact(F.array(*rules))


def sourced_problems(path: str, method: Column, verified: Column, sources: Column, methods: Sequence[str]) -> list[Column]:
    """ARR-04: every fact has an allowed method and one to three sources."""
    n = F.coalesce(F.size(sources), F.lit(0))
    return [member_problem(f"{path}.method", method, methods, "not an allowed method here"),
            F.when((method == "llm_draft_reviewed") & verified.isNull(), F.lit(f"{path}: llm_draft_reviewed needs verified_at")),
            F.when(verified.isNotNull(), date_problem(f"{path}.verified_at", verified)),
            F.when(n == 0, F.lit(f"{path}.sources: at least one source is required")),
            F.when(n > 3, F.lit(f"{path}.sources: more than 3"))]


def taxon_problems(r: Column) -> Column:
    """ARR-04: taxon record."""
    return problems(F.when(r["taxon_id"].isNull(), F.lit("taxon.taxon_id: must be an integer")),
                    F.when(r["marine"].isNull(), F.lit("taxon.marine: must be true or false")),
                    member_problem("taxon.method", r["method"], ("api:inaturalist",), "not an allowed method here"),
                    date_problem("taxon.fetched_at", r["fetched_at"]),
                    F.when(r["iconic_group"].isNotNull(), text_problem("taxon.iconic_group", r["iconic_group"], 40)),
                    text_problem("taxon.scientific_name", r["scientific_name"], 80))


# Licences a photo may carry and sources it may come from.
LICENCES = ("cc0", "cc-by", "cc-by-sa")
PHOTO_SOURCES = ("own", "wikimedia_commons")


def remote_photo_problems(r: Column) -> Column:
    """ARR-04: photo as a remote source gives it."""
    return problems(text_problem("photo.attribution", r["attribution"], 120),
                    member_problem("photo.license_code", r["license_code"], LICENCES, "not an allowed open license"),
                    F.when(~X.is_allowed_image(r["url"]), F.lit("photo.url: not an allowed thumbnail URL")),
                    F.when(~X.is_safe_url(r["source_url"]), F.lit("photo.source_url: not a safe https URL")))


def stored_photo_problems(r: Column, year_now: int) -> Column:
    """ARR-04: reviewed beach photo with its stored file."""
    digest = F.regexp_extract(r["file"], r"^beaches/([0-9a-f]{64})\.webp$", 1)
    return problems(
        F.when(F.coalesce(digest != r["sha256"], F.lit(True)) | (digest == ""), F.lit("beach_photo.file: must be beaches/<sha256>.webp")),
        range_problem("beach_photo.width", r["width"], 1, 480, "must be at most 480"),
        range_problem("beach_photo.bytes", r["bytes"], 1, 45 * 1024, "must be at most 46080"),
        text_problem("beach_photo.author", r["author"], 120),
        member_problem("beach_photo.license", r["license"], LICENCES, "not an allowed open license"),
        member_problem("beach_photo.source", r["source"], PHOTO_SOURCES, "must be own or wikimedia_commons"),
        F.when(r["taken_year"].isNotNull(), range_problem("beach_photo.taken_year", r["taken_year"], 1900, year_now,
                                                          "must be a plausible year or null")),
        date_problem("beach_photo.reviewed_at", r["reviewed_at"]))


# Budgets (characters) of the hand-written texts.
TEASER_CHARS, BLURB_CHARS, TITLE_CHARS, STORY_CHARS, SAND_CHARS = 90, 140, 80, 400, 140
BODY_CHARS, WHY_CHARS, NAME_CHARS, ROCK_CHARS, ALT_CHARS = 500, 200, 80, 80, 125
HAND_METHODS = ("curated", "llm_draft_reviewed")
ROCK_METHODS = (*HAND_METHODS, "api:macrostrat")


def localized_problems(path: str, es: Column, en: Column, limit: int) -> list[Column]:
    return [text_problem(f"{path}.es", es, limit), text_problem(f"{path}.en", en, limit)]


def teaser_problems(r: Column) -> Column:
    """ARR-04: one-line teaser."""
    return problems(*sourced_problems("teaser", r["method"], r["verified_at"], r["sources"], HAND_METHODS),
                    *localized_problems("teaser.text", r["text_es"], r["text_en"], TEASER_CHARS))


def history_problems(r: Column) -> Column:
    """ARR-04: history item."""
    return problems(*sourced_problems("historia", r["method"], r["verified_at"], r["sources"], HAND_METHODS),
                    *localized_problems("historia.title", r["title_es"], r["title_en"], TITLE_CHARS),
                    *localized_problems("historia.body", r["body_es"], r["body_en"], BODY_CHARS))


def rock_problems(r: Column) -> Column:
    """ARR-04: geology block of a coastal unit."""
    return problems(*sourced_problems("roca", r["method"], r["verified_at"], r["sources"], ROCK_METHODS),
                    *localized_problems("roca.title", r["title_es"], r["title_en"], TITLE_CHARS),
                    *localized_problems("roca.story", r["story_es"], r["story_en"], STORY_CHARS),
                    *localized_problems("roca.sand", r["sand_es"], r["sand_en"], SAND_CHARS),
                    text_problem("roca.rock_type", r["rock_type"], ROCK_CHARS))


def choice_problems(pinned: Column, hidden: Column) -> Column:
    """ARR-04: a species may not be both pinned and hidden."""
    return problems(F.when(pinned.isNull(), F.lit("vida.pinned_taxa: must be a list of integers")),
                    F.when(hidden.isNull(), F.lit("vida.hidden_taxa: must be a list of integers")),
                    F.when(F.arrays_overlap(pinned, hidden), F.lit("vida: a taxon is both pinned and hidden")))


def explode_problems(rows: DataFrame, keys: Sequence[str], column: str = "problems") -> DataFrame:
    """ARR-04: one (keys, problem) row per rule that fired."""
    return rows.select(*keys, F.explode(column).alias("problem"))


def fresh_beaches(refs: DataFrame, taxa: DataFrame, today: Column, max_age: int) -> DataFrame:
    """PRJ-24: (beach, fresh): every referenced species fetched recently; a missing one is stale."""
    age = F.datediff(today, F.col("fetched_at").try_cast("date"))
    ok = F.coalesce(age <= max_age, F.lit(False))
    return (refs.join(taxa.select("taxon_id", "fetched_at"), "taxon_id", "left")
            .groupBy("beach").agg(F.bool_and(ok).alias("fresh")))


def name_rules(beaches: DataFrame) -> DataFrame:
    """AGG-28 / STR-21: per beach the name words and, for a shared name, the words that must also occur."""
    b = beaches.select("beach_name", "province", X.words(X.base_name(F.col("beach_name"))).alias("words"),
                       X.words(X.name_suffix(F.col("beach_name"))).alias("suffix"))
    n = b.groupBy("words").agg(F.count("*").alias("sharing"))
    context = F.when(F.col("sharing") > 1, F.when(F.size("suffix") > 0, F.col("suffix")).otherwise(X.words(F.col("province"))))
    return b.join(n, "words").select("beach_name", "words", "sharing", F.coalesce(context, F.array().cast("array<string>")).alias("context"))


def merge_species(old: DataFrame, new: DataFrame, old_taxa: DataFrame, new_taxa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-30: (references, taxa): a beach's new references replace its old ones, a known photo is
    kept when the new record has none, and taxa nobody refers to are pruned."""
    refs = old.join(new.select("beach").distinct(), "beach", "left_anti").unionByName(new)
    a = old_taxa.select("taxon_id", F.struct(*[c for c in old_taxa.columns if c != "taxon_id"]).alias("o"))
    b = new_taxa.select("taxon_id", F.struct(*[c for c in new_taxa.columns if c != "taxon_id"]).alias("n"))
    both = a.join(b, "taxon_id", "full_outer")
    cols = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            if c != "photo" else F.coalesce("n.photo", "o.photo").alias("photo")
            for c in new_taxa.columns if c != "taxon_id"]
    taxa = both.select("taxon_id", *cols).join(refs.select("taxon_id").distinct(), "taxon_id", "left_semi")
    return refs, taxa


def candidate_report(rows: DataFrame, cap: int = S.PHOTOS_PER_GROUP) -> DataFrame:
    """AGG-23: per beach and in total (beach null): counts per status, kept after the cap, over it.

    Counted once per (beach, status); the totals are summed from those counts.
    """
    per = rows.groupBy("beach", "status").agg(F.count("*").alias("n"))
    capped = F.col("status").isin("tagged", "mixed", "unknown")
    per = per.withColumn("kept", F.when(capped, F.least("n", F.lit(cap))).otherwise(F.col("n"))).withColumn(
        "over", F.col("n") - F.col("kept"))
    total = per.groupBy("status").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "over")]).withColumn(
        "beach", F.lit(None).cast(rows.schema["beach"].dataType))
    return per.unionByName(total, allowMissingColumns=True)


def orphan_files(taxa: DataFrame, listing: DataFrame) -> DataFrame:
    """SET-08: files on disk that no record points to."""
    used = taxa.where(F.col("file").isNotNull()).select("file").distinct()
    return listing.join(used, "file", "left_anti")
