"""Near duplicates by circulant MinHash: banding, exact verification, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.common import flat_bytes, maybe_in, mix64, released, stored
from tidelens.llm.shingles import shingle_set

BANDS, ROWS = 32, 5  # a pair at similarity 0.8 shares no band once in 300,000 times
DEAL_BYTES = 4_000_000  # sets that a task holds before it passes them on
GROUP = 500  # members of one leader that meet its set in one place
NEAR = 0.4    # similarity to the leader from which members are told apart by what the leader lacks
SMALL = 8     # members of an open group that are paired with each other
ROUNDS = 2    # searches by leaders before the groups still open are searched exactly
COUNTER_BITS = 20  # counters by which shingles are ordered
_SALTS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_COORD = mix64(np.arange(501, 501 + ROWS, dtype=np.uint64)) | np.uint64(1)


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """Places of shingles in the shuffled universe of 2**32 coordinates."""
    return (mix64(x) >> np.uint64(32)).astype(np.uint32)


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima: coordinate k applies the second permutation, shifted circularly by k, to the first."""
    places = _first_permutation(shingles)
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    step = 16
    for k in range(0, len(out), step):
        shift = np.arange(k, k + step, dtype=np.uint32)[:, None]
        for a in range(0, len(places), 2048):
            part = _second_permutation(places[a:a + 2048] + shift).min(axis=1)
            np.minimum(out[k:k + step], part, out=out[k:k + step])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((rows * _COORD).sum(axis=1, dtype=np.uint64) ^ _SALTS).view(np.int64)


def sketches(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, s1, s2, bands): set size, a 128-bit digest of the set, and the band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            n, one, two, keys = [], [], [], []
            for i in range(batch.num_rows):
                own = shingle_set(data[ends[i]:ends[i + 1]], width)
                n.append(len(own))
                one.append(int(mix64(own).sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix64(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(signature(own)) if len(own) else np.zeros(0, np.int64))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(
        released(run), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def compared(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (a, b, na, nb, same, rest) for pairs of a member a and a leader b: set sizes, size of the
    full intersection, and the smallest hashes of what a has and b lacks.

    Texts of the ids in the pairs are turned into sets once and dealt out by leader. The members of
    a large leader are spread over parts of GROUP rows, and its set goes to each part.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    member = pairs.join(parts, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("role"))
    leader = parts.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(0).alias("role"))
    tickets = member.unionByName(leader).groupBy("doc_id").agg(F.collect_set(F.struct("b", "part", "role")).alias("tickets"))
    own = maybe_in(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tickets, "doc_id")

    def packed(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
            names=["b", "part", "role", "a", "shingles"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            rows, size = [], 0
            for i, (d, tickets) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = shingle_set(data[ends[i]:ends[i + 1]], width).tobytes()
                for t in tickets:
                    rows.append((t["b"], t["part"], t["role"], d, own))
                    size += len(own)
                    if size > DEAL_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
            yield packed(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lead = None, None
        for batch in batches:
            rows = []
            for at, (b, part, role, a) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                own = np.frombuffer(batch.column(4)[at].as_buffer(), np.uint64)
                if role == 0:
                    place, lead = (b, part), own.copy()
                elif place == (b, part):
                    there = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                    lacks = own[lead[there] != own]
                    rest = lacks[:len(own) * (100 - percent) // 100 + 1]
                    rows.append((a, b, len(own), len(lead), len(own) - len(lacks), (rest >> np.uint64(33)).astype(np.int32)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[5]])]).astype(np.int32)
            flat = np.concatenate(cols[5]) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(list(c), pa.int64()) for c in cols[:5]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["a", "b", "na", "nb", "same", "rest"])

    dealt = own.join(tickets, "doc_id").select("doc_id", "text", "tickets").mapInArrow(released(deal), "b long, part int, role int, a long, shingles binary")
    sorted_ = dealt.repartition("b", "part").sortWithinPartitions("b", "part", "role", "a")
    return sorted_.mapInArrow(released(compare), "a long, b long, na long, nb long, same long, rest array<int>").dropDuplicates(["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component): each linked id with the smallest id it reaches, itself included.

    Large-star and small-star steps: every id links its larger neighbours, then all others, to the
    smallest it knows, until no link changes. Minima are aggregated before they are joined back, so
    a hub is never gathered.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = stored(small)
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")


def _with_groups(rows: DataFrame, groups: DataFrame, column: str, out: str) -> DataFrame:
    return (rows.join(groups.select(F.col("id").alias(column), F.col("component").alias("_c")), column, "left")
            .withColumn(out, F.coalesce("_c", column)).drop("_c"))


def _open_groups(seen: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Rows (key, a) of smaller groups in which a link may still be hidden.

    ``seen`` has (key, a, b, na, nb, same, rest): group, member, its leader and their comparison.
    Two members of different components that are alike either have enough in common with the
    leader, or share something the leader lacks. The former needs sizes small enough for what the
    members share with the leader; the latter shows among the smallest hashes of ``rest`` of both,
    since so much of ``rest`` would have to be shared. Groups of one component are done.
    """
    named = _with_groups(_with_groups(seen, groups, "a", "ga"), groups, "b", "gb")
    state = named.groupBy("key").agg(F.min(F.least("ga", "gb")).alias("x"), F.max(F.greatest("ga", "gb")).alias("y"), F.min("na").alias("least"))
    mixed = named.join(state.where("x <> y").select("key", "least"), "key")
    bound = F.col("same") * ((100.0 + percent) / percent) - F.col("na")  # the largest partner that what is shared with b allows
    sized = stored(mixed.withColumn("bound", bound))
    by_rest = sized.select("key", "a", "ga", F.explode("rest").alias("h")).select(F.xxhash64("key", "h").alias("key"), "a", "ga")
    far = sized.where((F.col("ga") != F.col("gb")) & (F.col("bound") >= F.col("least")))
    reach = far.groupBy("key").agg(F.max("bound").alias("most"), F.min("na").alias("small"))
    near = sized.join(reach, "key").where((F.col("na") <= F.col("most")) & (F.col("bound") >= F.col("small")))
    by_size = far.select("key", "a", "ga").unionByName(near.select("key", "a", "ga")).distinct().select(
        F.xxhash64("key", F.lit("size")).alias("key"), "a", "ga")
    both = by_rest.unionByName(by_size)
    kept = both.groupBy("key").agg(F.min("ga").alias("x"), F.max("ga").alias("y")).where("x <> y").select("key")
    return both.join(kept, "key").select("key", "a").distinct()


def _rare_first(ids: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Rows (key, a, na, at): the shingles, rarest first, of which two sets alike must share one.

    The order is by a count in a table of fixed size, then by hash. Counts that fall together
    cost time only: any order that is the same for all sets gives every pair.
    """
    own = stored(maybe_in(docs.select(F.col(doc_id).cast("long").alias("a"), F.col(text).alias("text")), ids, "a").join(ids, "a").select("a", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            for i in range(batch.num_rows):
                np.add.at(table, shingle_set(data[ends[i]:ends[i + 1]], width) >> np.uint64(64 - COUNTER_BITS), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["at", "n"])

    held = own.mapInArrow(released(count), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[held["at"].to_numpy()] = held["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_bytes(batch.column(1))
            for i, d in enumerate(batch.column(0).to_pylist()):
                own = shingle_set(data[ends[i]:ends[i + 1]], width)
                n = len(own)
                own = own[np.lexsort((own, shared.value[own >> np.uint64(64 - COUNTER_BITS)]))][:n - (n * percent + 99) // 100 + 1]
                k = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(np.full(k, d, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(np.arange(k))],
                    names=["key", "a", "na", "at"])

    return own.mapInArrow(released(prefix), "key long, a long, na long, at long")


def _exact_pairs(open_: DataFrame, groups: DataFrame, sizes: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Pairs (a, b) of different components, among the members of groups (key, a), that can be alike.

    Up to SMALL members of a group are paired with each other. Members of larger groups meet in
    the shingles of ``_rare_first``; a frequent one is dealt out in parts of GROUP members. Sizes,
    and places of the first common shingle, must allow the similarity. No group is capped.
    """
    def mixed(rows: DataFrame) -> DataFrame:
        named = stored(_with_groups(rows, groups, "a", "ga"))
        state = named.groupBy("key").agg(F.min("ga").alias("x"), F.max("ga").alias("y"), F.count("*").alias("n")).where("x <> y")
        return stored(named.join(state.select("key", "n"), "key"))

    def paired(rows: DataFrame) -> DataFrame:
        k = F.ceil(F.col("n") / GROUP).cast("int")
        left = rows.withColumn("part", F.pmod(F.xxhash64("a"), k).cast("int")).drop("n")
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), k - 1))).select(
            "key", "part", F.col("a").alias("b"), F.col("ga").alias("gb"), F.col("na").alias("nb"), F.col("at").alias("bt"))
        able = (100 + percent) * F.least(F.col("na") - F.col("at"), F.col("nb") - F.col("bt")) >= percent * (F.col("na") + F.col("nb"))
        return left.join(right, ["key", "part"]).where((F.col("a") > F.col("b")) & (F.col("ga") != F.col("gb")) & able).select("a", "b").distinct()

    rows = mixed(open_.join(sizes, "a"))
    pairs = paired(rows.where(F.col("n") <= SMALL).withColumn("at", F.lit(0).cast("long")))
    many = stored(rows.where(F.col("n") > SMALL).select("a").distinct())
    if many.isEmpty():
        return pairs
    return pairs.unionByName(paired(mixed(_rare_first(many, docs, width, percent, doc_id, text)))).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every document.

    Words are runs of bytes other than ASCII white space with A-Z in lower case; fewer words than
    ``width`` are one shingle; a null text or one without words has an empty set and no link. Equal
    sets are one class, whose smallest id stands for it. Classes that share a band are compared,
    on full sets, with the member of the bucket that shares most bands with others; so one
    comparison a member links a family. Where a bucket's members are then in several components,
    the pairs that can still be alike meet in smaller groups (see ``_open_groups``), each with a
    leader of its own; members of groups still open after ROUNDS searches, and those far from a
    leader, meet by the rare shingles they must share (see ``_exact_pairs``). So no link of a
    bucket is lost and no bucket is capped. ``kept`` marks the smallest id of a component. Rows
    without an id link with nothing, have no component and are kept; repeated rows of one id stay.
    An empty table gives an empty result; other columns are not read.
    """
    own = stored(sketches(docs, width, doc_id, text))
    real = own.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    bands = real.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi")
    member = bands.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(member.join(sizes, "key").select("key", "rep", "size").distinct())
    popular = stored(shared.groupBy("rep").agg(F.sum("size").alias("pop")))

    def led(rows: DataFrame) -> DataFrame:
        """(key, a, b): each member with its group's most popular one, the smallest id of equals."""
        ranked = rows.join(popular.withColumnRenamed("rep", "a"), "a")
        lead = ranked.groupBy("key").agg(F.max(F.struct("pop", (-F.col("a")).alias("back"))).alias("l"))
        return ranked.join(lead, "key").select("key", "a", (-F.col("l.back")).alias("b")).where("a <> b")

    rows = stored(led(shared.select("key", F.col("rep").alias("a"))))
    links = groups = known = open_ = None

    def search(pairs: DataFrame) -> None:
        nonlocal links, groups, known
        if known is not None:  # a leader of many groups is compared with a member once
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(compared(stored(pairs), docs, width, percent, doc_id, text))
        known = found if known is None else known.unionByName(found)
        fresh = found.where(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")
        if groups is None or not fresh.isEmpty():
            links = stored(fresh if links is None else links.unionByName(fresh))
            groups = stored(components(links))

    for last in [False] * (ROUNDS - 1) + [True]:
        if rows.isEmpty():
            break
        search(rows.select("a", "b").distinct())
        seen = rows.join(known, ["a", "b"]).withColumn("j", F.col("same") / (F.col("na") + F.col("nb") - F.col("same")))
        # Members alike differ by a fifth at most in their distance from the leader, so each pair is near or far.
        near = seen.where(F.col("j") >= NEAR).drop("key", "j").distinct().withColumn("key", F.xxhash64("b"))
        far = seen.where(F.col("j") < NEAR + (100 - percent) / 100).select("key", "a")
        still = _open_groups(near, groups, percent)
        rest = stored(far.unionByName(still) if last else far)
        open_ = rest if open_ is None else open_.unionByName(rest)
        rows = rows.limit(0) if last else stored(led(still))
    if open_ is not None and not open_.isEmpty():
        set_sizes = real.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na")).dropDuplicates(["a"])
        search(_exact_pairs(open_.distinct(), groups, set_sizes, docs, width, percent, doc_id, text))
    rep = classes
    rep = rep.withColumn("component", F.col("rep")) if groups is None else _with_groups(rep, groups, "rep", "component")
    joined = own.select("doc_id", "n_shingles", "s1", "s2").join(rep.select("s1", "s2", "component"), ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
