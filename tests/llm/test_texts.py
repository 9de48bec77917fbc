"""Fingerprints, address rules, classifiers, conversations and the pipeline."""

import hashlib
import random
import zlib

import numpy as np

from tests.conftest import SMALL
from tidelens.llm import chat, fingerprint, language, quality, url_rules
from tidelens.llm.queries import QUERIES, URL_RULES

MIDDLE = "/root/testdata/sf0.01"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints_of_all_documents_and_their_edits(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op1_fingerprints"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    own = lambda t: fingerprint.digest(np.frombuffer(t.encode(), np.uint8))
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n, r = len(text), got[d]
        edited = text[:n - n // 2] + after[:n // 2]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, digest(edited), own(text), own(edited))
        assert r["near_edited"] == fingerprint.likeness(own(text), own(edited)) and r["near_next"] == fingerprint.likeness(own(text), own(after))
    near = np.array([[r["near_edited"], r["near_next"]] for r in got.values() if r["n_chars"] > 500])
    assert (near[:, 0] > near[:, 1]).mean() > 0.9 and ((near >= 0) & (near <= 1)).all()


def test_fingerprints_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "first", "x"), (5, None, "y"), (5, "five", "z"), (9, "é" * 4001, "w")], "doc_id long, text string, fingerprint string")
    got = [tuple(r)[:3] for r in fingerprint.edited_pairs(df).orderBy("doc_id", "n_chars").collect()]
    assert got == [(None, 5, digest("fir")), (5, 0, digest("")), (5, 4, digest("fiéé")), (9, 4001, digest("é" * 2001 + "first"))]
    assert fingerprint.edited_pairs(df.limit(0)).count() == 0
    one = fingerprint.edited_pairs(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == digest("abab") and one["near_next"] == 1.0
    marks = fingerprint.fingerprints(df)
    assert marks.columns == ["doc_id", "text", "fingerprint"] and len({r["fingerprint"] for r in marks.collect()}) == 4


def test_difference_is_bounded_and_grows_with_edits():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(600))
    own = lambda t: fingerprint.digest(np.frombuffer(t.encode(), np.uint8))
    scores = [fingerprint.likeness(own(text), own(text[:-k] + "".join(rng.choice("qxz ") for _ in range(k)))) for k in (1, 200, 1500)]
    assert 1.0 >= scores[0] > scores[1] > scores[2] >= 0.0
    assert fingerprint.likeness(own(""), own("")) == 1.0 and fingerprint.difference(own(""), own(text)) <= fingerprint.DIFF_CAP


def judged(url):
    """Host, path and written rule of one address, plainly."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host = rest[:ends[0]] if ends else rest
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[len(host):]
    path = rest[:min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


def test_written_rules_judge_every_page(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = QUERIES["op2_url_filter"](spark, MIDDLE).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = judged(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        assert r["verdict"] == (rule[2] if rule else "block" if r["mined_rule"] else "allow")


def test_odd_addresses_and_mined_rules(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG", "x://a.EXAMPLE.org/en/1?q#f", "http://example.org/es/", "http://notexample.org/es/",
           "http://b.com/de/x", "http://com/fr/", "http://a.com?x=/de/", "a://b://c/d", "http://ex\u00c4mple.org/x\ny", "http://org#://z/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd)], "page_id int, url string, verdict string")
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    for r in url_rules.judge_urls(pages, URL_RULES, none).collect():
        host, path, rule = judged(odd[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule[1], rule[2] if rule else "allow"), odd[r["page_id"]]
    seen = [(f"http://spam{i % 3}.example.net/win/{i}", True) for i in range(40)] + [(f"http://good{i % 5}.example.net/{'win' if i < 4 else 'page'}/{i}", False) for i in range(160)]
    rules = url_rules.mine_rules(spark.createDataFrame(seen + [(None, True), ("http://x.y/", None)], "url string, blocked boolean"), 0.02, 0.7)
    mined = rules.collect()
    toks = {u: set(t) for u, t in spark.createDataFrame(seen, "url string, b boolean").select("url", url_rules.tokens_of(url_rules.F.col("url"))).collect()}
    for r in mined:
        hit = [b for u, b in seen if set(r["tokens"]) <= toks[u]]
        assert sum(hit) / len(hit) >= 0.7 and abs(r["confidence"] - sum(hit) / len(hit)) < 1e-9 and sum(hit) >= 0.02 * len(seen)
    out = url_rules.judge_urls(spark.createDataFrame(seen, "url string, b boolean"), [], rules).collect()
    for r in out:
        best = max(((m["confidence"], m["support"], " ".join(m["tokens"])) for m in mined if set(m["tokens"]) <= toks[r["url"]]), default=None)
        assert r["mined_rule"] == (best and best[2]) and r["verdict"] == ("block" if best else "allow")
    assert sum(r["verdict"] == "block" for r in out) >= 40
    assert url_rules.mine_rules(spark.createDataFrame([], "url string, blocked boolean")).count() == 0


def test_rules_are_mined_from_whole_addresses(spark):
    keys = "&".join(f"k{i}={i}" for i in range(12))
    seen = ([(f"http://h.example/?{keys}&t={i}", True) for i in range(80)] + [(f"http://h.example/?t={i}", False) for i in range(20)]
            + [(f"http://h.example/?u={i}", False) for i in range(300)])
    rules = url_rules.mine_rules(spark.createDataFrame(seen, "url string, blocked boolean"))
    got = {tuple(r["tokens"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in rules.collect()}
    assert got["key=t",] == (0.8, 0.2) and all(got[f"key=k{i}",] == (1.0, 0.2) for i in range(12))
    pages = spark.createDataFrame([("http://new.org/?t=1",), ("http://new.org/?k7=1",), ("http://new.org/?u=1",)], "url string")
    assert {r["url"][-3:-2]: r["verdict"] for r in url_rules.judge_urls(pages, [], rules).collect()} == {"t": "block", "7": "block", "u": "allow"}


def test_quality_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, MIDDLE).collect()}
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert len(rows) == docs and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    own = [(labels[d], r["score"], r["predicted"]) for d, r in rows.items() if r["held_out"] and d in labels]
    assert np.mean([y == p for y, _, p in own]) > 0.93
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in own)


def test_quality_of_odd_tables(spark):
    rng = np.random.default_rng(1)
    good = [bytes(rng.choice(list(b"abcdefgh "), rng.integers(30, 900))) for _ in range(60)]
    texts, y = good + [t.upper() for t in good], np.array([1] * 60 + [0] * 60, np.float32)
    net = quality.fit(texts, y)
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "abc def " * 4000, "s"), (4, "ABC DEF " * 50, "s"), (4, "ABC DEF " * 50, "s")], "doc_id long, text string, score string")
    got = quality.score_quality(df, net)
    s = [r["score"] for r in got.orderBy("doc_id").collect()]
    assert got.columns == ["doc_id", "text", "score"] and s[0] == s[1] and s[2] > 0.7 > s[3] == s[4]
    assert quality.score_quality(df.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.train(df, labels).mean.any() == np.False_  # one class only
    assert quality.train(df, labels.limit(0)).base > 5
    # A late chunk counts as much as the first: every byte is covered.
    chunks, counts = quality.chunked(np.arange(256, dtype=np.uint8).repeat(5), np.array([0, 0, 1, 512, 1280]))
    assert counts.tolist() == [1, 1, 1, 2] and sorted(set(chunks[counts.cumsum()[2]:].ravel().tolist()) - {256}) == list(range(102, 256))


def test_language_of_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    own = [(docs[r["doc_id"]]["lang"], r["lang_pred"]) for r in rows if r["held_out"]]
    assert np.mean([a == b for a, b in own]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixtures_and_odd_tables(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("text", "lang")
    model = language.learn(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) between 2500 and 4000").dropDuplicates(["lang"]).collect()}
    mix = language.infer(model, by["de"][:2000] + " " + by["es"][:1200])
    assert set(mix) == {"de", "es"} and 0.5 < mix["de"] < 0.75 and abs(sum(mix.values()) - 1) < 1e-6
    assert set(language.infer(model, by["fr"])) == {"fr"}
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !! \u0660", "x"), (4, by["en"], "x"), (4, by["en"], "x")], "doc_id long, text string, score string")
    got = language.detect(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "languages"]
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en"]
    assert language.detect(df.limit(0), model).count() == 0
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.detect(df, nothing).collect()} == {"und"}


def test_conversations_read_back(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", said), ("assistant", said)]
    rows = QUERIES["op4_chat_format"](spark, SMALL).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), digest("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss)) and r["formatted_chars"] > len(loss)


def tree_rows(rng, n_trees=8):
    rows = []
    for t in range(n_trees):
        for m in range(rng.randint(1, 40)):
            rows.append((t, m, rng.randrange(m) if m else None, round(rng.uniform(-1, 1), 3) if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), f"t{t}m{m}"))
    chain = [(99, m, m - 1 if m else None, 1.0, "user", f"c{m}") for m in range(70)]
    return rows + chain + [(50, 1, 2, 1.0, "user", "cycle"), (50, 2, 1, 1.0, "user", "cycle"), (None, 4, 77, 1.0, "user", "orphan"), (7, None, None, 9.0, "user", "no id")]


def test_best_branches_equal_a_walk_through_each_tree(spark):
    rows = tree_rows(random.Random(5))
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, score double, role string, text string")
    got = {}
    for r in chat.format_trees(df, keep=3).collect():
        got[r["tree_id"], r["branch"]] = "|".join(t for _, t in chat.read_turns(r["formatted"]))
    want = {}
    for tree in {r[0] for r in rows} - {50}:
        own = {r[1]: r for r in rows if r[0] == tree and r[1] is not None}
        ranked = []
        for leaf in set(own) - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own:
                path.append(own[at])
                at = own[at][2]
            ranked.append((-sum(p[3] or 0 for p in path) / len(path), leaf, "|".join(p[5] for p in path[::-1])))
        for k, (_, _, text) in enumerate(sorted(ranked)[:3], 1):
            want[tree, k] = text
    assert got == want


def test_template_is_reversible():
    rng = random.Random(7)
    bits = ["<|turn|>", "<|text|>", "<|end|>\n", "\\", "\\l", "\\b", "[INST]", "</s>", "<", "[", "\n", "x", "é"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "", "od<d"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2])] == [t for r, t in turns if r == "assistant"]
        assert text.count("<|turn|>") == len(turns) and "[INST]" not in text and "</s>" not in text


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe
    from tests.llm.test_duplicates import brute_hits, brute_repeats, groups
    from tidelens.llm.common import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = [f for _, f in pipe.STAGES]
    good = stored(stages[0](spark, docs, SMALL))
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()
    unique = stored(stages[1](spark, good, SMALL))
    want, _ = groups(texts(good), 5)
    assert set(texts(unique)) == {d for d, g in want.items() if d == g}
    cut = stored(stages[2](spark, unique, SMALL))
    before, after = texts(unique), texts(cut)
    gone = brute_repeats(before)
    assert {d: np.frombuffer(t.encode(), np.uint8)[~gone[d]].tobytes().decode("utf-8", "ignore") for d, t in before.items()} == after
    clean = stored(stages[3](spark, cut, SMALL))
    assert clean.columns == docs.columns and set(texts(clean)) == set(after) - {d for d, _ in brute_hits(after, items)}
    last = stages[4](spark, clean, SMALL)
    assert {r["doc_id"]: r["decoded"] for r in last.collect()} == texts(clean)
    assert {r["doc_id"] for r in pipe.run(spark, SMALL).select("doc_id").collect()} == set(texts(clean))
    empty = docs.limit(0)
    for f in stages[1:]:
        assert f(spark, empty, SMALL).count() == 0
