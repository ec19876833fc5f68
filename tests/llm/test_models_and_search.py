import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import langid, sharding, topk, toxicity, url_filter

URLS = [
    None,
    "no scheme",
    "http://EXAMPLE.com/en/a?x=1#f",
    "https://www.example.com/en/",
    "https://WWW.example.com/en",
    "http://a.b.example.com/EN/x",
    "http://com/x",
    "http://notexample.com/en/x",
    "http://x.net/es/1",
    "http://x.net/fr",
    "http://x.net?/fr/",
    "http://net/fr/",
    "://y.com#/",
    "http://z.org/q?a=b&c=d",
    "a://b://c.com/",
    "http://xcom/en/",
    "http://É.COM/en/é",
    "http://h.com",
]


def brute_rule(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, rule in url_filter.RULES:
        name, slash, tail = rule.partition("/")
        fits = (host == name or host.endswith("." + name)) and path.startswith(slash + tail)
        if fits and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS + URLS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_equal_brute_force(pages):
    got = url_filter.judged(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path, best = brute_rule(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")


def test_trees_learn_from_rules(spark):
    """Unruled urls that look like blocked ones are blocked, those like allowed ones are not."""
    rows = []
    for k in range(300):
        rows += [f"http://site{k}.com/page", f"http://s{k}.net/es/{'9' * 30}?a=1&b=2&c=3&d={k}"]
    rows += [f"http://other{k}.org/page" for k in range(20)]
    rows += [f"http://o{k}.org/xx/{'9' * 30}?a=1&b=2&c=3&d={k}" for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["page_id"]]: r["verdict"] for r in url_filter.judged(pages).collect() if r["rule"] is None}
    told = Counter(("9999" in url, verdict) for url, verdict in got.items())
    assert told[(True, "block")] >= 18 and told[(False, "allow")] >= 18


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, score double")
    assert url_filter.judged(empty).count() == 0
    one_kind = spark.createDataFrame([(1, "http://a.com/", "x"), (2, "http://a.org/", "y")], "page_id long, url string, host string")
    assert {r["verdict"] for r in url_filter.judged(one_kind).collect()} == {"allow"}


def toxic_table(spark, n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{rng.integers(60)}" for _ in range(30)]
        bad = k % 4 == 0
        words += ["vile"] if bad else []
        words += ["muslim"] if rng.random() < (0.8 if bad else 0.2) else []
        rows.append((k, " ".join(rng.permutation(words)), "en", "a", 0))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_counterfactual(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.classified(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.95
    model = toxicity.trained(docs, labels)
    plain, mention = model.score("w1 w2 christian w3"), model.score("w1 w2 muslim w3")
    assert abs(plain - mention) < 0.05 and mention < 0.5


def test_toxicity_edges(spark, docs):
    table, labels = toxic_table(spark, 60)
    table = table.unionByName(docs([(900, None, None, None), (901, "", "en", "a"), (900, None, "en", "b")]))
    got = toxicity.classified(table, labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))).collect()
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.classified(table, labels.limit(0)).collect()
    assert len(none) == 63 and {r["predicted"] for r in none} == {0}
    assert toxicity.classified(table.limit(0), labels).count() == 0


def brute_posteriors(scores, transition):
    """Forward-backward of one text, one word at a time, in logarithms."""
    n, k = scores.shape
    ahead, back = np.zeros((n, k)), np.zeros((n, k))
    ahead[0] = scores[0]
    for t in range(1, n):
        ahead[t] = scores[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + transition, axis=0)
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp.reduce(transition + (scores[t + 1] + back[t + 1])[None], axis=1)
    joint = ahead + back
    return np.exp(joint - np.logaddexp.reduce(joint, axis=1)[:, None])


def test_blocked_chain_is_exact():
    rng = np.random.default_rng(4)
    sizes = [1, 2, langid.BLOCK, langid.BLOCK + 1, 5 * langid.BLOCK + 3, 31]
    scores, transition = rng.normal(0, 2, (sum(sizes), 4)), rng.normal(0, 2, (4, 4))
    starts = np.cumsum([0, *sizes[:-1]])
    got = langid.posteriors(scores, starts, transition)
    for start, size in zip(starts, sizes, strict=True):
        assert np.allclose(got[start : start + size], brute_posteriors(scores[start : start + size], transition))


def test_languages_held_out_and_switched(spark):
    rng = np.random.default_rng(5)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["schu", "ter", "bein"], "zz": ["ção", "eau", "ille"]}
    word = lambda lang: "".join(rng.choice(parts[lang], 2))
    rows = [(k, " ".join(word(lang) for _ in range(12)), lang, "s", 0) for k in range(240) for lang in [list(parts)[k % 3]]]
    edges = [(900, None), (901, ""), (902, "123 !!"), (903, " ".join([word("xx") for _ in range(30)] + [word("yy") for _ in range(10)]))]
    rows += [(k, t, None, "s", 0) for k, t in edges]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in langid.identified(docs).collect()}
    assert len(got) == len(rows)
    for k, _, lang, *_ in rows:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= got[k]["score"] <= 1
        if lang and got[k]["held_out"]:
            assert got[k]["lang_pred"] == lang
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert 0.6 < got[903]["score"] < 0.9
    assert langid.identified(docs.limit(0)).count() == 0
    unlabelled = langid.identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def brute_top(rows, k):
    usable = [(i, np.floor(1024 * np.array(v, dtype=float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, ask in usable:
        if q % 10 == 0:
            scored = sorted((-int(v @ ask), i) for i, v in usable if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize(("block", "query_block"), [(4096, 256), (16, 3)])
def test_top_k_equals_brute_force(spark, block, query_block):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 8)]) for k in range(300)]
    rows += [(1000 + k, [0.5] * 8) for k in range(40)] + [(2000, [0.0] * 8)]
    rows += [(3000, None), (3010, [None] * 8), (3020, [float("nan")] * 8), (3030, [float("inf")] * 8), (3040, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("own"))
    stored = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("id") % 10 == 0, k=5, block=block, query_block=query_block).orderBy("rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert got == brute_top(stored, 5)


def test_top_k_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (10, None)], kind)
    assert [tuple(r) for r in topk.top_k(one, F.col("id") % 10 == 0).collect()] == [(0, 1, 1, -1024 * 1024)]


def shards_of(table, **options):
    return sharding.sharded(table, **options).collect()


def test_sharding_law_and_groups(docs):
    texts = [f"text {k}" for k in range(300)] + [f"pair {k // 2}" for k in range(300)] + ["hot"] * 300 + [None, "", None]
    table = docs(texts)
    got = shards_of(table)
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and set(counts) == set(range(16))
    assert max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {r["doc_id"]: r["shard"] for r in got}
    together = sum(where[k] == where[k + 1] for k in range(300, 600, 2))
    assert together >= 130
    assert sorted(map(tuple, shards_of(table.repartition(5)))) == sorted(map(tuple, got))


def test_sharding_edges(docs):
    assert shards_of(docs([])) == []
    few = shards_of(docs(["a", "a", "b"]))
    assert sorted(r["slot"] for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3
    same = docs([(1, "x", "en", "a")] * 20)
    assert Counter(Counter(r["shard"] for r in shards_of(same)).values()) == {1: 12, 2: 4}


def test_a_hot_group_takes_the_shards_it_needs_at_every_slice(docs, monkeypatch):
    """A third of the rows is one text, under ids of its own or in one repeated row: quota 60, so it plans with nine shards."""
    for slice_rows, ids in ((100_000, range(10_000, 10_320)), (40, [7_777] * 320)):
        monkeypatch.setattr(sharding, "SLICE", slice_rows)
        texts = [f"text {k}" for k in range(400)] + [f"pair {k // 2}" for k in range(240)]
        got = shards_of(docs([*texts, *((i, "hot", "en", "a") for i in ids)]))
        assert Counter(Counter(r["shard"] for r in got).values()) == {60: 16}
        for s in range(16):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(60))
        crc = zlib.crc32(b"hot")
        held = sorted((n for n in Counter(r["shard"] for r in got if r["text_crc32"] == crc).values()), reverse=True)
        assert sum(held) == 320 and sum(held[:9]) >= 300, held


def test_language_sample_keeps_rare_languages_and_bounds_texts(spark):
    rows = [(k, "the hot text", "en") for k in range(4_500)] + [(10_000 + k, f"le mot {k}", "fr") for k in range(900)]
    rows += [(20_000, "mot " * 50_000, "de")] + [(20_001, "x", "de")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, languages = langid.training_rows(docs)
    counts = Counter(r["lang"] for r in sample.collect())
    assert languages == ["de", "en", "fr"] and counts["en"] == counts["fr"] == langid.TRAINING_DOCS
    assert 1 <= counts["de"] <= langid.TRAINING_DOCS
    assert max(len(r["text"]) for r in sample.collect()) <= langid.TRAINING_CHARS


def test_texts_are_labelled_in_portions_of_bounded_length():
    lengths = [None, 0, 30, 80, 500, 1, 99, 100, 101]
    got = list(langid.portions(lengths, 100))
    assert [k for start, n in got for k in range(start, start + n)] == list(range(len(lengths)))
    assert all(n == 1 or sum(x or 0 for x in lengths[start : start + n]) <= 100 for start, n in got)
    assert list(langid.portions([], 100)) == []


def test_a_text_of_number_signs_has_no_language(spark):
    crf = langid.fitted([("ka lo mi", "xx"), ("ter bein", "yy")], ["xx", "yy"])
    docs = spark.createDataFrame([(1, "½ ² 12"), (2, "ka ½")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(docs, crf).collect()}
    assert got[1] == "und" and got[2] in ("xx", "yy")


@pytest.mark.parametrize("alike", ["texts", "rows"])
def test_toxicity_sample_is_bounded_and_weighs_a_hot_text(spark, alike):
    """A third of all rows is one text, under ids of its own or in equal rows: it has a third of the sample."""
    hot = [(1000 + (k if alike == "texts" else 0), "hot", 1) for k in range(300)]
    rows = spark.createDataFrame([(k, f"w{k}", k % 2) for k in range(600)] + hot, "doc_id long, text string, toxic int")
    words, toxic = toxicity.sampled_features(rows, ["hot"], 90 / 900, "doc_id", 90)
    assert 70 <= len(words) == len(toxic) <= 90
    assert 15 <= sum(len(w) for w in words) <= 45
    assert len(toxicity.sampled_features(rows, ["hot"], 1.0, "doc_id", 90)[0]) == 90


def test_prefixes_of_identity_terms_are_part_of_the_swap():
    """A prefix feature that tells the label because a group's name is in toxic texts moves no score."""
    vocabulary = ["vile", "musli~", *(t for group in toxicity.IDENTITY_SETS for t in group)]
    at = {w: k for k, w in enumerate(vocabulary)}
    draw = np.random.default_rng(6)
    texts, toxic = [], []
    for k in range(400):
        bad = k % 3 == 0
        words = ["vile"] * bad + ["muslim"] * (draw.random() < (0.9 if bad else 0.1))
        texts.append(" ".join(words))
        toxic.append(float(bad))
    numbers = lambda t: np.array(sorted(at[w] for w in toxicity.terms_of(t) if w in at), dtype=int)
    model = toxicity.fitted(
        [numbers(t) for t in texts], [numbers(toxicity.swapped(t)) for t in texts], np.array(toxic), vocabulary
    )
    assert abs(model.score("muslim people") - model.score("christian people")) < 0.05
    assert model.score("vile people") > 0.9


def test_labels_are_drawn_before_texts_are_read(spark):
    docs, labels = toxic_table(spark, 300)
    assert toxicity.training_rows(docs, labels, most=50).count() == 50
