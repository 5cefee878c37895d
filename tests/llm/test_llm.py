"""The training-data operators against brute force, with the awkward rows: nulls, empty and very long texts, ties,
repeated rows, empty tables, and extra columns whose names clash with inner ones."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.llm import ann, decision_list, licences, mixing, ngram_join, packing, repair, toxicity, url_filter, warc
from lociforge.llm.common import WordTokenizer, shingle_sets, tokenizer_path, word_hashes
from lociforge.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("ab cde fghi jk lmnop q rst uvw xyz Ünï 你好 don't".split()) + str(r.randrange(400)) for _ in range(n))


def some_docs(spark, extra: bool = True):
    base = prose(1, 300)
    near = base.split()
    near[150] = "other"
    rows = [(0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "One  TWO"), (8, prose(2, 60_000)), (None, prose(3, 50)), (10, "a b c d e f g h " * 20), (11, prose(4, 200) + "\nline x\nline x\n### $$"), (None, base), (13, prose(5, 90))]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if i != 13 else None, len(t or "")) for i, t in rows], DOC)
    if extra:  # names that the operators use inside
        df = df.selectExpr("*", "1 as n", "'x' as sid", "2 as chunk", "3 as range", "4 as size", "5 as h", "'k' as kept", "6 as n_words", "7 as key", "8 as root", "9 as __own", "13 as __key", "14 as __k", "15 as k", "16 as own", "10 as cols", "11 as a", "12 as b")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


# --- words, hashes, tokens


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_word_hashes_do_not_depend_on_blocks(block):
    data = (prose(7, 500) + "\x0b\x0c\r\n  end").encode().lower()
    h, at = word_hashes(data, block)
    ws = list(re.finditer(rb"[^\x20\x09-\x0D]+", data))
    assert at.tolist() == [m.start() for m in ws]
    names = {}
    for m, x in zip(ws, h.tolist(), strict=True):
        assert names.setdefault(m.group(), x) == x
    assert len(set(names.values())) == len(names)


def test_shingle_sets():
    texts = [b"", b"a b", b"A B", b"a b c d e", b"a b c d e f", b"x " * 9]
    s = list(shingle_sets(iter(texts)))
    assert [len(x) for x in s] == [0, 1, 1, 1, 2, 1]
    assert s[1] == s[2] and s[3][0] in s[4]


def test_tokenizer_equals_the_library_on_whole_texts():
    t = WordTokenizer(tokenizer_path(), room=300)
    texts = ["", "Hello, World.", "don't stop... e\u0301 \u0130I \u00a0x\u2003y", prose(9, 900), "a <|endoftext|> b <|EndOfText|>", "The end.,. .,", "ΑΣ ß ﬁ", "x" * 5000]
    texts += ["x" * 24, "x" * 25 + " " + "x" * 24 + "y " + "x" * 24, "W\u030a w\u030a", "Éé×÷ª²\x1c\x00 İ'S '' '", "y" * 24 + "z " + "y" * 24, " \n", "12'3 a</w>b", "Über-straße №5 don’t “q”"]
    want = [t.t.encode(x, add_special_tokens=False).ids for x in texts]
    for x, ids in zip(texts, want, strict=True):
        assert t.encode([x.encode()])[0].tolist() == ids
    for block in (8, 100, 1 << 19, 1 << 19):
        got, ends = t.encode([x.encode() for x in texts], block=block)
        assert [x.tolist() for x in np.split(got, ends)[:-1]] == want
        got, ends = t.encode([x.encode() for x in texts], 7, block)
        assert [x.tolist() for x in np.split(got, ends)[:-1]] == [x + [7] for x in want]


def test_tokenizer_of_another_kind_encodes_whole_texts():
    import public_tokenizers

    t = WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "Hello  World", "a <|endoftext|> b"]
    got, ends = t.encode([x.encode() for x in texts])
    assert [x.tolist() for x in np.split(got, ends)[:-1]] == [t.t.encode(x, add_special_tokens=False).ids for x in texts]


# --- 1


def test_toxicity_chain_on_held_out_rows(spark):
    r = random.Random(3)
    rows, labs = [], []
    for i in range(900):
        toxic, low = r.random() < 0.3, r.random() < 0.3
        ws = prose(i, 40).split() + ["Grubble,"] * toxic + ["###zz"] * low
        r.shuffle(ws)
        rows.append((i, " ".join(ws), "en", "s", 1))
        labs.append((i, int(not low), int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(labs, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels.where("doc_id < 600"))
    got = {x["doc_id"]: x for x in toxicity.score_chain(docs, chain).collect()}
    late = [x for x in labs if x[0] >= 600]
    assert np.mean([got[i]["toxic"] == bool(t) for i, _, t in late]) > 0.97
    assert np.mean([(got[i]["p_low_quality"] > 0.5) == (q == 0) for i, q, _ in late]) > 0.97
    assert np.mean([(got[i]["p_toxic_low_quality"] > 0.5) == (q == 0 and t == 1) for i, q, t in late]) > 0.95
    assert {x["doc_id"] for x in toxicity.reject_toxic(docs, chain).collect()} == {i for i in got if not got[i]["toxic"]}


def test_chain_as_brute_force(spark):
    """Choice of features, folds and ridge models in plain Python, solved by Newton's method: neither features nor weights
    of a fold's model have seen the fold."""
    r, rows, labs = random.Random(9), [], []
    for i in range(240):
        toxic, low = r.random() < 0.4, r.random() < 0.4
        ws = [r.choice("abcd") for _ in range(4)] + [r.choice(["bad", "b"])] * (toxic and r.random() < 0.8) + [r.choice(["junk", "c"])] * (low and r.random() < 0.8) + [f"only{i}"]
        rows.append((i, " ".join(ws), "en", "s", 1))
        labs.append((i, int(not low), int(toxic)))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(labs, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    text = {i: toxicity.features(t.encode()) for i, t, *_ in rows}
    y = np.array([(q == 0, t == 1, q == 0 and t == 1) for _, q, t in labs], float)
    fold = np.array([toxicity.hash_fold(i, 3) for i in range(240)])

    def choose(go):
        chosen, n = set(), go.sum()
        has = Counter(f for i in np.flatnonzero(go) for f in text[i])
        for c in range(3):
            on, pos = Counter(f for i in np.flatnonzero(go) if y[i, c] for f in text[i]), y[go, c].sum()
            score = {f: n * ((on[f] * n - m * pos) / (pos * (n - pos))) * ((on[f] * n - m * pos) / (m * (n - m + 0.5))) for f, m in has.items() if m >= 5}
            chosen |= {f for f, s in score.items() if s >= 20}
        return sorted(chosen)

    def fit(x, t):
        """Least mean log loss plus 1e-3 / (2 n) times the squared weights, without the intercept."""
        x, w, n = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1), len(x)
        ridge = np.append(np.full(x.shape[1] - 1, 1e-3 / n), 0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - 0.7 * np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - t) / n + ridge * w)
        return w

    table = lambda names, i: np.array([[f in text[k] for f in names] for k in i], float).reshape(len(i), len(names))
    every, oof, p = np.arange(240), np.zeros((240, 3)), np.zeros((240, 3))
    assert sorted(chain.words) == choose(every >= 0)
    for c in range(3):
        for f in range(3):
            names, a, b = choose(fold != f), np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = fit(np.column_stack((table(names, a), oof[a, :c])), y[a, c])
            oof[b, c] = 1 / (1 + np.exp(-np.column_stack((table(names, b), oof[b, :c], np.ones(len(b)))) @ w))
    for c in range(3):  # the final models learn from out-of-fold probabilities and are fed each other's
        names = choose(every >= 0)
        w = fit(np.column_stack((table(names, every), oof[:, :c])), y[:, c])
        p[:, c] = 1 / (1 + np.exp(-np.column_stack((table(names, every), p[:, :c], np.ones(240))) @ w))
    got = np.array([[x[f"p_{n}"] for n, _ in toxicity.CATEGORIES] for x in toxicity.score_chain(docs, chain).orderBy("doc_id").collect()])
    assert np.abs(got - p).max() < 0.05 and np.abs(got - p).mean() < 0.01


def test_toxicity_awkward_rows(spark):
    docs = some_docs(spark)
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 1, 0), (1, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    assert toxicity.score_chain(docs, chain).count() == docs.count()
    none = toxicity.fit_chain(docs, labels.limit(0))
    assert toxicity.score_chain(docs, none).where("toxic").count() == 0
    assert toxicity.reject_toxic(docs, none).columns == docs.columns
    assert toxicity.score_chain(empty_docs(spark), none).count() == 0


def test_labelled_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, "b", "en", "s", 1), (1, "c", "en", "s", 1), (1, None, "en", "s", 1), (2, None, "en", "s", 1), (3, "x", "en", "s", 1)], DOC)
    labs = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, labs, toxicity.CATEGORIES, 3).collect()
    assert sorted((x["__id"], x["text"] or "") for x in got) == [(1, "c"), (2, ""), (3, "x")]
    assert toxicity.training_rows(docs, labs, toxicity.CATEGORIES, 5).count() == 5
    assert sorted(x["__id"] for x in decision_list.labelled(docs, labs, max_rows=3).collect()) == [1, 2, 3]


# --- 2


def test_mixture(spark):
    docs = some_docs(spark)
    got = mixing.mix_words(docs).collect()
    assert len(got) == docs.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_words(docs.repartition(3)).collect()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for d, x in zip(sorted(docs.select("source", "text").collect(), key=str), sorted(got, key=str), strict=True):
        sizes[d["source"]] += len(WORDS.findall(d["text"] or ""))
    for x in got:
        assert 0 <= x["taken"] <= 2 * x["size"] and len(x["shards"]) <= 2 and all(0 <= s < 16 for s in x["shards"])
        taken[x["target"]] += x["taken"]
        target[x["target"]] = x["source_size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, pool, still = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = (pool - sum(want.values())) / sum(weight[s] for s in still)
        over = [s for s in still if share * weight[s] > 2 * sizes[s]]
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        still -= set(over)
    want |= {s: share * weight[s] for s in still}
    assert sorted(target) == pytest.approx(sorted(set(want.values())))
    for t, n in taken.items():
        assert abs(n - t * sum(abs(w - t) < 1e-6 for w in want.values())) <= 2


def test_mixture_of_whole_documents(spark):
    docs = some_docs(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("text is null").count() == 0
    assert {x["text"] for x in mixed.collect()} <= {x["text"] for x in docs.collect()}
    assert mixing.mix_words(empty_docs(spark)).count() == 0 and mixing.mix_documents(empty_docs(spark)).count() == 0


def test_split_tree_draws_exact_halves(spark):
    blocks = spark.range(1000).selectExpr("concat('s', id % 3) as source", "id as block")
    got = mixing.split_tree(blocks, 5, 1).groupBy("shard").count().collect()
    assert sorted(x["shard"] for x in got) == [0, 1, 2, 3, 4] and max(x["count"] for x in got) - min(x["count"] for x in got) <= 3


# --- 3


def brute_groups(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids and sets[i] else rows[i][0]) for i in g]
    return sorted(out, key=str)


def near_copies(n: int, seed: int, edits: int):
    """A long list of copies of one text, each with words of its own: more than one list's worth of every shingle."""
    r, base, out = random.Random(seed), prose(seed, 220).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"w{i}x{r.randrange(99)}"
        out.append((1000 * seed + i, " ".join(w)))
    return out


def test_ngram_join_equals_brute_force(spark):
    rows = [(x["doc_id"], x["text"]) for x in some_docs(spark).select("doc_id", "text").collect()]
    rows += near_copies(40, 21, 4) + near_copies(30, 22, 9) + near_copies(8, 23, 7)
    shared = prose(31, 60)
    rows += [(5000 + i, shared + " " + prose(100 + i, 8 + i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as sid", "3 as a", "4 as b", "5 as root", "6 as np")
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.jaccard_groups(docs).collect()), key=str)
    assert got == brute_groups(rows)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = defaultdict(int)
    for _, n, c in brute_groups(rows):
        want[c] = want[c] + 1 if n == 0 else max(1, want[c])
    have = defaultdict(int)
    for x in kept.collect():
        have[x["doc_id"]] += 1
    assert sum(have.values()) == sum(want.values())
    assert ngram_join.jaccard_groups(empty_docs(spark)).count() == 0 and ngram_join.one_of_each_group(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_prefix_bounds_lose_no_link(percent):
    r = random.Random(percent)
    for _ in range(300):
        n, share = r.randrange(1, 60), r.random()
        a = set(r.sample(range(80), n))
        b = {x for x in a if r.random() < 0.7 + 0.3 * share} | set(r.sample(range(80), r.randrange(0, 6)))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        a, b = sorted((sorted(a), sorted(b)), key=len)
        more, met = ngram_join.SHARED - 1, 0
        for x in [x for x in a if x in set(b)]:
            i, j = a.index(x), b.index(x)
            near = i < ngram_join.probe_length(len(a), percent) + more and j < ngram_join.probe_length(len(b), percent) + more
            met += near and bool(ngram_join._meets(np.array(len(a)), np.array(i), np.array(len(b)), np.array(j), percent))
        assert met >= min(ngram_join.SHARED, ngram_join.least_overlap(len(a), len(b), percent))
        assert ngram_join.may_overlap(np.array(a), np.array(b), ngram_join.least_overlap(len(a), len(b), percent))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


# --- 4


def some_pages(spark):
    big = "é<p>" * 1000
    rows = [(1, "http://a.b/c", big), (2, None, big), (3, "http://a.b/\r\nX: y", big), (3, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (None, "u", "x" * 2000), (9, "u", "z" * 3_000_001), (8, "u", "z" * 3_000_001)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as sha1", "3 as chunk", "4 as refers_to")


def test_warc_round_trip(spark):
    pages = some_pages(spark)
    got = sorted((tuple(x) for x in warc.round_trip(pages).collect()), key=str)
    want = []
    for p in pages.collect():
        raw = (p["html"] or "").encode()
        same = [q["page_id"] for q in pages.collect() if q["page_id"] is not None and (q["html"] or "").encode() == raw]
        keep = max(same) if same and len(raw) >= 1000 else None
        again = keep is not None and p["page_id"] != keep
        want.append((p["page_id"], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keep if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    pages = some_pages(spark)
    manifest = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w", chunk=700_000)
    rows = [x for x in warc.read_archives(spark, manifest, chunk=500_000).where("page_id = 9 and record_type = 'response'").orderBy("chunk").collect()]
    assert [x["n_bytes"] for x in rows] == [500_000] * 6 + [1]
    at = hashlib.sha1()
    for x in rows:
        at.update(x["data"])
        assert x["sha1"] == at.hexdigest()
    text = b"".join(gzip.open(f).read() for f in tmp_path.glob("w/*.gz"))
    assert text.count(b"WARC/1.1\r\n") == pages.count() and b"\r\nX: y" not in text


# --- 5


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 16)) + 3 * r.standard_normal((6, 16))[r.integers(0, 6, 3000)]
    x[500:900] = x[500]  # a common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [1.0, 2.0]), (None, [1.0] * 16), (4080, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as leaf", "3 as n")
    for block in (8192, 256):
        old, ann.BLOCK_ROWS = ann.BLOCK_ROWS, block
        try:
            got = defaultdict(list)
            for y in ann.search(df).orderBy("query_id", "rank").collect():
                got[y["query_id"]].append((y["rank"], y["vec_id"], y["score"]))
        finally:
            ann.BLOCK_ROWS = old
        hit = 0
        assert set(got) == set(range(0, 3000, 20))
        for i, found in got.items():
            s = ann.inner(x, x[i])
            s[i] = -np.inf
            best = np.lexsort((np.arange(len(s)), -s))[:20]
            assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == s[f[1]] for f in found)
            hit += len(set(best.tolist()) & {f[1] for f in found})
        assert hit >= 0.95 * 20 * len(got)
    few = ann.search(df.where("vec_id < 5")).collect()
    assert [y["vec_id"] for y in few] and len(few) == 4
    assert ann.search(df.limit(0)).count() == 0


def test_kd_tree_gives_points_by_rising_distance():
    r = np.random.default_rng(4)
    for n in (0, 1, 64, 65, 3000):
        y = np.round(r.standard_normal((n, 5)), 1)
        rows, d2 = (np.concatenate(c) if c else np.empty(0) for c in ([x[i] for x in ann.KdTree(y).nearest(np.zeros(5))] for i in (0, 1)))
        assert sorted(rows.tolist()) == list(range(n)) and np.array_equal(d2, np.sort((y * y).sum(axis=1)))


def test_search_stops_before_all_rows_are_verified():
    r = np.random.default_rng(8)
    x = r.standard_normal((20_000, 32))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    norm2, m = float((x * x).sum(axis=1).max()), 16
    pr, hit = ann.projection(32, m, 5), 0
    block = ann.Block(np.arange(len(x)), x, pr, norm2)
    for i in range(40):
        got = block.search(i, x[i], ann.projected(x[i : i + 1], pr, None)[0], 20, norm2, ann.chi2_quantile(0.93, m), -np.inf)
        s = ann.inner(x, x[i])
        s[i] = -np.inf
        hit += len({v for v, _ in got} & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 40 * 20 and block.verified < 0.6 * 40 * len(x)


def test_every_row_of_a_repeated_query_id_is_answered(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df).collect()))
    assert got == [(20, 1, 3, 1.0), (20, 1, 4, 1.0), (20, 2, 3, 0.1), (20, 2, 4, 0.1)]


def test_chi2_quantile():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and ann.chi2_quantile(0.5, 2) == pytest.approx(1.38629, abs=1e-4)


# --- 6 and 8


def library_ids(texts, end):
    t = WordTokenizer(tokenizer_path()).t
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_packing(spark):
    docs = some_docs(spark)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    have = defaultdict(list)
    for p in pieces:
        have[p["doc_id"], p["doc_tokens"]].append(p)
    want = defaultdict(list)
    rows = docs.select("doc_id", "text").collect()
    for d, ids in zip(rows, library_ids([x["text"] for x in rows], 2), strict=True):
        want[d["doc_id"], len(ids)].append(ids)
    assert set(have) == set(want)
    for k, all_ids in want.items():
        assert sum(p["length"] for p in have[k]) == sum(map(len, all_ids))
        for p in have[k]:
            assert any(zlib.crc32(i[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for i in all_ids)
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    assert packing.pack(empty_docs(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 127, 128, 129, 4095, 4096, 4097, 12345])
def test_cut_lengths(n):
    cut = packing.cut_lengths(n, 4096, 128)
    assert sum(cut) == n and all(x & (x - 1) == 0 for x in cut[:-1]) and cut == sorted(cut, reverse=True)


def test_repair_round_trip(spark):
    docs = some_docs(spark)
    got = repair.round_trip(docs, tokenizer_path()).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0))
    want, at = [], 0
    for d, ids in zip(rows, library_ids([x["text"] for x in rows], 1), strict=True):
        want.append((d["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got.sort(key=lambda x: x["start"])
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got if x["doc_id"] is not None) == sorted(x for x in want if x[0] is not None)
    assert sorted(x["n_tokens"] for x in got if x["doc_id"] is None) == sorted(x[1] for x in want if x[0] is None)
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    assert [x["doc_id"] or -1 for x in got] == sorted(x["doc_id"] or -1 for x in got)
    assert repair.round_trip(empty_docs(spark), tokenizer_path()).count() == 0


def test_grammar_shrinks_and_expands():
    r = np.random.default_rng(0)
    raws = [np.concatenate((np.tile(r.integers(0, 50, 7), 300), r.integers(0, 50, 1000), [1])).astype("<u4") for _ in range(5)]
    data, n_ids, n_symbols, n_rules = repair.shard_bytes([4, None, 6, 7, 8], [x.tobytes() for x in raws], 60, 1)
    shard = repair.Shard(data)
    assert n_rules and n_symbols < 0.8 * n_ids and shard.doc_ids == [4, None, 6, 7, 8]
    for i in (3, 0, 4):
        assert [repair.Shard(data).token(i, 0), *(shard.token(i, at) for at in range(1, len(raws[i])))] == raws[i].tolist()
        assert shard.ids(i).tolist() == raws[i].tolist()
        for at in (-1, len(raws[i])):
            with pytest.raises(IndexError):
                shard.token(i, at)


@pytest.mark.parametrize("per_round", [16, 2048])
def test_grammar_leaves_no_frequent_pair(per_round):
    r = np.random.default_rng(2)
    passage = r.integers(2, 90, 200)
    ids = np.concatenate([np.concatenate((passage, r.integers(2, 90, r.integers(0, 9)), [1] * (i % 3 == 0))) for i in range(1000)] + [np.full(5000, 7), [1]])
    symbols, rules = repair.grammar(ids, 100, 1, per_round=per_round)
    table = repair.expansions(rules, 100)
    assert repair.expand(symbols, *table).tolist() == ids.tolist() and table[2].max() >= 200
    ends = [repair.expand(np.array([x]), *table)[-1] == 1 for x in range(100 + len(rules))]
    assert not any(ends[left] for left, _ in rules.tolist())
    left = Counter((a, b) for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True) if not ends[a])
    assert max(left.values(), default=0) < 8
    assert set(range(100, 100 + len(rules))) <= {*symbols.tolist(), *rules.ravel().tolist()}


# --- 7


def test_url_filter(spark):
    rows = [(1, "http://www.Example.ORG/es/x"), (2, "https://a.example.org/en/12?q"), (3, "ftp://org"), (4, "http://x.com/fr/"), (5, "no scheme"), (6, None), (7, ""), (8, "http://m.bad.net/p.html#f"), (8, "http://bad.net/p/"), (None, "http://bad.net/q"), (9, "http://notexample.org/es/"), (10, "x://h\n?y"), (11, "http://com/de/://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as listed", "2 as block", "3 as w0")
    listed = spark.createDataFrame([("bad.net/p",), ("bad.net/p",), (None,), ("else",)], "url string")
    got = {(x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(pages, listed).collect()}
    assert got == {
        (1, "www.example.org", "/es/x", "example.org/es/", "block"),
        (2, "a.example.org", "/en/12", "example.org/en/1", "block"),
        (3, "org", "", None, "allow"),
        (4, "x.com", "/fr/", "com/fr/", "allow"),
        (5, "", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (8, "m.bad.net", "/p.html", None, "block"),
        (8, "bad.net", "/p/", None, "block"),
        (None, "bad.net", "/q", None, "allow"),
        (9, "notexample.org", "/es/", "org/", "allow"),
        (10, "h\n", "", None, "allow"),
        (11, "com", "/de/://", "com/de/", "block"),
    }
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert url_filter.judge_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 3


def test_bloom_filter_passes_all_listed_and_few_others(spark, monkeypatch):
    urls = spark.range(20_000).selectExpr("concat('u', id) as url")
    listed = urls.where("url like '%7'")
    for most in (1 << 16, 4):  # a filter that is far too small only costs rows of the exact join
        monkeypatch.setattr(url_filter, "MAX_BLOCKS", most)
        got = url_filter.on_list(urls, "url", listed)
        assert got.where("listed <> (url like '%7')").count() == 0 and got.count() == 20_000


# --- 9


def test_licences(spark):
    t = licences.TEMPLATES
    mit = t["MIT-permission"]
    wrapped = mit[:60] + "\n" + mit[60:]
    rows = [(1, "Words here.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "text. All rights reserved. text"), (3, "x\n" + wrapped + " and so on"), (4, "Licensed under CC BY-NC 4.0."), (5, "My driving licence is new and nobody gave permission."), (6, None), (7, ""), (None, t["MIT"]), (8, ("w " * 50_000) + "\n" + t["GPL-3.0"] + "\n" + t["MIT"]), (9, "This work is licensed under the GNU General Public License, version 2.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as licence")
    got = licences.scan_licences(docs).collect()
    assert sorted((x["doc_id"] or 0, x["licence"], x["changed_words"]) for x in got) == [
        (0, "MIT", 0),
        (1, "Apache-2.0", 0),
        (2, "all-rights-reserved", 0),
        (3, "MIT-permission", 0),
        (4, "CC-BY-NC-4.0", 0),
        (8, "GPL-3.0", 0),
        (8, "MIT", 0),
        (9, "GPL-2.0", 0),
    ]
    text = dict(rows)
    for x in got:
        assert text[x["doc_id"]][x["start"] :].split()[0] == t[x["licence"]].split()[0]
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_versions_and_clauses_are_told_apart():
    scanner = licences.Scanner(licences.TEMPLATES, 0.25, 0.2)
    for name, text in licences.TEMPLATES.items():
        for before, behind in (("", ""), ("x\n", "\ny z"), ("Some words first. ", " And more behind.")):
            got = list(scanner.scan(before + text + behind))
            assert (got[0][1], got[0][5]) == (name, 0), (name, got)
    for text in ("This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY 3.0."):
        assert not list(scanner.scan(text))  # a version that no notice has
    edited = licences.TEMPLATES["LGPL-2.1-or-later"].replace("redistribute it", "freely redistribute it").replace("This library", "This fine library")
    assert [(x[1], x[5]) for x in scanner.scan(edited)] == [("LGPL-2.1-or-later", 2)]


def test_findings_as_every_word_start_against_every_template():
    """Of a text with one notice, edited by a few words, the finding has the least share of changed words of all word starts,
    lengths and templates that save enough; a text without one has none."""
    scanner, r = licences.Scanner(licences.TEMPLATES, 0.25, 0.2), random.Random(8)
    for name in sorted(licences.TEMPLATES):
        words = licences.TEMPLATES[name].split()
        for _ in range(r.randrange(1 + len(words) // 20)):
            i = r.randrange(1, len(words))
            if not any(c.isdigit() for c in words[i]) and not re.search(licences.CUES, words[i]):
                words[i] = "changed"
        text = prose(r.randrange(99), 12) + r.choice(["\n", ". "]) + " ".join(words) + " " + prose(5, 12)
        starts, best = [m.start() for m in WORDS.finditer(text)], None
        for k, start in enumerate(starts):
            for kind, mine, n, packer in scanner.templates:
                block = text[start : ([*starts, len(text) + 1][min(k + n, len(starts))]) - 1]
                alone, saved = scanner.sizes(block, packer)
                if saved < 0.25 * alone:
                    continue
                for more in range(int(0.2 * len(mine)) + 1):
                    end = [*starts, len(text) + 1][min(k + n + more, len(starts))] - 1
                    changed = licences.changed_words(mine, licences.plain_words(text[start:end]))
                    if changed <= 0.2 * len(mine) and (best is None or (changed / len(mine), -len(mine)) < best[:2]):
                        best = changed / len(mine), -len(mine), kind
        got = list(scanner.scan(text))
        assert got and got[0][1] == best[2], (name, got, best)
        assert got[0][5] / -best[1] == best[0]


def test_licences_inside_sentences():
    scanner = licences.Scanner(licences.TEMPLATES, 0.25, 0.2)
    gpl = licences.TEMPLATES["GPL-notice"].replace("redistribute it", "freely redistribute it")
    cases = [
        ("This article is licensed under CC BY 4.0.", "licensed", "CC-BY-4.0", 0),
        ("This software is released under the MIT License.", "released", "MIT", 0),
        ("Copyright 2020 A. Body, all rights reserved.", "all", "all-rights-reserved", 0),
        ("x " * 400 + "and (all rights reserved)", "(all", "all-rights-reserved", 0),
        ("w" * 5000 + " our text is licensed under the Apache License, Version 2.0.", "licensed", "Apache-2.0", 0),
        ("Note that " + gpl + " and more", "This", "GPL-notice", 1),
        ("Now licensed under CC BY-SA 4.0 and so on", "licensed", "CC-BY-SA-4.0", 0),
    ]
    for text, first, name, changed in cases:
        got = [(text[s:].split()[0], kind, n) for s, kind, _, _, _, n in scanner.scan(text)]
        assert got == [(first, name, changed)], text
    assert not list(scanner.scan("My driving licence is under the seat, with permission of a free software group, copyright or not."))
    two = "It is released under the MIT License and its text is licensed under CC BY 4.0, all rights reserved."
    assert [x[1] for x in scanner.scan(two)] == ["MIT", "CC-BY-4.0", "all-rights-reserved"]


# --- 10


def brute_statistics(t):
    w = WORDS.findall(t or "")
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_statistics_equal_brute_force(spark):
    docs = some_docs(spark)
    docs = docs.unionByName(docs.limit(1).withColumns({"text": F.lit("a b c d e f g h x a b c d e f g h\n\n \nq\nq\nq"), "doc_id": F.lit(77)}))
    got = decision_list.judge(docs, decision_list.DecisionList(())).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = []
    for d in docs.collect():
        s = brute_statistics(d["text"])
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((d["doc_id"], *s, failed, not failed))
    assert sorted(map(str, ((x["doc_id"], *(x[n] for n in names), x["base_failed"], x["kept"]) for x in got))) == sorted(map(str, want))
    kept = decision_list.keep_good(docs, decision_list.DecisionList(()))
    assert kept.columns == docs.columns and kept.count() == sum(x[-1] for x in want)


def test_decision_list_on_held_out_rows(spark):
    r, rows, labs = random.Random(5), [], []
    for i in range(900):
        bad = r.random() < 0.25
        ws = prose(i, 60).split()
        if bad:
            ws = [w + "###" for w in ws] if r.random() < 0.5 else [w.upper() * 3 for w in ws]
        rows.append((i, " ".join(ws), "en", "s", 1))
        labs.append((i, int(not bad), 0))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(labs, "doc_id long, quality int, toxic int")
    rules = decision_list.learn(decision_list.labelled(docs, labels.where("doc_id < 600")))
    assert 1 <= len(rules.rules) <= 8
    got = {x["doc_id"]: x["kept"] for x in decision_list.judge(docs, rules).collect()}
    assert np.mean([got[i] == bool(q) for i, q, _ in labs if i >= 600]) > 0.97
    empty = decision_list.learn(decision_list.labelled(docs, labels.limit(0)))
    assert empty.rules == ()
    assert decision_list.judge(empty_docs(spark), rules).count() == 0


@pytest.mark.parametrize("feature", ["upper_share", "digit_share"])
def test_decision_list_learns_shouting_and_digit_junk(spark, feature):
    spoilt = {"upper_share": lambda w: w.upper(), "digit_share": lambda w: w.translate(str.maketrans("abcdefghij", "0123456789"))}[feature]
    r, rows, labs = random.Random(6), [], []
    for i in range(600):
        bad = r.random() < 0.3
        ws = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(40, 90))]
        rows.append((i, " ".join(map(spoilt, ws) if bad else ws), "en", "s", 1))
        labs.append((i, int(not bad), 0))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(labs, "doc_id long, quality int, toxic int")
    rules = decision_list.learn(decision_list.labelled(docs, labels.where("doc_id < 400")))
    assert feature in {c.feature for rule in rules.rules for c in rule}
    assert {x["doc_id"]: x["kept"] for x in decision_list.judge(docs, rules).collect()} == {i: bool(q) for i, q, _ in labs}
    assert {x["doc_id"] for x in decision_list.keep_good(docs, rules).collect()} == {i for i, q, _ in labs if q}


def test_upper_and_digit_counts_equal_brute_force(spark):
    docs = some_docs(spark).unionByName(some_docs(spark).limit(1).withColumns({"text": F.lit("A1 ÀB ٣ zZ9 😀 Q\n0"), "doc_id": F.lit(78)}))
    got = sorted(str((x["doc_id"], x["n_upper"], x["n_digits"])) for x in decision_list.statistics(docs).collect())
    assert got == sorted(str((d["doc_id"], len(re.findall("[A-Z]", d["text"] or "")), len(re.findall("[0-9]", d["text"] or "")))) for d in docs.collect())


def test_hot_lists_meet_as_others_do(spark):
    """Joins of lists with hot keys dealt apart give the rows of plain joins, whatever keys are hot."""
    from lociforge.llm.ngram_join import _met_within, _on_lists

    rng = random.Random(12)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 40), i % 90, (20 + i % 7) << 32 | i % 5) for i in range(400)]
    d = spark.createDataFrame(rows, "key long, sid long, np long")
    one = d.groupBy("key").agg(F.min("sid").alias("sid"), F.min("np").alias("np"))
    pick = lambda m: m.selectExpr("key", "l.sid as a", "r.sid as b", "l.np as x", "r.np as y")
    seen = lambda m: sorted(tuple(x) for x in m.collect())
    for hot in ([], [0, 3, 77], range(40)):
        h = spark.createDataFrame([(k,) for k in hot], "key long")
        assert seen(_on_lists(d.alias("l"), one.alias("r"), h, "inner", pick)) == seen(pick(d.alias("l").join(one.alias("r"), "key")))
        assert seen(_on_lists(d, one.where("key % 3 > 0").select("key"), h, "left_semi")) == seen(d.where("key % 3 > 0"))
        assert seen(_met_within(d.alias("l"), d.alias("r"), h, pick)) == seen(pick(d.alias("l").join(d.alias("r"), "key")))


def test_word_tokenizer_looks_words_up_in_large_blocks(monkeypatch):
    """Round 3, op8: 3 MB of texts are at most two lookups, in which repeated words are learned once, with the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lociforge.llm.common import WordTokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(280)]
    t, seen, plain = WordTokenizer(path), [], WordTokenizer._slots
    monkeypatch.setattr(WordTokenizer, "_slots", lambda self, *a: seen.append(1) or plain(self, *a))
    made = list(t.batches(iter([x.encode() for x in texts]), 1))
    assert sum(map(len, texts)) > 2_800_000 and len(made) == 1 and len(seen) == 2
    library = Tokenizer.from_file(path)
    assert made[0][0][: made[0][1][9]].tolist() == [i for x in texts[:10] for i in [*library.encode(x, add_special_tokens=False).ids, 1]]
