"""The prefix trie, MinHash groups, source divergence and the splitting of long lists, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lociforge.llm import divergence, lists, minhash, ngram_join, prefix_trie
from lociforge.llm.common import shingle_sets

from .test_llm import DOC, WORDS, empty_docs, prose, some_docs

CONV = "conv_id long, turn long, role string, text string"


# --- prefix trie


def trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()[:16], r or "", x or ""))
    conv = {c: [x[3:] for x in sorted(ts)] for c, ts in conv.items()}
    built = {}
    for c, ts in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = conv.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:]
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(set), Counter(), Counter()
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].add(n)
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] += not kids[n]
        saved[n] += (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0
        if n:
            leaves[n[:-1]] += leaves[n]
            saved[n[:-1]] += saved[n]
    ends = {n: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n)))) for n, m in nodes.items()}
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items())


def conversations():
    r, rows = random.Random(5), []
    for c in [*range(60), *range(100, 140), 250, 251, 252, -5, -150, 100_001]:
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, r.choice([t, t, None]) if c % 7 == 0 else t, r.choice(["u", "a", None]), r.choice(["x", "yy", "é🙂", None, ""])))
    for c in range(300, 330):  # copies, some of which go on
        rows += [(c, t, "u", "same" if t < 10 else str(c % 2)) for t in range(12 + (c % 3 if c >= 320 else 0))]
    return rows + [(7, 3, "u", "x")] * 2 + [(None, 1, "u", "x")]


@pytest.mark.parametrize(("size", "shards"), [(256, 17), (3, 6)])
def test_trie_as_brute_force(spark, size, shards):
    """Also where conversations are longer than a segment and copies fall into several shards."""
    rows = conversations()
    d = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as key", "2 as part", "3 as depth", "4 as id")
    got = prefix_trie.conversation_trie(d, size, shards).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    rows = [(105, 1, "u", "x")]  # h turns are taken from a conversation that isn't there
    assert sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV)).fillna(-1, ["parent_conv_id"]).collect())) == trie(rows)


def test_one_conversation_of_most_rows(spark):
    """Its turns are dealt to many tasks, and its row is cut into segments."""
    rows = [(1, t, "u", f"t{t}") for t in range(3000)] + [(c, t, "u", f"t{t}") for c in (2, 3) for t in range(40)]
    dealt, runs = prefix_trie.placed_turns(spark.createDataFrame(rows, CONV))
    sizes = [x["count"] for x in dealt.groupBy("part").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.6 * len(rows)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, CONV), 64, 5).fillna(-1, ["parent_conv_id"]).collect()
    assert sorted(map(tuple, got)) == trie(rows)


# --- MinHash


def groups(rows, percent):
    """doc_id, n_shingles, component_id of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        ws = [w.lower() for w in WORDS.findall(t or "")]
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i), k) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(n, length, edits, seed, first):
    r = random.Random(seed)
    base = prose(seed, length).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_minhash_groups_as_brute_force(spark):
    """A large group whose members lie on either side of the threshold, short texts, and the awkward rows."""
    rows = [(x["doc_id"], x["text"]) for x in some_docs(spark).collect()] + near_copies(250, 120, 8, 11, 100) + near_copies(60, 12, 3, 12, 400)
    r = random.Random(1)
    rows += [(500 + i, " ".join(r.choice("abc") for _ in range(r.choice([3, 5, 7, 9])))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as sid", "3 as key", "4 as root", "5 as kept", "6 as sig")
    got = minhash.minhash_groups(d).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == groups(rows, 85)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert minhash.minhash_groups(empty_docs(spark)).count() == 0
    assert {x["kept"] for x in minhash.minhash_groups(spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")).collect()} == {True}


def test_signatures_in_blocks(monkeypatch):
    sets = list(shingle_sets(iter([prose(i, 5 + 40 * i).encode() for i in range(1, 9)])))
    want = [[min(int(x) for x in ((s ^ a) * b) >> np.uint64(32)) for a, b in zip(minhash._SEEDS, minhash._FACTORS)] for s in sets]
    for block in (7, 100, 1 << 15):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert minhash.signatures(sets).tolist() == want
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    b[:2400] = a[:2400]  # similarity 2/3
    x, y = minhash.signatures([np.unique(a), np.unique(b)])
    assert abs((x == y).mean() - 2 / 3) < 0.13


def test_posterior_bounds_keep_what_reaches_the_threshold():
    least = minhash.least_matches(85)
    assert least == sorted(least) and all(0 < m <= n for m, n in zip(least, range(minhash.STEP, minhash.HASHES + 1, minhash.STEP)))
    rng = np.random.default_rng(0)
    kept = {}
    for s in (0.5, 0.7, 0.85):
        hit = (rng.random((20_000, minhash.HASHES)) < s).cumsum(1)[:, minhash.STEP - 1 :: minhash.STEP]
        kept[s] = (hit >= np.array(least)).all(1).mean()
    assert kept[0.85] == 1 and kept[0.5] < 0.01 and kept[0.7] < 0.95


def test_long_lists_are_split(spark, monkeypatch):
    """Lists beyond a few members are split by their next keys: near copies around the threshold and short sets, all pairs."""
    monkeypatch.setattr(lists, "FEW", 4)
    rows = near_copies(120, 60, 12, 21, 0) + near_copies(80, 9, 3, 22, 200)
    r = random.Random(7)
    rows += [(400 + i, f"a{r.randrange(3)} b{r.randrange(3)} c c c c d{r.randrange(3)}" + f" e{r.randrange(3)}" * r.randrange(2)) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_groups(d).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=str) == groups(rows, 75)


def test_templated_short_texts_make_few_candidates(spark, monkeypatch):
    """Texts of one template that share lists but no link: no pair of them is a candidate."""
    made = []
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, sets, percent, f=ngram_join.verified: made.append(pairs.count()) or f(pairs, sets, percent))
    r = random.Random(1)
    rows = [(i, f"a{r.randrange(10)} b{r.randrange(10)} c c c c d{r.randrange(10)} e{r.randrange(10)}") for i in range(3000)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().count()
    assert got == len({t for _, t in rows}) and sum(made) < 1000


def test_parity_bits_bound_what_two_sets_differ_in(spark):
    """They never differ in more bits than elements, so no link at the threshold is lost; unlike sets differ in more."""
    rng = np.random.default_rng(2)
    made = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (1, 2, 7, 40, 150, 3000)]
    rows = [(2 * i, s.tobytes()) for i, s in enumerate(made)]
    rows += [(2 * i + 1, np.sort(np.concatenate((s[len(s) // 7 :], rng.integers(0, 2**64, len(s) // 7, np.uint64)))).tobytes()) for i, s in enumerate(made)]
    got = {x["sid"]: x for x in ngram_join.parity_bits(spark.createDataFrame(rows, "sid long, keys binary"), 4).collect()}
    sets = {k: set(np.frombuffer(x, np.uint64).tolist()) for k, x in rows}
    apart = {(a, b): sum(bin((got[a][m] ^ got[b][m]) & (2**64 - 1)).count("1") for m in lists.BITS) for a in sets for b in sets}
    assert all(n <= len(sets[a] ^ sets[b]) and n % 2 == len(sets[a] ^ sets[b]) % 2 for (a, b), n in apart.items())
    most = lambda a, b: len(sets[a]) + len(sets[b]) - 2 * -(-75 * (len(sets[a]) + len(sets[b])) // 175)
    assert all(apart[a, a + 1] <= most(a, a + 1) for a in (6, 8, 10)) and apart[6, 7] > 0
    assert apart[8, 6] > most(8, 6)


# --- source divergence


def divergence_by_hand(rows, least, top):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        texts = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in texts.items() if n >= least)
        share = {}
        for name in [None, *{d[1] for d in mine}]:
            n = Counter(t for d in mine if name is None or d[1] == name for t in d[2])
            total = sum(n[t] for t in kept)
            share[name] = {t: (1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)), n[t]) for t in kept}
        for s in share:
            if s is None:
                continue
            pairs = [(sum(abs(share[s][t][0] - share[o][t][0]) for t in kept), o) for o in share if o not in (s, None)]
            terms = [(share[s][t][0] - share[None][t][0], t) for t in kept if share[s][t][1] and share[s][t][0] > share[None][t][0]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 2000)
    monkeypatch.setattr(divergence, "HELD", 200)
    r = random.Random(4)
    vocabulary = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "Ünï", "UPPER", "你好世界你好世界", "x" * 40, "x" * 41, "éééééééé", "zİk"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choice(vocabulary) + r.choice(["", ",", "7", "\x00", "\t"]) for _ in range(r.randrange(60))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "S1", None, "é"])) for i in range(300)]
    rows += [(None, "en", "only null"), ("", "fr", "s1"), ("one two", "fr", "s2"), ("big " * 3000 + "abc " * 500, "en", "s1")] + [rows[0]] * 3
    d = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as texts", "4 as block", "5 as salt")
    for least, side in ((30, 512), (3, 2)):
        got = divergence.source_divergence(d, least, side=side).collect()
        assert sorted((x["lang"], x["source"], x["part"], x["item"], x["value"], x["rank"]) for x in got) == divergence_by_hand(rows, least, 50)
    assert divergence.source_divergence(spark.createDataFrame([], DOC)).count() == 0


def test_packed_terms():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 3, 500).astype(np.uint64) << np.uint64(60), r.integers(0, 2**63, 500).astype(np.uint64)
    assert divergence.radix_order([a, b]).tolist() == sorted(range(500), key=lambda i: (int(a[i]), int(b[i])))
    counts = divergence.TermCounts()
    text = ("word " * 50 + "abcdefghijkl " * 30 + "y" * 30 + " ") * 20
    counts.block([text.encode()], np.array([4]), piece=100)  # one text in many pieces is one text
    counts.block([b"word", b"Word word", b""], np.array([4, 5, 5]))
    got = {(t.decode(), int(g)): (int(n), int(m)) for terms, groups_, ns, ms in counts.taken() for t, g, n, m in zip(terms, groups_, ns, ms)}
    assert got == {("word", 4): (1001, 2), ("abcdefghijkl", 4): (600, 1), ("y" * 30, 4): (20, 1), ("word", 5): (2, 1)}
    big = np.array([0, 1, 10**13, 3 * 10**14])
    assert divergence.shares(big, 4 * 10**14, 7, 5).tolist() == [1 + 10**9 * (int(c) + 5) // (4 * 10**14 + 35) for c in big]
