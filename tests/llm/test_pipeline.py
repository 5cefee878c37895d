"""Every stage of the pipeline against a plain version of it, each on its own input, on the smallest supplied tables."""

import os
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as p
from lociforge.llm import decision_list, toxicity
from lociforge.llm.common import documents, tokenizer_path, written
from lociforge.llm.mixing import mix
from lociforge.llm.queries import labels
from tests.conftest import SF
from tests.llm.test_llm import WORDS, brute_groups, library_ids


def check_packing(packed, rows):
    """Every id of every row in exactly one piece, as the library gives it."""
    texts = [x["text"] for x in rows]
    tokens = dict(zip((x["doc_id"] for x in rows), library_ids(texts, 2), strict=True))
    want, have = Counter(), Counter()
    for x in rows:
        want[x["doc_id"]] += len(tokens[x["doc_id"]])
    for x in packed:
        have[x["doc_id"]] += x["length"]
        assert x["ids_crc32"] == zlib.crc32(tokens[x["doc_id"]][x["start"] : x["start"] + x["length"]].tobytes())
    assert have == want and tokenizer_path()


def test_toxicity_mixing_and_packing_in_turn(spark):
    """The stages that end in seconds; quality and near duplicates have brute-force tests of their own in test_llm."""
    stages, docs = dict(p.STAGES), documents(spark, SF)
    chain = toxicity.fit_chain(docs, labels(spark, SF))
    clean = written(stages["toxicity"](spark, docs, SF), "toxicity")
    rows = clean.collect()
    assert clean.columns == docs.columns
    assert Counter(x["doc_id"] for x in rows) == Counter(x["doc_id"] for x in docs.collect() if chain.score((x["text"] or "").encode())[1] < 0.5)
    mixed = written(stages["mixing"](spark, clean, SF), "mixing")
    text = {x["doc_id"]: x["text"] for x in rows}
    got = mixed.collect()
    assert mixed.columns == docs.columns and got and all(text[x["doc_id"]] == x["text"] for x in got)
    assert max(Counter(x["doc_id"] for x in got).values()) <= 2
    check_packing(stages["packing"](spark, mixed, SF).collect(), got)


@pytest.mark.skipif("PIPELINE_TEST" not in os.environ, reason="takes ten minutes: set PIPELINE_TEST=1")
def test_stages_in_turn(spark):
    docs, steps = documents(spark, SF), {}
    for name, f in p.STAGES:
        steps[name] = docs
        docs = written(f(spark, docs, SF), name)
        if name != "packing":
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
    steps["end"] = docs
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"] and p.ORACLE_SQL is None
    rows = {k: d.collect() for k, d in steps.items()}
    ids = {k: Counter(x["doc_id"] for x in v) for k, v in rows.items()}

    chain = toxicity.fit_chain(steps["toxicity"], labels(spark, SF))
    bad = {x["doc_id"] for x in rows["toxicity"] if chain.score((x["text"] or "").encode())[1] >= 0.5}
    assert ids["quality"] == Counter(i for i in ids["toxicity"] if i not in bad)

    rules = decision_list.learn(decision_list.labelled(steps["quality"], labels(spark, SF)))
    kept = {x["doc_id"] for x in decision_list.judge(steps["quality"], rules).where("kept").collect()}
    assert ids["near_duplicates"] == Counter(i for i in ids["quality"] if i in kept)

    groups = brute_groups([(x["doc_id"], x["text"]) for x in rows["near_duplicates"]])
    assert ids["mixing"] == Counter(c for i, _, c in groups if i == c)

    size = {x["doc_id"]: len(WORDS.findall(x["text"] or "")) for x in rows["mixing"]}
    text = {x["doc_id"]: x["text"] for x in rows["mixing"]}
    assert max(ids["packing"].values()) <= 2 and all(text[x["doc_id"]] == x["text"] for x in rows["packing"])
    goal = {x["s"]: x["t"] for x in mix(steps["mixing"], ["source"]).selectExpr("kept.c0 as s", "target as t").distinct().collect()}
    taken, largest = defaultdict(int), defaultdict(int)
    for x in rows["mixing"]:
        taken[x["source"]] += size[x["doc_id"]] * ids["packing"][x["doc_id"]]
        largest[x["source"]] = max(largest[x["source"]], size[x["doc_id"]])
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in goal.items())

    check_packing(rows["end"], rows["packing"])
