"""The pipeline's near-duplicate stage against brute force, and all stages on the driver's smallest table."""

from itertools import combinations
from pathlib import Path

import pytest

from shapeloom.llm import simhash

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def slow_groups(rows, similarity=0.8, size=5):
    """id -> smallest id of what is linked with it, over all pairs."""
    sets = {}
    for k, text in rows:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
        sets[k] = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} or {" ".join(words)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in root}


def test_near_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    want = slow_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    report = {}
    found = {r["node"]: r["root"] for r in simhash.near_groups(docs, report=report).collect()}
    linked = {k: v for k, v in want.items() if k != v}
    right = sum(found.get(k) == v for k, v in linked.items())
    assert right >= 0.99 * len(linked) and all(want[k] == want[v] for k, v in found.items())
    assert len(report["verified"]) == simhash.CONTRACTIONS + 1


def test_stages_hand_on_whole_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(str(SF / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, now, str(SF)), name.replace(" ", "-"))
        assert after.columns == docs.columns and after.exceptAll(now).isEmpty()
        now = after
    kept = {r["doc_id"] for r in now.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(SF)).collect()
    assert {r["doc_id"] for r in packed} == kept and all(r["offset"] + r["length"] <= 1024 for r in packed)
