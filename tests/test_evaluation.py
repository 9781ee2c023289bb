"""The evaluation of the cluster rule over all pairs, by brute force."""

from datetime import datetime, timedelta
from itertools import combinations

import pytest

from tidewire.operators import similarity

T0 = datetime(2025, 1, 1)
ROWS = [
    ("a", "Harbour bridge closed after storm damage", "s1", 0, "c1"),
    ("b", "Harbour bridge closed after storm damage overnight", "s2", 30, "c1"),  # another source, the next day
    ("c", "Council votes on school budget", "s1", 1, "c1"),  # of the cluster, but unlike: missed
    ("d", "Harbour bridge closed after storm damage", "s3", 20, None),  # like, but in no cluster: a false positive
    ("e", "Harbour bridge closed after storm damage", "s1", 400, "c1"),  # outside the band: missed
    ("f", "Ferry strike enters second week", "s2", 2, "c2"),
    ("g", "Live: harbour bridge closed after storm damage", "s1", 3, "c1"),  # vetoed: missed
    ("h", None, "s1", 3, None),
]


def test_evaluation_counts_all_pairs(spark):
    rows = [(i, h, s, T0 + timedelta(hours=n), c) for i, h, s, n, c in ROWS]
    df = spark.createDataFrame(rows, "id string, headline string, source_id string, fetched_at timestamp, cluster_id string")
    cluster = {r[0]: r[4] for r in ROWS}
    score = {frozenset((r.later_id, r.earlier_id)): r.score for r in similarity.cluster_edges(df).collect()}
    assert score and frozenset("ab") in score
    got = {round(r.threshold, 1): r for r in similarity.evaluation(df).collect()}
    assert sorted(got) == [t / 10 for t in range(1, 9)]
    for threshold, r in got.items():
        want = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
        for a, b in combinations(cluster, 2):
            hit = score.get(frozenset((a, b)), 0) >= threshold
            same = cluster[a] is not None and cluster[a] == cluster[b]
            want[("t" if hit == same else "f") + ("p" if hit else "n")] += 1
        assert {k: r[k] for k in want} == want and r.recall == pytest.approx(want["tp"] / (want["tp"] + want["fn"]))
    empty = similarity.evaluation(df.limit(0)).collect()
    assert len(empty) == 8 and all((r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (0, 0, 0, 0, 1.0, 0.0) for r in empty)
