from tessaly.operators import agreement, fuse


def test_report(spark):
    rows = [(1, [("关税问题", "support", ["证据一"], "甲乙"), ("能源合作", "oppose", ["x"], "")], [("能源合作", "support", ["y"], None), ("关税问题", "support", ["证据一", "z"], "甲丙"), ("多余", "neutral", [], "")]), (2, [], [])]
    both = spark.createDataFrame(rows, f"sample_id long, a {fuse.RECORDS}, b {fuse.RECORDS}")
    r = agreement.report(both).first()
    assert (r.n_samples, r.n_pairs, r.name_similarity, r.stance_agreement, r.shared_evidence) == (2, 2, 1.0, 0.5, 0.5)
    assert (r.evidence_length_a, r.evidence_length_b, r.future_similarity, r.count_delta) == (2.0, 5 / 3, 0.25, 0.5)
    assert [(p["i"], p["j"]) for p in agreement.greedy_pairs(["甲乙", "丙丁"], ["戊己", "甲乙"])] == [(0, 1), (1, 0)]
