import pytest
from pyspark.sql import functions as F
from tessaly.operators import split
from tessaly.plans import texts


def brute(rows, quota, total, least):
    groups = sorted({g for g, _, _ in rows})
    own = {g: sorted(i for x, i, _ in rows if x == g) for g in groups}
    rare = {g: sorted(i for x, i, s in rows if x == g and s) for g in groups}
    picked = []
    while len(picked) < least and any(rare.values()):
        for g in groups:
            if rare[g] and len(picked) < least:
                picked.append((g, rare[g].pop(0)))
    taken = {g: sum(x == g for x, _ in picked) for g in groups}
    left = {g: max(0, quota.get(g, 0) - taken[g]) for g in groups}
    for _ in range(1000):
        gap = total - len(picked) - sum(left.values())
        if gap > 0:
            g = next((g for g in sorted(groups, key=lambda g: -len(own[g])) if len(own[g]) > taken[g] + left[g]), None)
            if g is None:
                break
            left[g] += 1
    over = len(picked) + sum(left.values()) - total
    for g in sorted(groups, key=lambda g: -left[g]):
        cut = min(max(over, 0), left[g])
        left[g] -= cut
        over -= cut
    for g in groups:
        picked += [(g, i) for i in own[g] if (g, i) not in picked][: left[g]]
    return sorted(picked)


@pytest.mark.parametrize("quota", [{"a": 17, "b": 15, "c": 5, "d": 2, "e": 1}, {"a": 3}, {"a": 30, "b": 8, "c": 1}])
def test_priority_quotas_shortfall_and_overflow(spark, quota):
    n = {"a": 90, "b": 40, "c": 9, "d": 3, "e": 2, "f": 1}
    rows = [(g, 100 * k + i, i % 5 == 4 or g in "df") for k, g in enumerate(n) for i in range(n[g])]
    df = spark.createDataFrame(rows, "g string, i long, s boolean").repartition(3)
    got = split.held_out(df, "g", ["i"], lambda g: quota.get(g, 0), scarce=F.col("s")).collect()
    assert len(got) == 40 and sorted((r.g, r.i) for r in got) == brute(rows, quota, 40, 8)


def test_the_query_keeps_its_size(spark, tmp_path):
    def run(counts):
        rows = [(1000 * s + i, f"src{s}") for s, n in enumerate(counts) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return texts.stratified_split(spark, str(tmp_path)).groupBy("source").count().collect()

    assert {r["count"] for r in run([5] * 20)} == {2}
    short = {r.source: r["count"] for r in run([5] * 9 + [50])}
    assert short["src9"] == 22 and sum(short.values()) == 40
    assert sum(r["count"] for r in run([5] * 25)) == 40
    with pytest.raises(ValueError, match="not 40"):
        run([5] * 19 + [1])
