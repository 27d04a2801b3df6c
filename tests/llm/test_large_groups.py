"""Near-duplicate candidates: what a large group's members have in common is not paired out."""

from tracefold.llm import minhash as M


def join_rows(df):
    """The most rows that a join of the executed plan has made."""
    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            yield from walk(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        metrics = node.metrics()
        if "Join" in node.nodeName() and metrics.contains("numOutputRows"):
            yield metrics.apply("numOutputRows").value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def test_shingles_that_a_group_shares_are_not_paired_out(spark):
    n = 150
    base, common = [f"p{i}" for i in range(50)], [f"c{i}" for i in range(10)]
    words = {i: base + common + [f"w{i}_{j}" for j in range(40)] for i in range(n)}
    for a in (3, 60):
        words[a + 1] = base + common + words[a][-40:-5] + [f"v{a}_{j}" for j in range(5)]
    words[n] = base + [f"q{j}" for j in range(50)]
    m = spark.createDataFrame([(i, len(w), 7, i) for i, w in words.items()], "node long, n long, band long, comp long")
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "node long, t string")
    found = M._unresolved(m, texts, 1, 80)
    # a row for each shingle at most, not for each pair of documents
    assert join_rows(found) <= sum(map(len, words.values()))
    sets = {i: set(w) for i, w in words.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked == {(3, 4), (60, 61)}
    assert {tuple(sorted(r)) for r in found.collect()} == linked
