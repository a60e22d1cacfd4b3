"""Texts without lines keep their row in the rule audit."""

from tastemill.operators import rules as U


def test_null_and_blank_texts(spark):
    rows = [(1, "a", "The sky is blue\n\nfin"), (2, "a", None), (3, "b", "  \n\n "), (4, None, "")]
    res = {r["doc_id"]: r for r in U.rule_results(spark.createDataFrame(rows, "doc_id long, author string, text string")).collect()}
    assert sorted(res) == [1, 2, 3, 4] and res[1]["r20"] and res[1]["n_stanzas"] == 2
    for i in (2, 3, 4):
        assert res[i]["n_stanzas"] == 0
        assert not any(res[i][f"r{r}"] for r in U.SOMEWHERE) and res[i]["r2"] and res[i]["r6"] and res[i]["r19"]
    broken = U.broken_rules(U.rule_results(spark.createDataFrame(rows, "doc_id long, author string, text string"))).collect()
    assert {r["doc_id"]: r["broken"] for r in broken}[2] == list(U.SOMEWHERE)


def test_lines_are_split_once(spark):
    rows = [(1, "a", "A fox in winter\nthe owl, the fox\n\nno animal\nfin"), (1, "b", "A fox"), (2, None, "silver silver and gold"), (None, "c", "fin")]
    res = U.rule_results(spark.createDataFrame(rows, "doc_id long, author string, text string"))
    assert "explode(split" not in res._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["author"], r["n_stanzas"], r["r2"], r["r4"], r["r17"], r["r20"]) for r in res.where("doc_id is null or doc_id = 2").collect()}
    assert got == {(None, "c", 0, True, True, True, False), (2, None, 1, True, True, False, False)}
