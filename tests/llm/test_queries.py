def test_llm_queries_run(spark, sf):
    from brindle.llm.queries import REG

    for name in ("p6_ids", "p7_mix", "p7_shares", "p8_found"):
        df = REG.queries[name](spark, sf)
        assert df.count() > 0, name
    assert [f.name for f in REG.queries["p8_found"](spark, sf).schema] == ["doc_id"]
