import re
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import graph, ranking, text, vector


def test_chunks_cover_and_link(spark):
    body = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(1, body), (2, "short"), (3, ""), (4, None)], "id int, t string")
    rows = text.chunks(df, "id", "t", 300, 50).orderBy("id", "chunk_index").collect()
    one = [r for r in rows if r.id == 1]
    assert one[0].start == 0 and one[-1].end == 1000 and all(a.end - b.start == 50 for a, b in zip(one, one[1:]))
    assert all(a.next_chunk_id == b.chunk_id and b.prev_chunk_id == a.chunk_id for a, b in zip(one, one[1:]))
    assert one[0].prev_chunk_id is None and one[-1].next_chunk_id is None
    assert [r.id for r in rows if r.id > 1] == [2] and all(body[r.start : r.end] == r.chunk_text for r in one)


def test_sections_markers_quantities(spark):
    df = spark.createDataFrame([(1, "intro\n# A b\nx\n## C\ny\n"), (2, "none"), (3, None)], "id int, t string")
    got = [(r.id, r.level, r.title, r.body) for r in text.markdown_sections(df, "id", "t").orderBy("id", "section_index").collect()]
    assert got == [(1, 1, "A b", "x\n"), (1, 2, "C", "y\n"), (2, 0, None, "none")]
    m = spark.createDataFrame([(1, "It leads to loss and Reduces cost; reducing, unreduced."), (2, None)], "id int, t string")
    assert {(r.marker, r.n) for r in text.causal_markers(m, "id", "t").collect()} == {("leads to", 1), ("reduces", 1), ("reducing", 1)}
    c = "Ann Lee met Jobort Bopá and BIG Corp in New York City"
    spans = [r.span for r in text.capitalized_spans(spark.createDataFrame([(1, c)], "id int, t string"), "id", "t").collect()]
    assert spans == re.findall(r"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", c)
    q = spark.createDataFrame([(1, "by 40 percent, 12bps"), (2, None)], "id int, t string")
    assert [r.quantity for r in text.quantities(q, "id", "t").collect()] == ["by 40 percent", "12bps"]


def test_scores(spark):
    df = spark.createDataFrame([("The cat", "the CAT sat", "5% of 20", "21"), ("", "", "", ""), (None, "x", None, "y")], "a string, b string, c string, d string")
    r = df.select(text.lexical_overlap(F.col("a"), F.col("b")).alias("o"), text.numbers_aligned(F.col("c"), F.col("d")).alias("n")).collect()
    assert [x.o for x in r] == [2 / 3, 1.0, None] and [x.n for x in r][:2] == [False, True]
    k = text.keyword_search(spark.createDataFrame([(2, "red fox"), (1, "Red fox"), (3, "blue"), (4, None)], "id int, t string"), "id", "t", "red fox").collect()
    assert [(x.id, x.score) for x in k] == [(1, 1.0), (2, 1.0)]


def test_merge_spans(spark):
    rows = [(1, 0, 5, "concept", 0.5), (1, 4, 9, "causal_marker", 0.5), (1, 9, 12, "DATE", 0.1), (1, 9, 12, "DATE", 0.1)]
    df = spark.createDataFrame(rows, "doc int, start int, end int, type string, confidence double")
    assert sorted((r.start, r.type) for r in text.merge_spans(df, "doc").collect()) == [(4, "causal_marker"), (9, "DATE")]


def test_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "bot", None), (1, 4, "user", "c"), (2, 1, None, "x"), (2, 2, None, "y")]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    got = [(r.conv, r.role, r.n_turns, r.chunk_text) for r in text.transcript_turns(df, "conv", "turn", "role", "text").orderBy("conv", "chunk_index").collect()]
    assert got == [(1, "user", 2, "a\nb"), (1, "bot", 1, ""), (1, "user", 1, "c"), (2, None, 2, "x\ny")]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (None, 1)], "src int, dst int")
    assert sorted(r.node for r in graph.cyclic_nodes(e).collect()) == [1, 2, 3, 6]
    t = graph.trace(e, spark.createDataFrame([(1,)], "node int"), 10)
    assert sorted((r.node, r.hop) for r in t.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    up = graph.trace(e, spark.createDataFrame([(5,)], "node int"), 2, "up")
    assert sorted((r.node, r.hop) for r in up.collect()) == [(3, 2), (4, 1), (5, 0)]
    assert graph.cyclic_nodes(e.limit(0)).count() == 0
    v = spark.createDataFrame([("k", "human", 1, datetime(2024, 1, 1)), ("k", "llm", 2, datetime(2024, 2, 1))], "k string, who string, v int, t timestamp_ntz")
    assert graph.latest_by_trust(v, ["k"], "v", F.when(F.col("who") == "human", 3).otherwise(1), "t").first().v == 1


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector, "QUERY_BLOCK_BYTES", 64)
    got = {}
    for r in vector.search(df.where("vec_id % 100 = 0"), df, "vec_id", "embedding", 5).collect():
        got.setdefault(r.query_id, {})[r.place] = r.id
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for qid in (0, 100, 200):
        s = n @ n[qid]
        s[qid] = -9
        assert [got[qid][p] for p in range(1, 6)] == list(np.argsort(-s)[:5])
    assert vector.search(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("none", "z", 1)], "query string, item string, place int")
    gold = spark.createDataFrame([("q", "b", 2), ("q", "x", 1), ("lost", "y", 1)], "query string, item string, grade int")
    m = {r.query: r for r in ranking.metrics(hits, gold, (1, 3)).collect()}
    assert m["q"].precision_at_3 == 1 / 3 and m["q"].recall_at_3 == 0.5 and m["q"].mrr == 0.5
    assert abs(m["q"].ndcg_at_3 - (3 / np.log2(3)) / (3 + 1 / np.log2(3))) < 1e-9
    assert m["none"].mrr == 0 and m["lost"].recall_at_3 == 0
    a = spark.createDataFrame([("23.4", "0.234", "percent"), ("1,000", "1000", "integer"), ("UNKNOWN", "x", "text"), ("Low", "low", "text"), ("abc", "1", "float"), (None, "1", "float")], "a string, g string, k string")
    swapped = a.select(F.col("g").alias("ans"), F.col("a").alias("gold"), "k")
    assert ranking.grade_answers(swapped, "ans", "gold", "k").first().correct  # 0.234 for 23.4 %
    assert [r.correct for r in ranking.grade_answers(a, "a", "g", "k").collect()] == [False, True, False, True, False, False]


def test_entity_spans_and_a_stage(spark):
    df = spark.createDataFrame([(1, "Ann Lee leads to 5 percent loss"), (2, ""), (3, None)], "id int, t string")
    got = [(r.start, r.end, r.type, r.span) for r in text.entity_spans(df, "id", "t").collect()]
    assert got == [(0, 7, "PROPER_NOUN", "Ann Lee"), (8, 16, "causal_marker", "leads to"), (17, 26, "quantitative_claim", "5 percent")]
    more = text.entity_spans(df, "id", "t", [lambda v: [(0, 7, "PERSON", 0.9)]]).collect()
    assert [(r.start, r.type) for r in more][0] == (0, "PERSON")


def test_scenario_from_profile_to_search(spark):
    """Profile, candidate pairs, correlation, markers and search in one go over an invented training table."""
    from brindle.operators import profiling

    rng = np.random.default_rng(42)
    rows = [(i, float(t), float(min(100, 20 + t + rng.normal(0, 5))), int(i % 2)) for i, t in enumerate(rng.integers(0, 60, 220))]
    df = spark.createDataFrame(rows, "employee_id int, tenure_months double, progress_percent double, is_overdue int")
    prof = profiling.profile_table(df)
    kept = {c for r in profiling.candidate_pairs(prof).collect() for c in (r.column_x, r.column_y)}
    assert "employee_id" not in kept  # unique, so no candidate
    r = profiling.pairwise_pearson(df, ["tenure_months", "progress_percent"], 0.05, 0.1).first()
    assert r.correlation > 0.5 and r.p_value < 0.01
    docs = spark.createDataFrame([(1, "Tenure increases progress by 12 percent")], "id int, t string")
    assert text.causal_markers(docs, "id", "t").first().marker == "increases"
    assert text.keyword_search(docs, "id", "t", "tenure progress").first().score == 1.0


def test_grounding_query_tests_every_sentence(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "First one here. Then 12 more follow!\nThe last", "en", "s"), (2, "word " * 30 + "end.", "en", "s"), (3, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.claim_index, r.overlap) for r in entry.queries()["x13_grounding"](spark, str(tmp_path)).orderBy("doc_id", "claim_index").collect()]
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (2, 0)] and got[-1][2] == 1.0


def _claims(df):
    return df.select("doc_id", "text", F.posexplode(F.filter(F.split("text", text.SENTENCE_END), lambda c: F.trim(c) != "")).alias("claim_index", "claim"))


def test_sentence_grounding_is_grounding_of_every_sentence(spark):
    odd = [
        "A 5. Then 5.1 more!\n\nIt's 40 % of 39.5?  no", "x3.12 \n%", "x3.12 \n% and 11.9", "x3.12 \n% y " + "9" * 400 + ". And 7 now", "9" * 400 + ". Once " + "9" * 400, "x3.12\n% 13",
        "ΑΣ. Σ KK İx 3½ m² ~5%", "…\n!\n—", "\t\n \n \n", "0. 0.0 0%\n0.0000001", "~ 5 %. ~5\n%", "é5 5́. ́5", "", " ", None, "a\r\nb c. d\x0be", "v1.2.3. 1.2.3\n2.3",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string")
    names = ["doc_id", "claim_index", "overlap", "numbers_ok", "strength", "grounded"]
    for options in ({}, {"min_lexical": 0.4, "weight_overlap": 0.8}):
        want = sorted(text.grounding(_claims(df), "claim", "text", **options).select(*names).collect())
        assert sorted(text.sentence_grounding(df, "doc_id", "text", **options).select(*names).collect()) == want
    assert {(r.doc_id, r.claim_index) for r in want if not r.numbers_ok} == {(1, 0), (4, 0), (4, 1), (5, 0)}


def test_grounding_query_grows_with_the_text(spark, tmp_path):
    """A text of 1,500 sentences with numbers: each against the whole of it took over a minute."""
    import time

    import __spark_entry__ as entry

    body = " ".join(f"Item {i} costs {i * 7} of {i / 8}%." for i in range(1500))
    spark.createDataFrame([(1, body, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = entry.queries()["x13_grounding"](spark, str(tmp_path)).collect()
    assert len(got) == 1500 and all(r.numbers_ok for r in got) and time.time() - began < 60
