import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import chunking, evaluate, filters, fusion, lexical, parents, patterns, rerank, search
from tessera.sources import loaders


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_vector_facts(spark):
    df = spark.sql("select array(1d,2d,3d) a, array(4d,5d,6d) b, array(3d,4d) c, array(0d,0d) z")
    r = df.select(V.dot(F.col("a"), F.col("b")).alias("dot"), V.norm(F.col("c")).alias("n"), V.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.col("c")).alias("l2"), V.manhattan(F.array(F.lit(0.0), F.lit(0.0)), F.col("c")).alias("l1"), V.cosine(F.col("c"), F.col("z")).alias("zero"), V.normalize(F.col("z")).alias("nz")).first()
    assert (r["dot"], r["n"], r["l2"], r["l1"], r["zero"], r["nz"]) == (32, 5, 5, 7, 0, [0, 0])
    with pytest.raises(Exception, match="dimension"):
        df.select(V.dot(F.col("a"), F.col("c"))).collect()


def test_flat_search_and_filters(spark):
    v = spark.createDataFrame([("rec1", [1.0, 0.0, 0.0], "a"), ("rec2", [0.99, 0.01, 0.0], "b"), ("rec3", [0.0, 1.0, 0.0], "a")], "chunk_id string, embedding array<double>, tenant string")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, q array<double>")
    assert [r["chunk_id"] for r in search.top_k(v, q, 2).orderBy("rank").collect()] == ["rec1", "rec2"]
    assert [r["chunk_id"] for r in search.top_k(v, q, 2, predicate=F.col("tenant") == "a").orderBy("rank").collect()] == ["rec1", "rec3"]
    assert search.post_filtered(v, q, 1, 1, F.col("tenant") == "b").count() == 0  # the pool starves
    assert [r["chunk_id"] for r in search.graph_search(v, q, 2).orderBy("rank").collect()] == ["rec1", "rec2"]
    assert search.at_least(search.top_k(v, q, 3), 0.5).count() == 2



def test_more_queries_than_a_block(spark, monkeypatch):
    from tessera.plans import search_queries as Q

    points = [(i, [math.cos(i), math.sin(i)]) for i in range(12)]
    v = spark.createDataFrame(points, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame(points, "query_id long, q array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(Q, "vectors", lambda spark, d: v.withColumn("label", F.lit(1)))
    monkeypatch.setattr(Q, "vector_queries", lambda spark, d: q)
    want = [(i, i) for i in range(12)]
    for hits in (Q.vector_topk("cosine", k=1)(spark, ""), Q.prefilter_topk(spark, "").where("rank = 1"), search.ranked(search.scores(v, q), 1)):
        assert rows(hits.select("query_id", "chunk_id"), "query_id") == want


def test_more_graph_queries_than_a_block(spark, monkeypatch):
    points = [(i, [math.cos(i), math.sin(i)]) for i in range(12)]
    v = spark.createDataFrame(points, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame(points, "query_id long, q array<double>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert rows(search.graph_search(v, q, 1).select("query_id", "chunk_id"), "query_id") == [(i, i) for i in range(12)]


def test_stems():
    for word, want in {"running": "run", "connections": "connect", "relational": "relat", "ponies": "poni", "caresses": "caress", "hopping": "hop", "agreed": "agre", "sky": "sky", "happy": "happi", "at": "at"}.items():
        assert X.stem(word) == want


def test_technical_tokens(spark):
    df = spark.createDataFrame([(1, "See ERR_TIMED_OUT at /api/v1 createPaymentIntent 0x80FF"), (2, None), (3, "")], "id long, text string")
    got = [(r["term"], r["start_off"]) for r in X.tokenize(df, "id", "text", "technical").orderBy("pos").collect()]
    assert [t for t, _ in got] == ["see", "err_timed_out", "err", "timed", "out", "at", "api/v1", "api", "v1", "createpaymentintent", "create", "payment", "intent", "0x80ff", "0x80", "ff"]
    assert got[1][1] == got[4][1] == 4
    assert [r["term"] for r in X.analyze(df, "id", "text", "standard").orderBy("pos").collect()][:3] == ["see", "err", "time"]
    simple = X.tokenize(spark.createDataFrame([(1, '("Hello, world!")')], "id long, text string"), "id", "text", "simple").orderBy("pos").collect()
    assert [(r["term"], r["start_off"], r["end_off"]) for r in simple] == [("hello", 2, 7), ("world", 9, 14)]


def test_index_removal_and_scores(spark):
    df = spark.createDataFrame([("d1", "apple banana apple"), ("d2", "banana cherry"), ("d3", "date")], "id string, text string")
    tokens = lexical.token_rows(df, "id", X.service_tokens(F.col("text")))
    q = spark.createDataFrame([(1, "apple"), (1, "banana")], "query_id long, term string")
    best = lexical.bm25(tokens, q).orderBy(F.desc("score")).collect()
    assert [r["chunk_id"] for r in best] == ["d1", "d2"]
    assert {r["term"]: r["df"] for r in lexical.term_stats(tokens).collect()} == {"apple": 1, "banana": 2, "cherry": 1, "date": 1}
    left = lexical.remove_chunks(tokens, spark.createDataFrame([("d1",)], "chunk_id string"))
    assert {r["term"] for r in lexical.term_stats(left).collect()} == {"banana", "cherry", "date"}
    assert lexical.reindex(tokens, left.where("chunk_id = 'd2'")).count() == tokens.count()
    stats = lexical.index_stats(tokens).first()
    assert (stats["n"], stats["total_tokens"], stats["vocabulary"], stats["avgdl"]) == (3, 6, 4, 2.0)
    parts = lexical.bm25_explain(tokens, q).groupBy("chunk_id").agg(F.sum("contribution").alias("s")).collect()
    assert {r["chunk_id"]: round(r["s"], 9) for r in parts} == {r["chunk_id"]: round(r["score"], 9) for r in best}


def hits(spark):
    return spark.createDataFrame([(1, "dense", "A", 0.92, 1), (1, "dense", "B", 0.85, 2), (1, "dense", "C", 0.70, 3), (1, "sparse", "C", 12.5, 1), (1, "sparse", "A", 8.2, 2)], "query_id long, source string, chunk_id string, score double, rank int")


def test_fusion_facts(spark):
    got = {r["chunk_id"]: r["score"] for r in fusion.rrf(hits(spark)).collect()}
    assert got["A"] == round(1 / 61 + 1 / 62, 9) and got["C"] == round(1 / 63 + 1 / 61, 9)
    assert {r["chunk_id"]: r["score"] for r in fusion.rrf(hits(spark), 10).collect()}["A"] == round(1 / 11 + 1 / 12, 9)
    three = spark.createDataFrame([(1, "s", "a", 1.0, 3), (1, "s", "b", 2.0, 2), (1, "s", "c", 3.0, 1)], "query_id long, source string, chunk_id string, score double, rank int")
    norms = {m: [r["norm"] for r in fusion.normalized(three, m).orderBy("chunk_id").collect()] for m in ("minmax", "zscore", "softmax", "none")}
    assert norms["minmax"] == [0, 0.5, 1] and norms["zscore"][1] == 0.5 and abs(sum(norms["softmax"]) - 1) < 1e-9 and norms["none"] == [1, 2, 3]
    one = three.where("chunk_id = 'a'")
    assert [fusion.normalized(one, m).first()["norm"] for m in ("minmax", "zscore")] == [1.0, 0.5]


def test_multi_query_merge(spark):
    h = spark.createDataFrame([(1, "q0", "x", 0.9, 1), (1, "q0", "y", 0.8, 2), (1, "q1", "x", 0.7, 1), (1, "q1", "z", 0.6, 2)], "question_id long, query_id string, chunk_id string, score double, rank int")
    r = fusion.merge_queries(h).orderBy("rank").collect()
    assert len(r) == 3 and r[0]["chunk_id"] == "x" and r[0]["occurrences"] == 2 and r[0]["ranks"] == {"q0": 1, "q1": 1}


def test_rank_correlation_facts(spark):
    lists = lambda ids: spark.createDataFrame([(1, f"chunk_{i}", k + 1) for k, i in enumerate(ids)], "query_id long, chunk_id string, rank int")
    r = evaluate.agreement(lists([1, 2, 3, 4]), lists([2, 1, 4, 5])).first()
    assert r["common"] == 3 and r["jaccard"] == 0.6
    r = evaluate.agreement(lists([1, 2]), lists([3, 4])).first()
    assert (r["common"], r["kendall_tau"], r["spearman_rho"]) == (0, 0, 0)
    assert evaluate.recall(lists([1, 2]), lists([1, 2])).first()["recall"] == 1.0


META = "id long, tenant_id string, department string, access_level int, is_public boolean, created_at string, tags array<string>"


def test_every_filter_operator(spark):
    df = spark.createDataFrame([(1, "t1", "eng", 2, False, "2024-05-01", ["a", "b"]), (2, "t1", None, 0, True, "2023-01-01", []), (3, "t2", "hr", 1, None, None, None)], META)
    ids = lambda f, **o: [r["id"] for r in df.where(filters.compile_filter(f, df.schema, **o)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3] and ids(None) == [1, 2, 3]
    assert ids({"tenant_id": "t1"}) == [1, 2] and ids({"tags": "a"}) == [1] and ids({"department": ["eng", "hr"]}) == [1, 3]
    assert ids({"department": {"$ne": "eng"}}) == [2, 3] and ids({"department": {"$nin": ["eng"]}}) == [2, 3]
    assert ids({"access_level": {"$gte": 1}}) == [1, 3] and ids({"access_level": {"$lt": "x"}}) == [] and ids({"created_at": {"$gt": "2023-06-01"}}) == [1]
    assert ids({"tags": {"$in": ["b", "z"]}}) == [1] and ids({"tags": {"$contains": "b"}}) == [1] and ids({"department": {"$contains": "EN"}}) == [1]
    assert ids({"$not": {"is_public": True}}) == [1, 3] and ids({"$or": []}) == [] and ids({"$or": []}, empty_or=True) == [1, 2, 3]
    assert ids({"$and": [{"tenant_id": "t1"}, {"$or": [{"access_level": 0}, {"department": "hr"}]}]}) == [2]
    assert ids({"unknown": {"$ne": 1}}) == [1, 2, 3] and ids({"access_level": {"$eq": True}}) == []
    with pytest.raises(ValueError):
        ids({"id": {"$like": 1}})
    assert ids({"id": {"$like": 1}}, on_unknown="false") == []
    seen = lambda who, f=None: [r["id"] for r in filters.secured(df, who, f).orderBy("id").collect()]
    assert seen(filters.Principal("t1", 0)) == [2] and seen(filters.Principal("t1", 5, ("eng",))) == [1, 2]
    assert seen(filters.Principal("t1", 5), {"tenant_id": "t2"}) == [1, 2]  # a client can't choose the tenant
    assert filters.parse('{"a": 1}') == {"a": 1} and filters.between("n", 1, 2) == {"n": {"$gte": 1, "$lte": 2}}


def test_rerank_prefers_the_intent(spark):
    df = spark.createDataFrame([(1, "reset password", "d1", "Reset your password", "To reset password go to settings."), (1, "reset password", "d2", "Change email", "Email changes need a password.")], "query_id long, query string, chunk_id string, title string, content string")
    r = rerank.rerank_cross(df).orderBy("rank").collect()
    assert r[0]["chunk_id"] == "d1" and r[0]["score"] <= 0.99 and r[1]["score"] >= 0.05


def test_parents_and_budget(spark):
    c = spark.createDataFrame([(1, "c1", "p1", 0.9), (1, "c2", "p1", 0.8), (1, "c3", "p2", 0.5), (1, "c4", "gone", 0.99)], "query_id long, chunk_id string, parent_id string, score double")
    p = spark.createDataFrame([("p1", 40), ("p2", 40)], "parent_id string, token_estimate int")
    r = parents.resolve(c, p)
    assert [(x["parent_id"], x["n_children"], x["children"]) for x in r.orderBy("rank").collect()] == [("p1", 2, ["c1", "c2"]), ("p2", 1, ["c3"])]
    assert r.where("rank = 1").first()["rank_score"] == round(0.9 * 0.6 + 0.85 * 0.3 + 0.02, 5)
    b = parents.within_budget(r, 4, 50).first()
    assert b["parent_ids"] == ["p1"] and b["dropped_by_budget"] == 1 and b["budget_exceeded"]
    assert parents.within_budget(r, 1, 500).first()["dropped_by_limit"] == 1
    skip = spark.createDataFrame([(1, "a", 1, 30, 1), (1, "b", 2, 90, 1), (1, "c", 3, 20, 1)], "query_id long, parent_id string, rank int, token_estimate int, n_children int")
    assert parents.within_budget(skip, 4, 60).first()["parent_ids"] == ["a", "c"]  # what doesn't fit is skipped


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 40))
def test_chunks_cover_the_text(text, size):
    for method in ("window", "window_any", "word_window", "sentence_window", "recursive", "recursive_flat", "token_window", "separated"):
        pieces = list(chunking.METHODS[method](text, size=size, overlap=0 if method in ("separated", "recursive_flat") else size // 4))
        got = "".join("".join(p[0].split()) for p in pieces)
        assert set(text.split()) <= set("".join(p + " " for p, _, _ in pieces).split()) or len(got) >= len("".join(text.split()))
        if method in ("window", "window_any", "word_window", "sentence_window") and len(text) > size:
            assert all(len(p) <= size + 2 for p, _, _ in pieces)


def test_chunk_hierarchy_and_bounds(spark):
    df = spark.createDataFrame([(1, "One two three. " * 200), (2, None), (3, "short")], "doc_id long, text string")
    p, c = chunking.parent_child(df)
    assert p.where("doc_id = 2").count() == 0 and p.where("doc_id = 3").count() == 1
    assert c.join(p.select("parent_id"), "parent_id", "left_anti").count() == 0 and c.agg(F.max(F.length("content"))).first()[0] <= 350
    with pytest.raises(ValueError):
        chunking.chunk(df, "window", size=10, overlap=10)


def test_patterns(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(patterns.k_hops(e, s, 3), "hops", "node") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    h = spark.createDataFrame([(1, "x", 0.9), (2, "y", 0.6), (2, "z", 0.4), (3, "w", 0.1)], "query_id long, chunk_id string, score double")
    f = spark.createDataFrame([(3, "fb", 0.3), (1, "no", 0.3)], "query_id long, chunk_id string, score double")
    assert {(r["query_id"], r["chunk_id"], r["action"]) for r in patterns.corrective(h, f).collect()} == {(1, "x", "accept"), (2, "y", "refine"), (3, "fb", "fallback")}


def test_loaders_and_index_files(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("  alpha  ")
    (tmp_path / "docs" / "b.md").write_text("# beta")
    (tmp_path / "docs" / "empty.txt").write_text(" \n")
    (tmp_path / "docs" / "c.bin").write_text("no")
    (tmp_path / "docs" / "sub" / "d.md").write_text("delta")
    flat = loaders.load_texts(spark, str(tmp_path / "docs"), metadata={"filename": "x"})
    assert {(r["content"], r["file_type"]) for r in flat.collect()} == {("alpha", "text/plain"), ("# beta", "text/markdown")}
    assert {r["metadata"]["filename"] for r in flat.collect()} == {"x"}
    assert loaders.load_markdown(spark, str(tmp_path / "docs")).where("file_type = 'markdown'").count() == 3
    (tmp_path / "c.json").write_text('[{"id": "1", "content": "x", "metadata": {"title": "t", "tags": ["a"]}}]')
    assert loaders.load_corpus(spark, str(tmp_path / "c.json")).first()["metadata"]["tags"] == ["a"]
    df = spark.createDataFrame([("apple", "d1", 2), ("pear", "d2", 1)], "term string, chunk_id string, tf int")
    loaders.save_index({"postings": df}, str(tmp_path / "ix"), {"k1": 1.5})
    tables, config = loaders.load_index(spark, str(tmp_path / "ix"))
    assert tables["postings"].count() == 2 and config == {"k1": 1.5}
    loaders.save_postings(df, str(tmp_path / "p"), 4)
    assert [r["chunk_id"] for r in loaders.load_postings(spark, str(tmp_path / "p"), ["pear"], 4).collect()] == ["d2"]
    cur = spark.createDataFrame([(1, "old"), (2, "keep")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "new"), (1, "newer"), (3, "add")], "doc_id long, text string")
    assert rows(loaders.upsert(cur, new), "doc_id") == [(1, "newer"), (2, "keep"), (3, "add")]
    assert loaders.inline(spark, ["hello", " "]).count() == 1


def test_settings():
    assert Settings.from_env({"TESSERA_TOP_K": "7"}).top_k == 7
    with pytest.raises(ValueError):
        Settings.from_env({"TESSERA_ALPHA": "2"})


@settings(max_examples=50, deadline=None)
@given(st.permutations(range(5)))
def test_reciprocal_ranks_ignore_order(order):
    parts = [1 / (60 + r) for r in range(1, 6)]
    assert math.isclose(sum(parts), sum(parts[k] for k in order))


def test_tuned_lists_find_nine_tenths(spark, sf_dir):
    from tessera.plans.search_queries import ivf_tuned_recall

    assert ivf_tuned_recall(spark, sf_dir).agg(F.avg("recall")).first()[0] >= 0.9


def test_missing_vectors_score_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [-1.0, 0.0]), (4, [1.0, 0.001])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert rows(search.stage_one(v, q, 4).select("chunk_id", "score", "rank"), "rank") == [(1, 1.0, 1), (4, 1.0, 2), (2, 0.0, 3), (3, -1.0, 4)]
    assert rows(search.top_k(v, q, 4).select("chunk_id"), "rank") == [(1,), (4,), (3,)]
    assert rows(search.top_k(v, q, 4, "dot").select("chunk_id"), "rank") == [(1,), (4,), (3,)]


def odd_vectors(spark):
    """Copies, near copies that rounding makes equal, zero, NaN and missing elements, one with an infinite norm, a missing one and a missing query."""
    import numpy as np

    random = np.random.RandomState(3)
    some = [[float(x) for x in v] for v in random.standard_normal((60, 4)).round(2)]
    near = [[x + 1e-8 * (k % 3) for x in some[0]] for k in range(40)]
    odd = [[0.0] * 4, [float("nan"), 1.0, 0.0, 0.0], [None, 1.0, 0.0, 0.0], [1e200, 1e200, 0.0, 0.0], None, [1e-200, 0.0, 0.0, 0.0]]
    v = spark.createDataFrame([(1000 - k, e) for k, e in enumerate(some + some[:20] * 3 + near + odd)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(k, e) for k, e in enumerate([some[0], some[1], *odd])], "query_id long, q array<double>")
    return v.repartition(3), q


@pytest.mark.parametrize(("mode", "digits", "k"), [("raw", 9, 10), ("raw", 6, 3), ("unit", 6, 25), ("raw", 2, 7)])
def test_matrix_search_equals_pair_by_pair(spark, monkeypatch, mode, digits, k):
    v, q = odd_vectors(spark)
    kept = v.where("embedding is not null")
    want = search.ranked(search.pairs_of(kept, q, "cosine", mode).withColumn("score", F.round("score", digits)), k)
    monkeypatch.setattr(search, "TILE_ROWS", 16)
    monkeypatch.setattr(search, "TILE_QUERIES", 3)
    got = search.top_k(v, q, k, "cosine", mode, digits=digits).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_vectors_of_other_length_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    with pytest.raises(Exception, match="vectors differ in dimension"):
        search.top_k(v, q, 1).collect()


@pytest.mark.parametrize("name", ["cosine_topk", "score_threshold", "stage_one_topk", "candidate_sweep", "cosine_unit", "postfilter_topk"])
def test_no_score_pair_by_pair(spark, sf_dir, name):
    from tessera.plans import registry

    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_lists_by_matrices_equal_lists_by_expressions(spark):
    from tessera.functions.vectors import score

    v, q = odd_vectors(spark)
    c = spark.createDataFrame([(5, [0.5, 1.0, 0.0, 0.0]), (1, [0.0] * 4), (3, [0.5, 1.0, 0.0, 0.0]), (2, [-1.0, 0.2, 0.3, 0.0])], "list int, c array<double>")
    near = v.crossJoin(c).withColumn("s", F.round(score(F.col("embedding"), F.col("c"), "cosine"), 9))
    want = near.groupBy("chunk_id").agg(F.max_by("list", F.struct("s", -F.col("list"))).alias("list"))
    assigned = search.assign(v, c)
    assert "Join" not in assigned._jdf.queryExecution().optimizedPlan().toString()
    assert rows(assigned.select("chunk_id", "list"), "chunk_id") == rows(want, "chunk_id")
    held, some = v.where("embedding is not null").join(want, "chunk_id"), q.where("q is not null")
    asked = search.ranked(some.crossJoin(c).withColumn("s", F.round(score(F.col("c"), F.col("q"), "cosine"), 9)), 2, "s", "list").select("query_id", "q", "list")
    best = search.ranked(held.join(asked, "list").select("query_id", "chunk_id", F.round(score(F.col("embedding"), F.col("q"), "cosine"), 9).alias("score")), 10)
    assert rows(search.ivf_search(v, c, want, some, 10), "query_id", "rank") == rows(best, "query_id", "rank")


def test_graph_finds_the_first_of_many_copies(spark):
    import numpy as np

    data = np.random.RandomState(5).standard_normal((300, 8))
    v = spark.createDataFrame([(k, [float(x) for x in data[0 if k < 200 else k]]) for k in range(300)], "chunk_id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(k, [float(x) for x in data[k]]) for k in (0, 250, 299)], "query_id long, q array<double>")
    assert rows(search.graph_search(v, q, 10).select("query_id", "rank", "chunk_id"), "query_id", "rank") == rows(search.top_k(v, q, 10).select("query_id", "rank", "chunk_id"), "query_id", "rank")
