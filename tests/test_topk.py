"""Counting of tokens and search in blocks, against plain Python; pairs of queries and documents aren't shuffled."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import lexical, search, topk, vectors
from marlstone.sources import catalog, index

TEXTS = ["The  cat, the CAT-9", "", None, "é!ü", "Kelvin İstanbul x", "end", "9start a_b", "a" * 300, "no-token:\n\t!", "tail cat"]


def test_counts_and_vectors(spark, monkeypatch):
    """Blocks of any size, texts without tokens, tokens at the edges of texts, and letters that lower-case to ASCII."""
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(lexical, "TEXT_BYTES", size)
        docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
        words = {k: Counter(re.findall("[a-z0-9]+", (t or "").lower())) for k, t in enumerate(TEXTS)}
        got = {r.doc_id: (r.doc_len, [tuple(x) for x in r.counted]) for r in lexical.forward(docs).collect()}
        assert got == {k: (sum(c.values()), sorted(c.items())) for k, c in words.items()}
        made = {r.doc_id: r.vec for r in vectors.dense_vectors(docs, 8).collect()}
        for k, c in words.items():
            sums = np.zeros(8)
            for w, n in c.items():
                digest = hashlib.md5(w.encode()).hexdigest()
                sums[int(digest, 16) % 8] += n if digest[30] >= "8" else -n
            assert (k in made) == bool(sums.any())
            assert k not in made or made[k] == list(sums / np.sqrt((sums * sums).sum()))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"d{k}", " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(6))), float(k % 9), "X" if k % 2 else None) for k in range(300)]
    docs = spark.createDataFrame(rows + [(f"e{k}", "a b", 1.0, "x") for k in range(50)], "doc_id string, text string, price double, brand string").repartition(4)
    folder = str(tmp_path_factory.mktemp("shop"))
    index.write_index(docs, folder)
    return index.open_index(spark, folder)


def asked(spark):
    return spark.createDataFrame([(k, f"{'abcdefgh'[k % 8]} {'abcdefgh'[k // 8]} unknown", '{"price_max": 4, "brand": "x"}' if k % 3 else None) for k in range(40)], "qid long, text string, raw string").select("qid", "text", search.filters_of(F.col("raw")).alias("filters"))


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_words_in_blocks(spark, shop, monkeypatch, cells):
    """Ties by id, several blocks of queries and of documents, filters before ranking: what the scores of all pairs give."""
    for name, value in (("QUERY_BLOCK", 7), ("ROW_BLOCK", 80), ("CELLS", cells)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(topk, "FIRST", 5)
    queries = asked(spark)
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())
    every = lexical.scored(queries.select("qid", "text"), shop)
    assert rows(lexical.bm25(queries.select("qid", "text"), shop, top=6)) == rows(lexical.best(every, 6))
    some = shop["documents"].filter("price < 3").select("doc_id")
    assert rows(lexical.bm25(queries.select("qid", "text"), shop, some, top=6)) == rows(lexical.best(every.join(some, "doc_id", "left_semi"), 6))
    meta = search.metadata_of(shop)
    fits = every.join(queries, "qid").join(meta, "doc_id").filter("filters is null or (price <= 4 and coalesce(lower(brand) = 'x', false))")
    assert rows(lexical.bm25(queries, shop, top=6, meta=meta, allowed=search._mask)) == rows(lexical.best(fits.select("qid", "doc_id", "score"), 6))


def test_pairs_are_not_shuffled(spark, shop):
    plan = lexical.bm25(asked(spark).select("qid", "text"), shop)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and plan.count("Exchange hash") == 1


def test_filters_shuffle_no_tokens(spark, shop):
    """Metadata meet the counts of the queries' terms, by number, and not each document's tokens."""
    for more in ({"meta": search.metadata_of(shop), "allowed": search._mask}, {"passing": shop["documents"].filter("price < 3").select("doc_id")}):
        plan = lexical.bm25(asked(spark) if "meta" in more else asked(spark).select("qid", "text"), shop, **more)._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[plan.index("Join") :]
        assert joined.index("MapInArrow cut") < joined.index("counted#")
    held = spark.sparkContext.broadcast(spark.createDataFrame([(1, [("b", 1.0), ("zz", 1.0)]), (2, [("aa", 1.0), ("b", 1.0)])], "qid long, terms array<struct<tok:string,weight:double>>").toArrow())
    words = lexical.block_terms(held.value.combine_chunks())[1].dictionary.to_pylist()
    got = {r.doc_id: (r.doc_len, sorted(zip([words[a] for a in r.at], r.tf, strict=True))) for r in lexical.cut_to_terms(shop["forward"], held).collect()}
    every = {r.doc_id: (r.doc_len, sorted((t.tok, t.tf) for t in r.counted if t.tok in words)) for r in shop["forward"].collect()}
    assert got == {k: v for k, v in every.items() if v[1]} and len(got) < len(every)


def test_equal_queries_are_asked_once(spark, shop, monkeypatch):
    """Of equal texts and filters one is asked, and each gets what it would alone; null texts and filters are equal too."""
    filters = search.filters_of(F.col("raw"))
    rows = [(k, ["a bb", "c", None][k % 3], [None, '{"price_max": 4}'][k % 2]) for k in range(24)] + [(99, "a bb", '{"price_max": 4, "brand": "x"}')]
    queries = spark.createDataFrame(rows, "qid long, text string, raw string").select("qid", "text", filters.alias("filters"))
    counted, plain = [], {}
    for module, name in ((vectors, "cosine_topk"), (lexical, "bm25")):
        plain[name] = getattr(module, name)
        monkeypatch.setattr(module, name, lambda q, *rest, name=name, **more: counted.append(q.count()) or plain[name](q, *rest, **more))
    lists = lambda q: {r: sorted(map(tuple, found)) for r, found in ((i, [x[1:] for x in got if x.qid == i]) for got in [search.fused(q, shop).collect()] for i in {x.qid for x in got})}
    for q, most in ((queries, 7), (queries.drop("filters"), 3)):
        counted.clear()
        got = lists(q)
        assert len(counted) == 2 and max(counted) <= most
        assert {k for k, t, _ in rows if t} == set(got)
        for k in (0, 1, 4, 99):
            assert got[k] == lists(q.filter(f"qid = {k}"))[k]


def test_filters_read_the_index_own_columns(spark, shop):
    """What filters look at lies in the tables that are scored, so that no vector is shuffled for it; where it is elsewhere, it is joined."""
    plan = search.fused(asked(spark), shop)._jdf.queryExecution().optimizedPlan().toString()
    assert "/documents" not in plan and "store_id" not in plan and "price" in shop["vectors"].columns
    bare = shop | {"vectors": shop["vectors"].select("doc_id", "vec"), "forward": shop["forward"].select("doc_id", "doc_len", "counted")}
    rows = lambda index: sorted(tuple(r) for r in search.fused(asked(spark), index).collect())
    assert rows(shop) == rows(bare)


def test_batches_that_no_query_allows(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a b", float(k)) for k in range(300)], "doc_id long, text string, price double").coalesce(1)
    index.write_index(docs, str(tmp_path))
    queries = spark.createDataFrame([(1, "b")], "qid long, text string").select("qid", "text", search.filters_of(F.lit('{"price_min": 290}')).alias("filters"))
    assert {r.doc_id for r in search.fused(queries, index.open_index(spark, str(tmp_path))).collect()} == set(range(290, 300))


def test_rows_are_numbered_in_their_order(spark):
    """Over any partitions, and by the order that the reader saw, of which a slice leaves some out."""
    raw = spark.range(100).select((F.col("id") * 7 + F.when(F.col("id") > 40, 1 << 33).otherwise(0)).alias("_ord"), F.lit("").alias("Asin"), F.lit("").alias("Uniq Id"), F.col("id"))
    got = {r.id: r._id for r in catalog.with_ids(raw.repartition(7)).collect()}
    assert got == {k: f"ROW{k:05d}" for k in range(100)}


def test_relaxed_search_needs_no_metadata(spark, shop, monkeypatch):
    """Only the first search joins documents with their metadata; the second has no filters to hold them against."""
    searched = []
    plain = search.search
    monkeypatch.setattr(search, "search", lambda queries, *rest, **more: searched.append("filters" in queries.columns) or plain(queries, *rest, **more))
    none = asked(spark).withColumn("filters", search.filters_of(F.lit('{"price_max": 0.001, "price_min": 0.001}')))
    got = {(r.qid, r["rank"]): (r.doc_id, r.score, r.relaxed) for r in search.relaxed(none, shop).collect()}
    assert searched == [True, False]
    assert got and got == {(r.qid, r["rank"]): (r.doc_id, r.score, True) for r in plain(none.drop("filters"), shop).collect()}


@pytest.mark.parametrize("name", ["provenance", "groundedness", "citations_merge"])
def test_citing_plans_score_once(spark, sf, name):
    """What reads a list several times reads it from where it was written."""
    from marlstone.plans import QUERIES

    assert "MapInArrow" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_where_cosine_is_zero(spark):
    """Components that cancel are a common component; none in common is no pair."""
    queries = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 2.0])], "qid long, vec array<double>")
    rows = spark.createDataFrame([(1, [1.0, -1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0])], "doc_id long, vec array<double>")
    got = {(r.qid, r.doc_id): r.score for r in vectors.cosine_topk(queries, rows, 5, overlap=True).collect()}
    assert got == {(1, 1): 0.0, (2, 2): 1.0}


def test_postings_when_asked_for(spark, tmp_path):
    """Counts by term need no postings; these come with the first who looks documents up by token."""
    rows = [(1, "a b a"), (2, "b"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    held = index.handle(docs)
    assert "postings" not in held and {(r.tok, r.df, r.cf) for r in held["terms"].collect()} == {("a", 1, 2), ("b", 2, 2)}
    assert sorted(tuple(r) for r in index.handle(docs, postings=True)["postings"].collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)]


def test_facts_beside_the_texts(spark, tmp_path):
    """Facts from another table are joined by who reads them; the texts are written without a join."""
    spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, 1.0), (2, -1.0), (9, 0.0)], "doc_id long, rating double").write.parquet(str(tmp_path / "facts"))
    docs, facts = spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(str(tmp_path / "facts"))
    held = index.handle(docs, facts=facts)
    assert sorted((r.doc_id, r.text, r.rating) for r in held["documents"].collect()) == [(1, "a b a", 1.0), (2, "b", None), (3, None, None)]
    assert all("rating" not in spark.read.parquet(f).columns for f in held["documents"].inputFiles() if "/documents/" in f)
    assert sorted(tuple(r) for r in search.metadata_of(held).select("doc_id", "rating").collect()) == [(1, 1.0), (2, None), (3, None)]
    assert sorted(r.tok for r in index.handle(docs, postings=True, facts=facts)["postings"].select("tok").collect()) == ["a", "b", "b"]
    assert "rating" not in index.handle(docs)["documents"].columns
