"""The engine by its settings: from a file to ranked rows, with hash vectors and with an embedder of one's own."""

import pytest
from pyspark.sql import functions as F

from marlstone import engine
from marlstone.config import Config, config_of, session_config
from marlstone.operators import lexical, search
from marlstone.sources import index

HEAD = "Uniq Id,Product Name,Brand Name,Asin,Category,Selling Price,About Product,Ingredients,Rating,Review Snippets"
ROWS = ["u1,Glass Spray,Acme,A1,Household Cleaning,$ 8.00,Streak free|Plant based,water,4.5,good || fine", "u2,Wood Polish,Best,A2,Household Cleaning,$ 12.50,Shine,wax,4.0,", "u3,Oven Spray,Acme,A3,Household Cleaning,$ 3.00,Strong,,3.0,ok", "u4,Toy,Zed,A4,Toys,$ 1.00,,,,"]


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "c.csv").write_text("\n".join([HEAD, *ROWS]))
    return str(tmp_path / "c.csv")


def asked(spark):
    rows = [(1, "streak free glass spray", None, None), (2, "spray", '{"price_max": 5}', None), (3, "polish", None, 1)]
    return spark.createDataFrame(rows, "qid long, text string, raw string, k int").select("qid", "text", search.filters_of(F.col("raw")).alias("filters"), "k")


def test_settings_act(spark, csv, tmp_path):
    config = Config(index_folder=str(tmp_path / "i"), collection="shop", top_k=2)
    summary = engine.build(spark, csv, config).first()
    assert (summary.n_raw, summary.n_products, summary.n_reviews) == (4, 3, 3)
    opened = engine.open_engine(spark, config)
    got = {(r.qid, r["rank"]): r for r in opened.results(asked(spark)).collect()}
    assert {k: r.doc_id for k, r in got.items() if k[1] == 1} == {(1, 1): "u1", (2, 1): "u3", (3, 1): "u2"}
    assert max(k[1] for k in got) == 2 and (3, 2) not in got and got[1, 1].price == 8.0
    lists = lambda **o: {(r.qid, r["rank"]): (r.doc_id, r.score) for r in engine.open_engine(spark, Config(**{**config.__dict__, **o})).search(asked(spark)).collect()}
    assert max(n for q, n in lists(top_k=1)) == 1
    assert lists(rrf_k=1)[1, 1][1] == 0.5 and lists(candidates=1)[1, 1][0] == "u1" and len(lists(candidates=1)) < len(lists())
    scorer = lambda rows: rows.withColumn("rerank", F.when(F.col("doc_id") == "u3", 9.0).otherwise(1.0))
    first = lambda c: engine.Engine(c, opened.index, None).search(asked(spark), scorer).filter("qid = 1 and rank = 1").first().doc_id
    assert first(config) == "u1" and first(Config(rerank=True)) == "u3"
    calls = spark.createDataFrame([("a", 1, 0), ("a", 2, 10)], "who string, call_id int, at long")
    slow = engine.Engine(Config(throttle_seconds=2.5, cache_seconds=3), opened.index, None)
    assert {r.start for r in slow.throttled(calls, ["who"]).collect()} == {0, 2_500_000}
    requests = spark.createDataFrame([("q", 1, 0), ("q", 2, 2), ("q", 3, 4)], "key string, id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.hit for r in slow.cached(requests, ["key"]).collect()} == {1: False, 2: True, 3: False}


def test_embedder_by_name(spark, csv, tmp_path):
    config = Config(index_folder=str(tmp_path / "i"), embedder="letters", embedding_model="four", dim=4, alpha=1.0)
    letters = lambda: lambda texts: [[t.lower().count(c) + 0.01 for c in "swog"] for t in texts]
    loaders = {"letters": letters}
    engine.build(spark, csv, config, loaders)
    opened = engine.open_engine(spark, config, loaders)
    assert index.manifest(spark, f"{config.index_folder}/documents").first().signature == "letters:four-4"
    assert opened.search(spark.createDataFrame([(1, "wowow", None)], "qid long, text string, k int")).filter("rank = 1").first().doc_id == "u2"
    for wrong in (Config(index_folder=config.index_folder, dim=4), Config(**{**config.__dict__, "embedding_model": "other"})):
        with pytest.raises(ValueError, match="built for letters:four-4"):
            engine.open_engine(spark, wrong, loaders)
    with pytest.raises(ValueError, match="no loader"):
        engine.embedder_of(Config(embedder="missing"), loaders)
    with pytest.raises(Exception, match="components"):
        engine.build(spark, csv, Config(**{**config.__dict__, "dim": 5}), loaders)
    assert engine.open_engine(spark, config, loaders).index["vectors"].count() == 3  # the build that failed left the index as it was


def test_older_versions_go(spark, csv, tmp_path):
    config = Config(index_folder=str(tmp_path / "i"))
    for _ in range(3):
        engine.build(spark, csv, config)
    folder = f"{config.index_folder}/{config.collection}"
    (tmp_path / "i" / "documents" / "00000000000000000001-lost" / "postings").mkdir(parents=True)
    assert index.drop_older(spark, folder, keep=2) == 2 and index.drop_older(spark, folder, keep=2) == 0
    assert len(list((tmp_path / "i" / "documents" / "manifests").iterdir())) == 2
    assert engine.open_engine(spark, config).index["documents"].count() == 3


def test_turns_by_settings(spark, csv, tmp_path):
    """The bound on second answers and the allowed hosts come from the settings."""
    config = Config(index_folder=str(tmp_path / "i"), revise_bound=0, allowed_hosts=("shop.test",))
    engine.build(spark, csv, config)
    live = spark.createDataFrame([(1, 0, "Glass Spray", "https://shop.test/p", "x", 9.0, "in stock"), (1, 1, "Other", "https://else.test/p", "x", 9.0, "in stock")], "qid long, ord int, title string, url string, snippet string, price double, availability string")
    turns = spark.createDataFrame([(1, "glass spray in stock now")], "qid long, text string")

    def ungrounded(rows, attempt):
        from marlstone.operators import turn

        made = turn.offline_answer(rows, attempt)
        return made.withColumn("table_ids", F.array(F.lit("made up")))

    got = {}
    for bound in (0, 2):
        opened = engine.open_engine(spark, Config(**{**config.__dict__, "revise_bound": bound}))
        row = opened.turns(turns, live, answerer=ungrounded).first()
        got[bound] = (row.revisions, row.n_live, row.n_blocked)
    assert got == {0: (0, 1, 1), 2: (2, 1, 1)}


def test_settings_from_environment_and_session(spark):
    assert config_of({"MARLSTONE_EMBEDDER": "letters", "MARLSTONE_DIM": "4", "MARLSTONE_RERANK": "yes"}) == Config(embedder="letters", dim=4, rerank=True)
    spark.conf.set("marlstone.embedding_model", "four")
    assert session_config(spark).embedding_model == "four"
    spark.conf.unset("marlstone.embedding_model")


def test_terms_reach_the_scan(spark, csv, tmp_path):
    config = Config(index_folder=str(tmp_path / "i"))
    engine.build(spark, csv, config)
    opened = engine.open_engine(spark, config)
    found = lexical.scored(spark.createDataFrame([(1, "glass wax wax")], "qid long, text string"), opened.index)
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(tok, [glass,wax])" in plan or "In(tok, [wax,glass])" in plan
    assert {r.doc_id for r in found.collect()} == {"u1", "u2"}
