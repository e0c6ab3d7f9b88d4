"""Sources of grounded answers."""

from pyspark.sql import functions as F

from marlstone.operators import grounding

ANSWERS = "request_id long, answer string, chunks array<struct<uri:string,title:string>>, supports array<struct<text:string,refs:array<int>>>, title string"


def test_sources(spark):
    rows = [
        (1, "All of it", [("a", "A"), (None, "no"), ("b", None), ("a", "again"), ("", "x"), ("c", "C")], [("", [0]), ("first " * 60, [1]), ("second", [1, 0]), ("third", None), (None, [2]), ("beyond", [9])], "t"),
        (2, "bare " * 200, None, None, "t"), (3, None, [], [("x", [0])], "t"), (4, "", [("u", "U")], None, "t"), (5, "three", [(k, k) for k in "abc"], None, "t"),
    ]
    got = {(r.request_id, r.ord): r for r in grounding.grounded(spark.createDataFrame(rows, ANSWERS), most=2).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (4, 0), (5, 0), (5, 1)]
    assert (got[1, 0].url, got[1, 0].title, got[1, 0].snippet, got[1, 0].answer) == ("a", "A", "second", "All of it")
    assert (got[1, 1].url, got[1, 1].title, len(got[1, 1].snippet), got[1, 1].answer) == ("b", "", 200, None)
    assert got[2, 0].url == "" and len(got[2, 0].snippet) == 500 and got[2, 0].score == 0.7 and got[4, 0].snippet == "" and got[5, 1].url == "b"
    assert grounding.grounded(spark.createDataFrame([], ANSWERS)).count() == 0


def test_second_round_only_where_it_is_needed(spark):
    requests = spark.createDataFrame([(1, "q1"), (2, "q2")], "request_id long, query string")
    asked_for = []

    def ask(asked, k):
        asked_for.append((k, sorted((r.request_id, r["context"] if k else None) for r in asked.collect())))
        uris = {0: {1: "ab", 2: "a"}, 1: {2: "acd"}}[k]
        rows = [(i, f"answer {k}", [(c, c) for c in u], None, None) for i, u in uris.items()]
        return spark.createDataFrame(rows, ANSWERS)

    got = grounding.researched(requests, ask, most=2).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ord", "url"))).alias("u")).collect()
    assert {r.request_id: [x.url for x in r.u] for r in got} == {1: ["a", "b"], 2: ["a", "c"]}
    assert asked_for == [(0, [(1, None), (2, None)]), (1, [(2, "answer 0")])]
