"""Each stage of the pipeline against a brute-force version, on its own input."""

import re

import corpus_pipeline as P
import duckdb
from test_operators import brute_groups, words2

from marlstone.llm import packing, secrets
from marlstone.llm.oracles import OP3
from marlstone.llm.tokens import encoder
from marlstone.session import materialise


def base_spans(text):
    """Start, kind and end of the secrets that patterns find."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def without(text):
    """The text with each run of secrets that overlap or touch masked, character by character."""
    gone = [False] * len(text)
    for a, _, b in base_spans(text):
        gone[a:b] = [True] * (b - a)
    return "".join("" if g and k and gone[k - 1] else "[SECRET]" if g else text[k] for k, g in enumerate(gone))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = materialise(P.quality_rules(spark, docs, sf), "stage")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    judged = {i for (i,) in con.execute(f"select doc_id from ({OP3}) where kept").fetchall()}
    assert 0 < len(judged) < docs.count()
    assert {r.doc_id for r in kept.collect()} == judged and kept.dtypes == docs.dtypes

    one = materialise(P.near_duplicates(spark, kept, sf), "stage")
    want = {k[0] for k in brute_groups([(r.doc_id, r.text) for r in kept.collect()], P.SHINGLE, 80) if k[3]}
    assert {r.doc_id for r in one.collect()} == want and one.dtypes == docs.dtypes

    clean = materialise(P.decontamination(spark, one, sf), "stage")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words2(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    bad = {r.doc_id for r in one.collect() for w in [words2(r.text)] if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == want - bad and clean.dtypes == docs.dtypes

    masked = materialise(P.secret_masking(spark, clean, sf), "stage")
    before = {r.doc_id: r for r in clean.collect()}
    found = {r.doc_id: r.spans for r in secrets.scan(clean).collect()}
    assert masked.dtypes == docs.dtypes
    compared = 0
    for r in masked.collect():
        assert (r.text == before[r.doc_id].text) == (found[r.doc_id] == "")
        assert r.n_chars == (len(r.text) if found[r.doc_id] else before[r.doc_id].n_chars)
        if found[r.doc_id] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(before[r.doc_id].text)):  # the method added none
            assert r.text == without(before[r.doc_id].text)
            compared += r.text != before[r.doc_id].text
    assert compared

    packed = materialise(P.best_fit_packing(spark, masked, sf), "stage")
    assert packed.columns[:7] == [c.split()[0] for c in packing.RESULT.split(", ")]
    own = encoder(packing.TOKENIZER).tokenizer
    pieces = {}
    for r in packed.orderBy("doc_id", "piece").collect():
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in masked.collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _own string, _row int, kept string, _spans int, windows int, hub long"


def test_stages_on_awkward_tables(spark, sf):
    """Empty tables, nulls in all columns, repeated rows, ids that several texts share, clashing names."""
    prose = " ".join(f"word{k % 37} of the" for k in range(40))
    rows = [(None,) * 11, (1, None, None, None, None, "a", 1, "b", 2, 3, 4), (2, "", "en", "s", 0, None, None, None, None, None, None), (3, " ".join(f"{w}{k}" for k, w in enumerate(prose.split())), "xx", None, 5, "q", 1, "k", 2, 3, 4), (3, " ".join(f"other{k}" for k in range(60)), "xx", None, 5, "q", 1, "k", 2, 3, 4)]
    rows += [rows[3], (4, rows[3][1] + " token='abcdefABCDEF0123'", "xx", None, 5, "q", 1, "k", 2, 3, 4)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, COLUMNS)
        kept = materialise(P.quality_rules(spark, docs, sf), "stage")
        assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} == ({3, 4} if data else set())
        one = materialise(P.near_duplicates(spark, kept, sf), "stage")
        assert one.dtypes == docs.dtypes and sorted(r.text[:6] for r in one.collect()) == (["other0", "word00"] if data else [])
        clean = materialise(P.decontamination(spark, one, sf), "stage")
        masked = materialise(P.secret_masking(spark, clean, sf), "stage")
        assert clean.dtypes == masked.dtypes == docs.dtypes and clean.count() == masked.count() == (2 if data else 0)
        assert P.best_fit_packing(spark, masked, sf).count() == (2 if data else 0)
    raw = spark.createDataFrame(rows, COLUMNS)  # stages on what an earlier one would have dropped
    assert P.near_duplicates(spark, raw, sf).count() == 5 and P.decontamination(spark, raw, sf).count() == 7
    assert [r.text for r in P.secret_masking(spark, raw, sf).filter("doc_id = 4").collect()] == [rows[3][1] + " [SECRET]'"]


def test_run(spark, sf):
    """The stages in a row, each over what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "stage")
    pieces = P.run(spark, sf).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} and pieces
