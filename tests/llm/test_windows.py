"""Repeated passages, collocations and clusters against brute-force versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from marlstone.llm import anchors, balls, collocations

DOC = "doc_id long, text string, lang string, kept string, block int, key long"
VECTOR = "vec_id long, embedding array<float>, cluster int, point string"


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def brute_passages(rows, window):
    seen, out = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            if own in seen:
                gone[k : k + window] = [True] * window
            seen.add(own)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages(seed):
    """Overlapping cuts of one base, a null and an empty text, repeated rows, one null id, a repetitive and a long text."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["é", "日本", "X,"]
    base = [rng.choice(words) for _ in range(150)]
    cut = lambda n: base[rng.randrange(150) :][: rng.randrange(n)]
    rows = [(k, " ".join(cut(80) + [rng.choice(words) for _ in range(rng.randrange(30))] + cut(60))) for k in range(1, 110)]
    return [*rows, (0, None), (110, ""), (111, " \n "), (None, rows[3][1]), (200, "  " + " \n\t".join(base) + "\x0b"), (201, "a " * 90), (7, rows[6][1]), (7, rows[6][1]), (300, " ".join(rng.choice(words) for _ in range(6000)))]


@pytest.mark.parametrize("window, period, cover", [(6, 3, (0, 1)), (10, 7, (0, 1, 3)), (20, 13, anchors.COVER), (13, 13, anchors.COVER)])
def test_passages(spark, window, period, cover):
    rows = passages(window)
    docs = spark.createDataFrame([(i, t, None, "x", 1, 2) for i, t in rows], DOC).repartition(3)
    for block_bytes in (1500, 1 << 20):
        assert counted(anchors.remove_passages(docs, window=window, period=period, cover=cover, block_bytes=block_bytes)) == brute_passages(rows, window)
    assert anchors.remove_passages(docs.limit(0)).count() == 0


def test_passages_with_text(spark):
    rows = [(1, "a b c d e f"), (2, "x a  b c d\ny"), (3, "a b c"), (2, None)]
    got = {(r.doc_id, r.n_words): (r.kept, r.starts, r.ends) for r in anchors.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=4, period=3, cover=(0, 1), with_text=True).collect()}
    assert got == {(1, 6): ("a b c d e f", [], []), (2, 6): ("x y", [1], [5]), (3, 3): ("a b c", [], []), (2, 0): ("", [], [])}


def test_rows_that_share_an_id_and_many_copies(spark):
    """Of rows with one id and text one keeps its windows; of a thousand copies the first; ids of differing texts are ordered somehow."""
    text = " ".join(f"t{k}" for k in range(25))
    got = counted(anchors.remove_passages(spark.createDataFrame([(5, text)] * 3 + [(k, text) for k in range(6, 1000)], "doc_id long, text string"), block_bytes=4000).select("doc_id", "n_removed"))
    assert got == collections.Counter({(5, 0): 1, (5, 25): 2} | {(k, 25): 1 for k in range(6, 1000)})
    both = anchors.remove_passages(spark.createDataFrame([(5, text + " a"), (5, text + " b")], "doc_id long, text string"))
    assert sorted(r.n_removed for r in both.collect()) == [0, 25]


def test_cover_must_be_complete(spark):
    with pytest.raises(ValueError):
        anchors.remove_passages(spark.createDataFrame([], "doc_id long, text string"), cover=(0, 1))


def brute_collocations(rows, longest=3, least=10, best=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = collections.Counter()
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + size] for p, a in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1) if 100 * a >= 50 * c[p[i : i + size]]}
        found = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out[lang, rank, p.decode(), -a, left, right, n[lang], -score] += 1
    return out


@pytest.mark.parametrize("longest, best, block_bytes, batch", [(3, 2000, 4000, 1 << 17), (2, 5, 1 << 20, 7), (4, 40, 9000, 100)])
def test_collocations(spark, monkeypatch, longest, best, block_bytes, batch):
    monkeypatch.setattr(collocations, "BATCH", batch)
    rng = random.Random(longest)
    words = ["The", "the", "é", "ZÜ", "zz", "#1", "w1", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ".", ", ", "\n", "!", "\x0b"]) for _ in range(rng.randrange(90))) if k % 13 else None, rng.choice(["en", "fr", None, "und"])) for k in range(200)]
    rows += [("", "en"), ("same words here " * 400, "xx"), ("so it is, so it is", "de"), *[("repeated row of words", "it")] * 12]
    docs = spark.createDataFrame([(k % 50, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(rows)], DOC).repartition(3)
    assert counted(collocations.collocations(docs, longest=longest, best=best, block_bytes=block_bytes)) == brute_collocations(rows, longest, best=best)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    rows = [("en", 1, "a", 4 * 10**12), ("en", 1, "b", 3 * 10**12 + 1), ("en", 2, "a b", 3 * 10**12)]
    got = collocations.scored(spark.createDataFrame(rows, collocations.GIVEN)).collect()
    assert [tuple(r) for r in got] == [("en", "a b", 3 * 10**12, 4 * 10**12, 3 * 10**12 + 1, 10**6 * 9 * 10**24 // (4 * 10**12 * (3 * 10**12 + 1)))]


def brute_clusters(rows, dim, clusters, rounds=10):
    points = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"3:{p[0]}".encode()).hexdigest(), np.array(p[1], "<i4").tobytes()))
    centroids = [list(p) for _, p in order[:clusters]]
    near = lambda p: min((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(p)[1] for _, p in points]
        for j in range(len(centroids)):
            members = [p for (_, p), x in zip(points, own, strict=True) if x == j]
            if members:
                centroids[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    final, per = [near(p) for _, p in points], collections.Counter()
    for d, j in final:
        per[j] += d
    return collections.Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(points, final, strict=True))


@pytest.mark.parametrize("clusters", [8, 3, 1, 500])
def test_clusters(spark, clusters):
    """Grid points with many ties, repeated rows and ids, and all kinds of vectors that are left out."""
    rng = random.Random(clusters)
    rows = [(k if k % 19 else None, [rng.randrange(-3, 4) / 1024 for _ in range(3)]) for k in range(150)]
    rows += [(200, None), (201, [1.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (204, [None, 0.0, 0.0]), (205, [5.5, -3.25, 1.0]), (205, [5.5, -3.25, 1.0]), (206, [])]
    vectors = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], VECTOR).repartition(4)
    assert counted(balls.cluster(vectors, dim=3, clusters=clusters)) == brute_clusters(rows, 3, clusters)
    assert balls.cluster(vectors.limit(0)).count() == 0


def test_balls_spare_comparisons():
    """Well separated clusters: most members are compared with their own centroid alone, and the result is that of all comparisons."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (8, 16))
    cluster = rng.integers(0, 8, 4000)
    points = centroids[cluster] + rng.integers(-60, 60, (4000, 16))
    far = ((points[:, None] - centroids[None]) ** 2).sum(2)
    radii = [int(math.isqrt(int(far[cluster == j, j].max()))) + 1 for j in range(8)]
    best, least, taken = balls.Balls(centroids.tolist(), radii).assign(points, cluster)
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all() and taken < 1.2 * len(points)
    best, least, taken = balls.Balls(centroids.tolist(), [None] * 8).assign(points, np.zeros(4000, np.int64))
    assert (best == far.argmin(1)).all() and (least == far.min(1)).all()


def test_components_that_are_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        balls.cluster(spark.createDataFrame([(1, [1e6])], "vec_id long, embedding array<float>"), dim=1).collect()
