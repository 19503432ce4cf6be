"""Searches against brute force, and how little of the tables they compare."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from transferlake.operators import search

SF = "/root/testdata/sf0.1"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_hashing_finds_the_nearest_and_compares_few(spark):
    vectors = table(spark, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact = pairs(search.nearest(vectors, asked))
    found = search.nearest_by_hashing(vectors, asked)
    assert len(exact & pairs(found)) / len(exact) >= 0.9
    compared = search.hashed_candidates(vectors, asked, 36 * 5).count()
    assert compared <= 0.1 * vectors.count() * asked.count()
    assert "BatchEvalPython" not in found._jdf.queryExecution().toString()  # nothing row by row


def test_hashing_on_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 0.1]), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id) for r in search.nearest_by_hashing(df, df.where("vec_id = 1"), k=2).collect()}
    assert got == {(1, 1, 2), (1, 2, 6)}
    assert search.nearest_by_hashing(df.limit(0), df).count() == 0


@pytest.mark.parametrize("rows, block", [(7, 3), (10_000, 10_000)])
def test_nearest_over_tiles_matches_brute_force(spark, rows, block):
    rng = np.random.default_rng(3)
    held = [(i, rng.standard_normal(5).round(2).tolist(), i % 3) for i in range(60)] + [(60 + i, [1.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(5)]
    odd = [(100, None, 0), (None, [1.0] * 5, 1), (101, [0.0] * 5, 0), (102, [float("nan")] * 5, 0), (103, [1.0, 2.0], 0), (104, [2.0, 4.0], 0), (105, [], 1)]
    df = spark.createDataFrame(held + odd, "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id % 4 = 0 or vec_id > 99")

    def brute(within):
        out = set()
        usable = [(i, np.array(v), x) for i, v, x in held + odd if i is not None and v and np.isfinite(v).all() and np.any(v)]
        for i, v, x in usable:
            if i % 4 and i <= 99:
                continue
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 4), j) for j, w, y in usable if j != i and len(w) == len(v) and (not within or x == y))
            out |= {(i, k + 1, j) for k, (_, j) in enumerate(near[:4])}
        return out

    for within in (None, "label"):
        got = search.nearest(df, asked, 4, within, rows, block)
        assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == brute(within)
    assert search.nearest(df.limit(0), asked).count() == 0 == search.nearest(df, asked.limit(0)).count()


def test_the_plan_does_not_grow_with_the_queries(spark):
    vectors = table(spark, "embeddings")
    size = lambda n: len(search.nearest(vectors, vectors.where(f"vec_id < {n}"), block=8)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(8) == size(1_000)


def brute_bm25(docs, queries, k, k1=1.5, b=0.75):
    split = [(i, t.lower().split()) for i, t in docs]
    mean, n = sum(len(w) for _, w in split) / len(split), len(split)
    df = Counter(t for _, w in split for t in set(w))
    out = {}
    for q, text in queries:
        scored = []
        for i, w in split:
            tf = Counter(w)
            terms = [t for t in set(text.lower().split()) if tf[t]]
            if terms:
                scored.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean)) for t in terms), 4), i))
        out[q] = sorted(scored)[:k]
    return {(q, r + 1, i, -s) for q, x in out.items() for r, (s, i) in enumerate(x)}


def test_bounded_bm25_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"W{int(rng.paretovariate(0.7)) % 200}" for _ in range(3_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 50)))) for i in range(300)] + [(400 + i, "w1 tie tie") for i in range(12)] + [(500, "")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(20)] + [(90, "tie"), (91, "nowhere"), (92, "")]
    monkeypatch.setattr(search, "SLAB", 50)
    monkeypatch.setattr(search, "BLOCK", 6)
    monkeypatch.setattr(search, "POSTINGS", 4)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = search.bm25(*frames, k=5)
    assert {(r.query_id, r.rank, r.doc_id, r.score) for r in got.collect()} == brute_bm25(docs, queries, 5)
    assert search.bm25(frames[0].limit(0), frames[1]).count() == 0 == search.bm25(frames[0], frames[1].limit(0)).count()


def test_bm25_scores_a_tenth_of_the_pairs_at_most(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    queries = table(spark, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked, added = search.impacts(docs, queries)
    tiles = search.tile_scores(asked, added, 10).groupBy("slab", "query_id").agg(F.max("scored").alias("n"))
    seeds = added.count() and asked.select("t").distinct().count() * search.SEEDS  # documents scored for the least score, at most so many for each of a term's queries
    assert tiles.agg(F.sum("n")).first()[0] <= 0.1 * docs.count() * queries.count()
    assert seeds < 0.01 * docs.count() * queries.count()
