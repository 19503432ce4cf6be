"""Term statistics, BM25 and nearest vectors for batches of queries."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved

#: Documents, and queries, that meet in one tile; postings of one block of a list.
SLAB, BLOCK, POSTINGS = 8_192, 1_024, 128
#: Best postings of a term whose documents are scored first, for a score that others must reach.
SEEDS = 3
#: Scores are rounded to four places before they are ranked.
SLACK = 1e-4


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length) of docs(doc_id, text)."""
    words = docs.select("doc_id", terms(F.col("text")).alias("words"))  # a column of its own, so that it is made once a document
    return words.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents that have a term, and how often it occurs."""
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def impacts(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(asked, added) of queries(query_id, text) and docs(doc_id, text): the terms ``t`` of each query, and for each document what each asked term adds to its Okapi score.

    Only words that some query has are counted, and they are joined before they are counted, so that no other posting is shuffled. Terms are numbers; the empty word, which is no term, stands once in each document and
    tells how many there are and how long, so that texts are split once.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    mark = queries.sparkSession.range(1).select(F.lit("").alias("term"))
    numbers = saved(words.select("term").distinct().unionAll(mark).select("term", F.when(F.col("term") == "", -1).otherwise(F.monotonically_increasing_id()).alias("t")))
    asked = saved(words.join(numbers, "term").select("query_id", "t"))
    split = docs.select("doc_id", terms(F.col("text")).alias("words"))  # a column of its own, so that it is made once a document
    # Outer: no filter splits the texts again to see whether there are words.
    each = split.select("doc_id", F.size("words").alias("length"), F.explode_outer(F.array_append(F.coalesce("words", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    counted = saved(each.join(numbers, "term").groupBy("doc_id", "length", "t").agg(F.count("*").alias("tf")))
    found = counted.where("t >= 0")
    measured = F.sum(F.when(F.col("length").isNotNull(), F.col("tf")))
    whole = counted.where("t < 0").agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / measured).alias("mean"))  # one row
    idf = found.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(whole)).select("t", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return asked, saved(found.join(idf, "t").select("doc_id", "t", part.alias("impact")))


def pair_scores(asked: DataFrame, added: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of pairs(query_id, doc_id) that share a term."""
    wanted = pairs.select("query_id", "doc_id").distinct().join(asked, "query_id")
    return wanted.join(added, ["doc_id", "t"]).groupBy("query_id", "doc_id").agg(F.round(F.sum("impact"), 4).alias("score"))


def least_scores(asked: DataFrame, added: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th score among the documents to which one of the query's terms adds most, which the k best of all reach; 0 with fewer."""
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.col("impact").desc(), "doc_id"))
    seeds = added.withColumn("place", place).where(F.col("place") <= SEEDS).select("doc_id", "t").join(asked, "t").select("query_id", "doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    kth = pair_scores(asked, added, seeds).withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return asked.select("query_id").distinct().join(kth, "query_id", "left").select("query_id", F.coalesce("least", F.lit(0.0)).alias("least"))


def best_of_tile(doc_ids: np.ndarray, doc_terms: np.ndarray, added: np.ndarray, queries: dict, k: int) -> list[tuple]:
    """[(query_id, doc_id, score, scored)]: the k best of the tile's documents for each of queries {query_id: (terms, least)}, and how many were scored in full.

    A term's postings stand by impact, in blocks with their largest one. A query takes its terms from the one that can add most; from where the rest together is below the least score
    that counts, no list is opened. Of an opened list a block is skipped if its largest impact and the most that all other terms can add are below that score. The documents that are met are
    dropped once what they have and the most that is left to add falls below it, twice on the way, and only what is left is scored in full.
    """
    ids, rows = np.unique(doc_ids, return_inverse=True)
    order = np.lexsort((-added, doc_terms))
    rows, added, doc_terms = rows[order], added[order], doc_terms[order]
    known, first, size = np.unique(doc_terms, return_index=True, return_counts=True)
    by_row = [np.argsort(rows[a : a + n], kind="stable") for a, n in zip(first, size, strict=True)]  # for looking up rows
    place = {int(t): i for i, t in enumerate(known)}

    def looked_up(i: int, wanted: np.ndarray) -> np.ndarray:
        a, n = first[i], size[i]
        own = by_row[i]
        held = rows[a : a + n][own]
        at = np.minimum(np.searchsorted(held, wanted), n - 1)
        return np.where(held[at] == wanted, added[a : a + n][own][at], 0.0)

    out = []
    for query, (terms_, least) in queries.items():
        lists = sorted((place[t] for t in terms_ if t in place), key=lambda i: -added[first[i]])
        if not lists:
            continue
        most = np.array([added[first[i]] for i in lists])
        left = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what this list and later ones can add
        least -= SLACK
        opened = max(1, int((left[:-1] >= least).sum()))
        total = np.zeros(len(ids))
        met = np.zeros(len(ids), bool)
        for j, i in enumerate(lists[:opened]):
            a, n = first[i], size[i]
            starts = added[a : a + n : POSTINGS]  # the largest of each block
            kept = min(n, POSTINGS * int((starts + (left[0] - most[j]) >= least).sum()))
            met[rows[a : a + kept]] = True
            total[rows[a : a + n]] += added[a : a + n]
        alive = np.flatnonzero(met)
        middle = (opened + len(lists)) // 2
        for begin, end in ((opened, middle), (middle, len(lists))):
            alive = alive[total[alive] + left[begin] >= least]
            if end < len(lists) or begin == middle:
                for j in range(begin, end):
                    total[alive] += looked_up(lists[j], alive)
        score = np.round(total[alive], 4)
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(query, ids[alive[x]], float(score[x]), len(alive)) for x in best.tolist()]
    return out


def tile_scores(asked: DataFrame, added: DataFrame, k: int) -> DataFrame:
    """(slab, query_id, doc_id, score, scored): the k best documents of each slab for each query, and how many of the slab were scored in full.

    Documents are dealt to slabs and queries to blocks by hash, and a slab meets a block in one tile, so neither a frequent term nor a long list of queries is one task or passes the driver.
    """
    n_docs, n_queries = (df.select(c).distinct().count() for df, c in ((added, "doc_id"), (asked, "query_id")))
    slabs, blocks = max(1, math.ceil(n_docs / SLAB)), max(1, math.ceil(n_queries / BLOCK))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = added.select(number("doc_id", slabs).alias("slab"), "doc_id", "t", "impact").select("*", every(blocks).alias("block"))
    right = asked.join(least_scores(asked, added, k), "query_id").select(number("query_id", blocks).alias("block"), "query_id", "t", "least").select("*", every(slabs).alias("slab"))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "query_id"), (added, "doc_id"))]

    def tile(docs: pa.Table, queries: pa.Table) -> pa.Table:
        held: dict = {}
        for query, t, least in zip(queries.column("query_id").to_pylist(), queries.column("t").to_pylist(), queries.column("least").to_pylist(), strict=True):
            held.setdefault(query, ([], least))[0].append(t)
        columns = [docs.column(c).to_numpy() for c in ("doc_id", "t", "impact")]
        found = best_of_tile(*columns, held, k) if docs.num_rows and held else []
        slab = docs.column("slab")[0].as_py() if docs.num_rows else 0
        query, doc, score, scored = zip(*found, strict=True) if found else ([], [], [], [])
        types = [pa.int32(), queries.schema.field("query_id").type, docs.schema.field("doc_id").type, pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(([slab] * len(found), query, doc, score, scored), types, strict=True)], names=["slab", "query_id", "doc_id", "score", "scored"])

    return left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(tile, f"slab int, {kinds[0]}, {kinds[1]}, score double, scored long")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of queries(query_id, text), ties to the smaller doc_id; exact (see ``best_of_tile``)."""
    return ranked(tile_scores(*impacts(docs, queries, k1, b), k), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def excerpt(text: Column, most: int = 120) -> Column:
    """The first characters of a text, with an ellipsis where more follow."""
    return F.concat(F.rtrim(F.substring(text, 1, most)), F.when(F.length(text) > most, "…").otherwise(""))


def _usable(vectors: DataFrame, *more: str) -> DataFrame:
    kept = vectors.where("vec_id is not null and embedding is not null")
    return kept.select(*(F.col(c).alias(c) for c in ("vec_id", "embedding", *more)))  # columns of its own, where both sides come from one table


def _unit(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of unit length; those that are zero or hold null or non-finite numbers become NaN."""
    rows = np.asarray(pc.list_flatten(column)).astype(np.float64).reshape(-1, size)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, within: str | None = None, rows: int = 4_096, block: int = 1_024) -> DataFrame:
    """(query_id, rank, vec_id, score), with the column ``within`` too if one is named: exact k nearest by cosine, the query's own row left out, ties to the smaller vec_id.

    With ``within`` a query meets only vectors that have the same value there, and has k nearest for each. Vectors are dealt to blocks of about ``rows`` by hash and queries to blocks of about
    ``block``; each pair of blocks is a tile, one matrix product in one task, from which k rows a query leave. So the driver sees only two counts, the plan is the same for any number of queries, and a
    value that a third of all vectors have is as many tiles as it fills.
    """
    keys = [within] if within else []
    v, q = _usable(vectors, *keys), _usable(queries, *keys)
    strips, blocks = max(1, math.ceil(v.count() / rows)), max(1, math.ceil(q.count() / block))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.withColumn("strip", number(strips)).withColumn("block", every(blocks))
    right = q.withColumn("block", number(blocks)).withColumn("strip", every(strips))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    extra = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys]

    def tile(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        sizes = pc.unique(pc.list_value_length(asked.column("embedding"))).to_pylist() if own.num_rows else []
        for size in sizes:
            mine, theirs = (t.filter(pc.equal(pc.list_value_length(t.column("embedding")), size)) for t in (own, asked))
            if not mine.num_rows or not size:
                continue
            mine = mine.sort_by("vec_id")
            ids, query = mine.column("vec_id").to_numpy(), theirs.column("vec_id").to_numpy()
            score = np.round(_unit(theirs.column("embedding"), size) @ _unit(mine.column("embedding"), size).T, 4)
            score[np.isnan(score) | (query[:, None] == ids)] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, order, axis=1)
            kept = best > -np.inf
            for held, x in zip(found, (np.repeat(query, order.shape[1])[kept.ravel()], ids[order].ravel()[kept.ravel()], best.ravel()[kept.ravel()]), strict=True):
                held.append(x)
        idt = own.schema.field("vec_id").type
        columns = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(found, (idt, idt, pa.float64()), strict=True)]
        return pa.Table.from_arrays([*(pa.array([own.column(c)[0].as_py() if own.num_rows else None] * len(columns[0]), own.schema.field(c).type) for c in keys), *columns], names=[*keys, "query_id", "vec_id", "score"])

    tiles = left.groupBy(*keys, "strip", "block").cogroup(right.groupBy(*keys, "strip", "block")).applyInArrow(tile, ", ".join([*extra, f"query_id {kind}, vec_id {kind}, score double"]))
    rank = F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy(F.col("score").desc(), "vec_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "query_id", "rank", "vec_id", "score")


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k candidates(query_id, doc_id) nearest by cosine; docs(doc_id, v), queries(query_id, q)."""
    scored = candidates.select("query_id", "doc_id").join(queries, "query_id").join(docs, "doc_id").select("query_id", "doc_id", F.round(cosine(F.col("q"), F.col("v")), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def hybrid(docs: DataFrame, queries: DataFrame, doc_vectors: DataFrame, query_vectors: DataFrame, k: int = 10, candidates: int = 40) -> DataFrame:
    """(query_id, rank, doc_id, score, excerpt): the best by words, put in order by vectors."""
    by_words = bm25(docs, queries, candidates)
    best = rerank(by_words, doc_vectors, query_vectors, k)
    return best.join(docs.select("doc_id", excerpt(F.col("text")).alias("excerpt")), "doc_id").select("query_id", "rank", "doc_id", "score", "excerpt")


def token_set(a: Column, b: Column) -> Column:
    """Share of the smaller set of words that the other has too."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def hybrid_events(docs: DataFrame, queries: DataFrame, near: DataFrame, likeness: float = 0.75, title_likeness: float = 0.9, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, tier): near(query_id, doc_id) are the candidates by vectors; docs(doc_id, title, text), queries(query_id, text).

    Tier 1: candidates whose title is alike to the query; tier 2: those whose text is; tier 3, where neither is found: the k best by words. The first tier that a
    query has is its answer, in the order of word scores. What is alike is told by shared words.
    """
    asked_terms, added = impacts(docs.select("doc_id", "text"), queries)
    by_words = ranked(tile_scores(asked_terms, added, k), k)
    asked = queries.select("query_id", terms(F.col("text")).alias("q"))
    texts = near.join(asked, "query_id").join(docs.select("doc_id", "title", "text"), "doc_id")
    alike = texts.select("query_id", "doc_id", "q", terms(F.col("title")).alias("in_title"), terms(F.col("text")).alias("in_text"))  # only the candidates' texts are split
    tiers = alike.select("query_id", "doc_id", F.when(token_set(F.col("q"), F.col("in_title")) >= title_likeness, 1).when(token_set(F.col("q"), F.col("in_text")) >= likeness, 2).alias("tier")).where("tier is not null")
    found = tiers.join(pair_scores(asked_terms, added, tiers), ["query_id", "doc_id"], "left").select("query_id", "doc_id", "tier", F.coalesce("score", F.lit(0.0)).alias("score"))
    every = found.unionAll(by_words.select("query_id", "doc_id", F.lit(3).alias("tier"), "score"))
    first = every.withColumn("first", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return first.select("query_id", rank.alias("rank"), "doc_id", "tier")


#: Bits of the sketch by which candidates are told apart before any vector is compared.
SKETCH = 256


def signs(vectors: DataFrame, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """(vec_id, embedding, sketch, codes) of vectors(vec_id, embedding): on which side of random planes they lie.

    sketch holds ``SKETCH`` sides as longs. codes has for each table its code of ``bits`` sides and, with probes over 1, the likeliest neighbours of that code: those with one or two sides turned
    whose planes are nearest. Vectors that are null, zero or not finite have none and are left out.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    flips = [(), *combinations(range(bits), 1), *combinations(range(bits), 2)]
    masks = np.array([sum(1 << i for i in f) for f in flips], np.int64)
    takes = np.array([[float(i in f) for i in range(bits)] for f in flips])

    def run(batches):
        for batch in batches:
            for size in pc.unique(pc.list_value_length(batch.column("embedding"))).to_pylist():
                own = pa.Table.from_batches([batch]).filter(pc.equal(pc.list_value_length(batch.column("embedding")), size))
                if not size or not own.num_rows:
                    continue
                unit = _unit(own.column("embedding"), size)
                good = np.flatnonzero(np.isfinite(unit).all(axis=1))
                planes = np.random.default_rng([seed, size]).standard_normal((size, tables * bits + SKETCH))  # the same in every task
                side = unit[good] @ planes
                sketch = np.packbits(side[:, tables * bits :] > 0, axis=1, bitorder="little").view("<i8")
                near = side[:, : tables * bits].reshape(len(good), tables, bits)
                code = ((near > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                cost = (near**2) @ takes.T
                turned = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
                codes = (code[:, :, None] ^ masks[turned]) + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(pa.list_(pa.int64())) for x, n in ((sketch, SKETCH // 64), (codes, tables * min(probes, len(flips))))]
                kept = own.take(pa.array(good)).combine_chunks()
                yield from pa.Table.from_arrays([kept.column("vec_id"), kept.column("embedding"), *(pa.chunked_array([x]) for x in lists)], names=["vec_id", "embedding", "sketch", "codes"]).to_batches()

    return _usable(vectors).mapInArrow(run, f"vec_id {kind}, embedding {vectors.schema['embedding'].dataType.simpleString()}, sketch array<long>, codes array<long>")


def hashed_candidates(vectors: DataFrame, queries: DataFrame, most: int, tables: int = 6, bits: int | None = None, probes: int = 40, seed: int = 11) -> DataFrame:
    """(query_id, q, vec_id, embedding): for each query the ``most`` candidates whose sketches differ least from its own, of those that share a code with it.

    Each vector stands in one bucket of each table, a query looks into ``probes`` of each. bits follow the number of vectors, so that a bucket keeps about eight. Equal sketches go by vec_id.
    """
    if bits is None:
        bits = min(40, max(4, round(math.log2(max(vectors.count(), 1) / 8))))
    side = lambda df, n: saved(signs(df, tables, bits, n, seed))
    held, asked = side(vectors, 1), side(queries, probes)
    buckets = held.select(F.explode("codes").alias("code"), "vec_id", "sketch")
    looked = asked.select(F.explode("codes").alias("code"), F.col("vec_id").alias("query_id"), F.col("sketch").alias("of"))
    apart = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("of", F.lit(i)))) for i in range(1, SKETCH // 64)), F.bit_count(F.get("sketch", F.lit(0)).bitwiseXOR(F.get("of", F.lit(0)))))
    met = looked.join(buckets, "code").where("query_id <> vec_id").select("query_id", "vec_id", apart.alias("apart")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("apart", "vec_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "vec_id")
    return best.join(held.select("vec_id", "embedding"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")


def nearest_by_hashing(vectors: DataFrame, queries: DataFrame, k: int = 5, most: int | None = None, **planes: int) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest by cosine among ``most`` candidates (36 k, unless said otherwise) a query that signed random projections find.

    ``nearest`` is the measure of its recall. Candidates come from an equi-join on short codes, only their sketches are compared, by counting bits, and only ``most`` vectors a query are
    compared in full.
    """
    pairs = hashed_candidates(vectors, queries, most or 36 * k, **planes)
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 4).alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
