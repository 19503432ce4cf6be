"""Chunks of texts and searches over them as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Tokenizer
from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels, search
from ..sources import stand_ins as S
from .queries import TERMS, _labelled, query

SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: s <> '')"
_LAST = "list_last(string_split(a, chr(1)))"


def _packed(fits: str, otherwise: str = "a || chr(1) || s") -> str:
    """SQL that packs a list of texts, chunks parted by chr(1)."""
    return f"list_reduce(l, lambda a, s: CASE WHEN {fits} THEN a || ' ' || s ELSE {otherwise} END)"


@query(
    f"""WITH d AS (SELECT doc_id, {SENTENCES} AS l FROM documents), c AS (SELECT doc_id, string_split({_packed(f"length({_LAST}) + 1 + length(s) <= 500")}, chr(1)) AS c FROM d WHERE len(l) > 0)
SELECT doc_id, (i - 1)::INT AS chunk_index, len(c)::INT AS total, c[i] AS chunk, length(c[i])::INT AS n FROM c, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)"""
)
def pack_sentences(spark, sf_dir):
    chunks = S.read(spark, sf_dir, "documents").select("doc_id", text.pack_sentences(F.col("text"), 500).alias("c"))
    each = chunks.select("doc_id", F.size("c").alias("total"), F.posexplode("c").alias("chunk_index", "chunk"))
    return each.select("doc_id", "chunk_index", "total", "chunk", F.length("chunk").alias("n"))


@query(
    f"""WITH d AS (SELECT doc_id, {SENTENCES} AS l FROM documents),
o AS (SELECT doc_id, list_transform(l, lambda s, i: s || chr(3) || s) AS l FROM d WHERE len(l) > 0),
c AS (SELECT doc_id, string_split(list_reduce(o.l, lambda a, s: CASE WHEN length(split_part({_LAST}, chr(3), 1)) + 1 + length(split_part(s, chr(3), 1)) <= 500 THEN regexp_replace(a, chr(3) || '[^' || chr(3) || ']*$', '') || ' ' || s
  ELSE regexp_replace(a, chr(3) || '[^' || chr(3) || ']*$', '') || chr(1) || split_part({_LAST}, chr(3), 2) || ' ' || s END), chr(1)) AS c FROM o)
SELECT doc_id, (i - 1)::INT AS chunk_index, split_part(c[i], chr(3), 1) AS chunk FROM c, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)"""
)
def pack_overlap(spark, sf_dir):
    """Each chunk begins with the last sentence of the one before."""
    return S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_sentences(F.col("text"), 500, 1)).alias("chunk_index", "chunk"))


#: Sentences with these stand alone: with the fixed patterns, words that the given texts have.
ALONE = [*text.PRESERVE_PATTERNS, "%%%|!!"]
_IS_ALONE = "(" + " OR ".join(f"regexp_matches({{0}}, '{p}')" for p in ALONE) + ")"


@query(
    f"""WITH d AS (SELECT doc_id, list_transform({SENTENCES}, lambda s: CASE WHEN {_IS_ALONE.format("s")} THEN chr(4) || s ELSE s END) AS l FROM documents),
c AS (SELECT doc_id, list_transform(string_split({_packed(f"NOT starts_with(s, chr(4)) AND NOT starts_with({_LAST}, chr(4)) AND length({_LAST}) + length(s) + 2 <= 800")}, chr(1)), lambda s: ltrim(s, chr(4))) AS l FROM d WHERE len(l) > 0),
m AS (SELECT doc_id, string_split({_packed(f"length({_LAST}) < 150")}, chr(1)) AS c FROM c)
SELECT doc_id, (i - 1)::INT AS chunk_index, c[i] AS chunk FROM m, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)"""
)
def pack_preserve(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.pack_preserve(F.col("text"), patterns=ALONE)).alias("chunk_index", "chunk"))


@query(
    """WITH d AS (SELECT doc_id, '# ' || source || ' | ' || lang AS h, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
c AS (SELECT doc_id, string_split(list_reduce(list_prepend(h, l), lambda a, s: CASE WHEN length(list_last(string_split(a, chr(1)))) + 1 + length(s) <= 1000 THEN a || chr(10) || s ELSE a || chr(1) || h || chr(10) || s END), chr(1)) AS c FROM d)
SELECT doc_id, (i - 1)::INT AS chunk_index, c[i] AS chunk FROM c, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)"""
)
def pack_lines(spark, sf_dir):
    header = F.concat(F.lit("# "), "source", F.lit(" | "), "lang")
    docs = S.read(spark, sf_dir, "documents").where("text is not null and source is not null and lang is not null")
    return docs.select("doc_id", F.posexplode(text.pack_lines(header, F.split("text", "\n"))).alias("chunk_index", "chunk"))


@query(
    r"""SELECT 'course' AS kind, p_partkey AS key, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) || ': ' || p_name || ' (' || (1 + p_size % 5) || ' units)' AS page_content FROM part
UNION ALL SELECT 'section', event_id, 'Section ' || event_id || ' of ' || event_type || ' meets in the ' || CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END FROM events
UNION ALL SELECT 'faq', item_id, 'Q: ' || regexp_extract(text, '^([^.!?]*[.!?]?)', 1) || chr(10) || 'A: ' || text FROM benchmark
UNION ALL SELECT 'timeline', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ': ' || o_orderpriority || ' order of ' || o_custkey FROM orders
UNION ALL SELECT 'general', doc_id, source || ' (' || lang || '): ' || rtrim(substr(text, 1, 120)) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END FROM documents"""
)
def build_chunks(spark, sf_dir):
    read = lambda name: S.read(spark, sf_dir, name)
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("page_content")
    hour = F.hour("ts")
    c = F.col
    kinds = [
        read("part").select(F.lit("course").alias("kind"), c("p_partkey").alias("key"), line(c("p_type"), " ", F.regexp_extract("p_brand", r"(\d+)", 1), ": ", c("p_name"), " (", (1 + c("p_size") % 5).cast("string"), " units)")),
        read("events").select(F.lit("section"), "event_id", line("Section ", c("event_id").cast("string"), " of ", c("event_type"), " meets in the ", F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening"))),
        read("benchmark").select(F.lit("faq"), "item_id", line("Q: ", F.regexp_extract("text", "^([^.!?]*[.!?]?)", 1), "\nA: ", c("text"))),
        read("orders").select(F.lit("timeline"), "o_orderkey", line(F.date_format("o_orderdate", "yyyy-MM-dd"), ": ", c("o_orderpriority"), " order of ", c("o_custkey").cast("string"))),
        read("documents").select(F.lit("general"), "doc_id", line(c("source"), " (", c("lang"), "): ", search.excerpt(c("text")))),
    ]
    every = kinds[0]
    for one in kinds[1:]:
        every = every.unionAll(one)
    return every


# Searches by words and vectors


def _asked(spark, sf_dir):
    return S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir, key: str, value: str):
    """Vectors of documents, and of queries: those with the same number."""
    return S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias(value))


SCORES = f"""WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS term FROM benchmark),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, mean FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), st),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 4) AS score FROM p JOIN f USING (term) JOIN q USING (term) GROUP BY ALL),
top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)"""
_COS = "round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 4)"


@query(SCORES + f", r AS (SELECT query_id, doc_id, {_COS} AS c FROM top JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = doc_id WHERE rank <= 40) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id)::INT AS rank, doc_id, c AS score FROM r QUALIFY rank <= 5")
def cosine_rerank(spark, sf_dir):
    candidates = search.bm25(S.read(spark, sf_dir, "documents").select("doc_id", "text"), _asked(spark, sf_dir), 40)
    return search.rerank(candidates, _vectors(spark, sf_dir, "doc_id", "v"), _vectors(spark, sf_dir, "query_id", "q"), 5)


@query(SCORES + f", r AS (SELECT query_id, doc_id, {_COS} AS c FROM top JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = doc_id WHERE rank <= 40), k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id)::INT AS rank, doc_id, c AS score FROM r QUALIFY rank <= 10) SELECT query_id, rank, k.doc_id, score, rtrim(substr(text, 1, 120)) || CASE WHEN length(text) > 120 THEN '…' ELSE '' END AS excerpt FROM k JOIN documents t ON t.doc_id = k.doc_id")
def hybrid_search(spark, sf_dir):
    docs = S.read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.hybrid(docs, _asked(spark, sf_dir), _vectors(spark, sf_dir, "doc_id", "v"), _vectors(spark, sf_dir, "query_id", "q"))


_WORDS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"


@query(
    SCORES
    + f""", n AS (SELECT query_id, doc_id FROM (SELECT x.vec_id AS query_id, y.vec_id AS doc_id, {_COS} AS c FROM embeddings x JOIN benchmark ON item_id = x.vec_id JOIN embeddings y ON x.vec_id <> y.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) <= 40),
a AS (SELECT query_id, n.doc_id, {_WORDS.format("b.text")} AS q, {_WORDS.format("t.text")} AS w, {_WORDS.format("split_part(t.text, chr(10), 1)")} AS tw FROM n JOIN benchmark b ON item_id = query_id JOIN documents t ON t.doc_id = n.doc_id),
t AS (SELECT query_id, doc_id, CASE WHEN len(list_intersect(q, tw)) / greatest(least(len(list_distinct(q)), len(list_distinct(tw))), 1) >= 0.9 THEN 1 WHEN len(list_intersect(q, w)) / greatest(least(len(list_distinct(q)), len(list_distinct(w))), 1) >= 0.35 THEN 2 END AS tier FROM a),
e AS (SELECT t.query_id, t.doc_id, tier, coalesce(score, 0) AS score FROM t LEFT JOIN s ON s.query_id = t.query_id AND s.doc_id = t.doc_id WHERE tier IS NOT NULL UNION ALL SELECT query_id, doc_id, 3, score FROM top WHERE rank <= 10),
b AS (SELECT * FROM e QUALIFY tier = min(tier) OVER (PARTITION BY query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, tier FROM b"""
)
def hybrid_events(spark, sf_dir):
    docs = S.read(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")
    vectors, asked = S.read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)
    own = vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    near = search.nearest(vectors, own, 40).select("query_id", F.col("vec_id").alias("doc_id"))
    return search.hybrid_events(docs, asked, near, likeness=0.35)


@query()
def knn_lsh(spark, sf_dir):
    vectors = S.read(spark, sf_dir, "embeddings")
    return search.nearest_by_hashing(vectors, vectors.where("vec_id % 50 = 0"))


@query()
def train_classifier(spark, sf_dir):
    """A text classifier with class weights: fitted on the training part, its report on the validation part."""
    rows = labels.stratified_split(_labelled(spark, sf_dir))
    weights = labels.class_weights(rows.where("part = 'train'")).select("label", "weight")
    index = labels.label_index(rows).select("label", F.col("idx").cast("double").alias("idx"))
    texts = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    data = rows.join(F.broadcast(weights), "label").join(F.broadcast(index), "label").join(texts, "id")
    stages = [Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="idx", weightCol="weight", maxIter=10, regParam=0.01)]
    model = Pipeline(stages=stages).fit(data.where("part = 'train'"))
    judged = model.transform(data.where("part = 'validation'")).select(F.col("label").alias("truth"), "prediction")
    named = judged.join(F.broadcast(index.select(F.col("label").alias("pred"), F.col("idx").alias("prediction"))), "prediction")
    return labels.classification_report(named.select("truth", "pred"))
