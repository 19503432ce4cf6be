"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - x . w): one weight per word, shared by all thresholds, which are in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import checkpointed, text_slices

#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 6_000
#: A candidate feature occurs in this many sample texts and lies this many standard errors from no association with one of the thresholds.
MIN_TEXTS, MIN_Z = 5, 5.0
#: A candidate becomes a feature if the model so far leaves it this many standard errors to explain.
LEFT_Z = 3.0
#: Selection ends when so many rounds have lowered the negative log likelihood by less than this part of what it was without features.
PATIENCE, LEAST_GAIN = 8, 0.001
#: Features are alike if they share this part of the texts that have one of them; one of them stands for all.
ALIKE = 0.95
#: A feature is dense in a text if it occurs twice or more, and once in this many words.
DENSE = 200
#: Lengths of the word beginnings that are features beside whole words: they stand for stems.
PREFIXES = range(3, 9)
#: The grade from which a document is toxic, and the probability of it beyond which the document is rejected.
TOXIC_GRADE, REJECT = 2, 0.5
REMEMBERED_WORDS = 200_000
WORD, SYMBOLS = re.compile(r"[^\W\d_]+"), re.compile(r"([^\w\s])\1*")
#: What a word in capitals and a word that repeats the one before have as a feature.
CAPITALS, AGAIN = "<capitals>", "<again>"


def word_counts(text: str) -> Counter[str]:
    """How often a text has each lower-cased word and each run of one symbol; CAPITALS and AGAIN count words that are so."""
    cased = WORD.findall(text)
    words = list(map(str.lower, cased))
    counts = Counter(words)
    counts.update(m[0] for m in SYMBOLS.finditer(text))
    counts[CAPITALS] += sum(len(w) > 1 for w in filter(str.isupper, cased))
    counts[AGAIN] += sum(map(eq, words, words[1:]))
    return +counts


def word_features(word: str) -> list[str]:
    """The word, and its proper beginnings with a star; a symbol's run and CAPITALS and AGAIN are themselves alone."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if k < len(word))] if word[0].isalpha() else [word]


def with_density(counts: dict[str, int], n_words: int) -> list[str]:
    """Feature names of a text: each that occurs, and once more with ``@`` if it is dense."""
    return [*counts, *(f"{f}@" for f, n in counts.items() if n > 1 and n * DENSE >= n_words)]


def text_features(text: str) -> list[str]:
    words = word_counts(text)
    counts: Counter[str] = Counter()
    for word, n in words.items():
        for f in word_features(word):
            counts[f] += n
    return with_density(counts, words.total())


class ActiveFeatures(dict):
    """The features of a model that a word has, dense or not."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.names = {f.rstrip("@") for f in weights}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = tuple(f for f in word_features(word) if f in self.names)
        return found


@dataclass
class Severity:
    """A fitted model. Without toxic and other labelled texts it has no words and gives severity 0.

    thresholds[k] parts grade k from k + 1; grades that no text had share the threshold of the next.
    """

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    toxic_grade: int = TOXIC_GRADE

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + math.exp(max(-60.0, min(60.0, t - score)))) for t in self.thresholds]

    def scorer(self) -> Callable[[str], float]:
        """x . w of a text."""
        active, weights = ActiveFeatures(self.weights), self.weights

        def score(text: str) -> float:
            words, counts = word_counts(text), Counter()
            for word in compress(words, map(active.__getitem__, words)):
                for f in active[word]:
                    counts[f] += words[word]
            return sum(weights.get(f, 0.0) for f in sorted(with_density(counts, words.total()))) if counts else 0.0

        return score


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, start: np.ndarray | None = None, l2: float = 0.05, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the penalised maximum likelihood, by Newton steps; ``start`` are earlier ones in a row.

    The likelihood is concave, and infinite costs keep the thresholds in order.
    """
    (n, p), cuts = x.shape, n_grades - 1
    share = np.array([(grades > k).sum() for k in range(cuts)]) + 0.5
    first = np.log((n + 1 - share) / share)
    at = np.concatenate([np.zeros(p), np.maximum.accumulate(first + 1e-3 * np.arange(cuts))]) if start is None else start
    penalty = np.concatenate([np.full(p, l2), np.full(cuts, 1e-6)])
    eye = np.vstack([np.eye(cuts), np.zeros(cuts)])  # the last row, also -1, is no threshold
    upper, lower = np.hstack([-x, eye[np.where(grades < cuts, grades, -1)]]), np.hstack([-x, eye[grades - 1]])

    def parts(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        u, v = np.where(grades < cuts, upper @ beta, 60.0), np.where(grades > 0, lower @ beta, -60.0)
        pu, pv = 1 / (1 + np.exp(-np.clip(u, -60, 60))), 1 / (1 + np.exp(-np.clip(v, -60, 60)))
        gap = np.where(grades == cuts, 1 / (1 + np.exp(np.clip(v, -60, 60))), pu - np.where(grades > 0, pv, 0.0))
        cost = np.inf if (gap <= 0).any() else -np.log(gap).sum() + 0.5 * (penalty * beta * beta).sum()
        return cost, np.where(grades < cuts, pu, 1.0), np.where(grades > 0, pv, 0.0), np.maximum(gap, 1e-300)

    cost, pu, pv, gap = parts(at)
    for _ in range(rounds):
        su, sv = pu * (1 - pu), pv * (1 - pv)
        du, dv = su / gap, -sv / gap
        huu, hvv, huv = su * (1 - 2 * pu) / gap - du * du, -sv * (1 - 2 * pv) / gap - dv * dv, su * sv / gap / gap
        gradient = upper.T @ du + lower.T @ dv - penalty * at
        mixed = upper.T @ (huv[:, None] * lower)
        curve = upper.T @ (huu[:, None] * upper) + lower.T @ (hvv[:, None] * lower) + mixed + mixed.T - np.diag(penalty)
        step = np.linalg.solve(curve - 1e-9 * np.eye(len(at)), gradient)
        size = 1.0
        while size > 1e-6 and not (new := parts(at - size * step))[0] < cost:
            size /= 2
        if size <= 1e-6 or cost - new[0] < 1e-6 * n**0.5:
            break
        at, (cost, pu, pv, gap) = at - size * step, new
    return at[:p], at[p:]


def residuals(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each row, the slope of its log likelihood in its score, and the information on the score that the model expects of it; and the negative log likelihood."""
    below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60.0], cuts, [60.0]]) - score[:, None], -60, 60)))
    slopes = below[:, 1:] + below[:, :-1] - 1
    shares, own = np.diff(below, axis=1), (np.arange(len(grades)), grades)
    return slopes[own], (shares * slopes**2).sum(axis=1), float(-np.log(np.maximum(shares[own], 1e-300)).sum())


def select_features(rows: list[list[int]], grades: np.ndarray, names: list[str], n_grades: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(features, weights, thresholds) by forward selection.

    A score test says how much of what the model so far leaves a feature explains, over all thresholds and of either sign, in standard errors. Each round adds the
    feature that explains most, at nearly the same the longest, since one stem stands for the many words that begin with it; then, in the same order, every
    other that lies in texts that the round's features for the most part do not have; and fits again, by a few steps until the end. Features ALIKE to a chosen one go. It ends when none explains LEFT_Z,
    or PATIENCE rounds no more than LEAST_GAIN.
    """
    n_features = len(names)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    order = np.argsort(feature, kind="stable")
    texts_of = np.split(owner[order], np.cumsum(np.bincount(feature, minlength=n_features))[:-1]) if n_features else []
    size = np.array([len(f.rstrip("@")) for f in names])
    times = np.bincount(feature, minlength=n_features)
    gone = np.zeros(n_features, bool)  # chosen, or alike to a chosen one
    chosen: list[int] = []
    costs: list[float] = []
    x = np.zeros((len(rows), 0))
    weights, cuts = fit_ordinal(x, grades, n_grades)
    while n_features:
        slope, information, cost = residuals(x @ weights, cuts, grades)
        costs.append(cost)
        if len(costs) > PATIENCE and costs[-1 - PATIENCE] - cost < LEAST_GAIN * costs[0]:
            break
        z = np.abs(np.bincount(feature, slope[owner], n_features)) / np.sqrt(np.bincount(feature, information[owner], n_features) + 0.5)
        z[gone] = 0
        if z.max() < LEFT_Z:
            break
        taken = np.zeros(len(rows), bool)
        added: list[int] = []
        open_ = np.flatnonzero(z >= LEFT_Z)
        # Within 2 % of each other features are alike, and the longest comes first.
        for f in open_[np.lexsort((open_, -size[open_], -np.floor(np.log(z[open_]) / np.log(1.02))))].tolist():
            if not gone[f] and (not added or taken[texts_of[f]].mean() < 0.5):
                added.append(f)
                taken[texts_of[f]] = True
                has = np.zeros(len(rows), bool)
                has[texts_of[f]] = True
                both = np.bincount(feature[has[owner]], minlength=n_features)
                gone |= both >= ALIKE * (times + times[f] - both)
        columns = np.zeros((len(rows), len(added)))
        for k, f in enumerate(added):
            columns[texts_of[f], k] = 1
        chosen += added
        x = np.hstack([x, columns])
        weights, cuts = fit_ordinal(x, grades, n_grades, np.concatenate([weights, np.zeros(len(added)), cuts]), rounds=15)
    weights, cuts = fit_ordinal(x, grades, n_grades, np.concatenate([weights, cuts]))
    return chosen, weights, cuts


def sample_labelled(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of docs with the grade of their doc_id in grades(doc_id, grade), for at most ``sample_rows`` ids, by a hash of the id.

    Ids alone are shuffled; the sample, with one row an id, has a bound and is broadcast, so that texts stay where they are read.
    An id with several grades has the highest; null ids and null or negative grades take no part.
    """
    rated = grades.where("doc_id is not null and grade >= 0").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    known = rated.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = checkpointed(known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows))
    return docs.join(F.broadcast(sample), "doc_id")


def fit_severity(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", grade_column: str = "grade", sample_rows: int = SAMPLE_ROWS, toxic_grade: int = TOXIC_GRADE) -> Severity:
    """Fit on at most ``sample_rows`` of the rows with a grade (0, 1, ...), chosen by a hash of id; rows with a null id
    are left out and null texts are empty ones.

    Repeated texts count once, with their highest grade. What reaches the driver is bounded by the sample: the features that MIN_TEXTS of its
    texts share and that lie MIN_Z from chance, and which of them each sampled text has.
    """
    rated = labelled.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), F.col(grade_column).cast("int").alias("grade")).where("grade >= 0")
    # The ids alone are ordered; texts are read for the sample only, whose size has a bound.
    ids = checkpointed(rated.select("id").where("id is not null").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_rows).distinct())
    chosen = rated.join(F.broadcast(ids), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), batch.column("grade").slice(start, len(texts)), pa.array([text_features(t) for t in texts], pa.list_(pa.string()))], names=["key", "grade", "features"])

    texts = chosen.groupBy(F.xxhash64("text").alias("key")).agg(F.max("grade").alias("grade"), F.first("text").alias("text"))
    sample = checkpointed(texts.mapInArrow(run, "key long, grade int, features array<string>"))
    grades = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # one row a grade
    n, hot = sum(grades.values()), sum(k for g, k in grades.items() if g >= toxic_grade)
    if not hot or hot == n:
        return Severity()
    seen = np.array(sorted(grades))
    each = sample.select("key", "grade", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").alias("n"), *(F.count_if(F.col("grade") >= int(g)).alias(f"over{g}") for g in seen[1:]))
    apart = []
    for g in seen[1:]:
        rate = sum(k for h, k in grades.items() if h >= g) / n
        apart.append(F.abs(F.col(f"over{g}") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate))))
    candidates = [r.feature for r in counts.where((F.col("n") >= MIN_TEXTS) & (F.greatest(*apart, F.lit(0.0)) >= MIN_Z)).select("feature").collect()]  # bounded by the sample
    names = sorted(candidates)
    index = {f: i for i, f in enumerate(names)}
    table = sample.sparkSession.createDataFrame(list(index.items()), "feature string, at int")
    has = each.join(F.broadcast(table), "feature").groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    rows = sample.select("key", "grade").join(has, "key", "left").orderBy("key").collect()
    rank = np.searchsorted(seen, [r.grade for r in rows])
    features, weights, cuts = select_features([r.at or [] for r in rows], rank, names, len(seen))
    thresholds = [float(cuts[max(0, np.searchsorted(seen, k) - 1)]) for k in range(1, int(seen[-1]) + 1)]
    return Severity({names[f]: float(w) for f, w in zip(features, weights, strict=True)}, thresholds, toxic_grade)


def _judged(score: Callable[[str], float], model: Severity, texts: list[str]) -> tuple[list[float], list[int], list[bool]]:
    expected, grade, rejected = [], [], []
    for text in texts:
        above = model.above(score(text))
        expected.append(float(sum(above)))
        grade.append(sum(p > 0.5 for p in above))
        rejected.append(bool(above and above[model.toxic_grade - 1] > REJECT))
    return expected, grade, rejected


def score_severity(docs: DataFrame, model: Severity, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, expected_severity, severity, toxic) for every row of docs, without a shuffle.

    expected_severity is the mean grade, severity the number of thresholds that are passed with a probability over one half,
    toxic whether TOXIC_GRADE or more is more likely than REJECT. A null or empty text has no words and gets the
    base rate. Repeated rows each give a row; other columns play no part; an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            parts = [_judged(score, model, texts) for _, texts in text_slices(batch, "text")]
            columns = [[x for part in parts for x in part[k]] for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.bool_()), strict=True))], names=[id_column, "expected_severity", "severity", "toxic"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"`{id_column}` {kind}, expected_severity double, severity int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Severity, text_column: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            rejected = [r for _, texts in text_slices(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])) for r in _judged(score, model, texts)[2]]
            yield batch.filter(pc.invert(pa.array(rejected, pa.bool_())))

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType, True) for f in docs.schema]))


def grade_of(toxic: Column, quality: Column) -> Column:
    """Ordered grades from 0/1 labels: 0 harmless, 1 harmless but of low quality, 2 toxic; null without a toxic label."""
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 0), 1).when(toxic == 0, 0)
