"""Language identification by interpolated Kneser-Ney character language models.

Texts become sequences of 64 character classes; a model is the table of all 4-grams of the training texts, held as
arrays sorted by the 24-bit number of a 4-gram, with lower orders as continuation counts. The chosen language has the
lowest cross-entropy per character. A quarter of all rows, by a hash of the id, teach no counts: on them the score and the limit for rejection are calibrated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_slices

ORDER, BITS = 4, 6
UNKNOWN = "und"
#: Remainders of crc32(id) mod FOLDS whose rows are held out and on which figures are calibrated; the others teach counts.
FOLDS, HELD_OUT, CALIBRATES = 4, 2, 1
#: Robust standard deviations above a language's usual cross-entropy at which a text is rejected.
REJECT_SD = 8.0
#: Standard deviation over the median absolute deviation of a normal distribution.
MAD = 1.4826
#: Least standard deviations of a long text's cross-entropy and of what a short one adds, however alike the texts are that calibrate.
LEAST_SPREAD, LEAST_SHORT = 0.03, 0.75
#: 4-grams that a task gathers before it hands them on.
HELD = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1-26 a-z, 27-62 other letters by their number."""
    letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
    code = np.arange(0x110000)
    out = np.where(letters, 27 + code % 36, 0).astype(np.uint8)
    out[97:123] = np.arange(1, 27)
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram numbers of all texts and how many each text has.

    Lower-cased letters keep their class, runs of anything else are one boundary; before a text stand
    boundaries, and a text with letters ends with one. A text without letters has no 4-grams.
    """
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), "<u4")
    c = _classes()[raw].astype(np.uint32)
    keep = c != 0
    keep[1:] |= keep[:-1].copy()
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[keep]
    c = c[keep]
    sizes = np.bincount(owner, minlength=len(low))
    starts = np.cumsum(sizes) - sizes
    starts = starts[sizes > 0]
    number = c.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(c)
        shifted[back:] = c[:-back]
        for k in range(back):
            at = starts + k
            shifted[at[at < len(c)]] = 0
        number |= shifted << np.uint32(BITS * back)
    return number, sizes


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over every row of (lang, text): counted per task first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in text_slices(batch, "text"):
                by: dict[str, list[str]] = defaultdict(list)
                for k, text in enumerate(texts):
                    by[langs[start + k]].append(text)
                for lang, own in by.items():
                    held[lang].append(np.unique(grams(own)[0], return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [merged(held[lang])]
                        if len(held[lang][0][0]) > HELD:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    return rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Models of several languages over one sorted table of 4-grams.

    ``tables[k]`` has, for order k + 1, the sorted numbers of all k + 1-grams seen in any language, their
    natural-log probabilities per language, the sorted numbers of contexts and the log weight of the next lower order. An n-gram
    that no language has backs off to the next order. A table has at most 64 ** 4 rows, whatever the input.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        by_order = []
        for lang in self.langs:
            keys, n = counts[lang]
            order = np.argsort(keys)
            levels = [(keys[order].astype(np.int64), n[order].astype(np.float64))]
            for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
                levels.append(tuple(x.astype(t) for x, t in zip(np.unique(levels[-1][0] & ((1 << BITS * k) - 1), return_counts=True), (np.int64, np.float64), strict=True)))
            by_order.append(levels[::-1])
        for k in range(ORDER):
            keys = np.unique(np.concatenate([x[k][0] for x in by_order])) if by_order else np.zeros(0, np.int64)
            contexts = np.unique(keys >> BITS)
            logp = np.zeros((len(keys), len(self.langs)))
            logw = np.zeros((len(contexts), len(self.langs)))
            for j, levels in enumerate(by_order):
                own, n = levels[k]
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                context, at = np.unique(own >> BITS, return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                spot = np.searchsorted(contexts, context)
                logw[spot, j] = np.log(discount * kinds / total)
                direct = np.zeros(len(keys))
                direct[np.searchsorted(keys, own)] = np.maximum(n - discount, 0) / total[at]
                lower = np.exp(self._backed(keys & ((1 << BITS * k) - 1), k)[:, j]) if k else np.full(len(keys), 1 / (1 << BITS))
                weight = np.exp(logw[np.searchsorted(contexts, keys >> BITS), j])
                logp[:, j] = np.log(direct + weight * lower)
            self.tables.append((keys.astype(np.uint32), logp.astype(np.float32), contexts.astype(np.uint32), logw.astype(np.float32)))

    def _backed(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of n-grams of an order, per language."""
        if not order:
            return np.full((len(keys), len(self.langs)), -np.log(1 << BITS), np.float32)
        own, logp, contexts, logw = self.tables[order - 1]
        keys = keys.astype(np.uint32)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        out = logp[at]
        if len(missing := np.flatnonzero(own[at] != keys)):
            gone = keys[missing]
            spot = np.minimum(np.searchsorted(contexts, gone >> np.uint32(BITS)), len(contexts) - 1)
            weight = np.where((contexts[spot] == gone >> np.uint32(BITS))[:, None], logw[spot], 0)
            out[missing] = weight + self._backed(gone & np.uint32((1 << BITS * (order - 1)) - 1), order - 1)
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and characters of each text; 0 without letters."""
        number, sizes = grams(texts)
        out = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(sizes)
        if len(some) and self.langs:
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = -np.add.reduceat(self._backed(number, ORDER), starts, axis=0, dtype=np.float64) / sizes[some][:, None]
        return out, sizes


def fit_languages(training: DataFrame) -> KneserNey:
    """Models of every language in (lang, text), from the 4-gram counts of all rows; rows with a null lang or text teach nothing.

    The counts are made by Spark; the table of them, which every worker needs, comes to the driver in columns of 16 bytes a row, and has
    at most 64 ** 4 rows a language.
    """
    rows = training.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    table = gram_counts(rows).toArrow()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    lang = pa.chunked_array(lang).combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    code, gram, n = (np.asarray(x) for x in (lang.indices, table.column("gram").combine_chunks(), table.column("n").combine_chunks()))
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(lang.dictionary) + 1))
    return KneserNey({name: (gram[order[a:b]], n[order[a:b]]) for name, a, b in zip(lang.dictionary.to_pylist(), bounds[:-1], bounds[1:], strict=True)})


def _scored(docs: DataFrame, model: KneserNey, id_column: str, text_column: str, carried: list[str]) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.cross_entropies(texts) for _, texts in text_slices(batch, "text", 250_000)]
            ce, sizes = np.concatenate([p[0] for p in parts] or [np.zeros((0, len(model.langs)))]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
            ranked = np.sort(ce, axis=1)
            pred = [model.langs[k] if n else UNKNOWN for k, n in zip(ce.argmin(axis=1).tolist(), sizes.tolist(), strict=True)] if model.langs else [UNKNOWN] * len(sizes)
            least = ranked[:, 0] if model.langs else np.zeros(len(sizes))
            margin = ranked[:, 1] - ranked[:, 0] if len(model.langs) > 1 else np.where(sizes > 0, 1.0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in carried), pa.array(pred, pa.string()), pa.array(sizes.astype(np.int64)), pa.array(least), pa.array(margin)], names=[id_column, *carried, "pred", "n", "ce", "margin"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"), *carried).mapInArrow(run, f"`{id_column}` {kind}{extra}, pred string, n long, ce double, margin double")


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) and the ``carried`` columns for every row of docs.

    Rows teach if crc32(id as text) mod 4 is not 2 and their id, lang and text are not null; rows where it is 2 are held out
    (a null id is not held out and does not teach). Of the teaching rows those of remainder 1 teach no counts, unless their language
    has no other: on them the figures are calibrated. lang_pred is the language of the lowest cross-entropy per character, the first by name
    at a tie; ``und`` if the text is null or has no letter, or nothing was learned. score is how often calibrating rows with
    a margin like that (in characters' worth of evidence) are right, in bins over all calibrating rows,
    never falling as the margin grows, times 1 / (1 + x^4), x being the text's cross-entropy above the usual one as a share of the limit: at the limit the score is halved, so foreign texts and noise
    stay below 0.5 however clearly one language is the least bad; 0 for ``und``. rejected holds for ``und``, and for a cross-entropy beyond its language's limit (see ``reject_limits``).

    Repeated rows teach and answer each time; very long texts take time in proportion; columns other than
    the three play no part; an empty table gives no rows.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"), *carried)
    fold = F.crc32(F.col("id").cast("string")) % FOLDS
    own = own.withColumn("held_out", F.coalesce(fold == HELD_OUT, F.lit(False)))
    teaches = ~F.col("held_out") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    taught = own.where(teaches).select("lang", "text", (fold == CALIBRATES).alias("calibrates"))
    lonely = taught.groupBy("lang").agg(F.min("calibrates").alias("lonely")).where("lonely").select("lang", "lonely")
    model = fit_languages(taught.join(F.broadcast(lonely), "lang", "left").where("not calibrates or lonely"))
    rows = checkpointed(_scored(own.withColumn("truth", F.when(teaches & (fold == CALIBRATES), F.col("lang"))), model, "id", "text", ["held_out", "truth", *carried]))

    evidence = F.floor(F.least(F.lit(31.0), 4 * F.log2(1 + F.col("margin") * F.col("n")))).cast("int")
    rows = rows.withColumn("bin", evidence)
    known = rows.where("truth is not null and n > 0")
    bins = {r.bin: (r.n, r.hits) for r in known.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("hits")).collect()}  # 32 at most
    score = F.lit(0.0)
    if bins:
        rates = _rising([(bins.get(b, (0, 0))[0], bins.get(b, (0, 0))[1]) for b in range(32)])
        score = F.element_at(F.array(*map(F.lit, rates)), F.col("bin") + 1)
    limits = reject_limits(known.where("truth = pred").select("pred", "n", "ce"))
    # how far a text's cross-entropy is above its language's usual one, as a share of what is let through
    excess = (F.col("ce") - F.coalesce("usual", "usual_of_all")) / (REJECT_SD * (F.col("spread") + F.col("short_spread") / F.sqrt(F.greatest("n", F.lit(1)))))
    beyond = excess > 1
    near = F.coalesce(1 / (1 + F.pow(F.greatest(excess, F.lit(0.0)), F.lit(4))), F.lit(1.0))
    return rows.join(F.broadcast(limits), "pred", "left").select(  # one row a language of the model
        F.col("id").alias(id_column),
        "held_out",
        F.col("pred").alias("lang_pred"),
        F.when(F.col("pred") == UNKNOWN, 0.0).otherwise(score * near).alias("score"),
        ((F.col("pred") == UNKNOWN) | F.coalesce(beyond, F.lit(False))).alias("rejected"),
        *carried,
    )


def reject_limits(known: DataFrame) -> DataFrame:
    """(pred, usual, usual_of_all, spread, short_spread): what is usual among calibrating rows (pred, n, ce) of a language.

    usual is the language's median cross-entropy. Deviations from it are pooled over all languages: spread is the robust standard deviation of a
    long text, from those with the median length or more, and short_spread that of sqrt(n) times the deviation, which shorter texts
    add, neither less than LEAST_SPREAD and LEAST_SHORT. So every language and length has a limit, and rows that carry a wrong label move it little.
    Copies, which have equal figures, count once, so that a group of them does not make its own text the only usual one.
    """
    known = known.distinct()
    half = lambda x: F.percentile_approx(x, 0.5, 10_000)
    each = known.groupBy("pred").agg(half("ce").alias("usual"))
    size = known.agg(half("n").alias("middle"))
    apart = known.join(F.broadcast(each), "pred").crossJoin(F.broadcast(size)).withColumn("apart", F.abs(F.col("ce") - F.col("usual")))  # one row
    least = lambda x, floor: F.greatest(MAD * half(x), F.lit(floor))
    spread, short = least(F.when(F.col("n") >= F.col("middle"), F.col("apart")), LEAST_SPREAD), least(F.col("apart") * F.sqrt("n"), LEAST_SHORT)
    pooled = apart.agg(spread.alias("spread"), short.alias("short_spread"), half("ce").alias("usual_of_all"))
    return each.crossJoin(F.broadcast(pooled))


def _rising(bins: list[tuple[int, int]]) -> list[float]:
    """Shares of hits per bin, pooled with neighbours until they never fall; empty bins take the one before."""
    pools: list[list[float]] = []
    for n, hits in bins:
        pools.append([n + 1e-9, hits + 0.5e-9, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] > pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    rates = [p[1] / p[0] for p in pools for _ in range(int(p[2]))]
    return [float(min(1.0, max(0.0, r))) for r in rates]
