"""Toxicity from class-conditional Kneser-Ney models of words as strings of letters.

Two models of order ORDER, one of toxic and one of ordinary texts, share all their
backoff counts: below the highest order both use the continuation counts of the
pooled classes. So for a letter after its context the log-ratio of the models is
fixed by the two highest-order counts, and where an n-gram wasn't seen the backoff
cancels and the ratio of the backoff weights is left. A word's evidence is the sum
over its letters, and a text's is the mean over its words, both plain and of the
words whose evidence passes CUT; a logistic curve on a fold of its own turns these
into a score.

The models are fitted on a bounded sample of labelled rows; all texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_table, releasing, runs, stored

ORDER = 6
#: Bits of a letter's code: ORDER of them fit a 64-bit key.
BITS = 10
DISCOUNT = 0.75
#: Evidence, in nats, from which a word counts as toxic by itself.
CUT = 4.0
#: Labelled rows of each class that the models are counted on, and rows of either class for the logistic curve.
SAMPLE, CALIBRATION = 2500, 4000
RUN = 6 << 20
_PAD, _END = 1, 2


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, word of each): the n-gram that ends at each letter, and at the end, of each word, in BITS bits a letter.

    Code points up to 255 have codes of their own. All others share the codes above by
    their remainder: letters of one alphabet, which lie close together, differ, and two
    words of a large script are alike only where all their letters' remainders are.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = "\x01" * (ORDER - 1)
    code = np.frombuffer((pad + ("\x02" + pad).join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.where(code > 255, 256 + code % ((1 << BITS) - 256), code)
    key = np.zeros(len(code), np.uint64)
    for k in range(ORDER):
        key[k:] |= code[: len(code) - k] << np.uint64(BITS * k)
    real = code != _PAD
    owner = np.cumsum(code == _END) - (code == _END)
    return key[real], owner[real]


@dataclass
class Model:
    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)

    def word_evidence(self, words: list[str]) -> np.ndarray:
        keys, owner = letters(words)
        distinct, at = np.unique(keys, return_inverse=True)
        value = np.zeros(len(distinct))
        for table, ratio, shift in ((self.contexts, self.context_ratio, BITS), (self.grams, self.gram_ratio, 0)):
            if len(table):
                own = distinct >> np.uint64(shift)
                place = np.minimum(np.searchsorted(table, own), len(table) - 1)
                value = np.where(table[place] == own, ratio[place], value)
        return np.bincount(owner, value[at], len(words)) if len(words) else np.zeros(0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """(mean evidence, mean evidence of the words over CUT) for each text; zeros without words."""
        words = Words(texts, alnum_table())
        each = self.word_evidence(words.vocabulary.to_pylist())[words.codes] if len(words.codes) else np.zeros(0)
        rows, n = words.rows(), len(words.counts)
        count = np.maximum(words.counts, 1)
        return np.stack([np.bincount(rows, each, n) / count, np.bincount(rows, np.where(each > CUT, each, 0.0), n) / count], axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ np.array(self.weights), -40, 40)))


def _design(features: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(features)), np.clip(features[:, 0], -5, 5), np.log1p(50 * features[:, 1])], axis=1)


def fit_models(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float = DISCOUNT) -> Model:
    """The log-ratios from the counts of the highest order in both classes; keys are distinct and sorted."""
    n = len(keys)
    if not n:
        empty = np.zeros(0, np.uint64)
        return Model(empty, np.zeros(0), empty, np.zeros(0))
    shared = np.full(n, 1 / (1 << BITS))
    distinct = keys
    for order in range(1, ORDER):  # continuation counts: each longer n-gram counts once
        longer = distinct_suffixes(keys, order + 1)
        gram, follows = np.unique(longer & _mask(order), return_counts=True)
        context, first, kinds = np.unique(gram >> np.uint64(BITS), return_inverse=True, return_counts=True)
        total = np.bincount(first, follows)
        at = np.searchsorted(gram, distinct & _mask(order))
        ctx = first[at]
        shared = np.maximum(follows[at] - discount, 0) / total[ctx] + discount * kinds[ctx] / total[ctx] * shared
    context, ctx = np.unique(keys >> np.uint64(BITS), return_inverse=True)
    logs, back = [], []
    for count in (toxic, ordinary):
        total = np.bincount(ctx, count, len(context))
        kinds = np.bincount(ctx, count > 0, len(context))
        seen = total > 0
        weight = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        own = np.where(seen[ctx], np.maximum(count - discount, 0) / np.maximum(total, 1)[ctx], 0.0)
        logs.append(np.log(own + weight[ctx] * shared))
        back.append(np.log(weight))
    return Model(keys, (logs[0] - logs[1]).astype(np.float32), context, (back[0] - back[1]).astype(np.float32))


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << BITS * order) - 1)


def distinct_suffixes(keys: np.ndarray, order: int) -> np.ndarray:
    return np.unique(keys & _mask(order)) if order < ORDER else keys


def fit_curve(features: np.ndarray, toxic: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic weights by Newton's method, with a small ridge so that separable samples have an end."""
    x, w = _design(features), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (toxic - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, sample: int = SAMPLE, calibration: int = CALIBRATION, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Models from labelled rows outside fold `held_out`.

    Of the other three folds, two give up to `sample` rows of each class for the
    counts and one up to `calibration` rows for the curve, the first by a hash of the
    id. Rows without a label or id teach nothing; of an id's labels the largest counts.
    """
    spark = docs.sparkSession
    curve = max(f for f in range(4) if f != held_out)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic")).withColumn("_fold", fold(F.col("_id"))).where(F.col("_fold") != held_out)
    first = lambda df, n: df.orderBy(F.xxhash64("_id"), "_id").limit(n)
    some = first(known.where((F.col("_fold") != curve) & (F.col("_toxic") == 1)), sample)
    some = some.unionByName(first(known.where((F.col("_fold") != curve) & (F.col("_toxic") == 0)), sample))
    some = some.unionByName(first(known.where(F.col("_fold") == curve), calibration))
    # at most 2 * sample + calibration small rows, so the broadcast is bounded
    texts = stored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id").select("text", "_toxic", (F.col("_fold") == curve).alias("_curve")), "labelled")

    def count(batches):
        for batch in batches:
            for run in runs(batch, "text", RUN):
                words = Words(run.column("text"), alnum_table())
                toxic = np.asarray(run.column("_toxic"), np.int64)[words.rows()]
                n = len(words.vocabulary)
                one, zero = np.bincount(words.codes, toxic, n), np.bincount(words.codes, 1 - toxic, n)
                keys, owner = letters(words.vocabulary.to_pylist())
                distinct, at = np.unique(keys, return_inverse=True)
                if len(distinct):
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), *(pa.array(np.bincount(at, c[owner]).astype(np.int64)) for c in (one, zero))], ["key", "t", "o"])

    counted = texts.where(~F.col("_curve")).select("text", "_toxic").mapInArrow(count, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).toArrow()
    keys = np.asarray(counted["key"], np.int64).astype(np.uint64)
    order = np.argsort(keys)
    model = fit_models(keys[order], *(np.asarray(counted[c], np.float64)[order] for c in ("t", "o")))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            for run in runs(batch, "text", RUN):
                f = shared.value.features(run.column("text"))
                yield pa.RecordBatch.from_arrays([run.column("_toxic"), pa.array(f[:, 0]), pa.array(f[:, 1])], ["toxic", "a", "b"])

    got = texts.where("_curve").select("text", "_toxic").mapInArrow(measure, "toxic int, a double, b double").toArrow()  # at most `calibration` rows
    a, b, y = (np.asarray(got[c], np.float64) for c in ("a", "b", "toxic"))
    model.weights = fit_curve(np.stack([a, b], axis=1), y) if len(y) else (-2.0, 0.0, 2.0)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs, in one pass without a shuffle.

    The score lies between 0 and 1 and depends on the text alone. Null and empty
    texts are scored as texts without evidence. Repeated and null ids get a row
    each; other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches):
        for batch in batches:
            for run in runs(batch, "text", RUN):
                yield pa.RecordBatch.from_arrays([run.column("id"), pa.array(shared.value.score(shared.value.features(run.column("text"))))], ["id", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(releasing(rate), f"id {kind}, score double").withColumnRenamed("id", id_col)
