"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm.common import _BYTE, _LOWER, SPACE, chunks, mix, table, word_spans

#: Bound of the fit: at most so many labelled documents of each class, of at most so many characters each and so many
#: together; the driver holds their n-gram buckets (two bytes each, about three a character), not their texts.
SAMPLE, SAMPLE_CHARS, CLASS_CHARS = 1500, 20_000, 12_000_000
BUCKETS = 1 << 16
DIM = 8
#: Lengths of n-grams.
SIZES = (3, 4, 5)
#: Rounds of picking words, Adam steps in each, their rate, and the embeddings' decay.
ROUNDS, STEPS, RATE, DECAY = 5, 20, 0.03, 1e-7
#: Words of a document that a round learns from, and that its score averages.
WORST, POOL = 3, 2


def ngram_buckets(offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte place, bucket) of the character n-grams of all words, each word with one blank before and after; A-Z as a-z."""
    space = SPACE[body]
    n = len(body)
    text = np.where(space, np.uint8(32), _LOWER[body])
    edge = np.zeros(n, np.int64)
    inner = offsets[1:-1]
    np.add.at(edge, inner[inner < n], 1)
    row = np.cumsum(edge)
    codes = _BYTE[text]
    places, buckets = [], []
    run = np.cumsum(space)
    for size in SIZES:
        if n < size:
            continue
        m = n - size + 1
        h = np.zeros(m, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + m]
        # no blank strictly inside, and one row
        blanks = run[size - 2 : size - 2 + m] - run[:m]
        ok = (blanks == 0) & (row[:m] == row[size - 1 : size - 1 + m]) & ~(space[:m] & space[1 : 1 + m])
        places.append(np.flatnonzero(ok))
        buckets.append((mix(h[ok]) >> np.uint64(48)).astype(np.int64))
    return (np.concatenate(places), np.concatenate(buckets)) if places else (np.empty(0, np.int64),) * 2


def word_bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: words per row, n-grams per word, and the n-grams' buckets in order of words. A word counts if it has n-grams."""
    for _, offsets, body in chunks(column):
        starts, _, n = word_spans(offsets, body)
        place, bucket = ngram_buckets(offsets, body)
        word = np.searchsorted(starts, place + SPACE[body[place]], "right") - 1 if len(place) else place
        order = np.argsort(word, kind="stable")
        per_word = np.bincount(word, minlength=len(starts))
        row = np.repeat(np.arange(len(n)), n)[per_word > 0]
        yield np.bincount(row, minlength=len(n)), per_word[per_word > 0], bucket[order].astype(np.uint16)


def spans(values: np.ndarray, sizes: np.ndarray, op: np.ufunc = np.add) -> np.ndarray:
    return op.reduceat(values, np.concatenate(([0], np.cumsum(sizes)[:-1]))) if len(sizes) else np.empty(0, values.dtype)


def spans_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs; a run of no values sums to 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


class Model:
    """Bucket embeddings and a softmax over the average of a word's; a document's score is that of its worst words."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds to the difference of the two logits, times the bag's size."""
        return (self.embed @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def fit(self, words: np.ndarray, grams: np.ndarray, buckets: np.ndarray, labels: np.ndarray) -> None:
        """Alternates between picking each document's worst words and Adam steps on them, embeddings and softmax jointly.

        words: per document; grams: per word; buckets: per n-gram. The first pick is by the buckets' log odds.
        """
        word_doc = np.repeat(np.arange(len(words)), words)
        toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
        end = np.cumsum(np.concatenate(([0], spans_of(grams, words))))
        for k, y in enumerate(labels.tolist()):
            (toxic if y else clean)[np.unique(buckets[end[k] : end[k + 1]])] += 1
        score = np.log((toxic + 1) / (labels.sum() + 2)) - np.log((clean + 1) / ((1 - labels).sum() + 2))
        score = score.astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(grams)[:-1]))
        m, v, t = [0.0] * 3, [0.0] * 3, 0
        for _ in range(ROUNDS):
            value = word_scores(score, grams, buckets)
            order = np.lexsort((-value, word_doc))
            rank = np.arange(len(order)) - np.repeat(np.concatenate(([0], np.cumsum(words)[:-1])), words)
            pick = np.sort(order[rank < WORST])
            n, y = grams[pick], labels[word_doc[pick]]
            at = np.repeat(starts[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            used, bag = np.unique(buckets[at], return_inverse=True)
            bag_of = np.repeat(np.arange(len(n)), n)
            per_doc = np.bincount(word_doc[pick])[word_doc[pick]]
            share = max(labels.mean(), 1e-3)
            cost = (np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3)) / per_doc / len(labels)).astype(np.float32)
            by = np.argsort(bag, kind="stable")
            cuts = np.searchsorted(bag[by], np.arange(len(used)))
            for _ in range(STEPS):
                t += 1
                e = self.embed[used]
                mean = np.stack([spans(e[:, d][bag], n) for d in range(DIM)], 1) / n[:, None]
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                g = (p * cost[:, None]).astype(np.float32)
                back = g @ self.out.T / n[:, None]
                ge = np.zeros_like(self.embed)
                ge[used] = np.stack([np.add.reduceat(back[:, d][bag_of][by], cuts) for d in range(DIM)], 1) + DECAY * e
                for k, (x, gr) in enumerate(((self.embed, ge), (self.out, mean.T @ g), (self.bias, g.sum(0)))):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.99 * v[k] + 0.01 * gr * gr
                    x -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
            score = self.bucket_scores()


def word_scores(score: np.ndarray, grams: np.ndarray, buckets: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """The mean of each word's buckets' scores, some words after the other, as n-grams are many times the words."""
    ends = np.concatenate(([0], np.cumsum(grams)))
    parts = [slice(k, k + at_once) for k in range(0, len(grams), at_once)]
    found = [spans(score[buckets[ends[p.start] : ends[min(p.stop, len(grams))]]], grams[p]) / grams[p] for p in parts]
    return np.concatenate(found) if found else np.zeros(0)


def word_values(scores: np.ndarray, words: np.ndarray, grams: np.ndarray, buckets: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each document: the mean of its POOL highest words' logits; 0 words give the bias."""
    out = np.full(len(words), bias, np.float64)
    if len(grams):
        value = spans(scores[buckets], grams) / grams
        doc = np.repeat(np.arange(len(words)), words)
        full = words > 0
        top = np.zeros(len(words))
        for k in range(POOL):
            best = np.full(len(words), -np.inf)
            best[full] = spans(value, words[full], np.maximum)
            top += np.where(np.isfinite(best), best, top / max(k, 1))
            hit = np.flatnonzero(value == best[doc])
            value[hit[np.unique(doc[hit], return_index=True)[1]]] = -np.inf
        out[full] += top[full] / POOL
    return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """(bucket scores, bias) learned from rows that are not held out; None if they do not show both classes.

    The sample is the documents of least hash of each class, so reruns agree; it is bounded by SAMPLE, SAMPLE_CHARS and
    CLASS_CHARS. An id that is labelled twice counts as toxic if one of its labels does; of texts that share an id the
    one of least hash is learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fits = F.length("text").between(1, SAMPLE_CHARS)
    sized = docs.where(fits & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.length("text")).alias("chars"))
    parts = [own.where(f"toxic = {y}").join(sized, "label_id").orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE) for y in (0, 1)]
    so_far = F.sum("chars").over(W.partitionBy("toxic").orderBy(F.xxhash64("label_id"), "label_id"))
    sample = parts[0].union(parts[1]).withColumn("so_far", so_far).where(F.col("so_far") <= CLASS_CHARS).select("label_id", "toxic")
    rows = docs.select(F.col("doc_id").alias("label_id"), "text").where(fits).join(F.broadcast(sample), "label_id")  # SAMPLE rows a class at most
    rows = rows.groupBy("label_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("label_id", "toxic", F.col("t.text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, grams, buckets in word_bags(batch.column("text")):
                ends = np.cumsum(spans_of(grams, words))
                firsts = np.concatenate(([0], np.cumsum(words)))
                cells = np.concatenate(([0], ends))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label_id").slice(at, len(words)), batch.column("toxic").slice(at, len(words)), pa.array([grams[firsts[k] : firsts[k + 1]].astype(np.uint32).tobytes() for k in range(len(words))], pa.binary()), pa.array([buckets[cells[k] : cells[k + 1]].tobytes() for k in range(len(words))], pa.binary())],
                    ["label_id", "toxic", "grams", "buckets"],
                )
                at += len(words)

    got = rows.mapInArrow(bags, "label_id long, toxic int, grams binary, buckets binary").toArrow()
    got = got.sort_by([("label_id", "ascending"), ("buckets", "ascending")])
    y = got.column("toxic").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    grams = [np.frombuffer(x, np.uint32).astype(np.int64) for x in got.column("grams").to_pylist()]
    buckets = np.frombuffer(b"".join(got.column("buckets").to_pylist()), np.uint16)
    del got
    model = Model()
    model.fit(np.array([len(x) for x in grams]), np.concatenate(grams), buckets, y)
    del grams, buckets
    pa.default_memory_pool().release_unused()
    return model.bucket_scores(), float(model.bias[1] - model.bias[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    A word's vector is the average of its character n-grams' vectors, so unseen spellings share vectors; a linear softmax
    over it is trained jointly with them. A document's score is that of its POOL worst words. Null and empty texts get
    the bias alone; without both classes among the labels all scores are 0. Repeated rows each give a row; an empty table
    gives none; labels, lang and source are no inputs of a score, and other columns are not read.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [word_values(model[0], *bag, model[1]) for bag in word_bags(batch.column("text"))] if model else []
            z = np.concatenate(z) if z else np.full(batch.num_rows, -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
