"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, small_batches

#: Hashed subwords, their lengths, and the size of an embedding.
BUCKETS, SUBWORDS, SIZE = 1 << 17, (3, 4, 5, 6), 8
#: Of so many words of a text one is in its bag, the most toxic ones; one at least.
SHARE = 50
#: Labelled rows that are learned from, of each label.
ROWS_EACH = 2000
#: Step of the embeddings in training.
RATE = 0.05
#: Words that a worker remembers.
REMEMBERED = 100_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of every word, its ends marked; the whole word is one of its subwords."""
    marked = [f"<{w}>" for w in vocabulary]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = ends[owner] - np.arange(len(code))  # characters from here to the word's end
    out, who = [], []
    step, bits = np.uint64(0x100000001B3), np.uint64(64 - (BUCKETS - 1).bit_length())
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SUBWORDS) + 1):
        h = h[: len(code) - n + 1] * step + code[n - 1 :] + np.uint64(1)
        if n in SUBWORDS:
            at = np.flatnonzero(left[: len(h)] >= n)
            out.append(((h[at] ^ h[at] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> bits)
            who.append(owner[at])
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * np.uint64(0x9E3779B97F4A7C15) ** (left.astype(np.uint64) % np.uint64(61)), out=sums[1:])
    out.append(((sums[ends] - sums[ends - sizes]) * np.uint64(0xD1342543DE82EF95)) >> bits)
    who.append(np.arange(len(marked)))
    return np.concatenate(out).astype(np.int64), np.concatenate(who)


def bag(logits: np.ndarray) -> np.ndarray:
    """Places of a text's most toxic words, one in SHARE, wherever they stand."""
    k = -(-len(logits) // SHARE)
    return np.argpartition(logits, -k)[-k:]


def figures(logits: np.ndarray) -> tuple[float, float]:
    """Of a text of one word at least: its most toxic word, and the mean over its bag, which tells how often toxic words come."""
    return float(logits.max()), float(logits[bag(logits)].mean(dtype=np.float64))


class Model:
    """score(bucket) is all that a linear softmax of averaged embeddings needs: the embedding's difference in logits. A text's score is a logistic of its two figures."""

    def __init__(self, logit: np.ndarray, slopes: tuple[float, float] = (1.0, 0.0), shift: float = 0.0):
        self.logit, self.slopes, self.shift = logit.astype(np.float32), slopes, shift

    def word_logits(self, vocabulary: list[str]) -> np.ndarray:
        bucket, word = subwords(vocabulary)
        n = np.bincount(word, minlength=len(vocabulary))
        return np.bincount(word, weights=self.logit[bucket], minlength=len(vocabulary)) / np.maximum(n, 1)

    def score(self, logits: np.ndarray) -> float:
        """Of a text, given its words' logits in order; no words: the least there is."""
        if not len(logits):
            return 0.0
        z = self.shift + sum(a * x for a, x in zip(self.slopes, figures(logits), strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[list[str]], labels: np.ndarray, rounds: int = 25, seed: int = 7) -> Model:
    """Embeddings, softmax weights and the choice of words are trained together.

    Each round takes the bag of every text under the model so far, its most toxic words (and
    for clean texts one more at random), averages the embeddings of its words' subwords, and
    takes a gradient step on the softmax loss, in the embeddings and in the weights. Embeddings start along the log-odds of their subwords.
    A fifth of the texts is kept aside to set slope and shift of the logistic score.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), (0.0, 0.0), 4.0 if len(texts) and labels.max() else -4.0)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    listed, parts, count = list(vocabulary), [], []
    for at in range(0, len(listed), 20_000):
        bucket, owner = subwords(listed[at : at + 20_000])
        parts.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        count.append(np.bincount(owner, minlength=len(listed[at : at + 20_000])))
    bucket, count = np.concatenate(parts), np.concatenate(count)
    first = np.concatenate(([0], np.cumsum(count)))
    del listed, parts
    ids = [np.array([vocabulary[w] for w in t], np.int32) for t in texts]
    aside = rng.permutation(len(texts)) % 5 == 0
    train = np.flatnonzero(~aside)

    def buckets_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[w]
        ends = np.cumsum(n)
        return bucket[np.arange(ends[-1]) + np.repeat(first[w] - (ends - n), n)], np.repeat(np.arange(len(w)), n)

    # log-odds that a text with the subword is toxic
    has = np.zeros((2, BUCKETS))
    for i in train:
        if len(ids[i]):
            has[int(labels[i]), np.unique(buckets_of(np.unique(ids[i]))[0])] += 1
    total = np.bincount(labels[train], minlength=2) + 1.0
    odds = np.log((has + 4 * (total / total.sum())[:, None]) / total[:, None])  # an unseen subword says nothing
    odds = odds[1] - odds[0]
    weights = rng.normal(0, 0.1, (SIZE, 2))
    weights[0] = -1, 1
    embed = rng.normal(0, 0.01, (BUCKETS, SIZE))
    embed[:, 0] = odds / 2
    seen_e, seen_w = np.full(BUCKETS, 1e-2), np.full(weights.shape, 1.0)

    def word_logits() -> np.ndarray:
        return np.add.reduceat((embed @ (weights[:, 1] - weights[:, 0])).astype(np.float32)[bucket], first[:-1]) / count

    for _ in range(rounds):
        logit = word_logits()
        chosen, truth = [], []
        for i in train:
            if len(ids[i]):
                own = logit[ids[i]]
                best = bag(own)
                for at in [best] + ([rng.integers(len(own), size=len(best))] if not labels[i] else []):
                    chosen.append(ids[i][at])
                    truth.append(labels[i])
        truth = np.array(truth)
        size = np.array([len(c) for c in chosen])
        w = np.concatenate(chosen)
        b, token = buckets_of(w)
        text = np.repeat(np.arange(len(chosen)), size)[token]
        share = 1 / (count[w][token] * size[text])
        mean = np.stack([np.bincount(text, weights=embed[b, d] * share, minlength=len(chosen)) for d in range(SIZE)], axis=1)
        out = mean @ weights
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(truth)), truth] -= 1
        p *= np.where(truth, 0.5 / max(1, truth.sum()), 0.5 / max(1, (1 - truth).sum()))[:, None] * 100
        back, step = p @ weights.T, mean.T @ p
        for d in range(SIZE):
            g = np.bincount(b, weights=back[text, d] * share, minlength=BUCKETS)
            seen_e += g * g / SIZE
            embed[:, d] -= RATE * g / np.sqrt(seen_e)
        seen_w += step * step
        weights -= 0.05 * step / np.sqrt(seen_w)
    model = Model(embed @ (weights[:, 1] - weights[:, 0]))
    logit = word_logits()
    held = [i for i in np.flatnonzero(aside) if len(ids[i])]
    if len({int(labels[i]) for i in held}) < 2:
        held = [i for i in range(len(ids)) if len(ids[i])]
    model.slopes, model.shift = _logistic(np.array([figures(logit[ids[i]]) for i in held]), labels[held])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 3000) -> tuple[tuple[float, float], float]:
    """Slopes and shift of a logistic fit of the two figures, with a light penalty; clean texts weigh seven tenths, since there are more of them."""
    m, s = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = (x - m) / s
    weight = np.where(y > 0, 0.3 / max(1, (y > 0).sum()), 0.7 / max(1, (y == 0).sum()))
    a, b = np.zeros(2), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-np.clip(z @ a + b, -30, 30))) - y) * weight
        a = np.maximum(a - (z.T @ e + 1e-3 * a), 0.0)  # neither figure speaks for a text being clean
        b -= float(e.sum())
    a = a / s
    return (float(a[0]), float(a[1])), float(b - a @ m)


def learn(docs: DataFrame, labels: DataFrame, learned_from, rows_each: int = ROWS_EACH) -> Model:
    """A model of the labelled rows for which the condition holds, at most `rows_each` of each label, chosen by a hash of doc_id. A document that is labelled twice, or stands twice in docs, is learned from twice; null ids and labels are passed over."""
    labels = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(learned_from)
    counts = labels.groupBy("toxic").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    share = F.floor(F.lit(float(rows_each)) / F.col("n") * F.lit(float(1 << 40)))
    chosen = labels.join(F.broadcast(counts), "toxic").filter(place < share).select("doc_id", "toxic", place.alias("place"))
    chosen = chosen.orderBy("place", "doc_id", "toxic").limit(2 * rows_each)  # so few that they can be broadcast
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id", "text").limit(2 * rows_each).select("text", "toxic").toLocalIterator()
    texts, truth = [], []
    for r in got:
        texts.append(words(r["text"]))
        truth.append(r["toxic"])
    return fit(texts, np.array(truth, np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score) for every row: the whole text is read, nothing else.

    Null text, or text without a word: 0. Null ids, repeated rows and further columns pass
    through in `row`; an empty table gives an empty result. Of a long text all words are scored,
    and its bag is larger in proportion. Nothing is shuffled.
    """
    small_batches(docs)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known: dict[str, float] = {}
        for b in batches:
            scores = []
            for i in range(0, len(b), 100):
                texts = [words(t) for t in b.column("text").slice(i, 100).to_pylist()]
                missing = list({w for t in texts for w in t if w not in known})
                if len(known) > REMEMBERED:
                    known.clear()
                    missing = list({w for t in texts for w in t})
                for at in range(0, len(missing), 50_000):
                    known.update(zip(missing[at : at + 50_000], model.word_logits(missing[at : at + 50_000]).tolist(), strict=True))
                scores += [model.score(np.array([known[w] for w in t])) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema["row"], T.StructField("score", T.DoubleType())]))
