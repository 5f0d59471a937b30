"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, small_batches

#: Hashed trigram features.
FEATURES = 1 << 13
#: Labelled rows that are learned from, for each language and in all; but so many of each language at least.
ROWS_EACH, ROWS, LEAST_EACH = 300, 2400, 5
NONE = "und"
#: Two-letter language codes by family. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr pa gu ne",
    "semitic": "ar he mt am",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower()[:2] in codes.split()), lang)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(texts: list[str | None], size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, whether each has a letter, a feature for every place, where each text's places begin), for some texts at a time.

    Letters are lowered and every other character is a space; a place's feature is the
    trigram that starts there, and a text has a space before and two after it.
    """
    at = 0
    while at < len(texts):
        to, total, low = at, 0, []
        while to < len(texts) and (to == at or total < size):
            low.append(f" {(texts[to] or '').lower()}  ")
            total += len(low[-1])
            to += 1
        edges = np.cumsum([0, *map(len, low)])
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
        h = code * np.uint64(0x9E3779B1)
        h[:-1] += code[1:] * np.uint64(0x85EBCA77C2B2AE63)
        h[:-2] += code[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield at, np.add.reduceat(letter.astype(np.int32), edges[:-1]) > 0, (h >> np.uint64(64 - (FEATURES - 1).bit_length())).astype(np.int32), edges
        at = to


def histogram(text: str | None) -> np.ndarray | None:
    """Relative frequencies of a text's features; None without a letter."""
    _, some, h, _ = next(features([text]))
    return (np.bincount(h, minlength=FEATURES) / len(h)).astype(np.float32) if some[0] else None


def train_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine: hinge loss, both classes weighted alike, by subgradient steps with momentum. y: 1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for k in range(steps):
        out = x @ w + b
        g = np.where(out * y < 1, -y * weight, 0).astype(np.float32)
        rate = 4.0 / (1 + k / 30)
        vw = 0.9 * vw - rate * (g @ x + penalty * w)
        vb = 0.9 * vb - rate * float(g.sum()) * 0.1
        w, b = w + vw, b + vb
    return w, b


@dataclass
class Model:
    """weights[:, k], bias[k]: one family against the rest for each family, then one language against another for each pair."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> Model:
        """x: relative frequencies, one row for each text. Where x can be written it is scaled in place: it is the largest thing in the driver."""
        if not len(x):
            return cls()
        scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
        norm = float(np.sqrt(np.concatenate([((x[at : at + 64] * scale) ** 2).sum(axis=1) for at in range(0, len(x), 64)]).mean()))
        scale = (scale / norm).astype(np.float32)
        x = np.multiply(x, scale, out=x if x.flags.writeable else None)
        lang = np.array(lang)
        kin = np.array([family(v) for v in lang])
        families = sorted(set(kin))
        languages = {f: sorted(set(lang[kin == f])) for f in families}
        pairs = [p for f in families for p in combinations(languages[f], 2)]
        machines = [train_svm(x, np.where(kin == f, 1, -1)) if len(families) > 1 else (np.zeros(FEATURES), 1.0) for f in families]
        for a, b in pairs:
            own = np.flatnonzero((lang == a) | (lang == b))
            machines.append(train_svm(x[own], np.where(lang[own] == a, 1, -1)))
        return cls(families, languages, pairs, np.stack([w * scale for w, _ in machines], axis=1).astype(np.float32), np.array([b for _, b in machines]))

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        """margins: of all machines. The family of the largest margin; in it the language of most wins, then of the largest sum of margins. The score is the logistic family margin times that of the closest win."""
        k = len(self.families)
        best = int(margins[:k].argmax())
        f = self.families[best]
        sure = 1 / (1 + np.exp(-2 * margins[best]))
        wins = dict.fromkeys(self.languages[f], (0, 0.0))
        closest = dict.fromkeys(self.languages[f], np.inf)
        for (a, b), m in zip(self.pairs, margins[k:], strict=True):
            if a in wins:
                for v, s in ((a, m), (b, -m)):
                    wins[v] = wins[v][0] + (s > 0), wins[v][1] + s
                    closest[v] = min(closest[v], s)
        lang = max(wins, key=lambda v: (wins[v], v))
        if np.isfinite(closest[lang]):
            sure *= 1 / (1 + np.exp(-2 * closest[lang]))
        return lang, float(sure)


def learn(docs: DataFrame, learned_from, rows_each: int = ROWS_EACH, rows: int = ROWS) -> Model:
    """A model of the rows with a language for which the condition holds; about `rows_each` of each language and at most `rows` in all, chosen by a hash of doc_id.

    Every language is learned: where there are many, `rows` is shared out among them, and
    exceeded from where that would leave less than LEAST_EACH for each. Counts of languages
    decide how large a share of each is wanted, so no language's rows are gathered or
    ordered as a whole. Rows come in order of their place within their language's share, so
    that the bound in all cuts a little of each frequent language, and no rare one.
    """
    known = docs.filter(learned_from & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # null ids share no place: their texts are hashed
    known = known.withColumn("place", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 40)))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("low")).collect()  # one row a language, as the model has
    each = max(LEAST_EACH, min(rows_each, rows // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame(counts, "lang string, n long, low long")
    share = F.floor(F.lit(float(each)) / F.col("n") * F.lit(float(1 << 40)))
    some = known.join(F.broadcast(shares), "lang").filter((F.col("place") < share) | (F.col("place") == F.col("low")))
    chosen = some.orderBy(F.col("place") != F.col("low"), F.col("place") * F.col("n").cast("double"), "doc_id").limit(max(rows, each * len(counts)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (h := histogram(text)) is not None:
                    at = np.flatnonzero(h).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tobytes()]), pa.array([h[at].tobytes()])], names=["lang", "at", "x"])

    # only what is not zero goes to the driver, in whose JVM rows are held several times over
    got = chosen.select("lang", "text").mapInArrow(count, "lang string, at binary, x binary").collect()
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    langs = [r["lang"] for r in got]
    del got
    model = Model.fit(x, langs)
    del x
    release()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score) for every row: the whole text is read, nothing else.

    Null text, or text without a letter, or a model without languages: `und`, score 0. Null
    ids, repeated rows and further columns pass through in `row`; an empty table gives an
    empty result. A long text is one histogram like any other. Nothing is shuffled.
    """
    small_batches(docs)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weights = [np.ascontiguousarray(model.weights[:, k]) for k in range(len(model.bias))]
        for b in batches:
            langs, scores = [NONE] * len(b), np.zeros(len(b))
            for i in range(0, len(b) if model.families else 0, 500):
                texts = b.column("text").slice(i, 500).to_pylist()
                for first, some, h, edges in features(texts):
                    sums = np.stack([np.add.reduceat(w[h], edges[:-1]) for w in weights], axis=1)
                    margins = sums / np.diff(edges)[:, None] + model.bias
                    for r in np.flatnonzero(some):
                        langs[i + first + r], scores[i + first + r] = model.predict(margins[r])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(langs), pa.array(scores)], names=["row", "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([docs.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
