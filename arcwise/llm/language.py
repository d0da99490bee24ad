"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; digits count as one character and other ASCII non-letters as a space.
Character n-grams of lengths 1 to 3 are hashed to ``dims`` places, weighted by log term
frequency and inverse document frequency and scaled to unit length. Document frequencies cover
all training rows; they are sums per place. The weights are fitted on the driver with
follow-the-regularised-leader (elastic net: l1, l2) on a sample of at most ``sample`` labelled
rows, the ones with the least hash of their id. A fifth of the sample is left out of that and
sets the temperature by which scores are divided before the softmax.

Null text or text without a letter gives ``und`` with score 0. Empty tables give an empty result;
without training rows every text is ``und``. Rows with null language are not learned from.
Repeated rows are predicted alike. Ties go to the language that sorts first. Extra columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from arcwise.llm.blocks import U64, chunks, mix, text_bytes
from arcwise.llm.shared import in_batches, least_hashed, prepared

DIMS = 1 << 14
SAMPLE = 1500
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_FOLD[48:58] = 48


def grams(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): hashed n-grams of the texts, one after the other; places has a row for each length 1, 2 and 3, and dims where a text ends first."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    small = code < 128
    code[small] = _FOLD[code[small]]
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=at[1:])
    edge = np.ones(len(code) + 2, bool)
    edge[: len(code)] = False
    edge[at[:-1]] = True
    c = code.astype(U64)
    out = np.full((3, len(code)), dims, np.int32)
    h = np.zeros(len(code) + 2, U64)
    h[: len(code)] = mix(c)
    out[0] = h[: len(code)] & U64(dims - 1)
    two = h[:-2] * U64(3) ^ h[1:-1] * U64(0x9E3779B97F4A7C15)
    out[1] = np.where(edge[1:-1], U64(dims), mix(two) & U64(dims - 1))
    three = two * U64(5) ^ h[2:] * U64(0xC2B2AE3D27D4EB4F)
    out[2] = np.where(edge[1:-1] | edge[2:], U64(dims), mix(three) & U64(dims - 1))
    return out, at


def counts(texts: list[str], dims: int):
    """For each text, how often each place occurs, as an array of length dims."""
    places, at = grams(texts, dims)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.bincount(places[:, a:b].ravel(), minlength=dims + 1)[:dims]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x dims, for log term frequencies: IDF is multiplied in
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text, n in zip(texts, counts([t or "" for t in texts], len(self.idf)), strict=True):
            if not self.languages or not text or not _LETTER.search(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            place = np.flatnonzero(n)
            x = (1 + np.log(n[place])) * self.idf[place]
            z = (self.weights[:, place] @ (x / max(np.sqrt(x @ x), 1e-12)) + self.bias) / self.temperature
            p = np.exp(z - z.max())
            best = int(z.argmax())
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def fit_ftrl(rows, labels: np.ndarray, classes: int, dims: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, seed: int = 7):
    """Weights (classes x dims) and bias by FTRL-proximal on sparse rows [(place, value)]."""
    z, n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))
    order = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            place = np.append(rows[i][0], dims)
            x = np.append(rows[i][1], 0.1)
            zp, np_ = z[:, place], n[:, place]
            w = weights(zp, np_)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p[:, None] * x[None, :]
            more = np_ + g * g
            z[:, place] = zp + g - (np.sqrt(more) - np.sqrt(np_)) / alpha * w
            n[:, place] = more
    w = weights(z, n)
    return w[:, :dims], w[:, dims] * 0.1


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood on rows left out of the fit, within [0.05, 20].

    A row's own label counts as 1 - 1 / (rows + 2), so that rows without an error don't ask for certainty.
    """
    rows, classes = scores.shape
    if not rows or classes < 2:
        return 1.0
    slip = 1 / (rows + 2)
    want = np.full(scores.shape, slip / (classes - 1))
    want[np.arange(rows), labels] = 1 - slip

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-np.mean(np.sum(want * (s - np.log(np.exp(s).sum(axis=1, keepdims=True))), axis=1)))

    return min(np.geomspace(0.05, 20, 80), key=loss)


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = DIMS, sample: int = SAMPLE) -> Model:
    """Fits a model to the rows for which ``learn`` holds and the language is not null. ``sample`` bounds the rows that the
    weights are fitted to; document frequencies cover all of the rows.
    """
    prepared(docs.sparkSession)
    rows = docs.filter(learn & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def frequencies(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                for c in counts([x or "" for x in batch.column(0).slice(a, b - a).to_pylist()], dims):
                    total += c > 0
                    n += 1
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *place], pa.int32()), pa.array([n, *total[place]], pa.int64())], names=["place", "n"])

    df = {r["place"]: r["n"] for r in rows.select("text").transform(in_batches, frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}  # dims + 1 rows at most
    total = df.pop(-1, 0)
    seen = np.zeros(dims)
    seen[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    def sparse(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                got = [(p := np.flatnonzero(c), c[p]) for c in counts([x or "" for x in part.column(0).to_pylist()], dims)]
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<i4").tobytes() for p, _ in got], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in got], pa.binary()), part.column(1)], names=["place", "n", "lang"])

    chosen = least_hashed(rows, sample, "key").select("text", "lang")
    own = chosen.transform(in_batches, sparse, "place binary, n binary, lang string").collect()  # sample rows of dims places at most
    languages = sorted({r["lang"] for r in own})
    if not languages:
        return Model([], np.zeros((0, dims)), idf, np.zeros(0), 1.0)
    data, labels = [], np.array([languages.index(r["lang"]) for r in own])
    for r in own:
        place = np.frombuffer(r["place"], "<i4")
        x = (1 + np.log(np.frombuffer(r["n"], "<i4"))) * idf[place]
        data.append((place, x / max(np.sqrt(x @ x), 1e-12)))
    fit = [i for i in range(len(own)) if i % 5 or len(own) < 20]
    w, bias = fit_ftrl([data[i] for i in fit], labels[fit], len(languages), dims)
    rest = [i for i in range(len(own)) if i % 5 == 0 and len(own) >= 20]
    scores = np.array([w[:, data[i][0]] @ data[i][1] + bias for i in rest]).reshape(len(rest), len(languages))
    return Model(languages, w, idf, bias, calibrate(scores, labels[rest]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (calibrated probability of that language) to every row."""
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            names, scores = [], []
            _, offsets = text_bytes(batch.column(text))
            for a, b in chunks(offsets):
                n, s = sent.value.predict(batch.column(text).slice(a, b - a).to_pylist())
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).transform(in_batches, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 1 modulo 3. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))


def language_predictions(docs: DataFrame) -> DataFrame:
    model = train(docs, ~held_out())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
