"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- and 4-grams, hashed into ``BUCKETS``; a linear
layer and a softmax give the language. Both are trained in numpy by stochastic gradient descent on a
bounded sample: at most ``per_language`` labelled training texts of each language, chosen by the hash of their id.
A part of them is left out of training to fit a temperature and the score below which a text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.llm.corpus import beside, identified, remainder
from sigscreen.llm.texts import LOWER, Chunk, chunks, giving_back
from sigscreen.runtime import cut_lineage

BUCKETS = 1 << 15
DIMS = 16
SIZES = (3, 4)
PER_LANGUAGE = 400         # bound of the training sample
REJECTED = 0.001           # share of right calibration texts that may fall below the threshold

# letters keep their byte, all else becomes a space, so that grams see where words begin and end
SEEN = np.full(256, 0x20, np.uint8)
SEEN[97:123] = LOWER[97:123]
SEEN[65:91] = LOWER[65:91]
SEEN[128:] = np.arange(128, 256)


def grams(part: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every gram of a chunk, and how many the texts up to each one have."""
    codes, rows = [], []
    n = len(part.offsets) - 1
    # a space before and after each text
    size = np.diff(part.offsets)
    start = part.offsets[:-1] + 2 * np.arange(n)
    data = np.full(len(part.data) + 2 * n, 0x20, np.uint8)
    place = np.arange(len(part.data)) + np.repeat(2 * np.arange(n) + 1, size)
    data[place] = SEEN[part.data]
    wide = data.astype(np.uint32)
    for k in SIZES:
        code = np.zeros(max(0, len(wide) - k + 1), np.uint32)
        for j in range(k):
            code = code << np.uint32(8) | wide[j:j + len(code)]
        bucket = ((code * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17)).astype(np.int32)
        codes.append(bucket)
        begin = np.minimum(start, len(code))         # a last text without letters may lie past the last gram
        rows.append(np.stack([begin, np.maximum(begin, np.minimum(start + size + 3 - k, len(code)))]))
    return codes, rows


def has_letter(part: Chunk, i: int) -> bool:
    raw = part.data[part.offsets[i]:part.offsets[i + 1]]
    low = raw | 0x20
    if bool(((low >= 97) & (low <= 122) & (raw < 128)).any()):
        return True
    return any(c.isalpha() for c in raw[raw >= 128].tobytes().decode("utf-8", "ignore"))


@dataclass
class Model:
    names: list[str]
    table: np.ndarray          # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    least: float               # scores below are rejected

    def logits(self, part: Chunk) -> np.ndarray:
        n = len(part.offsets) - 1
        total, count = np.zeros((n, len(self.names))), np.zeros(n)
        codes, rows = grams(part)
        for code, (lo, hi) in zip(codes, rows):
            count += hi - lo
            for c in range(len(self.names)):
                sums = np.zeros(len(code) + 1)
                np.cumsum(self.table[:, c][code], out=sums[1:], dtype=np.float64)
                total[:, c] += sums[hi] - sums[lo]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, part: Chunk) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(part) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(docs: DataFrame) -> DataFrame:
    """(lang, fit, buckets, weights): the bag of grams of each text, at most ``BUCKETS`` entries."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                codes, rows = grams(part)
                ids, weights = [], []
                for i in range(part.hi - part.lo):
                    own = np.concatenate([c[r[0, i]:r[1, i]] for c, r in zip(codes, rows)])
                    bucket, n = np.unique(own, return_counts=True)
                    ids.append(bucket)
                    weights.append(n / max(1, n.sum()))
                rows = [batch.column(j).slice(part.lo, part.hi - part.lo) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))],
                    ["lang", "fit", "buckets", "weights"])

    return docs.select("lang", "fit", "text").mapInArrow(
        giving_back(run), "lang string, fit boolean, buckets array<int>, weights array<float>")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 12, rate: float = 20.0, seed: int = 7) -> Model:
    """A model of the languages in rows (doc_id, text, lang) that are not held out; texts and langs that are null don't count.

    Only the sample reaches the driver, as bags of hashed grams: at most ``per_language`` texts of each language.
    """
    rows = docs.where((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # a language's least hashes lie below a share of the range that holds some four times as many rows as are wanted
    share = cut_lineage(hashed.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * per_language + 100) / F.count(F.lit(1))).alias("share")))
    below = hashed.join(share, "lang").where(F.col("hash").cast("double") <= F.lit(-2.0**63) + F.col("share") * F.lit(2.0**64))
    chosen = below.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    chosen = cut_lineage(chosen.select("doc_id", "lang", (F.pmod("at", F.lit(4)) != 0).alias("fit")).dropDuplicates(["doc_id"]))
    sample = beside(rows.drop("lang"), chosen, "doc_id", "inner")
    got = sorted(_bags(sample).collect(), key=lambda r: (r["lang"], len(r["buckets"]), r["buckets"]))
    got = [r for r in got if r["buckets"]]
    names = sorted({r["lang"] for r in got})
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (len(names), DIMS)).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    bags = [(np.array(r["buckets"]), np.array(r["weights"], np.float32), names.index(r["lang"]), r["fit"]) for r in got]
    fit = [b for b in bags if b[3]] or bags
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            ids, w, y, _ = fit[i]
            mean = w @ table[ids]
            grad = softmax(layer @ mean + bias)
            grad[y] -= 1
            back = grad @ layer
            layer -= 0.01 * step * np.outer(grad, mean)
            bias -= 0.001 * step * grad
            table[ids] -= step * np.outer(w, back)
    flat = table @ layer.T
    kept = [b for b in bags if not b[3]] or bags
    z = np.array([w @ flat[ids] + bias for ids, w, _, _ in kept], np.float64)
    y = np.array([b[2] for b in kept])
    at = np.arange(len(y))
    warm = min(np.geomspace(0.2, 5, 40), key=lambda t: -np.log(softmax(z / t)[at, y] + 1e-12).mean())
    p = softmax(z / warm)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    least = min(0.5, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return Model(names, np.ascontiguousarray(flat.astype(np.float32)), bias, float(warm), least)


def _told(model: Model, column: pa.Array):
    """(lo, hi, languages, scores) of each chunk of a column of texts."""
    for part in chunks(column):
        n = part.hi - part.lo
        known = np.array([bool(model.names) and has_letter(part, i) for i in range(n)])
        pred, score = np.full(n, "und", object), np.zeros(n)
        if known.any():
            best, p = model.predict(part)
            pred[known] = np.array(model.names, object)[best[known]]
            score[known] = p[known]
        yield part.lo, part.hi, pred, score


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, did, fp, held_out, lang_pred, score and rejected of each row of (doc_id, text[, lang]).

    Without a model one is trained on the rows themselves. lang_pred is a learned language, or und where
    the text is null or has no letter, or where nothing could be learned; und has score 0. rejected marks und and scores below the
    calibrated threshold. held_out follows the doc_id alone, and is false for a null one. Repeated rows get a row each. Other columns are left out.
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # buckets x languages floats
    names = ["doc_id", "did", "fp", "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            for lo, hi, pred, score in _told(sent.value, batch.column(3)):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(lo, hi - lo) for j in range(3)), pa.array(pred, pa.string()), pa.array(score)], names)

    out = identified(docs).select("doc_id", "did", "fp", "text").mapInArrow(
        giving_back(run), "doc_id long, did long, fp long, lang_pred string, score double")
    return out.select("doc_id", "did", "fp", (remainder() == 2).alias("held_out"), "lang_pred", "score",
                      ((F.col("lang_pred") == "und") | (F.col("score") < model.least)).alias("rejected"))


def recognized(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that ``identify`` does not reject. They pass by once and are not shuffled.

    Null, empty and letterless texts are rejected; repeated rows stay or go together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi, pred, score in _told(m, pc.cast(batch.column(at), pa.string())):
                yield batch.slice(lo, hi - lo).filter(pa.array((pred != "und") & (score >= m.least)))

    return docs.mapInArrow(giving_back(run), docs.schema)
