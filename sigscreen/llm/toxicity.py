"""Toxic spans by a linear-chain conditional random field.

1. In a bounded sample (``SAMPLE``) of training texts, subword features (the word, its leading 3 to 8 bytes) of the toxic
   ones are counted over all labelled training texts, by label.
2. A word of a toxic text gets the expected toxic tag that its features have from the other texts, so that no bar
   on size or share decides; the words of clean texts are clean. On these token sequences a two-tag field is
   trained: hashed feature weights and tag transitions, by gradient from the forward-backward algorithm.
3. Every text gets the marginal of the toxic tag at each word. Words of marginal 0.5 or more form the spans;
   the marginals add up to the text's evidence, which a logistic curve fitted on the sample turns into the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigscreen.llm.corpus import beside, identified, remainder
from sigscreen.llm.texts import LOWER, SYMBOLS, U, Chunk, Poly, chunks, find_words, signed
from sigscreen.runtime import cut_lineage

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LEADS = (3, 4, 5, 6, 8)
KINDS = len(LEADS) + 1
BUCKETS = 1 << 18
SAMPLE = 500               # training texts of either label,
SAMPLE_BYTES = 4 << 20     # and their bytes together; texts of over an eighth of it are not drawn
PRIOR = -4.0               # log odds that a feature of a toxic text is a toxic one, before any count
TIMES = 4                  # a feature counts so often in a text at most
SEGMENT = 64               # words of a training sequence
COUNTED = 8 << 20          # bytes of text whose features are counted together
NOTED = 0.1                # marginals below do not add up in a score


def features(part: Chunk) -> tuple:
    """The words of a chunk, and (words x kinds) feature hashes."""
    words = find_words(part, WORD)
    poly = Poly(SYMBOLS[0][LOWER[part.data]])
    out = np.empty((len(words.starts), KINDS), U)
    out[:, 0] = poly.runs(words.starts, words.ends)
    for k, lead in enumerate(LEADS, 1):
        # a word shorter than the lead has no such feature; it repeats the word, marked by kind
        out[:, k] = poly.runs(words.starts, np.minimum(words.starts + lead, words.ends))
    return words, out + np.arange(KINDS, dtype=U) * U(0x9E3779B97F4A7C15)


def _counts(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(feature, toxic, times): how often each feature of the sorted ``wanted`` stands in texts, ``TIMES`` a text at most.

    toxic is the part in toxic texts. The row of a null feature has the words of all texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        wanted = sent.value
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for part in chunks(batch.column(1), COUNTED):
                words, feats = features(part)
                n = part.hi - part.lo
                doc = np.repeat(np.arange(n), np.diff(words.first))
                mine = signed(feats).ravel()
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == mine)
                pair, times = np.unique(at[hit] * n + doc[hit // KINDS], return_counts=True)
                values, doc_of = np.divmod(pair, n)
                times = np.minimum(times, TIMES)
                bad = label[part.lo:part.hi] == 1
                found, index = np.unique(values, return_inverse=True)
                toxic = np.bincount(index, weights=times * bad[doc_of], minlength=len(found))
                every = np.bincount(index, weights=times, minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*wanted[found].tolist(), None], pa.int64()),
                     pa.array(np.append(toxic, bad[doc].sum()).astype(np.int64)),
                     pa.array(np.append(every, len(doc)).astype(np.int64))], ["feature", "toxic", "times"])

    return docs.select("toxic", "text").mapInArrow(run, "feature long, toxic long, times long")


def _own(feats: np.ndarray) -> np.ndarray:
    """How often each feature of a text's words counts in it."""
    _, index, times = np.unique(feats, return_inverse=True, return_counts=True)
    return np.minimum(times, TIMES)[index].reshape(feats.shape)


def _expected(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """P(a word of a toxic text is toxic) by the times that its features stand in other toxic and in clean texts.

    A toxic feature has any toxic share from ``base`` to 1, each as likely; others have ``base``. Of what a toxic feature
    has in toxic texts, a part is there by chance as in clean ones. The strongest feature of a word counts.
    """
    share = base + (1 - base) * np.arange(1, 65) / 65
    pairs, index = np.unique(np.stack([toxic.ravel(), clean.ravel()], axis=1), axis=0, return_inverse=True)
    fit = pairs[:, :1] * np.log(share / base) + pairs[:, 1:] * np.log((1 - share) / (1 - base))
    top = fit.max(axis=1)
    odds = PRIOR + top + np.log(np.exp(fit - top[:, None]).mean(axis=1))
    by_chance = (pairs[:, 1] + 0.5) / (pairs[:, 0] + 0.5) * base / (1 - base)
    p = np.clip(1 - by_chance, 0, 1) / (1 + np.exp(-np.clip(odds, -50, 50)))
    return np.minimum(p[index.ravel()].reshape(toxic.shape).max(axis=1), 0.999)


@dataclass
class Field:
    """weights: score of the toxic tag by feature bucket; start and step: log scores of tags.

    scale and shift turn a text's evidence into the log odds that it is toxic.
    """
    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[bucket(feats)].sum(axis=1) + self.bias

    def marginals(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each word, texts running from first[i] to first[i + 1], by forward-backward over 2 x 2 steps.

        The texts stand one after another: the step into a text's first word forgets what came
        before. Products of steps are taken along many blocks at once, then carried from block to block.
        """
        n = len(score)
        if not n:
            return np.zeros(0)
        e = np.stack([np.ones(n), np.exp(np.clip(score, -60, 60))], axis=1)
        e /= e.sum(axis=1, keepdims=True)
        f = np.exp(self.step)[None] * e[:, None, :]
        heads = first[:-1][np.diff(first) > 0]
        f[heads] = (np.exp(self.start) * e[heads])[:, None, :]
        ahead = _scan(f, np.array([0.5, 0.5]))
        # backward: b[t] = f[t + 1] b[t + 1], the same scan over transposed steps in reverse
        g = np.ascontiguousarray(f[::-1].transpose(0, 2, 1))
        back = np.ones((n, 2))
        back[:-1] = _scan(g, np.array([0.5, 0.5]))[::-1][1:]
        p = ahead * back
        return p[:, 1] / p.sum(axis=1)


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of -log(1 - p) over a text's marginals of at least ``NOTED``, else that of its highest; 0 without words."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    noted = p >= NOTED
    total = np.bincount(doc[noted], weights=-np.log1p(-np.minimum(p[noted], 1 - 1e-12)), minlength=n)
    return np.where(top >= NOTED, total, -np.log1p(-np.minimum(top, NOTED)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _calibrate(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through weighed texts with evidence ``x``, by Newton steps.

    Labels count as if a further text of the other kind had been seen (Platt), and the scale is drawn to 1.
    """
    bad, good = (weight * toxic).sum(), (weight * (1 - toxic)).sum()
    aim = np.where(toxic == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    rows = np.stack([x, np.ones(len(x))], axis=1)
    at = np.array([1.0, np.log((bad + 1) / (good + 1))])
    for _ in range(50):
        p = logistic(rows @ at)
        slope = rows.T @ (weight * (aim - p)) - np.array([at[0] - 1, 0])
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([1, 1e-3])
        at = at + np.clip(np.linalg.solve(bend, slope), -1, 1)
    return max(float(at[0]), 1e-3), float(at[1])


def _scan(f: np.ndarray, row: np.ndarray, width: int = 256) -> np.ndarray:
    """row f[0], row f[0] f[1], ... each scaled to sum 1."""
    n = len(f)
    lanes = -(-n // width)
    padded = np.broadcast_to(np.eye(2), (lanes * width, 2, 2)).copy()
    padded[:n] = f
    padded = padded.reshape(lanes, width, 2, 2)
    done = np.empty_like(padded)
    now = np.broadcast_to(np.eye(2), (lanes, 2, 2))
    for k in range(width):
        x = padded[:, k]
        nxt = np.empty((lanes, 2, 2))
        for i in range(2):
            for j in range(2):
                nxt[:, i, j] = now[:, i, 0] * x[:, 0, j] + now[:, i, 1] * x[:, 1, j]
        nxt /= nxt.sum(axis=(1, 2), keepdims=True)
        done[:, k] = now = nxt
    entry = np.empty((lanes, 2))
    a, b = float(row[0]), float(row[1])
    for lane, ((p, q), (r, s)) in enumerate(done[:, -1].tolist()):
        entry[lane] = a, b
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    out = np.einsum("li,lkij->lkj", entry, done).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


def bucket(feats: np.ndarray) -> np.ndarray:
    return (feats >> U(46)).astype(np.int64)


def _fit(feats: np.ndarray, tags: np.ndarray, first: np.ndarray, weight: np.ndarray, rounds: int = 60,
         rate: float = 0.5) -> Field:
    """Gradient ascent on the likelihood of the expected tags; the texts, each with a weight, are cut into segments of ``SEGMENT`` words."""
    cuts = np.unique(np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(first[:-1], first[1:])] + [first[-1:]]))
    size = np.diff(cuts)
    s = len(size)
    real = np.arange(SEGMENT)[None, :] < size[:, None]
    at = np.minimum(cuts[:-1, None] + np.arange(SEGMENT), len(tags) - 1)
    y = tags[at] * real
    buckets = bucket(feats)
    used, index = np.unique(buckets, return_inverse=True)
    index = index.reshape(buckets.shape)
    w, bias, start, step = np.zeros(len(used)), 0.0, np.zeros(2), np.zeros((2, 2))
    memory = [np.full(len(used), 1e-6), 1e-6, np.full(2, 1e-6), np.full((2, 2), 1e-6)]
    both = np.stack([1 - y, y], axis=2)
    counts = real * weight[np.searchsorted(first, cuts[:-1], "right") - 1][:, None]
    seen_step = np.einsum("sti,stj->ij", both[:, :-1], both[:, 1:] * counts[:, 1:, None])
    seen_start = (both[:, 0] * counts[:, :1]).sum(axis=0)
    for _ in range(rounds):
        score = w[index].sum(axis=1) + bias
        e = np.ones((s, SEGMENT, 2))
        e[..., 1] = np.where(real, np.exp(np.clip(score[at], -30, 30)), 1)
        trans = np.exp(step)
        fwd, back = np.empty((s, SEGMENT, 2)), np.ones((s, SEGMENT, 2))
        now = np.exp(start) * e[:, 0]
        fwd[:, 0] = now = now / now.sum(axis=1, keepdims=True)
        for t in range(1, SEGMENT):
            nxt = (now @ trans) * e[:, t]
            nxt /= nxt.sum(axis=1, keepdims=True)
            now = np.where(real[:, t, None], nxt, now)
            fwd[:, t] = now
        for t in range(SEGMENT - 2, -1, -1):
            nxt = (back[:, t + 1] * e[:, t + 1]) @ trans.T
            nxt /= nxt.sum(axis=1, keepdims=True)
            back[:, t] = np.where(real[:, t + 1, None], nxt, 1)
        p = fwd * back
        p /= p.sum(axis=2, keepdims=True)
        pair = fwd[:, :-1, :, None] * trans * (back * e)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        miss = np.zeros(len(tags))
        miss[at[real]] = ((y - p[..., 1]) * counts)[real]
        grads = [np.bincount(index.ravel(), weights=np.repeat(miss, KINDS), minlength=len(used)) - 0.01 * w,
                 miss.sum(), seen_start - (p[:, 0] * counts[:, :1]).sum(axis=0),
                 seen_step - (pair * counts[:, 1:, None, None]).sum(axis=(0, 1))]
        moved = []
        for i, (value, g) in enumerate(zip((w, bias, start, step), grads)):
            memory[i] = memory[i] + g * g
            moved.append(value + rate * g / np.sqrt(memory[i]))
        w, bias, start, step = moved
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Field(weights, float(bias), start, step)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from the rows of (doc_id, text) whose label is known and that are not held out.

    The field is fitted on at most ``sample`` texts and ``SAMPLE_BYTES`` bytes of either label, chosen by the hash of their id, each of
    which stands for as many as it was drawn from. The features of its toxic texts are counted over all rows. What reaches the driver is the
    sample's hashed features and their counts. A doc_id with several labels counts as toxic if one says so.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 2)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known)
    texts = beside(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), known, "doc_id", "inner")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sized = beside(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("bytes")),
                   known, "doc_id", "inner").groupBy("doc_id", "toxic").agg(F.sum("bytes").alias("bytes"))

    def drawn_from(label: int) -> DataFrame:
        first = sized.where((F.col("toxic") == label) & (F.col("bytes") <= SAMPLE_BYTES // 8)).orderBy(*by_hash).limit(sample)
        upto = F.sum("bytes").over(Window.orderBy(*by_hash))               # over the few rows drawn
        return first.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES)

    chosen = cut_lineage(drawn_from(1).union(drawn_from(0)).select("doc_id", "toxic"))
    rows = beside(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), chosen, "doc_id", "inner")

    def run(batches):
        for batch in batches:
            for part in chunks(batch.column(0)):
                words, feats = features(part)
                for i in range(part.hi - part.lo):
                    own = feats[words.first[i]:words.first[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(part.lo + i, 1), pa.array([own.tobytes()], pa.binary())], ["toxic", "feats"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, feats binary").collect()
    got = sorted(((r["toxic"], bytes(r["feats"])) for r in got if r["feats"]))
    if not got:
        return Field(np.zeros(BUCKETS), -20.0, np.zeros(2), np.zeros((2, 2)), shift=-20.0)
    feats = [np.frombuffer(f, U).reshape(-1, KINDS) for _, f in got]
    first = np.append(0, np.cumsum([len(f) for f in feats]))
    label = np.array([t for t, _ in got])
    toxic = np.flatnonzero(label == 1)
    wanted = signed(np.unique(np.concatenate([feats[i].ravel() for i in toxic]) if len(toxic) else np.zeros(0, U)))
    wanted.sort()
    tags = [np.zeros(len(f)) for f in feats]
    if len(wanted):
        counts = _counts(texts, wanted).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("times").alias("times"))
        table = counts.where("feature is null or toxic > 1").toArrow()      # one that stands once is known from no other text
        key = table.column("feature")
        bad, every = (table.column(c).to_numpy() for c in ("toxic", "times"))
        total = key.is_null().to_numpy()
        base = float(np.clip(bad[total].sum() / max(1, every[total].sum()), 1e-6, 1 - 1e-6))
        place = np.searchsorted(wanted, key.drop_null().to_numpy())
        seen, clean = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        seen[place], clean[place] = bad[~total], (every - bad)[~total]
        for i in toxic:
            at = np.searchsorted(wanted, signed(feats[i]))
            p = _expected(np.maximum(seen[at] - _own(feats[i]), 0), clean[at], base)
            # some word of a toxic text is toxic
            tags[i] = np.minimum(p / max(-np.expm1(np.log1p(-p).sum()), 1e-9), 1) if p.max() > 1e-6 else p
    drawn = np.bincount(label, minlength=2)
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([max(there.get(t, 0) / max(drawn[t], 1), 1.0) for t in (0, 1)])[label]
    flat = np.concatenate(feats)
    field = _fit(flat, np.concatenate(tags), first, weight)
    field.scale, field.shift = _calibrate(evidence(field.marginals(field.emissions(flat), first), first), label, weight)
    return field


def score_texts(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, did, fp, score and spans (first and last byte + 1, highest marginal) of each row of (doc_id, text).

    The score is the chance that the text is toxic by its ``evidence``, and 0 for a null text or one without words.
    Repeated rows get a row each; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", "did", "fp", "score", "spans"]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        field = sent.value
        for batch in batches:
            for part in chunks(batch.column(3)):
                words, feats = features(part)
                p = field.marginals(field.emissions(feats), words.first)
                n = part.hi - part.lo
                doc = np.repeat(np.arange(n), np.diff(words.first))
                chance = logistic(field.scale * evidence(p, words.first) + field.shift)
                score = np.where(np.diff(words.first) > 0, chance, 0.0)
                spans = [[] for _ in range(n)]
                hit = np.flatnonzero(p >= 0.5)
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)
                for run in np.split(hit, np.flatnonzero(new)[1:]):
                    if len(run):
                        d = doc[run[0]]
                        at = part.offsets[d]
                        spans[d].append({"start": int(words.starts[run[0]] - at), "end": int(words.ends[run[-1]] - at),
                                         "p": float(p[run].max())})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(j).slice(part.lo, n) for j in range(3)), pa.array(score), pa.array(spans, pa.list_(span))], names)

    return identified(docs).select("doc_id", "did", "fp", "text").mapInArrow(
        run, "doc_id long, did long, fp long, score double, spans array<struct<start:int,end:int,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row of (doc_id, text), by a field trained on ``labels``.

    predicted is 1 from a score of 0.3. held_out follows the doc_id alone, and is false for a null one. Without any label all scores are
    near 0.
    """
    field = field or train(docs, labels)
    return score_texts(docs, field).select(
        "doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
