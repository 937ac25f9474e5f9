"""Toxicity by compression distance between two zstandard dictionaries.

Training (on a bounded sample of labelled rows, ``SAMPLE_ROWS`` per class):

1. Character prefixes of words are compared by document frequency in the two
   classes; a prefix that is ``MIN_LOG_ODDS`` likelier in toxic documents marks
   the toxic passages worth learning.
2. One zstandard dictionary is trained on pieces of ordinary text, another on
   those toxic passages.
3. A text is cut into windows of ``WINDOW_WORDS`` words. Each window is
   compressed twice: with the ordinary dictionary, and with the toxic one laid
   beside the ordinary one, so that ordinary text costs the same in both and
   only toxic passages save bytes. The bytes saved are the window's distance.
4. A logistic model calibrates a document's window distances (largest, mean,
   shares and counts above fixed thresholds) against the labels, weighted to the
   class sizes of all labelled rows, so 0.5 is the decision threshold.

Scoring is a map over whole texts: no shuffle, one Arrow column out and one
back. The model (two dictionaries, some 40 kB, and a few weights) travels in
the function.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample: labelled rows of each class, and characters of one text.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 60_000
WINDOW_WORDS = 4
PREFIXES = (5, 6, 8)
MIN_LOG_ODDS = 3.2
ORDINARY_BYTES = 32768
TOXIC_BYTES = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WINDOW = re.compile(rb"\S+(?:\s+\S+){0,%d}" % (WINDOW_WORDS - 1))


@dataclass
class Model:
    """``prior`` alone is the score if a class had no labelled row (dictionaries empty)."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]
    prior: float


def _clean(text: str | bytes | None) -> bytes:
    data = text.encode() if isinstance(text, str) else (text or b"")
    return data.translate(_LOWER)


def _compressors(model: Model):
    import zstandard as zs

    params = zs.ZstdCompressionParameters(
        strategy=zs.STRATEGY_DFAST, min_match=6, window_log=17, hash_log=16, chain_log=16, search_log=5,
        target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = []
    for raw in (model.ordinary, model.ordinary + model.toxic):
        d = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        made.append(zs.ZstdCompressor(dict_data=d, compression_params=params).compress)
    return made


def _features(data: bytes, ordinary, toxic) -> tuple:
    d = np.array([len(ordinary(w)) - len(toxic(w))
                  for w in (b" %b " % w for w in _WINDOW.findall(data))] or [0])
    return (d.max(), d.mean(), (d >= 3).mean(), (d >= 4).mean(), (d >= 5).mean(),
            math.log1p((d >= 4).sum()), math.log1p((d >= 6).sum()), math.log(len(d)))


def _prefixes(data: bytes) -> set:
    return {(b" " + w)[:k] for w in set(data.split()) for k in PREFIXES if len(w) >= k - 1}


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    keep = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + keep * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        w -= np.linalg.solve(bend, slope)
    return w


def fit(rows: list[tuple], totals: dict[int, int]) -> Model:
    """``rows``: (text, label) of the sample; ``totals``: labelled rows of each class."""
    import zstandard as zs

    n = sum(totals.values())
    prior = totals.get(1, 0) / n if n else 0.0
    rows = sorted({(_clean(t), int(y)) for t, y in rows})  # copies count once
    by = {c: [t for t, y in rows if y == c] for c in (0, 1)}
    blank = Model(b"", b"", [], [], [], prior)
    if not by[0] or not by[1]:
        return blank
    seen = {c: Counter(p for t in by[c] for p in _prefixes(t)) for c in (0, 1)}
    least = max(3, len(by[1]) // 100)
    marked = {p for p, c in seen[1].items() if c >= least and
              math.log((c + .5) / (len(by[1]) + 1)) - math.log((seen[0][p] + .5) / (len(by[0]) + 1)) >= MIN_LOG_ODDS}
    hits = [b" " + w + b" " for t in by[1] for w in t.split()
            if any((b" " + w)[:k] in marked for k in PREFIXES)]
    passages = [b"".join(hits[i:i + 4]) for i in range(0, len(hits), 4)]
    pieces = [t[i:i + 256] for t in by[0] for i in range(0, len(t), 256)]
    rng = np.random.default_rng(0)
    pieces = [pieces[i] for i in rng.permutation(len(pieces))[:20_000]]

    def trained(size: int, samples: list[bytes], **kw) -> bytes:
        try:
            return zs.train_dictionary(size, samples, level=3, **kw).as_bytes()
        except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
            return b"".join(samples)[-size:]

    model = Model(trained(ORDINARY_BYTES, pieces), trained(TOXIC_BYTES, passages, k=24, d=6), [], [], [], prior)
    ordinary, toxic = _compressors(model)
    x = np.array([_features(t, ordinary, toxic) for t, _ in rows], float)
    y = np.array([c for _, c in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, totals[1] / len(by[1]), totals[0] / len(by[0])) * len(rows) / n
    model.weights = _fit_logistic((x - mean) / scale, y, weight).tolist()
    model.mean, model.scale = mean.tolist(), scale.tolist()
    return model


def scores(model: Model, texts: list) -> list[float]:
    if not model.weights:
        return [model.prior] * len(texts)
    ordinary, toxic = _compressors(model)
    w, mean, scale = (np.array(v) for v in (model.weights, model.mean, model.scale))
    out = []
    for t in texts:
        x = (np.array(_features(_clean(t), ordinary, toxic), float) - mean) / scale
        out.append(float(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))))
    return out


def training_remainder(id_col):
    """crc32 of the id as text, modulo 5; rows with 0 are held out of training."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows outside the held-out fifth.

    ``labels(doc_id, toxic)``: rows with a null or other label are ignored. At
    most ``sample_rows`` rows of each class, those with the smallest hash of
    their id, reach the driver (of an id on several rows the smallest text);
    class sizes are counted over all labels.
    """
    known = (labels.filter(training_remainder(F.col("doc_id")) != 0).filter("toxic in (0, 1)")
             .select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct())
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              for c in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * sample_rows rows
    rows = (docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
            .join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    return fit([(r["text"], r["toxic"]) for r in rows], totals)


def score_column(model: Model, text_col):
    """The toxicity score of a text column (null: empty text)."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(model, texts.cast(pa.large_binary()).to_pylist()), pa.float64())

    return score(text_col)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Repeated rows are scored alike; a null id is never held out; null and empty
    texts get the score of a text without a toxic window. Without labelled rows
    of both classes the score is the share of label 1 (0 if there is no label).
    """
    model = train(docs, labels)
    return (docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
            .select("doc_id", F.coalesce(training_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                    "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text the classifier calls toxic.

    Repeated rows go or stay alike; null and empty texts and null ids stay unless a text without a
    toxic window would go; without labels of both classes all stay if label 1 is the rarer. No row gives no row.
    """
    model = train(docs, labels)
    return docs.filter(score_column(model, F.col("text")) < 0.5)
