"""A quality classifier with hierarchical empirical Bayes.

Two logistic models on hashed features, one for quality and one for toxicity, are fitted on a bounded sample of labelled documents
(``MAX_LABELLED``). They turn each document into evidence, a log Bayes factor. Evidence of all documents is summed by host and by path
within the host; a site's rate is shrunk towards its parent's rate (path to host, host to all) with a strength estimated by moments from
all sites' rates, so sparse sites stay near the prior. A document's posterior combines its own evidence with its path's rate.

Grouped sums have one row for each site and task before the shuffle, so a hot host costs little; the narrow evidence rows, not the
texts, are joined with the rates. A broadcast holds the two weight vectors only (2 MB).

Defined cases: a null or empty text has no evidence and gets its site's rate; null hosts and paths are sites of their own; labels of no
document are ignored, several labels of one document count by their largest value; without labels of both kinds a model gives no evidence; an
empty table gives no rows; repeated rows repeat in the result; ids of any type match labels by their text; a posterior on the border counts as good and
as toxic (ties); very long texts are read whole; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BATCH_ROWS, Scratch, documents, packed, slices, unpacked

#: Documents of the labelled sample at most: those of the smallest hashes.
MAX_LABELLED = 20000
BITS = 18
EPOCHS = 4
#: Documents of the sample that a feature needs.
MIN_DOCS = 10
L1, L2, ALPHA = 10.0, 1.0, 0.5
#: Posterior from which a document counts as bad or as toxic.
BAD, TOXIC = 0.5, 0.5
_EDGE = b".,;:!?\"'()[]{}"
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = b"#*$%&|<>{}\\^~=_@+/"


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text: its distinct words and the shape of its words and lines."""
    mask = (1 << BITS) - 1
    if not text:
        return np.zeros(0, np.int32)
    cased = text.encode()
    raw = cased.lower()
    words = raw.split()
    if not words:
        return np.zeros(0, np.int32)
    names = {w.strip(_EDGE) for w in set(words)}
    n = len(words)
    symbols = n and len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(cased) - len(cased.translate(None, _LETTERS.upper()))
    shape = {
        b"\x01capitals": int(10 * capitals / max(1, letters)),
        b"\x01shouts": min(10, int(10 * raw.count(b"!") / n)),
        b"\x01symbols": min(20, int(20 * symbols / n)),
        b"\x01mean": int(len(raw) / n),
        b"\x01words": n.bit_length(),
        b"\x01distinct": int(10 * len(names) / n),
        b"\x01lines": int(10 * len(set(lines)) / max(1, len(lines))),
    }
    found = {zlib.crc32(w) & mask for w in names}
    found.update(zlib.crc32(k + bytes([min(v, 255)])) & mask for k, v in shape.items())
    return np.fromiter(found, np.int32, len(found))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> tuple[np.ndarray, float]:
    """Sparse weights and bias of a logistic model by FTRL-proximal updates over single documents.

    The L1 term leaves words without signal at 0, so rare words of the sample are not learned by heart.
    """
    size = 1 << BITS
    rate = labels.mean() if len(labels) else 0.0
    if not 0.0 < rate < 1.0:
        return np.zeros(size, np.float32), 0.0
    docs = np.zeros(size, np.int64)
    for x in rows:
        docs[x] += 1
    rows = [x[docs[x] >= min_docs] for x in rows]
    l1 = min(L1, max(1.0, L1 * len(rows) / 8000))
    z, squares, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias = float(np.log(rate / (1 - rate)))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            now = w[x]
            d = 1.0 / (1.0 + np.exp(-np.clip(now.sum() + bias, -30, 30))) - labels[i]
            old, new = squares[x], squares[x] + d * d
            zx = z[x] + d - (np.sqrt(new) - np.sqrt(old)) / ALPHA * now
            z[x], squares[x] = zx, new
            w[x] = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((1.0 + np.sqrt(new)) / ALPHA + L2))
            bias -= 0.02 * d
    return w.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, id_col: str, text: str, max_labelled: int = MAX_LABELLED):
    """The two models (quality, toxic) from at most ``max_labelled`` labelled documents."""
    truth = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    here = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))  # ids of any type
    # Hash order makes the sample the same for any partitioning; the ids are chosen before any text moves.
    chosen = truth.join(here.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = here.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))  # max_labelled rows

    def run(batches):
        for b in slices(batches):
            found = [features(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "quality", "toxic", "x"])

    got = sample.mapInArrow(run, "doc_id string, quality int, toxic int, x binary").toArrow()
    order = np.argsort(np.array(got.column("doc_id").to_pylist(), dtype=str), kind="stable")
    rows = [np.frombuffer(got.column("x")[int(i)].as_py(), np.int32) for i in order]
    models = []
    for name in ("quality", "toxic"):
        y = got.column(name).to_numpy(zero_copy_only=False)[order].astype(float)
        known = ~np.isnan(y)
        models.append(fit([r for r, k in zip(rows, known) if k], y[known]) + (float(y[known].mean()) if known.any() else 0.5,))
    return models


def evidence(docs: DataFrame, models, *keep: str, text: str = "text") -> DataFrame:
    """Rows (keep, e_quality, e_toxic): log Bayes factors of whole texts."""
    rows = docs.select(*keep, text)
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]), "e_quality double, e_toxic double"])
    shared = docs.sparkSession.sparkContext.broadcast([(w, bias - np.log(rate / (1 - rate)) if 0 < rate < 1 else 0.0) for w, bias, rate in models])

    def run(batches):
        (wq, bq), (wt, bt) = shared.value
        for b in slices(batches):
            q, t = [], []
            for x in b.column(b.num_columns - 1).to_pylist():
                f = features(x)
                q.append(float(np.clip(wq[f].sum() + bq, -30, 30)) if len(f) else 0.0)
                t.append(float(np.clip(wt[f].sum() + bt, -30, 30)) if len(f) else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(q), pa.array(t)], names=[*b.schema.names[:-1], "e_quality", "e_toxic"])

    return rows.mapInArrow(run, schema)


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame, kind: str, rate: float) -> float:
    """Pseudo-documents of the parent's rate: rate (1 - rate) over the variance between sites, by moments."""
    spread = F.pow(F.col(f"s_{kind}") / F.col("n") - rate, 2)
    got = sites.agg(F.sum(F.col("n") * spread).alias("a"), F.sum("n").alias("n"), F.count("*").alias("sites")).first()
    if not got.n or got.sites < 2:
        return 1000.0
    within = rate * (1 - rate)
    between = max(0.0, (got.a - (got.sites - 1) * within) / got.n)
    return float(min(1e6, max(2.0, within / between if between > 0 else 1e6)))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, *keep: str, text: str = "text", host=None, path=None) -> DataFrame:
    """Rows (keep, p_quality, p_toxic, kept), one for each row of ``docs``; ``keep`` holds the id first."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    models = train(docs, labels, keep[0], text)
    scored = evidence(packed(docs, keep, host.alias("_host"), path.alias("_path"), F.col(text).alias("_text")), models, "_keep", "_host", "_path", text="_text")
    prior = {"quality": models[0][2], "toxic": models[1][2]}
    for kind, p in prior.items():
        scored = scored.withColumn(f"p_{kind}", _sigmoid(F.col(f"e_{kind}") + _logit(F.lit(p))))
    scored = scratch.write(scored, "scored", BATCH_ROWS)
    sums = [F.count("*").alias("n"), *[F.sum(f"p_{k}").alias(f"s_{k}") for k in prior]]
    paths = scratch.write(scored.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = scratch.write(paths.groupBy("_host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in prior]), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in prior]).first()
    for k, p in prior.items():
        rate = whole[f"s_{k}"] / whole.n if whole.n else p
        m_host, m_path = _strength(hosts, k, rate), _strength(paths, k, rate)
        hosts = hosts.withColumn(f"h_{k}", (F.col(f"s_{k}") + m_host * rate) / (F.col("n") + m_host))
        paths = paths.withColumn(f"m_{k}", F.lit(m_path))
    parent = hosts.select(F.col("_host").alias("_h"), *[f"h_{k}" for k in prior])
    rates = paths.join(parent, F.col("_host").eqNullSafe(F.col("_h")))
    rates = rates.select(F.col("_host").alias("_rh"), F.col("_path").alias("_rp"), *[((F.col(f"s_{k}") + F.col(f"m_{k}") * F.col(f"h_{k}")) / (F.col("n") + F.col(f"m_{k}"))).alias(f"r_{k}") for k in prior])
    rates = scratch.write(rates, "rates")
    joined = scored.join(rates, F.col("_host").eqNullSafe(F.col("_rh")) & F.col("_path").eqNullSafe(F.col("_rp")))
    post = {k: _sigmoid(F.col(f"e_{k}") + _logit(F.col(f"r_{k}"))) for k in prior}
    out = joined.select("_keep", *[p.alias(f"p_{k}") for k, p in post.items()])
    out = out.withColumn("kept", (F.col("p_quality") >= BAD) & (F.col("p_toxic") < TOXIC))
    return unpacked(out, keep, "p_quality", "p_toxic", "kept")


def op8_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels, Scratch(spark, "op8"), "doc_id")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
