"""Quality classifier by co-training.

Two views of a document, the content of its text and its metadata (source,
language, recorded length), each get a logistic classifier. Both start from the
same labelled documents. In each of ROUNDS rounds both judge every document
without a label; each view then hands those LENT documents to the other one that
it is surest of and hasn't handed over yet, in the labels' proportion, as further
training rows. What a view is surest of is relative to what the labels alone say:
a lent row carries the view's probability as its target and weighs as much as
that probability tells more than the share of good documents does. Views that
tell less than a quarter of what there is to know about the documents set aside
weigh less in proportion, so that one that knows nothing teaches nothing. The views are then calibrated and combined on
labelled documents set aside, and the combination scores every document over its
whole text.

Fitting uses LABELLED labelled documents at most, drawn by a hash of their ids;
judging, in every round and at the end, covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, remove

LABELLED, ROUNDS, LENT, WEIGHT = 8000, 3, 800, 0.3
SOURCES, LANGUAGES = 64, 16
#: Kinds of bytes; a text's pairs of neighbouring kinds are counted.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#$%&*@^~", "-_", "'\"()[]{}<>", ":;/\\=+`"]
_kind = np.full(256, len(KINDS), np.int64)
for _k, _chars in enumerate(KINDS):
    _kind[list(_chars.encode())] = _k
_kind[128:] = len(KINDS) + 1
WIDE = len(KINDS) + 2
TEXT_FEATURES = WIDE * WIDE + 6
META_FEATURES = SOURCES + LANGUAGES + 4


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row per text: shares of byte-kind pairs, repetition, word and line shape."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for i, text in enumerate(texts):
        text = text or ""
        x = _kind[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        if len(x) > 1:
            out[i, : WIDE * WIDE] = np.sqrt(np.bincount(x[:-1] * WIDE + x[1:], minlength=WIDE * WIDE) / (len(x) - 1))
        words = text.split()
        lines = text.split("\n")
        n = len(words)
        # distinct words, within stretches so that long texts compare with short ones
        fresh = [len(set(words[k : k + 50])) / len(words[k : k + 50]) for k in range(0, n, 50)]
        out[i, WIDE * WIDE :] = (np.mean(fresh) if fresh else 0, min(fresh, default=0), len(set(lines)) / len(lines), np.log1p(len(text) / max(n, 1)), np.log1p(n / len(lines)), np.log1p(n) / 10)
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_FEATURES))
    for i, (s, la, n) in enumerate(zip(source, lang, n_chars)):
        if s is not None:
            out[i, xxhash.xxh3_64_intdigest(str(s)) % SOURCES] = 1
        if la is not None:
            out[i, SOURCES + xxhash.xxh3_64_intdigest(str(la)) % LANGUAGES] = 1
        known = n is not None and n == n
        size = np.log1p(max(float(n), 0)) / 10 if known else 0
        out[i, SOURCES + LANGUAGES :] = (s is None, la is None, not known, size)
    return out


class Logistic:
    """Weighted logistic regression with an L2 penalty, by Newton's method, on
    standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 25):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(axis=0, dtype=np.float64)
        self.scale = np.maximum(x.std(axis=0, dtype=np.float64), 1e-3)
        n = x.shape[1] + 1
        w, ridge = np.zeros(n), np.full(n, penalty)
        ridge[-1] = 1e-6
        for _ in range(rounds):
            g, h = ridge * w, np.diag(ridge)
            for s in range(0, len(x), 1000):  # standardised block by block, never as a whole
                z = np.hstack(((x[s : s + 1000] - self.mean) / self.scale, np.ones((len(x[s : s + 1000]), 1))))
                p, k = _sigmoid(z @ w), weight[s : s + 1000]
                g = g + z.T @ (k * (p - y[s : s + 1000]))
                h = h + (z * (k * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z
            step = np.linalg.solve(h, g)
            w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-5:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.w[:-1] + self.w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Both views' classifiers, their calibration and the combination."""

    def __init__(self, models: list[Logistic], calibrated: list[Logistic], join: Logistic):
        self.models, self.calibrated, self.join = models, calibrated, join

    def view(self, v: int, x: np.ndarray) -> np.ndarray:
        return self.calibrated[v].logit(self.models[v].logit(x)[:, None]) if len(x) else np.zeros(0)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.view(0, text), self.view(1, meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.join.logit(np.stack((a, b), axis=1)))


def entropy(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return -(p * np.log(p) + (1 - p) * np.log(1 - p))


class CoTraining:
    """Labelled rows of both views, what the views have lent each other, and the
    classifiers learned from them. history has, per round, the rows handed over
    (by the text view, by the metadata view), their mean weights, and the losses
    of both views and of the combination on the documents set aside."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.views, self.y, self.prior = (text, meta), y, float(y.mean())
        aside = np.arange(len(y)) % 4 == 3
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), bool)
        self.fitted, self.check = ~aside, aside if aside.any() else ~aside
        none = lambda x: (np.zeros((0, x.shape[1]), np.float32), np.zeros(0), np.zeros(0))
        self.lent = [none(text), none(meta)]  # what each view got: rows, targets, weights
        self.history: list[dict] = []
        self.scorer = self._learn()

    def _learn(self) -> Scorer:
        models = []
        for x, (more, target, weight) in zip(self.views, self.lent):
            models.append(Logistic(np.vstack((x[self.fitted], more)), np.concatenate((self.y[self.fitted], target)), np.concatenate((np.ones(self.fitted.sum()), weight))))
        y = self.y[self.check]
        calibrated = [Logistic(m.logit(x[self.check])[:, None], y) for m, x in zip(models, self.views)]
        scorer = Scorer(models, calibrated, None)
        both = np.stack([scorer.view(v, x[self.check]) for v, x in enumerate(self.views)], axis=1)
        scorer.join = Logistic(both, y)
        loss = lambda p: float(-np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))))
        scores = scorer.score(*(x[self.check] for x in self.views))
        blind = max(float(entropy(np.array(y.mean()))), 1e-9)
        self.gain = [min(1.0, 4 * max(0.0, 1 - loss(p) / blind)) for p in scores[:2]]
        self.history.append({"lent": (len(self.lent[1][1]), len(self.lent[0][1])), "weight": tuple(float(w[2].mean()) if len(w[2]) else 0.0 for w in (self.lent[1], self.lent[0])), "loss": tuple(map(loss, scores))})
        return scorer

    def weigh(self, v: int, p: np.ndarray) -> np.ndarray:
        """What a view's probabilities tell beyond the share of good documents, of WEIGHT."""
        return WEIGHT * self.gain[v] * np.clip(1 - entropy(p) / max(float(entropy(np.array(self.prior))), 1e-9), 0, 1)

    def exchange(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """rows[v]: features for the other view, and view v's probabilities."""
        for v, (x, p) in enumerate(rows):
            old = self.lent[1 - v]
            self.lent[1 - v] = (np.vstack((old[0], x)), np.concatenate((old[1], p)), np.concatenate((old[2], self.weigh(v, p))))
        self.scorer = self._learn()


def _features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Both views as 32-bit floats in bytes, which the driver gathers compactly."""

    @F.pandas_udf("struct<t:binary,m:binary>")
    def both(text: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.DataFrame:
        pack = lambda x: [r.tobytes() for r in x.astype(np.float32)]
        return pd.DataFrame({"t": pack(text_features(text.tolist())), "m": pack(meta_features(source.tolist(), lang.tolist(), n.tolist()))})

    return docs.select(*keep, both(*_inputs()).alias("f")).select(*keep, "f.t", "f.m")


def _inputs() -> list[F.Column]:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double")]


def _nulls() -> F.Column:
    """Which inputs are null; a hash of the values passes over them."""
    return F.array(*(c.isNull() for c in _inputs()))


def _gather(docs: DataFrame, keep: list[str]) -> pd.DataFrame:
    """Features of the documents, one row of each key: rows that share an id or
    all inputs are as many as they like, the smallest features stand for them."""
    return _features(docs, keep).groupBy(*keep).agg(F.min(F.struct("t", "m")).alias("f")).select(*keep, "f.t", "f.m").toPandas()


def surest(pool: DataFrame, gone: list[int], by: str, prior: float, most: int) -> list[tuple[int, float]]:
    """(k, p, ...) -> the `most` rows that the view `by` is surest of, in the
    labels' proportion and on their side of their share; ties by a hash."""
    free = pool.where(~F.col("k").isin(gone)) if gone else pool
    good = max(1, round(most * prior))
    sure = F.round(by, 3)
    top = free.where(F.col(by) > prior).orderBy(F.desc(sure), F.xxhash64("k"), "k").limit(good)
    low = free.where(F.col(by) < prior).orderBy(sure, F.xxhash64("k"), "k").limit(max(1, most - good))
    return [(r.k, r.p) for r in top.unionByName(low).select("k", F.col(by).alias("p")).collect()]  # `most` rows


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = ROUNDS, lent: int = LENT) -> CoTraining | None:
    """None where the labelled documents don't have both classes. Labels without
    an id or other than 0 and 1 take no part; of documents that share a labelled
    id one stands for all. Documents equal in all inputs are lent once."""
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0, 1)")
    chosen = marks.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(LABELLED)
    known = _gather(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")), ["id", "y"])  # LABELLED rows
    if known.y.nunique() < 2:
        return None
    known = known.assign(h=[xxhash.xxh3_64_intdigest(str(i)) for i in known.id]).sort_values(["h", "id", "y"])
    stack = lambda s, n: np.frombuffer(b"".join(s), np.float32).reshape(-1, n)
    model = CoTraining(stack(known.t, TEXT_FEATURES), stack(known.m, META_FEATURES), known.y.to_numpy())
    key = F.xxhash64(*_inputs(), _nulls())
    handed: list[list[int]] = [[], []]
    for _ in range(rounds):
        judged = score_documents(docs.select("*", key.alias("k")), model).select("doc_id", "k", F.col("text_score").alias("p0"), F.col("meta_score").alias("p1"))
        unknown = judged.join(marks.select("id"), F.col("doc_id") == F.col("id"), "left_anti")
        pool = materialize(unknown.groupBy("k").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1")))
        picked = [surest(pool, handed[v], f"p{v}", model.prior, lent) for v in (0, 1)]
        remove(pool)
        wanted = docs.sparkSession.createDataFrame([(k,) for k in sorted({k for some in picked for k, _ in some})], "k long")  # 2 * LENT rows
        got = _gather(docs.withColumn("_k", key).join(F.broadcast(wanted), F.col("_k") == F.col("k")), ["k"]).set_index("k")  # 2 * LENT rows
        rows = []
        for v, (column, width) in enumerate((("m", META_FEATURES), ("t", TEXT_FEATURES))):
            ks = [k for k, _ in picked[v]]
            rows.append((stack(got[column].loc[ks], width) if ks else np.zeros((0, width), np.float32), np.array([p for _, p in picked[v]])))
            handed[v] += ks
        model.exchange(rows)
    return model


def score_documents(docs: DataFrame, model: CoTraining | None) -> DataFrame:
    """The input with columns text_score, meta_score and score, each 0 to 1 (1 is
    good). Null texts and metadata have features of their own; an empty text is
    scored like any other. Without a model every score is 1. Input columns of
    these names are replaced; repeated rows score alike."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text_score", "meta_score", "score")))
    if model is None:
        return docs.select("*", *(F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")))
    send = docs.sparkSession.sparkContext.broadcast(model.scorer)  # a fixed number of weights

    @F.pandas_udf("struct<a:double,b:double,c:double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, n in batches:
            a, b, c = send.value.score(text_features(text.tolist()), meta_features(source.tolist(), lang.tolist(), n.tolist()))
            yield pd.DataFrame({"a": a, "b": b, "c": c})

    packed = docs.select(F.struct("*").alias("_row"), score(*_inputs()).alias("_s"))
    return packed.select("_row.*", F.col("_s.a").alias("text_score"), F.col("_s.b").alias("meta_score"), F.col("_s.c").alias("score"))


def op7_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("keep"))
