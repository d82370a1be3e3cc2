"""Quality and toxicity of documents from weak labels.

Several heuristic labellers vote on every document; they overlap, disagree and
abstain.  Expectation-maximisation over the counts of vote patterns in the
whole corpus estimates how often each labeller gives each vote for bad and for
good documents, and so the posterior of every pattern.  The posteriors are the
labels a hashed linear scorer is trained on, and the scorer decides.

Labellers of junk are rules on symbols, capitals, repetition and the like.
Those of toxicity compare three views of a document (words, frequent word
beginnings, those that recur) with the features that go with the toxic mark in a
bounded sample of labelled documents.

Votes, counts of patterns and scores cover all documents.  Two samples are
bounded, by documented parameters: ``most_labelled`` rows for the toxic
features and ``most_training`` documents for the scorer.  Only vote patterns,
features of the samples and two weight vectors pass the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = b"#$%&*|^~<>=_@\\{}[]"
JUNK_VOTES = ("symbols", "bare_tokens", "capitals", "repeats", "exclaims", "short_words", "distinct")
TOXIC_VOTES = ("toxic_words", "toxic_beginnings", "toxic_recurring")
OFTEN = 0.006
BITS = 18
#: Features count this much less than 1 each; keeps the first steps small.
SCALE = 8.0
BAD, GOOD, NONE = 2, 1, 0


def vote(value: float, bad: float, good: float) -> int:
    """BAD at or beyond ``bad``, GOOD at or beyond ``good`` on the other side, NONE between."""
    if bad > good:
        return BAD if value >= bad else GOOD if value <= good else NONE
    return BAD if value <= bad else GOOD if value >= good else NONE


def junk_shares(text: str) -> dict[str, float] | None:
    """The measures that the junk labellers vote on; None without any token."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return None
    words = [t for t in tokens if t.isalpha() or t.lower() != t.upper()]
    m, raw = max(len(words), 1), text.encode()
    return {
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / n,
        "bare_tokens": 1 - len(words) / n,
        "capitals": sum(map(str.isupper, words)) / m,
        "repeats": sum(map(eq, tokens, tokens[1:])) / n,
        "exclaims": raw.count(b"!") / n,
        "short_words": sum(map((3).__ge__, map(len, words))) / m,
        "distinct": len(set(words)) / (m if m < 400 else math.sqrt(400 * m)),
        "size": n,
    }


#: (bad from, good up to) of each measure; a short text says little about the last two.
JUNK_LIMITS = {
    "symbols": (0.4, 0.05),
    "bare_tokens": (0.15, 0.02),
    "capitals": (0.4, 0.15),
    "repeats": (0.2, 0.03),
    "exclaims": (0.4, 0.06),
    "short_words": (0.08, 0.18),
    "distinct": (0.12, 0.3),
}


def junk_votes(shares: dict[str, float] | None) -> list[int]:
    if shares is None:
        return [NONE] * len(JUNK_VOTES)
    votes = [vote(shares[name], *JUNK_LIMITS[name]) for name in JUNK_VOTES]
    return votes if shares["size"] >= 20 else votes[:5] + [NONE, NONE]


def word_features(text: str) -> dict[str, list[str]]:
    """Names of features by view: words, frequent beginnings of words, those that recur.

    A beginning counts if it makes up ``OFTEN`` of all words and, unless the
    text is very short, occurs twice, so that a long text does not gather
    them by chance.
    """
    counts = Counter(WORD.findall(text.lower()))
    size = counts.total()
    often = max(OFTEN * size, 1 if size < 30 else 2)
    beginnings: Counter[str] = Counter()
    for w, n in counts.items():
        if len(w) > 4:
            beginnings[w[:5]] += n
            if len(w) > 5:
                beginnings[w[:6]] += n
    return {
        "toxic_words": ["w" + w for w in counts],
        "toxic_beginnings": ["b" + b for b, n in beginnings.items() if n >= often],
        "toxic_recurring": ["r" + b for b, n in beginnings.items() if n > 2 and n >= 2 * often],
    }


class Described:
    """One text: its word features, junk measures and votes."""

    def __init__(self, text: str, odds: dict[str, float], prior: float):
        self.views = word_features(text)
        self.shares = junk_shares(text)
        self.votes = "".join(map(str, junk_votes(self.shares) + toxic_votes(self.views, odds, prior)))

    def features(self) -> np.ndarray:
        """Hashed features of the linear scorer: words, measures and all votes."""
        names = [n for view in self.views.values() for n in view]
        names += [f"v{k}{v}" for k, v in zip(JUNK_VOTES + TOXIC_VOTES, self.votes, strict=True)]
        if self.shares is not None:
            told = JUNK_VOTES if self.shares["size"] >= 20 else JUNK_VOTES[:5]
            names += [f"s{k}{min(8, int(-2 * math.log2(self.shares[k])) if self.shares[k] > 0 else 9)}" for k in told]
        return hashed(names)


def hashed(names) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names), np.int32))


# --- features that go with the toxic mark ---------------------------------------------------


def toxic_features(labelled: DataFrame, least: int = 4, evidence: float = 24.0, most: int = 20_000) -> tuple[dict[str, float], float]:
    """({feature: log odds}, log prior odds) from (text, toxic) rows.

    A feature is listed if at least ``least`` toxic documents have it, over
    half of the documents with it are toxic, and the likelihood ratio of that
    is at least ``evidence``; of more than ``most`` the strongest are taken.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                into = toxic if mark else clean
                into[""] += 1
                into.update(n for view in word_features(text).values() for n in view)
        names = list(toxic.keys() | clean.keys())
        for k in range(0, len(names), 100_000):
            part = names[k : k + 100_000]
            columns = [pa.array(part), pa.array([toxic[n] for n in part], pa.int64()), pa.array([clean[n] for n in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "toxic", "clean"])

    sums = labelled.mapInArrow(count, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = sums.where((F.col("toxic") >= least) & (F.col("toxic") > F.col("clean")) | (F.col("name") == ""))
    found = {r["name"]: (r["toxic"], r["clean"]) for r in sums.orderBy(F.col("name") != "", F.desc(F.col("toxic") - F.col("clean")), "name").limit(most).collect()}
    toxic, clean = found.pop("", (0, 0))
    if not toxic or not clean:
        return {}, 0.0
    base = toxic / (toxic + clean)
    odds = {}
    for name, (t, c) in found.items():
        share = t / (t + c)
        ratio = 2 * (t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0))
        if ratio >= evidence:
            odds[name] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return odds, math.log(toxic / clean)


def toxic_votes(views: dict[str, list[str]], odds: dict[str, float], prior: float) -> list[int]:
    """One vote for each view: the odds of its strongest features against the prior.

    A view without any listed feature abstains where another view has some.
    """
    if not odds:
        return [NONE] * len(TOXIC_VOTES)
    found = [sorted((odds[n] for n in names if n in odds), reverse=True) for names in views.values()]
    if not any(found):
        return [GOOD] * len(TOXIC_VOTES)
    totals = [prior + sum(f[:3]) if f else None for f in found]
    return [NONE if t is None or 0 <= t <= 2.5 else BAD if t > 2.5 else GOOD for t in totals]


# --- expectation-maximisation ---------------------------------------------------------------


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of BAD for each vote pattern (rows of NONE, GOOD, BAD).

    A labeller that votes has, for each class, a probability of voting BAD;
    labellers are independent given the class, and abstaining says nothing.
    The start takes any vote for BAD as a hint.
    """
    if not len(patterns):
        return np.zeros(0)
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.02)
    chosen = np.stack([patterns == v for v in (GOOD, BAD)])  # vote, pattern, labeller
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad])  # class, pattern
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        rates = np.einsum("kp,vpl->kvl", weight, chosen) + np.array([[[2.0], [0.1]], [[1.0], [1.0]]])
        rates /= rates.sum(axis=1, keepdims=True)
        logs = np.log(prior)[:, None] + np.einsum("kvl,vpl->kp", np.log(rates), chosen)
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(now - bad).max() < 1e-6:
            break
        bad = now
    return bad


# --- linear scorer --------------------------------------------------------------------------


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 1.0, decay: float = 1e-3, least: int = 5, seed: int = 7) -> np.ndarray:
    """Logistic weights (the last one is the bias) for hashed binary features, by gradient steps."""
    size = (1 << BITS) + 1
    weights, rng, batch = np.zeros(size), np.random.default_rng(seed), 64
    if len(rows):  # what hardly any document has can only be learnt by heart
        common = np.bincount(np.concatenate(rows), minlength=size - 1) >= least
        rows = [r[common[r]] for r in rows]
    lift = {1: 0.5 / max(labels.mean(), 1e-3), 0: 0.5 / max(1 - labels.mean(), 1e-3)} if len(labels) else {}
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            sizes = np.array([len(rows[i]) for i in part])
            index = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            norm = np.full(len(part), 1 / SCALE)
            z = np.bincount(owner, weights[index], len(part)) * norm + weights[-1]
            y = labels[part]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.sqrt(y * lift[1] + (1 - y) * lift[0])
            touched, inverse = np.unique(index, return_inverse=True)
            step = np.bincount(inverse, (error * norm)[owner], len(touched))
            weights[touched] -= rate * (step + decay * weights[touched])
            weights[-1] -= rate * error.sum() / SCALE
    return weights


def score(weights: np.ndarray, index: np.ndarray) -> float:
    z = weights[index].sum() / SCALE + weights[-1]
    return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


# --- on tables ------------------------------------------------------------------------------


def _bounded(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows, the same every time, picked by a hash of ``keys``."""
    n = df.count()
    share = min(1.0, most / max(n, 1))
    return df if share == 1 else df.where(F.xxhash64(*keys) / float(1 << 63) < 2 * share - 1)


class QualityModel:
    """Fitted scorers of junk and toxicity; ``judged`` applies them."""

    def __init__(self, junk: np.ndarray | None, toxic: np.ndarray | None, odds: dict[str, float], prior: float):
        self.junk, self.toxic, self.odds, self.prior = junk, toxic, odds, prior

    def judge(self, spark) -> Column:
        """Column function: text to struct(quality, toxicity); null for a text without words."""
        kind = pa.struct([("quality", pa.float64()), ("toxicity", pa.float64())])
        weights = spark.sparkContext.broadcast((self.junk, self.toxic, self.odds, self.prior))  # 2 ** BITS numbers each

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            junk, toxic, odds, prior = weights.value
            for batch in batches:
                out = []
                for text in batch:
                    text = text.as_py()
                    if not text or text.isspace():
                        out.append(None)
                        continue
                    index = Described(text, odds, prior).features()
                    out.append({"quality": 1 - score(junk, index) if junk is not None else 1.0, "toxicity": score(toxic, index) if toxic is not None else 0.0})
                yield pa.array(out, kind)

        return F.arrow_udf(run, "struct<quality:double,toxicity:double>").asNondeterministic()


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    toxic_col: str = "toxic",
    most_labelled: int = 20_000,
    most_training: int = 12_000,
) -> QualityModel:
    """Labellers, their accuracies, and the two scorers.

    Rows of ``labels`` with a null id or mark are passed over; several marks
    of one id count as toxic if any is.  Without toxic or without clean
    labelled documents nothing is held to be toxic.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    marks = labels.select(F.col(label_id_col).alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).dropna()
    marks = _bounded(marks, most_labelled, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most about most_labelled small rows
    odds, prior = toxic_features(texts.join(F.broadcast(marks), "doc_id").select("text", "toxic"))
    listed = spark.sparkContext.broadcast((odds, prior))

    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        odds, prior = listed.value
        for batch in batches:
            yield pa.array([Described(t.as_py(), odds, prior).votes for t in batch])

    voted = F.arrow_udf(votes, "string").asNondeterministic()
    found = texts.select(voted("text").alias("votes")).groupBy("votes").count().collect()  # at most 3 ** 10 patterns
    patterns = np.array([[int(v) for v in r["votes"]] for r in found], np.int8).reshape(-1, len(JUNK_VOTES) + len(TOXIC_VOTES))
    counts = np.array([r["count"] for r in found], float)
    parts = (slice(0, len(JUNK_VOTES)), slice(len(JUNK_VOTES), None))
    junk_at, toxic_at = (dict(zip([r["votes"] for r in found], fit_votes(patterns[:, p], counts), strict=True)) for p in parts)

    sample = _bounded(texts, most_training, "doc_id", "text")
    kind = pa.struct([("votes", pa.string()), ("index", pa.binary())])

    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        odds, prior = listed.value
        for batch in batches:
            told = (Described(t.as_py(), odds, prior) for t in batch)
            yield pa.array([{"votes": d.votes, "index": d.features().tobytes()} for d in told], kind)

    described = F.arrow_udf(describe, "struct<votes:string,index:binary>").asNondeterministic()
    taken = sample.select("doc_id", described("text").alias("d")).select("doc_id", "d.*").toLocalIterator(prefetchPartitions=True)
    taken = sorted(((r["votes"], bytes(r["index"])) for r in taken))  # the order of arrival must not matter
    rows = [np.frombuffer(index, np.int32) for _, index in taken]

    def scorer(posterior: dict[str, float]) -> np.ndarray | None:
        wanted = np.array([posterior[v] for v, _ in taken])
        return train(rows, wanted) if len(rows) and (wanted > 0.5).any() else None

    return QualityModel(scorer(junk_at), scorer(toxic_at) if odds else None, odds, prior)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "__judged__", **options) -> DataFrame:
    """All columns of ``docs`` plus ``out``: struct(quality, toxicity), each from 0 to 1.

    Null, empty and blank texts have quality and toxicity 0.  A column that is
    already called ``out`` is replaced.
    """
    model = fit_quality(docs, labels, id_col, text_col, **options)
    blank = F.struct(F.lit(0.0).alias("quality"), F.lit(0.0).alias("toxicity"))
    return docs.withColumn(out, F.coalesce(model.judge(docs.sparkSession)(F.col(f"`{text_col}`")), blank))


def accepted(verdict: Column, least_quality: float = 0.5, most_toxicity: float = 0.5) -> Column:
    return (verdict["quality"] >= least_quality) & (verdict["toxicity"] < most_toxicity)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, quality, toxicity, keep: one row per document, repeated rows included."""
    v = F.col("__judged__")
    return judged(docs, labels, id_col, **options).select(
        F.col(id_col).alias("doc_id"), v["quality"].alias("quality"), v["toxicity"].alias("toxicity"), accepted(v).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    return judged(docs, labels, **options).where(accepted(F.col("__judged__"))).select(*[F.col(f"`{c}`") for c in docs.columns])
