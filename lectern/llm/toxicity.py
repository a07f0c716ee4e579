"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text and the first letters of its words other than
identity terms, present or not. Weights are a logistic regression with one more penalty: in labelled texts
that mention a group, the mention is swapped for other groups of its kind, and
changes of the score are penalised. So the name of a group says nothing by
itself. The model is a bounded table; scoring is local to a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.llm.langid import training_rows

#: bounds of the training sample and of the model
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 3000, 6000, 4096
#: log-likelihood ratio that a feature needs; chance gives it once in a million features
MIN_EVIDENCE = 24.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: identity terms by kind; terms of one kind are swapped for each other
IDENTITY = [
    "women men girls boys frauen männer femmes hommes mujeres hombres",
    "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist",
    "black white asian latino african european arab hispanic",
    "gay straight lesbian bisexual transgender heterosexual homosexual queer",
    "immigrants refugees foreigners natives citizens migranten flüchtlinge immigrés réfugiés inmigrantes refugiados",
    "disabled blind deaf autistic elderly young old poor rich",
]


TERMS = frozenset(t for kind in IDENTITY for t in kind.split())


def features_of(text: str | None) -> set[str]:
    """Lower-case words, and the first letters of longer ones with a star; identity terms are whole words only."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({w[:k] + "*" for w in words - TERMS if len(w) > k} for k in PREFIXES))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f: w for f, w in weights.items() if not f.endswith("*")}
        self.heads = {k: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == k + 1} for k in PREFIXES}

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        logit = self.bias + sum(self.words[w] for w in sorted(words & self.words.keys()))
        for k, heads in self.heads.items():
            if heads:
                found = {w[:k] for w in words - TERMS if len(w) > k} & heads.keys()
                logit += sum(heads[h] for h in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def swaps() -> list[tuple[str, str]]:
    return [(a, b) for kind in IDENTITY for a in kind.split() for b in kind.split() if a < b]


def train(rows: list[list[int]], toxic: np.ndarray, names: list[str], rounds: int = 400, decay: float = 2e-4, fair: float = 1.0) -> Model:
    """Full-batch Adam on logistic loss, squared weights and squared score changes under swaps.

    A labelled text that holds one of two terms of a kind is scored once more with
    the other in its place. Identity terms have no other feature than their word,
    so that changes the score by the difference of two weights, and texts with the
    same swap are counted together; where both terms stand, a swap changes nothing.
    Each pair counts at least once, so terms that no labelled text holds keep together too.
    """
    n, m = len(rows), len(names)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), dtype=np.int64, count=len(row))
    index = {f: i for i, f in enumerate(names)}
    df = np.bincount(col, minlength=m)
    pairs = [(index[a], index[b]) for a, b in swaps() if a in index and b in index]
    left, right = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    terms = {index[t] for t in TERMS if t in index}
    both = Counter(pair for r in rows if len(held := sorted(terms.intersection(r))) > 1 for pair in combinations(held, 2))
    together = np.array([both[min(p), max(p)] for p in pairs], dtype=np.int64)
    pull = fair * (df[left] + df[right] - 2 * together + 1) / max(1, n)
    positive = max(1, int(toxic.sum()))
    each = np.where(toxic, 0.5 / positive, 0.5 / max(1, n - positive))
    w, bias = np.zeros(m), 0.0
    mean, spread, rate = np.zeros(m + 1), np.zeros(m + 1), 0.05
    for t in range(1, rounds + 1):
        logit = bias + np.bincount(row, weights=w[col], minlength=n)
        wrong = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - toxic) * each
        grad = np.bincount(col, weights=wrong[row], minlength=m) + decay * w
        gap = pull * (w[left] - w[right])
        np.add.at(grad, left, gap)
        np.add.at(grad, right, -gap)
        both = np.append(grad, wrong.sum())
        mean = 0.9 * mean + 0.1 * both
        spread = 0.999 * spread + 0.001 * both**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_features: int = MAX_FEATURES) -> Model:
    """The classifier from a bounded sample of labelled training rows.

    About ``max_toxic`` and ``max_clean`` rows with the smallest seeded hash
    are used. Features whose shares differ no more than chance allows are left
    out; of the rest those with the most evidence stay. Without rows of both labels every
    score is the share of toxic rows. A key labelled twice counts as toxic if
    one label says so.
    """
    spark = docs.sparkSession
    known = labels.where(training_rows(key) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        share = 1.0 if counts.get(1) else 0.0
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    draw = F.pmod(F.xxhash64("k", F.lit(31)), F.lit(1_000_000))
    cut = F.when(F.col("y") == 1, int(1_000_000 * min(1.0, max_toxic / counts[1]))).otherwise(int(1_000_000 * min(1.0, max_clean / counts[0])))
    drawn = known.where(draw < cut)
    # at most the bounds of the sample, ids and labels only
    sample = docs.join(F.broadcast(drawn), F.col(key) == F.col("k")).select(F.col(text).alias("t"), "y", F.col(key).alias("k"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                found = features_of(t.as_py())
                seen.update(found)
                if y.as_py():
                    bad.update(found)
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()), pa.array([bad[f] for f in names], pa.int64())],
            names=["f", "n", "bad"],
        )

    tallied = sample.mapInArrow(tally, "f string, n bigint, bad bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n_bad, n_all = min(counts[1], max_toxic), min(counts[1], max_toxic) + min(counts[0], max_clean)
    share = n_bad / n_all
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    evidence = 2 * (part(F.col("bad"), F.col("n") * share) + part(F.col("n") - F.col("bad"), F.col("n") * (1 - share)))
    best = tallied.withColumn("g", evidence).where(F.col("g") >= MIN_EVIDENCE).orderBy(F.desc("g"), "f").limit(max_features).select("f").collect()
    names = sorted({r["f"] for r in best} | TERMS)
    shipped = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            rows = [sorted(index[f] for f in features_of(t.as_py()) if f in index) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["x", "y", "k"])

    kinds = ", ".join(f"{n} {sample.schema[n].dataType.simpleString()}" for n in ("y", "k"))
    got = sample.mapInArrow(indices, f"x array<int>, {kinds}").collect()
    got.sort(key=lambda r: (r["k"], r["x"]))
    return train([r["x"] for r in got], np.array([bool(r["y"]) for r in got]), names)


def judge_toxicity(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` to every row; a null or empty text scores by the bias alone.

    Other columns stay as they are; columns of these two names are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        own = shipped.value
        return pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    scored = docs.withColumn("score", F.arrow_udf(run, DoubleType())(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
