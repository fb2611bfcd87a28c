"""Toxicity by weak supervision: many voters, a label model, a linear classifier.

1. Terms.  A bounded sample of labelled rows (about LABELLED, by hash) gives,
   for every word and every start of a word, in how many toxic and clean texts it
   stands.  Those whose share of toxic texts is surely above the usual one (WILSON
   deviations) are taken by likelihood ratio, none that starts another one, and
   each becomes a lexicon voter; so do the fixed INSULTS.
2. Patterns vote besides: several hits, several different words, hits per word,
   shouting, rows of exclamation marks.  One pass over all whole texts gives each
   its votes as bits and a few counts; this table is stored.
3. Label model.  The counts of equal votes over all documents, a table that
   Spark keeps, are explained by a hidden class: expectation and maximisation
   estimate for each voter how often it votes on toxic and on clean texts.  The
   labelled sample is where they start, and counts as what it is.  Every few
   steps the correlations of each two voters within a class are taken from the
   same sums, and voters that repeat each other lose weight.
   A task sends one matrix of voters by voters; nothing grows with the corpus.
4. A logistic regression on votes and counts is fitted to the posterior labels
   of a bounded sample of documents (TRAINED), and its margin is brought to the
   scale of the labelled sample, so that scores are shares of toxic texts.

Labels are read only where crc32 of the doc_id modulo 3 is not 1; they, lang,
source and doc_id are never inputs of a score: equal texts have equal scores.

Edge cases: a null or empty text has no votes and is scored by that; a null
doc_id is not held out and has no label; repeated labels of a document count as
toxic if one does; null labels are none; without labelled rows, or without toxic
ones, a share of PRIOR is toxic and the INSULTS and patterns vote alone, so that
scores rank texts but are on no scale; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import ship, stored

# fixed values: English insults
INSULTS = ("bastard", "clown", "disgusting", "filthy", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Labelled rows to learn from, and documents that the classifier is fitted to; about so many, never over twice.
LABELLED, TRAINED = 12_000, 30_000
#: Lengths of starts of words, toxic texts that a term needs, terms at most.
STARTS, LEAST_TOXIC, TERMS = range(3, 9), 6, 50
WILSON, LIFT, PRIOR = 3.0, 2.5, 0.05
#: A start is wider than a term from so many times its texts on, with so much of its gain.
WIDER = 1.2, 0.9
#: Steps of the estimation, and after how many the weights are taken anew.
STEPS, WEIGH = 16, 4
#: Entries of a task's tables before they are emptied.
HELD = 200_000
CUT = 0.7
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("any", "two", "three", "five", "two_words", "three_words", "per_1000", "per_200", "per_50", "shouting", "exclaiming")
FEATURES = "doc_id long, mark long, votes long, hits long, kinds long, n_words long"


def learnable(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def some_of(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """All of n rows if they are most or fewer, else about so many, by a hash; never over twice as many."""
    return rows.where(F.pmod(key, F.lit(-(-n // most))) == 0).limit(2 * most) if n > most else rows


def sample_of_labels(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, toxic) of a bounded number of labelled rows; equal texts once."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable("doc_id"))
    own = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = F.broadcast(some_of(own, F.xxhash64("_id"), own.count(), most))  # at most twice so many rows of two numbers
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(own, "_id")
    return d.withColumn("_h", F.xxhash64("text")).groupBy("_h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("_h")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[Counter[str]] = [Counter(), Counter()]

    def packed() -> pa.RecordBatch:
        terms = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in held]], names=["term", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = {w for w in WORD.findall(text.as_py().lower()) if len(w) < 40}
            held[1 if toxic else 0].update({w + "$" for w in words if len(w) >= STARTS[0]} | {w[:k] for w in words for k in STARTS if len(w) > k})
            if len(held[0]) + len(held[1]) > HELD:
                yield packed()
                held[0].clear()
                held[1].clear()
    if held[0] or held[1]:
        yield packed()


def terms_of(sample: DataFrame) -> tuple[list[str], int, int]:
    """Words ("word$") and starts of words that toxic texts hold far more often; toxic and clean texts."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], toxic, clean
    base = toxic / (toxic + clean)
    t = sample.mapInArrow(_terms_of, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("f"), F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_TOXIC)
    m, p = F.col("t") + F.col("f"), F.col("t") / (F.col("t") + F.col("f"))
    sure = (p + WILSON**2 / (2 * m) - WILSON * F.sqrt(p * (1 - p) / m + WILSON**2 / (4 * m * m))) / (1 + WILSON**2 / m)
    gain = F.col("t") * F.log(p / base) + F.when(F.col("f") > 0, F.col("f") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    best = t.where(sure > min(LIFT * base, (1 + base) / 2)).select("term", "t", gain.alias("gain")).orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(20 * TERMS).collect()  # a bounded list
    return sorted(widest([(r["term"], r["t"], r["gain"]) for r in best])), toxic, clean


def widest(best: list[tuple[str, int, float]], most: int = TERMS) -> list[str]:
    """Of (term, toxic texts, gain) in falling order of gain the terms none of which starts another.

    A start takes the place of a longer term if it reaches WIDER times its toxic
    texts at nearly its gain.
    """
    stem = lambda x: x.rstrip("$")
    chosen: dict[str, tuple[int, float]] = {}
    for x, t, gain in best:
        longer = [c for c in chosen if stem(c).startswith(stem(x))]
        if longer and t >= WIDER[0] * max(chosen[c][0] for c in longer) and gain >= WIDER[1] * max(chosen[c][1] for c in longer):
            for c in longer:
                del chosen[c]
        elif longer or any(stem(x).startswith(stem(c)) for c in chosen):
            continue
        if len(chosen) < most:
            chosen[x] = t, gain
    return list(chosen)


class Voters:
    """The bits of a text's votes: one for each term, one for the insults, one for each pattern."""

    def __init__(self, terms: list[str]):
        self.names = [*terms, "insults", *PATTERNS]
        self.whole = {w: len(terms) for w in INSULTS} | {t[:-1]: i for i, t in enumerate(terms) if t.endswith("$")}
        self.starts = {t: i for i, t in enumerate(terms) if not t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.starts})
        self.known: dict[str, int] = {}

    def term(self, word: str) -> int:
        """The number of the term that a word belongs to, or -1."""
        if word in self.whole:
            return self.whole[word]
        return next((self.starts[word[:k]] for k in self.lengths if word[:k] in self.starts and len(word) >= k), -1)

    def of(self, text: str) -> tuple[int, int, int, int]:
        """(votes, hits, different words hit, words) of a text."""
        words = Counter(WORD.findall(text.lower()))
        votes = hits = kinds = 0
        known = self.known
        for word, n in words.items():
            at = known.get(word)
            if at is None:
                if len(known) > HELD:
                    known.clear()
                known[word] = at = self.term(word)
            if at >= 0:
                votes |= 1 << at
                hits += n
                kinds += 1
        total = sum(words.values())
        upper = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", text)))
        signs = (hits >= 1, hits >= 2, hits >= 3, hits >= 5, kinds >= 2, kinds >= 3, hits * 1000 >= max(total, 1), hits * 200 >= max(total, 1), hits * 50 >= max(total, 1), upper * 2 > len(text), text.count("!") * 10 > total > 0)
        for i, sign in enumerate(signs, len(self.names) - len(PATTERNS)):
            votes |= int(sign) << i
        return votes, hits, kinds, total


def _features(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(terms)
        for batch in batches:
            rows = [voters.of(text.as_py() or "") for text in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "mark", "votes", "hits", "kinds", "n_words"])

    return run


def features(texts: DataFrame, terms: list[str]) -> DataFrame:
    """texts(doc_id, mark, text) as votes and counts."""
    return texts.mapInArrow(_features(terms), FEATURES)


def _bits(votes: np.ndarray, n: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(n)[None, :] & 1).astype(float)


class LabelModel:
    """How often each voter votes on toxic and on clean texts, and how far voters repeat each other."""

    def __init__(self, n: int, prior: float):
        self.n, self.prior = n, prior
        self.rates = np.full((2, n), 0.5)
        self.weights = np.ones(n)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.rates), np.log(1 - self.rates)
        odds = np.log(self.prior / (1 - self.prior)) + bits @ (self.weights * (yes[1] - yes[0])) + (1 - bits) @ (self.weights * (no[1] - no[0]))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def sums(self, counts: DataFrame) -> np.ndarray:
        """[class, voter, voter]: texts of each class by the posterior in which both voted; the last voter is always one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, self.n + 1, self.n + 1))
            for batch in batches:
                b = _bits(batch.column("votes").to_numpy(), self.n)
                q, c = self.posterior(b), batch.column("c").to_numpy()
                b = np.concatenate([b, np.ones((len(b), 1))], 1)
                total += np.stack([b.T @ (b * (w * c)[:, None]) for w in (1 - q, q)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        out = np.zeros((2, self.n + 1, self.n + 1))
        for r in counts.mapInArrow(run, "sums binary").collect():  # one matrix of fixed size for each task
            out += np.frombuffer(r["sums"]).reshape(out.shape)
        return out

    def take(self, sums: np.ndarray) -> None:
        self.rates = (sums[:, -1, :-1] + 0.5) / (sums[:, -1, -1:] + 1)

    def correlations(self, sums: np.ndarray) -> np.ndarray:
        """[class, voter, voter] within each class."""
        both = sums[:, :-1, :-1] / np.maximum(sums[:, -1:, -1:], 1e-9)
        mean = sums[:, -1, :-1] / np.maximum(sums[:, -1, -1:], 1e-9)
        cov = both - mean[:, :, None] * mean[:, None, :]
        sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 1e-12))
        return cov / (sd[:, :, None] * sd[:, None, :])

    def fit(self, counts: DataFrame, own: np.ndarray) -> None:
        """counts(votes, c) of all documents; own: the sums of the labelled sample, class by class."""
        self.take(own)
        for step in range(STEPS):
            sums = self.sums(counts) + own
            self.take(sums)
            if step % WEIGH == WEIGH // 2:
                shared = (self.correlations(sums) ** 2).mean(0)
                np.fill_diagonal(shared, 1)
                self.weights = 1 / shared.sum(1)


def _own_sums(rows: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
    b = np.concatenate([_bits(rows, n), np.ones((len(rows), 1))], 1)
    return np.stack([b[toxic == k].T @ b[toxic == k] for k in (0, 1)])


def design(votes: np.ndarray, hits: np.ndarray, kinds: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """What the classifier sees of texts: the votes, counts on a scale of logarithms, one."""
    per = np.log1p(1000 * hits / np.maximum(words, 1))
    return np.concatenate([_bits(votes, n), np.stack([np.log1p(hits), np.log1p(kinds), per, np.log1p(words) / 10, np.ones(len(votes))], 1)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on shares y, by Newton's steps."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _table(rows: list) -> tuple[np.ndarray, ...]:
    return tuple(np.array([r[c] for r in rows], np.int64) for c in ("votes", "hits", "kinds", "n_words"))


class Model:
    """Terms, label model and classifier, learnt from docs(doc_id, text) and labels(doc_id, toxic)."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        ship(docs.sparkSession)
        sample, _ = stored(sample_of_labels(docs, labels), "toxic-sample")
        self.terms, toxic, clean = terms_of(sample)
        self.n = len(Voters(self.terms).names)
        own = features(sample.select(F.lit(None).cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("mark"), "text"), self.terms).collect()  # at most twice LABELLED rows of numbers
        seen, marks = _table(own), np.array([r["mark"] for r in own], np.int64)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
        self.rows, _ = stored(features(texts, self.terms), "toxic-votes")
        self.labels = LabelModel(self.n, min(max(toxic / (toxic + clean), 0.001), 0.5) if toxic and clean else PRIOR)
        sums = _own_sums(seen[0], marks, self.n)
        if not toxic or not clean:
            sums = self.guessed()
        counts, _ = stored(self.rows.groupBy("votes").agg(F.count("*").alias("c")), "toxic-counts")
        self.labels.fit(counts, sums)
        n = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        some = _table(some_of(self.rows, F.col("mark"), n, TRAINED).select("votes", "hits", "kinds", "n_words").collect())  # at most twice TRAINED rows of numbers
        x = np.concatenate([design(*some, self.n), design(*seen, self.n)])
        self.weights = logistic(x, self.labels.posterior(x[:, : self.n]))
        if toxic and clean:
            margin = design(*seen, self.n) @ self.weights
            scale = logistic(np.stack([margin, np.ones(len(margin))], 1), marks.astype(float), 1e-3)
            self.weights = self.weights * scale[0]
            self.weights[-1] += scale[1]

    def guessed(self) -> np.ndarray:
        """Sums to start from without labels: all voters but shouting and exclaiming stand on toxic texts, and seldom on others."""
        sums = np.zeros((2, self.n + 1, self.n + 1))
        for k, rate in ((0, 0.02), (1, 0.7)):
            r = np.append(np.full(self.n, rate), 1.0)
            r[self.n - 2 : self.n] = 0.1
            sums[k] = 20 * (r[:, None] * r[None, :])
        return sums

    def scores(self) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        weights, n = self.weights, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_numpy() for c in ("votes", "hits", "kinds", "n_words")]
                score = 1 / (1 + np.exp(-np.clip(design(*columns, n) @ weights, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(score, 6))], names=["doc_id", "score"])

        d = self.rows.mapInArrow(run, "doc_id long, score double")
        return d.select("doc_id", F.coalesce(~learnable("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).scores()
