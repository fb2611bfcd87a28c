"""Toxicity: held-out accuracy, the label model on known rates, and edge cases."""

import zlib

import numpy as np

from terradelta.llm import toxicity as t

DOCS, LABELS = "doc_id long, text string, score double, toxic int", "doc_id long, quality int, toxic int"


def test_held_out_rows_of_the_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = t.op12_toxicity(spark, d).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out]
    hit, said, real = ((held.predicted == 1) & (held.toxic == 1)).sum(), (held.predicted == 1).sum(), (held.toxic == 1).sum()
    assert hit / said > 0.95 and hit / real > 0.9


def test_label_model_finds_rates_and_copies(spark):
    rnd = np.random.default_rng(1)
    n, truth = 20_000, np.array([0.8, 0.7, 0.9, 0.6])
    y = rnd.random(n) < 0.2
    votes = np.stack([np.where(y, rnd.random(n) < p, rnd.random(n) < 0.05) for p in truth], 1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)  # two voters that repeat the first
    rows, c = np.unique(votes @ (1 << np.arange(6)), return_counts=True)
    own = t._own_sums(votes[:50] @ (1 << np.arange(6)), y[:50].astype(int), 6)
    m = t.LabelModel(6, 0.2)
    m.fit(spark.createDataFrame([(int(a), int(b)) for a, b in zip(rows, c, strict=True)], "votes long, c long"), own)
    assert np.abs(m.rates[1][:4] - truth).max() < 0.06 and np.abs(m.rates[0][:4] - 0.05).max() < 0.03
    assert m.weights[0] < 0.5 and m.weights[1] > 0.8
    q = m.posterior(t._bits(rows, 6))
    found = q[np.searchsorted(rows, votes @ (1 << np.arange(6)))] > 0.5
    assert (found == y).mean() > 0.95


def test_terms_are_words_or_the_widest_starts():
    best = [("abcde", 26, 53.0), ("abcd", 44, 51.0), ("idiot$", 40, 45.0), ("idi", 40, 45.0), ("abc", 44, 40.0)]
    assert sorted(t.widest(best)) == ["abcd", "idiot$"]
    v = t.Voters(["abcd", "idio$"])
    assert [v.term(w) for w in ("abcdx", "abcd", "idio", "idiot", "abc")] == [0, 0, 1, 2, -1]


def table(n=240):
    """A third of the rows toxic, by a word that no list names."""
    return [(i, f"some words number {i} " + ("you zorkel and zorkelish thing" if i % 3 == 0 else "you fine and pleasant thing"), 0.5, 1) for i in range(n)], [(i, 1, int(i % 3 == 0)) for i in range(n)]


def score(spark, docs, labels):
    return {(r.doc_id, i): r for i, r in enumerate(t.Model(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).scores().collect())}


def test_learns_words_from_labels_outside_the_held_out_ones(spark):
    docs, labels = table()
    got = score(spark, docs, labels)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got.values())
    other = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, q, x in labels]
    assert sorted(map(tuple, score(spark, docs, other).values())) == sorted(map(tuple, got.values()))


def test_edge_cases(spark):
    docs, labels = table()
    docs += [(None, docs[0][1], None, None), (900, None, 0.0, 0), (901, "", 0.0, 0), (0, docs[0][1], 0.1, 0), (902, "words " * 50_000, 0.0, 0)]
    labels += [(0, 1, 0), (1, 1, None), (None, 1, 1), (5000, 1, 1)]
    got = score(spark, docs, labels).values()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].score == by[0][0].score == by[0][1].score and by[None][0].held_out is False
    assert by[900][0].score == by[901][0].score < 0.3 and by[902][0].predicted == 0
    assert score(spark, [], []) == {} and score(spark, [], labels) == {}


def test_without_labels_the_insults_vote(spark):
    docs = [(i, f"text {i} " + ("you stupid worthless idiot" if i % 5 == 0 else "nothing much of note today"), 0.0, 0) for i in range(100)]
    got = score(spark, docs, []).values()
    assert min(r.score for r in got if r.doc_id % 5 == 0) > max(r.score for r in got if r.doc_id % 5)
