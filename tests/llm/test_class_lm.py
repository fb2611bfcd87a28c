import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terradelta.llm import class_lm


def out(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def test_exchange_separates_alternating_words():
    b = np.zeros((9, 9))
    for i in range(4):
        for j in range(4, 8):
            b[i, j] = b[j, i] = 10 + i + j
    b[8, :4] = 3
    b[4:8, 8] = 3
    of = class_lm.exchange(b, 3, {8: 2})
    assert of[8] == 2 and len(set(of[:4])) == 1 and len(set(of[4:8])) == 1 and of[0] != of[4]


def test_base_counts_and_gain(spark):
    rnd = random.Random(1)
    tongues = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = [(i, " ".join(rnd.choice(rnd.choice([t]) if rnd.random() < 0.97 else tongues[0]) for _ in range(rnd.randrange(5, 80)))) for i in range(420) for t in [tongues[i % 3]]]
    rows += [(900, None), (901, ""), (902, "A0\tb1\x0bUNSEEN%d" % 5), rows[3]]
    got = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    low = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)}).split()
    counts = Counter(w for d, t in rows if not out(d) for w in low(t))
    ends = sum(not out(d) for d, _ in rows)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = {}
    for d, t in rows:
        c = [counts[w] for w in low(t)] + [ends]
        want[d] = (out(d), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gains_equal_likelihoods():
    rnd = np.random.default_rng(2)
    b = rnd.integers(0, 6, (12, 12)).astype(float)
    of = rnd.integers(0, 4, 12)

    def c_of(of):
        one = np.zeros((12, 4))
        one[np.arange(12), of] = 1
        return one.T @ b @ one

    w = 5
    one = np.zeros((12, 4))
    one[np.arange(12), of] = 1
    one[w] = 0
    left, right = b[:, w] @ one, b[w] @ one
    without = one.T @ b @ one
    gain = class_lm.gains(without, left, right, b[w, w])
    want = [class_lm.likelihood(c_of([*of[:w], k, *of[w + 1 :]])) for k in range(4)]
    assert np.allclose(gain - gain[0], np.array(want) - want[0])


def test_scores_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choice(words[i % 2 :: 2]) for _ in range(rnd.randrange(1, 40)))) for i in range(150)]
    monkeypatch.setattr(class_lm, "UNITS", 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    train = docs.where(~class_lm.held_out("doc_id"))
    counts = class_lm.word_counts(train).cache()
    head = class_lm.head_words(counts, 40)
    count = {r.word: r.c for r in counts.collect()}
    assert len(head) <= 40 and head == sorted(head, key=lambda x: (-x[1], x[0])) and min(c for _, c in head) >= max([c for w, c in count.items() if w not in dict(head)], default=0)
    send = spark.sparkContext.broadcast
    numbered = train.mapInArrow(class_lm._numbered(send(head)), "doc_id long, row long, n_tokens long, known long, logs double, units binary, rest array<string>")
    m = class_lm.Model(spark, counts, head, numbered.select("units"))
    index = {w: i for i, (w, _) in enumerate(head)}
    kind = lambda w: m.of[index.get(w, class_lm.RARE)]
    end = class_lm.FREE + 1
    pairs, size, members = Counter(), Counter(), Counter()
    for d, t in rows:
        if not out(d):
            path = [end, *map(kind, t.split()), end]
            pairs.update(zip(path, path[1:]))
            size.update(path[1:])
    members.update(kind(w) for w in count)
    members[end] = 1
    assert all(m.bigrams[a, b] == pairs[a, b] for a in range(class_lm.CLASSES) for b in range(class_lm.CLASSES))
    assert np.allclose((10**m.moves).sum(1), 1) and m.gained == sorted(m.gained)[: len(m.gained)] or m.gained[-1] <= max(m.gained)
    members[class_lm.FREE] += 1  # all unseen words
    assert all(abs(10 ** m.rooms[k] - max(size[k] + members[k], 1)) < 1e-6 for k in range(class_lm.CLASSES))
    given = Counter({end: m.ends + 1, class_lm.FREE: 1})
    for w, c in count.items():
        given[kind(w)] += c + 1
    assert all(given[k] / 10 ** m.rooms[k] == pytest.approx(1) for k in given)  # emissions sum to one
    assert len({m.of[i] for i in range(len(head))}) > 1 and all(m.of[i] < class_lm.FREE for i in range(len(head)))
    monkeypatch.setattr(class_lm, "HEAD", 40)
    for r in class_lm.score(docs).collect():
        t = dict(rows)[r.doc_id].split()
        path = [end, *map(kind, t), end]
        want = sum(m.moves[a, b] for a, b in zip(path, path[1:])) + sum(math.log10((count.get(w, 0) + 1) / (size[kind(w)] + members[kind(w)])) for w in t) + math.log10((m.ends + 1) / (size[end] + 1))
        assert r.score == pytest.approx(want) and r.perplexity == pytest.approx(10 ** (-want / r.n_tokens))


def test_tail_words_and_empty(spark, monkeypatch):
    rows = [(i, "common " * 3 + f"rare{i % 11} once{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in class_lm.score(docs).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 2)
    for r in class_lm.score(docs).collect():
        w = whole[r.doc_id]
        assert r.n_known == w.n_known and r.base_score == pytest.approx(w.base_score)
    assert class_lm.score(docs.limit(0)).count() == 0
