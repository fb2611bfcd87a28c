import itertools
import random
import re

import pyarrow as pa

from terradelta.llm import ngram_join, shingles
from terradelta.llm.ngram_join import keep_one, ngram_components

SCHEMA = "doc_id long, text string, root string"


def brute(rows, k, percent):
    sets = {}
    for i, (doc, text, *_) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def rows_of(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünï", "a\x0bb"]
    rows = [(1000, None, "x"), (1001, "", "x"), (1002, " \n\t", "x"), (1003, "one Two", "x"), (1004, "ONE two", "x"), (1005, "one", "x")]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 80, 200]))] + passage * rnd.randrange(2)
        for _ in range(rnd.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randrange(3)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
            rows.append((len(rows), " ".join(copy), "x"))
    rows.append(rows[-1])
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, k, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 50)):
        rows = rows_of(seed)
        got = ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(3), k, percent)
        assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_crowds_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    rnd = random.Random(8)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(90)]
        for i in range(60):
            copy = list(base)
            for _ in range(rnd.randrange(8)):
                copy[rnd.randrange(90)] = f"e{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(copy), "x"))
    got = ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 85)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85)


def test_long_text_empty_table_and_keep_one(spark):
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(5, long, "a"), (3, long + " end", "b"), (9, None, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ngram_components(docs).collect())) == [(3, 39_998, 3), (5, 39_997, 3), (9, 0, 9)]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [3, 9]
    assert keep_one(docs).columns == ["doc_id", "text", "root"]
    assert ngram_components(docs.limit(0)).count() == 0


def test_keep_one_by_row(spark):
    a, b, c = "one two three four five six seven", "another text of its own with words", "eight nine ten eleven twelve thirteen"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string, _id string")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs([(*r, "s", "clash") for r in rows])).collect()), key=str)
    # a unique text stays although its id is that of a copy
    assert kept([(1, a), (5, b), (5, a)]) == [(1, a), (5, b)]
    # equal texts without an id leave one, repeated rows leave one, an id comes before none
    assert kept([(None, a), (None, a), (None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert kept([(2, a), (2, a), (None, a), (3, c), (3, c)]) == [(2, a), (3, c)]
    # rows without shingles are no group
    assert kept([(1, ""), (1, ""), (2, None), (None, None)]) == sorted([(1, ""), (1, ""), (2, None), (None, None)], key=str)
    assert kept([]) == []
    columns = ngram_join.keep_one(docs([(1, a, "s", "clash")])).columns
    assert columns == ["doc_id", "text", "source", "_id"]


def test_a_long_text_leaves_nothing_behind():
    before = [" ".join(f"w{i % 5000}" for i in range(n)) for n in (3, 5000, 400_000)]
    texts = [*before, None, "", *before[:2]]
    got = []
    for row, data, offsets in shingles.slices(pa.array(texts)):
        s, at = shingles.sets(data, offsets, 4)
        got += [s[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]
    assert [len(x) for x in got] == [1, 4997, 5000, 0, 0, 1, 4997]
    assert got[0] == got[5] and got[1] == got[6] and set(got[1]) < set(got[2])
    assert sum(x.nbytes for x in shingles._powers) <= 16 << 20
