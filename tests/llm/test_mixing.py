import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from terradelta.llm import mixing


def test_fill_reshares_the_excess():
    assert mixing.fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.fill([10, 0], [1, 1], 15, 2) == [15.0, 0.0] and mixing.fill([0], [1], 0, 2) == [0.0]


def brute_cost(patterns, quotas, repeats):
    """(largest flow, least cost) over all whole flows of a tiny network."""
    edges = [(p, s) for p, (_, ss) in enumerate(patterns) for s in ss]
    best = (0, 0)
    for x in itertools.product(*[range(min(patterns[p][0] * repeats, quotas[s]) + 1) for p, s in edges]):
        give, get = [0] * len(patterns), [0] * len(quotas)
        for (p, s), v in zip(edges, x):
            give[p] += v
            get[s] += v
        if any(g > w * repeats for g, (w, _) in zip(give, patterns)) or any(g > q for g, q in zip(get, quotas)):
            continue
        cost = sum(max(0, g - k * w) - max(0, g - (k + 1) * w) for g, (w, _) in zip(give, patterns) for k in range(repeats) for _ in range(k))
        best = max(best, (sum(x), -cost))
    return best


def test_flow_is_cheapest():
    rnd = random.Random(3)
    for _ in range(12):
        patterns = [(rnd.randrange(4), rnd.sample(range(2), rnd.choice([1, 2]))) for _ in range(3)]
        quotas = [rnd.randrange(6) for _ in range(2)]
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        give = [sum(v for (p, _), v in flow.items() if p == q) for q in range(3)]
        cost = sum(max(0, g - w) for g, (w, _) in zip(give, patterns))
        assert (sum(give), -cost) == brute_cost(patterns, quotas, 2)


def test_op3_contract(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randrange(60)), rnd.choice(["a", "b", "b", "c", "c", "c", "c", None])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "z"), (5002, "x " * 4000, "c"), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.op3_mixing(spark, str(tmp_path)).collect()))
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    source = {r[0]: r[2] for r in rows}
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in set(source.values())}
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert r.source_size == total[source[r.doc_id]] and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    names = sorted((s for s in total if s is not None)) + [None]
    want = dict(zip(names, mixing.fill([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(total.values()), 2)))
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]])
    for s in total:
        assert abs(taken[s] - want[s]) <= (4000 if s == "c" else 60)


def test_overlapping_sources_and_empty(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 3 else ["a"], 10) for i in range(300)], "doc_id long, sources array<string>, size long")
    got = mixing.mix_sizes(docs, weights=(1, 1))
    assert got.count() == 300 and got.where("copies > 2").count() == 0
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    docs = docs.select("doc_id", F.lit("t u").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("size"))
    assert mixing.mix_documents(docs).count() == 450 and mixing.mix_documents(docs).columns == docs.columns


def test_documents_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "a", "one two three"), (1, "b", "four five six")], "doc_id long, source string, text string")
    got = mixing.mix_documents(docs, weights=[1.0], share=1.0).collect()
    assert {r.doc_id for r in got} == {None, 1}


def test_repeated_rows_share_copies_alike_on_every_run(spark):
    docs = spark.createDataFrame([(1, "a", "one two three", x) for x in range(9)] + [(2, "a", "four five", 9)], "doc_id long, source string, text string, other int")
    runs = [sorted(r.other for r in mixing.mix_documents(docs.repartition(n), weights=[1.0], share=1.4).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and 10 <= len(runs[0]) < 20
