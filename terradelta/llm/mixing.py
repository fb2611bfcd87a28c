"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by
membership pattern (the sorted set of their sources): one row per pattern with
its words.  The flow network has an edge from each pattern to each of its
sources; every source wants its quota, every pattern can give its words once at
cost 0, and again at higher cost for each repetition (convex costs), at most
``max_repeats`` times in all.  The cheapest flow says how many words of which
pattern count for which source.  Sources whose documents belong to no other
source need no network: their one pattern takes the target.  The network holds
the patterns of overlapping sources, never documents; more than MAX_PATTERNS of
these are an error.

Selection.  A pattern's flow is so many full copies of all its documents and a
rest.  Documents get a seeded hash; the rest goes to those of the lowest
hashes.  The limit is found from sums per hash bucket (partial sums first; more
buckets for more rows), and only the one bucket at the limit is put in order and
cut, so no pattern, however large, is sorted or gathered.  The last document taken is the one that brings
the sum nearest to the rest, so a source misses its quota by less than the
size of one document of its patterns.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, after all others; repeated rows are rows of their own with
the same hash, ordered by size, and so are rows of one doc_id with different
texts and rows without doc_id; with no words at all every target is 0; an empty
table gives an empty result; other columns pass through ``mix_documents``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terradelta.llm.common import WORD, small_or_not, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
MAX_PATTERNS = 20_000
SEED = 17
#: Hash buckets of a pattern at least, and rows that a bucket holds at most, about.
BUCKETS, BUCKET_ROWS = 4096, 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most * size; the excess is shared again."""
    target, open_, left = [0.0] * len(sizes), [i for i in range(len(sizes))], total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return target


def min_cost_flow(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], repeats: int) -> dict[tuple[int, int], int]:
    """{(pattern, source): words}: the cheapest flow of the largest size.

    patterns: (words, sources).  The k-th copy of a pattern's words costs k - 1
    a word.  Shortest augmenting paths; costs are whole and the potentials keep
    reduced costs non-negative.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, place of the reverse edge]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (words, sources) in enumerate(patterns):
        for k in range(repeats):
            edge(start, p, words, k)
        for s in sources:
            edge(p, n + s, words * repeats, 0)
    for s, quota in enumerate(quotas):
        edge(n + s, end, quota, 0)
    potential = [0] * len(graph)
    while True:
        cost, way, heap = {start: 0}, {}, [(0, start)]
        done = set()
        while heap:
            c, a = heappop(heap)
            if a in done:
                continue
            done.add(a)
            for i, (b, room, w, _) in enumerate(graph[a]):
                if room > 0 and (d := c + w + potential[a] - potential[b]) < cost.get(b, 1 << 62):
                    cost[b], way[b] = d, (a, i)
                    heappush(heap, (d, b))
        if end not in cost:
            break
        for a, c in cost.items():
            potential[a] += min(c, cost[end])
        for a in range(len(graph)):
            if a not in cost:
                potential[a] += cost[end]
        room, b = 1 << 62, end
        while b != start:
            a, i = way[b]
            room, b = min(room, graph[a][i][1]), a
        b = end
        while b != start:
            a, i = way[b]
            graph[a][i][1] -= room
            graph[b][graph[a][i][3]][1] += room
            b = a
    return {(p, e[0] - n): patterns[p][0] * repeats - e[1] for p in range(n) for e in graph[p] if n <= e[0] < n + m and e[1] < patterns[p][0] * repeats}


def select_seeded(docs: DataFrame, taken: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, pattern, size) with copies; taken: (pattern, words, full, rest).

    full copies of every document of the pattern, and one more for documents
    of the lowest hashes up to rest words.
    """
    d = docs.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("u", F.lit(buckets)).cast("int"))
    sums = d.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("words").over(run)).join(taken, "pattern")  # at most the buckets of a pattern
    cut = sums.where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select("pattern", F.col("bucket").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("inside"))
    cut, _ = stored(taken.join(cut, "pattern", "left").select("pattern", "full", "rest", "cut", "inside"), "mix-cut")
    d = d.join(F.broadcast(cut) if cut.count() <= MAX_PATTERNS else cut, "pattern")  # a row per pattern
    edge = d.where(F.col("bucket") == F.col("cut"))
    order = Window.partitionBy("pattern").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("more", 2 * (F.col("inside") - F.col("before")) >= F.col("size"))
    whole = d.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn("more", F.col("rest").isNotNull() & (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))))
    both = whole.unionByName(edge.drop("before"))
    return both.withColumn("copies", F.col("full") + F.col("more").cast("int")).drop("u", "bucket", "cut", "inside", "full", "rest", "more")


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, sources, size, copies, ...) for docs(doc_id, sources array<string>, size, ...).

    Also the source's size and target, for the first source of each document.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("pattern", F.array_sort("sources", lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0)))
    found = docs.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()  # a row per pattern
    names = sorted({s for r in found for s in r["pattern"]}, key=lambda s: (s is None, s.encode("utf-32-be") if s is not None else b""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["pattern"]:
            sizes[at[s]] += r["words"]
    target = fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r["words"] for r in found), repeats)
    shared = {s for r in found if len(r["pattern"]) > 1 for s in r["pattern"]}
    net = [p for p, r in enumerate(found) if shared.intersection(r["pattern"])]
    if len(net) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of overlapping sources")
    flow = min_cost_flow([(found[p]["words"], [at[s] for s in found[p]["pattern"]]) for p in net], [round(t) if s in shared else 0 for s, t in zip(names, target, strict=True)], repeats)
    given = {p: sum(flow.get((i, at[s]), 0) for s in found[p]["pattern"]) for i, p in enumerate(net)}
    rows = []
    for p, r in enumerate(found):
        words = given[p] if p in given else min(round(target[at[r["pattern"][0]]]), repeats * r["words"]) if r["pattern"] else 0
        full = words // r["words"] if r["words"] else 0
        rows.append((r["pattern"], full, words - full * r["words"] if r["words"] else 0))
    taken = spark.createDataFrame(rows, "pattern array<string>, full int, rest long")
    buckets = max(BUCKETS, 1 << (max((r["rows"] for r in found), default=0) // BUCKET_ROWS).bit_length())
    per_source = (F.broadcast if len(names) <= MAX_PATTERNS else lambda x: x)(spark.createDataFrame(list(zip(names, sizes, target, strict=True)), "own string, source_size long, target double"))
    d = select_seeded(docs, F.broadcast(taken) if len(rows) <= MAX_PATTERNS else taken, seed, buckets)
    return d.join(per_source, F.get("pattern", F.lit(0)).eqNullSafe(F.col("own"))).withColumnRenamed("own", "own_source")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, source, text, ...) that the mix takes, each as often as it is taken."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.array("source").alias("sources"), n_words(F.col("text")).alias("size"))
    sized, _ = stored(sized, "mix-sizes")
    chosen = mix_sizes(sized, **options).groupBy(F.col("doc_id").alias("id"), F.col("own_source").alias("from"), "copy").agg(F.sum("copies").alias("copies"), F.count("*").alias("same")).where("copies > 0")
    chosen = small_or_not(chosen, "mix-chosen")
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("c"))
    d = d.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("from")) & (F.col("c") == F.col("copy")))
    once = d.where("same = 1").select("row", "copies")
    if not chosen.where("same > 1").isEmpty():  # repeated rows share their copies, the first ones have one more
        place = F.row_number().over(Window.partitionBy("id", "from", "copy").orderBy(F.xxhash64("row")))  # the same rows on every run
        more = d.where("same > 1").withColumn("k", place)
        once = once.unionByName(more.select("row", (F.floor(F.col("copies") / F.col("same")) + (F.col("k") <= F.col("copies") % F.col("same")).cast("long")).alias("copies")).where("copies > 0"))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array("source").alias("sources"), n_words(F.col("text")).alias("size"))
    sized, _ = stored(docs, "mix-sizes")
    d = mix_sizes(sized)
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
