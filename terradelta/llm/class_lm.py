"""LM scoring with Brown's class-based bigrams.

P(text) is the product over its tokens of P(class | class before) and
P(token | class).  Tokens are the words, lower case in A-Z, and one end token;
the token before the first word is the end token.

Training, on the documents that are not held out:

1. Counts of all tokens, combined before the shuffle and stored: this table
   grows with the corpus and is never collected.  The HEAD most frequent words or
   fewer (a level of counts, found from a histogram of at most 64 * STEPS rows)
   come to the driver; HEAD bounds this.
2. Each text is turned into numbers once and stored: the WORDS most frequent
   words have numbers of their own, all others are RARE.
3. Exchange clustering.  The bigrams of the UNITS most frequent words, of RARE and of the
   end token give a first clustering on the driver, until a pass moves nothing.
   Then all WORDS words are exchanged in rounds: tasks count for every word the
   classes before and after it, the sums stay in Spark, and each word is held
   against the fixed class bigrams for the class that raises the likelihood
   most.  In the first round all words without a class take one, later in each
   round every other word may move, as all move at once.  Rounds end when the
   likelihood gains less than LEAST of itself, or falls (then the round is taken
   back), or after ROUNDS.  RARE and the end token have a class each; no word's
   class is taken from its spelling.  The driver holds class bigrams and a class per
   word.
4. Emissions: (c + 1) / (N_k + V_k) for a token of class k, with the count of the
   word itself, rare or not.  Unseen words are all of class RARE, where one more in
   the sum stands for them.  Transitions are shrunk to the class frequencies.  Both
   sum to one.

Scoring is one pass over the numbers.  Words below HEAD are joined with the
stored counts by word.  All such words are rare, so no key is hot.  perplexity is
10 ** (-score / n_tokens).

Edge cases: a null or empty text is one end token; a null doc_id counts as
training; repeated rows are scored each; without training documents every
class is equally likely and c is 0 for all; an empty table gives an empty
result; columns other than doc_id and text pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import GAP, ascii_lower, ship, stored

HEAD, WORDS, UNITS, CLASSES = 150_000, 32_766, 640, 64
RARE, END = WORDS, WORDS + 1
FREE = CLASSES - 2  # the last classes are those of RARE and END
SHRINK = 5.0
ROUNDS, LEAST = 4, 2e-4
STEPS = 16
#: Pieces of a task's counts, and how many are put together in one go.
PARTS, TOGETHER = 32, 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the words of docs(text); without the end token."""
    w = docs.select(F.explode(F.split(ascii_lower(F.coalesce("text", F.lit(""))), GAP)).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("c"))


def head_words(counts: DataFrame, head: int) -> list[tuple[str, int]]:
    """(word, c) of the most frequent words, at most head: all above a level of counts."""
    level = F.floor(F.log2("c") * STEPS).cast("int")
    sizes = counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect()  # at most 64 * STEPS rows
    least, n = None, 0
    for r in sizes:
        n += r["n"]
        if n > head:
            break
        least = r["l"]
    if least is None:
        return []
    rows = counts.where(level >= least).collect()  # at most head rows
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0].encode()))


def _numbered(shared):
    """Texts as numbers, with what their words' counts give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head = shared.value
        index = {w.encode(): i for i, (w, _) in enumerate(head)}
        logs = np.log10(np.array([c for _, c in head] + [0], np.float64) + 1)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                words = tokens(text.as_py())
                at = np.array([index.get(w, -1) for w in words], np.int64)
                rest = [words[i] for i in np.flatnonzero(at < 0).tolist()]
                units = np.where((at < 0) | (at >= WORDS), RARE, at).astype("<u2").tobytes()
                values = (row, len(words) + 1, len(words) - len(rest), float(logs[at[at >= 0]].sum()), units, rest)
                row += 1
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            arrays[-1] = arrays[-1].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "row", "n_tokens", "known", "logs", "units", "rest"])

    return run


def _paths(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[np.ndarray]:
    """Units of many texts with an end token before, between and after them."""
    hold, n, end = [], 0, np.array([END], "<u2").tobytes()
    for batch in batches:
        for x in batch.column("units"):
            x = x.as_py()
            hold += [end, x]
            n += len(x) // 2 + 1
            if n > size:
                yield np.frombuffer(b"".join([*hold, end]), "<u2").astype(np.int64)
                hold, n = [], 0
    if hold:
        yield np.frombuffer(b"".join([*hold, end]), "<u2").astype(np.int64)


class _Counts:
    """Sums by row * width + column in one array of fixed size; only keys that occur leave the task, in PARTS ranges of rows."""

    def __init__(self, rows: int, width: int):
        self.rows, self.width = rows, width
        self.total = np.zeros(rows * width, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.total += np.bincount(keys, minlength=len(self.total))

    def pieces(self) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys = np.flatnonzero(self.total)
        n = self.total[keys]
        firsts = [_rows(self.rows, p).start * self.width for p in range(PARTS + 1)]
        cuts = np.searchsorted(keys, firsts)
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                raw = zlib.compress((keys[a:b] - firsts[p]).astype("<i4").tobytes() + n[a:b].astype("<i8").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([raw], pa.binary())], names=["part", "task", "counts"])


def _rows(rows: int, p: int) -> range:
    """The rows of a part."""
    return range(rows * p // PARTS, rows * (p + 1) // PARTS)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 12
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n)


def _dense(raw: bytes, rows: int, width: int) -> np.ndarray:
    out = np.zeros(rows * width, np.int64)
    keys, n = _unpacked(raw)
    out[keys] = n
    return out.reshape(rows, width)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(0, np.int64)
    for x in table["counts"]:
        keys, n = _unpacked(x.as_py())
        if keys[-1] >= len(total):
            total = np.concatenate([total, np.zeros(keys[-1] + 1 - len(total), np.int64)])
        total[keys] += n
    keys = np.flatnonzero(total)
    raw = zlib.compress(keys.astype("<i4").tobytes() + total[keys].astype("<i8").tobytes(), 1)
    return pa.table({"part": table["part"].slice(0, 1).combine_chunks(), "task": table["task"].slice(0, 1).combine_chunks(), "counts": pa.array([raw], pa.binary())})


SCHEMA = "part int, task long, counts binary"


def summed(pieces: DataFrame, name: str) -> DataFrame:
    """One row per part, stored; TOGETHER pieces at most are added in one go, whatever the number of tasks."""
    d, _ = stored(pieces, name)
    tasks = (d.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        d = d.withColumn("task", F.floor(F.col("task") / TOGETHER).cast("long")).groupBy("part", "task").applyInArrow(_add, SCHEMA)
        tasks = -(-tasks // TOGETHER)
    return stored(d, name)[0]


def _unit_bigrams(units: int):
    """Bigrams of the first units, RARE (all others) and END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = units + 2, _Counts(units + 2, units + 2)
        for u in _paths(batches):
            u = np.where(u == END, units + 1, np.minimum(u, units))
            total.add(u[:-1] * size + u[1:])
        yield from total.pieces()

    return run


def _contexts(of):
    """Per word: classes before it, classes after it, and how often it follows itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, width = of.value, 2 * CLASSES + 1
        total = _Counts(WORDS + 2, width)
        for u in _paths(batches):
            k = classes[u]
            own = u[:-1][u[:-1] == u[1:]]
            total.add(np.concatenate([u[1:] * width + k[:-1], u[:-1] * width + CLASSES + k[1:], own * width + 2 * CLASSES]))
        yield from total.pieces()

    return run


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(c: np.ndarray) -> float:
    """What of the log likelihood depends on the classes, from their bigrams."""
    return float(_xlog(c).sum() - _xlog(c.sum(0)).sum() - _xlog(c.sum(1)).sum())


def gains(c: np.ndarray, left: np.ndarray, right: np.ndarray, self_: float) -> np.ndarray:
    """How much the likelihood grows when a word without class joins each class.

    c: class bigrams without the word; left, right: how often it follows and
    precedes each class, without itself; self_: how often it follows itself.
    """
    rows, columns = c.sum(1) + left, c.sum(0) + right  # what the neighbours' classes have whatever the word's class
    before, after = np.flatnonzero(left), np.flatnonzero(right)
    some = c[before]
    gain = (_xlog(some + left[before, None]) - _xlog(some)).sum(0)
    some = c[:, after]
    gain += (_xlog(some + right[after]) - _xlog(some)).sum(1)
    d = np.diag(c)
    gain += _xlog(d + left + right + self_) + _xlog(d) - _xlog(d + left) - _xlog(d + right)
    gain -= _xlog(rows + right.sum() + self_) - _xlog(rows) + _xlog(columns + left.sum() + self_) - _xlog(columns)
    return gain


def exchange(bigrams: np.ndarray, classes: int, fixed: dict[int, int] | None = None) -> np.ndarray:
    """Class of each unit; fixed units keep their classes to themselves.  Ends when a pass moves nothing."""
    fixed = fixed or {}
    n, free = len(bigrams), classes - len(fixed)
    b = bigrams.astype(np.float64)
    weight = b.sum(0) + b.sum(1)
    order = [int(i) for i in np.lexsort((np.arange(n), -weight)) if i not in fixed]
    of = np.zeros(n, np.int64)
    for rank, i in enumerate(order):
        of[i] = rank % free
    for i, k in fixed.items():
        of[i] = k
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    c = one.T @ b @ one
    moved = True
    while moved:
        moved = False
        for i in order:
            if not weight[i]:
                continue
            old, self_ = of[i], b[i, i]
            one[i, old] = 0
            left, right = b[:, i] @ one, b[i] @ one
            c[:, old] -= left
            c[old] -= right
            c[old, old] -= self_
            gain = gains(c, left, right, self_)
            new = int(gain[:free].argmax())
            if gain[new] <= gain[old] + 1e-7 * (1 + abs(gain[old])):
                new = old
            one[i, new] = 1
            c[:, new] += left
            c[new] += right
            c[new, new] += self_
            of[i] = new
            moved |= new != old
    return of


def _class_bigrams(of):
    """(part, counts): class bigrams from the words of one part."""

    def run(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        words = np.array(_rows(WORDS + 2, p))
        x = _dense(table["counts"][0].as_py(), len(words), 2 * CLASSES + 1)
        c = np.zeros((CLASSES, CLASSES), np.int64)
        np.add.at(c, of.value[words], x[:, CLASSES : 2 * CLASSES])
        return pa.table({"part": pa.array([p], pa.int32()), "counts": pa.array([c.astype("<i8").tobytes()], pa.binary())})

    return run


def _moved(of, bigrams, turn: int):
    """(part, classes): new classes of one part's words, each held against the same class bigrams."""

    def run(table: pa.Table) -> pa.Table:
        p = table["part"][0].as_py()
        words = np.array(_rows(WORDS + 2, p))
        x = _dense(table["counts"][0].as_py(), len(words), 2 * CLASSES + 1).astype(np.float64)
        all_ = bigrams.value.astype(np.float64)
        new = of.value[words].copy()
        for i, w in enumerate(words.tolist()):
            old = new[i]
            if w >= WORDS or not x[i].any() or (turn and old < FREE and (w + turn) % 2):
                continue
            left, right, self_ = x[i, :CLASSES].copy(), x[i, CLASSES : 2 * CLASSES].copy(), x[i, -1]
            left[old] -= self_
            right[old] -= self_
            c = all_.copy()
            c[:, old] -= left
            c[old] -= right
            c[old, old] -= self_
            gain = gains(c, left, right, self_)
            best = int(gain[:FREE].argmax())
            if old >= FREE or gain[best] > gain[old] + 1e-7 * (1 + abs(gain[old])):
                new[i] = best
        return pa.table({"part": pa.array([p], pa.int32()), "classes": pa.array([new.astype("u1").tobytes()], pa.binary())})

    return run


def _by_part(d: DataFrame, f, schema: str, column: str) -> dict[int, bytes]:
    return {r["part"]: r[column] for r in d.repartition(PARTS, "part").groupBy("part").applyInArrow(f, schema).collect()}  # PARTS rows of fixed size


class Model:
    """What scoring needs: classes, and logarithms of transitions and class sizes."""

    def __init__(self, spark: SparkSession, counts: DataFrame, head: list[tuple[str, int]], texts: DataFrame):
        """texts(units): the numbered training texts."""
        send = spark.sparkContext.broadcast
        totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.ends = texts.count()
        self.n, self.v = totals["n"] + self.ends, totals["v"] + (self.ends > 0)
        units = min(UNITS, len(head))
        b = np.zeros((units + 2, units + 2), np.int64)
        for r in summed(texts.mapInArrow(_unit_bigrams(units), SCHEMA), "lm-units").collect():  # PARTS rows of fixed size
            rows = _rows(units + 2, r["part"])
            b[rows.start : rows.stop] = _dense(r["counts"], len(rows), units + 2)
        self.of = np.full(WORDS + 2, FREE, np.int64)
        self.of[:units] = exchange(b, CLASSES, {units: FREE, units + 1: FREE + 1})[:units]
        self.of[END] = FREE + 1
        self.gained: list[float] = []
        kept = None
        for turn in range(ROUNDS + 1):
            of = send(self.of)
            seen = summed(texts.mapInArrow(_contexts(of), SCHEMA), "lm-contexts")
            c = np.zeros((CLASSES, CLASSES), np.int64)
            for raw in _by_part(seen, _class_bigrams(of), "part int, counts binary", "counts").values():
                c += np.frombuffer(raw, "<i8").reshape(CLASSES, CLASSES)
            now = likelihood(c.astype(np.float64))
            self.gained.append(now)
            if kept is not None and turn > 1 and now <= kept[0] + LEAST * abs(kept[0]):
                if now < kept[0]:
                    _, self.of, c = kept
                break
            kept = (now, self.of, c)
            if turn == ROUNDS or not len(head):
                break
            new = self.of.copy()
            for part, raw in _by_part(seen, _moved(of, send(c), turn), "part int, classes binary", "classes").items():
                new[_rows(WORDS + 2, part)] = np.frombuffer(raw, "u1")
            self.of = new
        self.bigrams = c
        prior = (c.sum(0) + 1) / (c.sum() + CLASSES)
        self.moves = np.log10((c + SHRINK * prior) / (c.sum(1, keepdims=True) + SHRINK))
        known = np.array([n for _, n in head[:WORDS]], np.int64)
        own = self.of[: len(known)]
        sizes = np.bincount(own, weights=known + 1, minlength=CLASSES)
        sizes[FREE] += totals["n"] - known.sum() + totals["v"] - len(known)
        sizes[FREE] += 1  # all unseen words
        sizes[FREE + 1] += self.ends + (self.ends > 0)
        self.rooms = np.log10(np.maximum(sizes, 1))  # no path meets a class without words


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, moves, rooms = shared.value
        for batch in batches:
            out = []
            for x in batch.column("units"):
                path = np.concatenate([[of[END]], of[np.frombuffer(x.as_py(), "<u2")], [of[END]]])
                out.append(float(moves[path[:-1], path[1:]].sum() - rooms[path[1:]].sum()))
            names = ["doc_id", "row", "n_tokens", "known", "logs"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, pa.float64())], names=[*names, "path"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, _ = stored(word_counts(docs.where(~held_out("doc_id"))), "lm-counts")
    head = head_words(counts, HEAD)
    schema = "doc_id long, row long, n_tokens long, known long, logs double, units binary, rest array<string>"
    rows, _ = stored(docs.mapInArrow(_numbered(spark.sparkContext.broadcast(head)), schema), "lm-rows")  # at most HEAD words
    m = Model(spark, counts, head, rows.where(~held_out("doc_id")).select("units"))
    shared = spark.sparkContext.broadcast((m.of, m.moves, m.rooms))  # of fixed size
    rest = rows.select("row", F.explode("rest").alias("word")).join(counts, "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs"))
    d = rows.drop("rest").mapInArrow(_score(shared), "doc_id long, row long, n_tokens long, known long, logs double, path double").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(m.ends + 1)))
    return d.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(m.ends > 0))).cast("long").alias("n_known"),
        F.lit(m.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(m.n + m.v + 1)))).alias("base_score"),
        (logs + F.col("path")).alias("score"),
        F.pow(F.lit(10.0), -(logs + F.col("path")) / F.col("n_tokens")).alias("perplexity"),
    )


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
