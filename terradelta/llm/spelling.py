"""Spelling variants: words that differ by one code point, grouped under the common form.

1. Texts are cut into maximal runs of letters.  A task counts the distinct runs
   of each text once, gives each its result (a run whose hash with the document's
   id is divisible by SLIP loses one code point) and adds up what its texts
   have, in a table of bounded size; sums by word follow.  Frequent words so
   leave a task a few times, whatever their number.
2. Full neighbourhoods: for every word all distinct deletions, replacements and
   insertions over the alphabet that the words show are emitted as keys of 64
   bits.  A key is a polynomial over code points, so that of a neighbour comes
   from prefix sums of the word, many words at a time.  Distinct by rule:
   deleting from a run of equal letters counts once, a replacement changes the
   letter, and a letter is inserted before an equal one only once.
3. The keys are hash-joined to those of the vocabulary.  The first step of that
   join is a bitmap of the vocabulary's keys, which each task holds and which
   lets pass every key there is, so that almost only real neighbours are
   shuffled.  Its size follows the vocabulary up to a bound (16 MB); beyond it
   the bitmap lets more keys pass and the result stays the same.  A key that
   meets one of the vocabulary is spelt out and compared with that word, so that
   equal keys of different words do no harm; no distance is computed.
4. The near word of largest count is a word's form if its count is RATIO times
   the word's; forms are followed by doubling until none moves.  Counts grow
   by RATIO at each step, so chains are short.

Edge cases: a null text has no runs; a null doc_id hashes as an empty number; repeated rows
count each; ties of counts take the least word in code-point order; words of
any length keep all their neighbours, in pieces of bounded size; no words, or
an empty table, give an empty result; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import ship, small_or_not, stored
from terradelta.llm.shingles import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SLIP, LEAST_POINTS, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of a task's table before it is emptied.
HELD_WORDS = 200_000
#: Keys of neighbours that are made at a time.
PIECE = 1 << 20
#: Bits of the bitmap for each word, at most in all, and parts of it.
BITS_PER_WORD, MOST_BITS, PARTS = 32, 27, 16
_U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CANDIDATE = "own long, at int, cut int, letter string, key long"


def result(doc_id: int | None, run: str) -> str:
    """What a run of a document counts as."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(least_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")  # only A-Z change
                for word, n in Counter(RUN.findall(text)).items():
                    word = result(doc_id, word)
                    if len(word) >= least_points:
                        held[word] += n
                        size += len(word)
                if len(held) > HELD_WORDS or size > 64 * HELD_WORDS:
                    yield packed()
                    held.clear()
                    size = 0
        if held:
            yield packed()

    return run


def word_counts(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """(word, n) of docs(doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_counted(least_points), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Alphabet:
    """The letters that words show, and the hashes of them at any place."""

    def __init__(self, letters: list[str]):
        self.letters = np.array(sorted(letters))
        self.codes = np.array([ord(x) for x in self.letters.tolist()], np.uint64)
        self.hashes = mix((self.codes + _U(1)) * _U(_BASE))
        self.of = np.zeros(int(self.codes.max()) + 1 if len(letters) else 1, np.int32)
        self.of[self.codes.astype(np.int64)] = np.arange(len(letters))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of letter numbers."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        return self.of[codes]


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))


def keys_of(sums: np.ndarray) -> np.ndarray:
    return mix(sums)


def word_keys(numbers: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    return keys_of((alphabet.hashes[numbers] * _powers(numbers.shape[1])[:-1]).sum(1, dtype=np.uint64))


def neighbourhood(numbers: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
    """(word, place, letters cut, letter or -1, key) of all distinct neighbours, in pieces.

    numbers: words of one length.  A neighbour is the word up to the place, the
    letter, and the word from place + letters cut on.
    """
    words, length = numbers.shape
    letters = len(alphabet.letters)
    power = _powers(length + 1)
    terms = alphabet.hashes[numbers] * power[:length]
    before = np.concatenate([np.zeros((words, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    total = before[:, -1:]
    same = np.zeros((words, length), bool)  # equal to the letter before
    same[:, 1:] = numbers[:, 1:] == numbers[:, :-1]
    w, at = np.nonzero(~same)
    yield w, at, 1, np.full(len(w), -1), keys_of(before[w, at] + (total[w, 0] - before[w, at + 1]) * _U(_INVERSE))
    step = max(1, PIECE // max(1, words * letters))
    for a in range(0, length + 1, step):
        places = np.arange(a, min(a + step, length + 1))
        put = alphabet.hashes[None, None, :] * power[places][None, :, None]
        rest = (before[:, places] + (total - before[:, places]) * _U(_BASE))[:, :, None]
        more = keys_of(rest + put)
        here = np.full((words, len(places)), -1, np.int32)
        inside = places < length
        here[:, inside] = numbers[:, places[inside]]
        other = here[:, :, None] != np.arange(letters)[None, None, :]
        w, p, x = np.nonzero(other)
        yield w, places[p], 0, x, more[w, p, x]
        if inside.any():
            kept = (total - terms[:, places[inside]])[:, :, None]
            changed = keys_of(kept + put[:, inside])
            w, p, x = np.nonzero(other[:, inside])
            yield w, places[inside][p], 1, x, changed[w, p, x]


def _by_length(words: list[str], letters: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of one length, few enough for a piece."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        step = max(1, PIECE // max(1, n * letters))
        for a in range(0, len(rows), step):
            yield rows[a : a + step], [words[i] for i in rows[a : a + step].tolist()]


SHIFTS = (0, 21, 42)


def _bit(keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """One of the bits that stand for each key."""
    turned = keys >> _U(shift) | keys << _U(64 - shift) if shift else keys
    return (turned & _U((1 << bits) - 1)).astype(np.int64)


def _keyed(alphabet: Alphabet, bits: int):
    """The words' keys; after them the parts of the task's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n", "key", "part", "raw"]
        bitmap = np.zeros(1 << bits, bool)
        for batch in batches:
            words = batch.column("word").to_pylist()
            keys = np.zeros(len(words), np.uint64)
            for rows, some in _by_length(words, 1):
                keys[rows] = word_keys(alphabet.numbers(some), alphabet)
            for shift in SHIFTS:
                bitmap[_bit(keys, shift, bits)] = True
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys.view(np.int64)), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary())], names=names)
        for p, piece in enumerate(np.split(bitmap, PARTS)):
            if piece.any():
                raw = zlib.compress(np.packbits(piece, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([p], pa.int32()), pa.array([raw], pa.binary())], names=names)

    return run


def _joined(table: pa.Table) -> pa.Table:
    total = None
    for x in table["raw"]:
        piece = np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        total = piece.copy() if total is None else total | piece
    return pa.table({"part": table["part"].slice(0, 1).combine_chunks(), "raw": pa.array([total.tobytes()], pa.binary())})


def _candidates(alphabet: Alphabet, bits: int, bitmap):
    """All neighbours whose key may be one of the vocabulary."""
    letters = np.concatenate([alphabet.letters.astype(object), [""]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            own = batch.column("key").to_numpy()
            words = batch.column("word").to_pylist()
            for rows, some in _by_length(words, len(alphabet.letters)):
                for w, at, cut, letter, keys in neighbourhood(alphabet.numbers(some), alphabet):
                    for shift in SHIFTS:
                        b = _bit(keys, shift, bits)
                        hit = np.flatnonzero(there[b >> 3] >> (b & 7).astype(np.uint8) & 1)
                        w, at, letter, keys = w[hit], at[hit], letter[hit], keys[hit]
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[rows[w]]), pa.array(at.astype(np.int32)), pa.array(np.full(len(w), cut, np.int32)), pa.array(letters[letter], pa.string()), pa.array(keys.view(np.int64))],
                            names=["own", "at", "cut", "letter", "key"],
                        )

    return run


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """words(word, n), stored with keys, and (word, near, near_n) of all pairs, both ways."""
    spark = words.sparkSession
    words, _ = stored(words, "spelling-words")
    letters = [r["x"] for r in words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect()]  # at most the letters of RUN
    alphabet = Alphabet(letters)
    bits = min(MOST_BITS, max(16, (words.count() * BITS_PER_WORD).bit_length()))
    keyed, _ = stored(words.mapInArrow(_keyed(alphabet, bits), "word string, n long, key long, part int, raw binary"), "spelling-keys")
    vocabulary = keyed.where("part is null").select("word", "n", "key")
    size = (1 << bits) // PARTS // 8
    bitmap = bytearray(size * PARTS)
    for r in keyed.where("part is not null").select("part", "raw").groupBy("part").applyInArrow(_joined, "part int, raw binary").collect():  # PARTS rows of fixed size
        bitmap[r["part"] * size : (r["part"] + 1) * size] = r["raw"]
    shared = spark.sparkContext.broadcast(bytes(bitmap))  # 2**MOST_BITS bits at most
    spread = vocabulary.repartition("key")  # the work of a word follows its length, not its place
    found = spread.mapInArrow(_candidates(alphabet, bits, shared), CANDIDATE)
    met = found.join(small_or_not(vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "spelling-near"), "key").drop("key")
    met, _ = stored(met, "spelling-met")
    pairs = met.join(vocabulary.select(F.col("key").alias("own"), "word"), "own")
    spelt = F.concat(F.expr("substring(word, 1, at)"), "letter", F.expr("substring(word, at + cut + 1)"))
    return vocabulary, pairs.where(spelt == F.col("near")).select("word", "near", "near_n").distinct()


def forms(vocabulary: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    d = vocabulary.select("word", "n").join(best, "word", "left")
    taken = -F.col("b.m") >= ratio * F.col("n")
    return d.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("b.w")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n"))


def roots(found: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the reach."""
    d, _ = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        on = small_or_not(d.select(F.col("word").alias("at"), F.col("root").alias("further")), "spelling-further")
        d, _ = stored(d.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if d.where("moved").isEmpty():
            return d.select("word", "root")
        d = d.select("word", "root")
    raise RuntimeError("the forms did not settle")


def spelling_variants(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs(doc_id, text, ...)."""
    ship(docs.sparkSession)
    vocabulary, near = near_words(word_counts(docs, least_points).where(F.col("n") >= least_count))
    found, _ = stored(forms(vocabulary, near, ratio), "spelling-forms")
    d = found.join(roots(found), "word", "left")
    return d.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
