"""Line dedup: lines within one word of an earlier line go, the earliest stays.

A line is normalised to lower case with single spaces.  All lines with a word are
compared for equality.  The edit bound is one word in lines of at least
``near_words`` words: these also go if one inserted, deleted or replaced word turns
them into an earlier one of at least so many words.  In shorter lines one word is
too much of the line (a date, a name); ``near_words=2`` lets the bound hold for all
lines with more than one word.  Order is (doc_id, hash of the text, line number); an occurrence
goes if an earlier line, kept or not, is equal or within the bound.

Plan, all of it DataFrame expressions:

1. Lines are normalised and hashed in one pass, whose narrow rows are stored.
   Occurrences are reduced to distinct lines with their first place, with
   partial minima before the shuffle, so a line that a third of the documents
   hold is one row per task.  Later steps handle distinct lines only.
2. One edit leaves either the first or the last half of a line alone.  Hashes
   of the halves (for this length and the length below, two to four keys a
   line) tell which lines can have a neighbour at all; the others need no
   variants.  This loses nothing.
3. The deletion neighbourhood of the rest: a row for each word left out, keyed
   by the hash of the remaining words in order, and one for the line as it is.
   Hashes come from prefix sums, so a line costs its length.  Rows join on
   equal keys if the same place is left out (a replaced word) or one side is
   whole (an inserted or deleted word).  Only the earliest row of each key and
   place is joined, as all of them are within the bound of each other, so large
   groups give no pairs among themselves.
4. The words of the pairs are compared, which verifies the edit distance.

Tables that two jobs need are stored in the shared folder; a side is broadcast
only after its stored size has been checked.

Edge cases: a null or empty text has no lines and comes back as it was; rows of
one doc_id with different texts are documents of their own, in the order of
their hashes; of repeated rows (same doc_id, same text) one, told by the hash of
the whole row, is the earliest and the others lose all lines; rows without doc_id
come first; a document left without a word is dropped by ``dedup``
(all it said stands earlier); an empty table gives an empty result; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import GAP, small_or_not, stored

#: Words of a line from which on one edited word is within the bound, unless told otherwise.
NEAR_WORDS = 8
BLOCK = 64


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it, its lambdas included."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalised(line: Column) -> Column:
    """Lower case, single spaces.  Few lines have other white space than single spaces, so only these pay for a pattern."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\f":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(F.lower(line), GAP, " ")).otherwise(F.lower(line)))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, at, t, n, h): each line with a word of docs(doc_id, text); copy is a hash of the whole text."""
    d = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    d = d.select("doc_id", "copy", "at", normalised(F.col("raw")).alias("t"))
    d = d.withColumn("n", F.when(F.col("t") == "", 0).otherwise(1 + F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))))
    return d.where(F.col("n") > 0).withColumn("h", F.xxhash64("t"))


def _half(side: str, q: Column) -> Column:
    part = F.expr("substring_index(t, ' ', q)") if side == "first" else F.expr("substring_index(t, ' ', -q)")
    return F.xxhash64(F.lit(side), q, part)


def _halves(d: DataFrame, near_words: int) -> DataFrame:
    """Adds the keys of the halves that one edit can leave alone."""
    near = F.col("n") >= near_words
    for i, q in enumerate((F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2))):
        d = d.withColumn("q", q.cast("int"))
        used = near if i == 0 else (F.col("n") > near_words) & (F.col("n") % 2 == 0)  # for lines of a word less, if these are near too
        d = d.withColumn(f"f{i}", F.when(used, _half("first", F.col("q")))).withColumn(f"l{i}", F.when(used, _half("last", F.col("q"))))
    return d.drop("q")


def prefix_xor(values: Column) -> Column:
    """Exclusive ors of the first 0, 1, ... values; linear but for blocks of a fixed size."""
    longs = "array<bigint>"

    def run(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start).cast(longs), lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))).cast(longs))

    def joined(blocks: Column, starts: Column) -> Column:
        inner = F.zip_with(blocks, F.slice(starts, 1, F.size(starts) - 1), lambda p, s: F.slice(run(p, s), 1, F.size(p)))
        return F.concat(F.flatten(inner), F.slice(starts, -1, 1))

    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    sums = lambda b: F.transform(b, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)))
    long = _once(blocks, lambda b: _once(run(sums(b), zero), lambda s: joined(b, s)))
    return F.when(F.size(values) <= BLOCK, run(values, zero)).otherwise(long)


def variants(lines: DataFrame) -> DataFrame:
    """(key, gap, first, h): a row per word left out, and one (gap -1) for the whole line."""
    d = lines.withColumn("w", F.split("t", " ", -1))
    d = d.withColumn("a", F.transform("w", lambda x, j: F.xxhash64(x, j))).withColumn("b", F.transform("w", lambda x, j: F.xxhash64(x, j - 1)))
    d = d.select("h", "n", "first", prefix_xor(F.col("a")).alias("pa"), prefix_xor(F.col("b")).alias("pb"))
    rest = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.struct(F.xxhash64(F.col("n") - 1, F.get("pa", i).bitwiseXOR(F.get("pb", F.col("n"))).bitwiseXOR(F.get("pb", i + 1))).alias("key"), i.alias("gap")),
    )
    whole = F.array(F.struct(F.xxhash64(F.col("n"), F.get("pa", F.col("n"))).alias("key"), F.lit(-1).alias("gap")))
    return d.select("h", "first", F.inline(F.concat(rest, whole)))


def within_one(x: Column, y: Column) -> Column:
    """Whether two word arrays are at most one edit apart."""
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    same = F.zip_with(short, F.slice(long, 1, F.size(short)), lambda a, b: a == b)
    p = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(short)).cast("int")  # words that agree at the start
    rest = lambda a, skip: F.slice(a, p + 1 + skip, F.size(a))
    return F.when(F.size(x) == F.size(y), rest(short, 1) == rest(long, 1)).otherwise((F.size(long) - F.size(short) == 1) & (rest(short, 0) == rest(long, 1)))


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h of the distinct lines that have an earlier line within the bound, but not equal."""
    keys = distinct.select("h", F.explode(F.array("f0", "l0", "f1", "l1")).alias("key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select(F.col("key").alias("shared"))
    shared = small_or_not(shared, "line-halves")
    some = keys.join(shared, F.col("key") == F.col("shared"), "left_semi").select("h").distinct().join(distinct, "h")
    some = some.groupBy(F.col("first.copy").alias("id")).agg(F.collect_list(F.struct("h", "n", "first")).alias("some"))  # lines of one document
    lines = docs.join(small_or_not(some, "line-some"), F.xxhash64("text") == F.col("id")).select("some", F.split("text", "\n", -1).alias("raw"))
    lines = lines.select(F.inline(F.transform("some", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"), x["first"].alias("first"), F.get("raw", x["first"]["at"]).alias("line")))))
    lines = lines.select("h", "n", "first", normalised(F.col("line")).alias("t")).where(F.xxhash64("t") == F.col("h"))
    lines, _ = stored(lines.dropDuplicates(["h"]), "line-texts")
    v = variants(lines)
    earliest = v.groupBy("key", "gap").agg(F.min(F.struct("first", "h")).alias("e")).select(F.col("key").alias("ek"), F.col("gap").alias("eg"), "e")
    fits = (F.col("gap") == F.col("eg")) & (F.col("gap") >= 0) | (F.col("gap") < 0) & (F.col("eg") >= 0) | (F.col("gap") >= 0) & (F.col("eg") < 0)
    pairs = v.join(earliest, F.col("key") == F.col("ek")).where(fits & (F.col("e.first") < F.col("first"))).select("h", F.col("e.h").alias("g")).distinct()
    texts = lines.select("h", F.split("t", " ", -1).alias("w"))
    c = pairs.join(texts, "h").join(texts.select(F.col("h").alias("g"), F.col("w").alias("v")), "g")
    return c.where(within_one(F.col("w"), F.col("v"))).select("h").distinct()


def _places(docs: DataFrame, near_words: int) -> DataFrame:
    """(doc_id, copy, at, near, goes): the occurrences of repeated and near lines, and whether they go."""
    docs = docs.select("doc_id", "text")
    rows, _ = stored(_halves(line_rows(docs), near_words).drop("t"), "line-rows")  # texts are normalised once
    d = rows.groupBy("h", "n", "f0", "l0", "f1", "l1").agg(F.min(F.struct("doc_id", "copy", "at")).alias("first"), F.count("*").alias("c"))
    distinct, _ = stored(d, "line-distinct")
    near, _ = stored(near_lines(docs, distinct).select(F.col("h").alias("nh")), "line-near")
    going = distinct.join(near, F.col("h") == F.col("nh"), "left").where("c > 1 or nh is not null")
    going = small_or_not(going.select(F.col("h").alias("gh"), F.col("n").alias("gn"), "first", F.col("nh").isNotNull().alias("near")), "line-going")
    d = rows.select("doc_id", "copy", "at", "h", "n").join(going, (F.col("h") == F.col("gh")) & (F.col("n") == F.col("gn")))
    return d.select("doc_id", "copy", "at", "near", (F.col("near") | ~F.struct("doc_id", "copy", "at").eqNullSafe(F.col("first"))).alias("goes"))


def removed_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, copy, at, near): the occurrences that go; those of a repeated row, as many times as it repeats."""
    return _places(docs, near_words).where("goes").drop("goes")


def with_removed(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(row, doc_id, text, gone, near, again): one row for each document of docs.

    row holds all columns of docs, gone the numbers of the lines that go (null: none),
    near how many of these are near, again how many further rows have the same
    doc_id and text: these lose all lines and are left out here.
    """
    gone = _places(docs, near_words).groupBy(F.col("doc_id").alias("id"), "copy").agg(
        F.collect_set(F.when(F.col("goes"), F.col("at"))).alias("gone"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("at")))).alias("near"),
        (F.count("*") / F.size(F.collect_set("at"))).cast("long").alias("same"),  # a repeated row repeats all its lines
    )
    gone = gone.where((F.size("gone") > 0) | (F.col("same") > 1)).withColumn("gone", F.when(F.size("gone") > 0, F.col("gone")))
    gone = small_or_not(gone, "line-gone")
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("c"))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("c") == F.col("copy")), "left")
    own = ["row", "doc_id", "text", "gone", "near"]
    once = d.where("coalesce(same, 1) = 1").select(*own, F.lit(0).cast("long").alias("again"))
    if gone.where("same > 1").isEmpty():
        return once
    first = F.min_by(F.struct(*own), F.xxhash64("row")).alias("f")  # combined before it is shuffled: one row per task, however often a row repeats
    many = d.where("same > 1").groupBy("id", "c").agg(first, (F.count("*") - 1).alias("again"))
    return once.unionByName(many.select("f.*", "again"))


def _left() -> Column:
    """The text without the lines that go."""
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_once(F.split("text", "\n", -1), kept), "\n"))


def dedup(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs without the lines that go and without documents that lose all words; n_chars follows, if there."""
    d = with_removed(docs, near_words).select("row", "gone", _left().alias("left"))
    d = d.where(F.col("gone").isNull() | F.col("left").rlike("[^\\x20\\x09-\\x0D]"))
    own = {c: F.col("row")[c] for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("gone").isNull(), own["n_chars"]).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    own["text"] = F.col("left")
    return d.select(*[c.alias(k) for k, c in own.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those that go, the near ones of these, and the code points and hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    d = with_removed(docs).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("again"))).alias("k"))  # further rows of a document lose all lines
    numbers = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike("[^\\x20\\x09-\\x0D]"))
    spoken = _once(F.split("text", "\n", -1), numbers)
    d = d.withColumns({"gone": F.when(F.col("k") == 0, F.col("gone")).otherwise(spoken), "near": F.when(F.col("k") == 0, F.col("near"))})
    d = d.withColumn("left", F.coalesce(_left(), F.lit("")))
    return d.select(
        "doc_id",
        F.coalesce(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.length("left").cast("long").alias("n_chars_left"),
        F.crc32(F.col("left").cast("binary")).alias("left_crc32"),
    )
