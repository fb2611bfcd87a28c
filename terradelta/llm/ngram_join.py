"""N-gram Jaccard join: documents that share enough of their word shingles.

The product of the document by shingle incidence matrix with its transpose is
taken by blocks, one block per shingle, and only where it can matter:

1. One pass hashes each text's set.  Equal sets form a class, and only one
   document of a class goes on; copies are never paired.  The same pass fills a
   sketch of 2**18 document counts, whose size is fixed.
2. Shingles are ordered by (level of the sketched count, hash).  Two sets that
   reach the threshold t share a shingle among the first n - ceil(t n) + 1 of
   each (size-derived bound), so only those prefixes enter the product, and
   common shingles come into a prefix only if a text has hardly any others.
   Any order gives the same links; this one keeps blocks small.
3. Within the block of a shingle, a pair is kept if its sizes and the places of
   the shingle leave room for enough overlap, and then if the overlap counted
   over all shared prefix shingles does.  First every class meets one member of
   each of its blocks; its two best pairs are counted exactly, and the links
   merge classes into components.
4. Whatever blocks still hold several components give all remaining pairs of
   members of different components (members of the block's main component are
   paired with the others only, never among themselves), counted exactly.  The
   classes of crowded blocks get new prefixes first, ordered by a sketch of the
   crowd alone, and meet once more: what the copies have in common comes last,
   so copies edited in different places no longer meet at all.

So a group of near copies costs its size times the prefix, not the square.
The hash of 64 bits stands for a shingle; the overlap is exact on these.

Edge cases: a null or empty text has no shingles, links with nothing and is its
own component; a null doc_id gets its component only from documents with one of
equal shingles; fewer than k words are one shingle; repeated rows and ties give
one class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terradelta.llm import shingles
from terradelta.llm.common import components, remove, small_or_not, stored

_U = np.uint64
SKETCH_BITS = 18
_PARTS = 16
#: Blocks of more classes than this are divided again by a sketch of their own.
CROWD, CROWD_BITS = 32, 20
PREFIXES = "doc_id long, cls long, n int, last_level int, last_key long, keys array<long>"


def _class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit id of each row's set; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(sets * _U(0xA0761D6478BD642F)))])
    n = np.diff(at).astype(np.uint64)
    ids = shingles.mix((total[at[1:]] - total[at[:-1]]) ^ (n * _U(0xE7037ED1A0B428DB))) >> _U(1)
    return np.where(n == 0, _U(0), np.maximum(ids, _U(1))).astype(np.int64)


def _first_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in shingles.slices(batch.column("text")):
                s, at = shingles.sets(data, offsets, k)
                counts += np.bincount((s >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.array(_class_ids(s, at)), pa.array(np.diff(at)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "cls", "n", "part", "counts"])
        for p, raw in _pieces(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([p], pa.int32()), pa.array([raw], pa.binary())], names=["doc_id", "cls", "n", "part", "counts"])

    return run


def _pieces(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for p, piece in enumerate(np.split(counts, _PARTS)):
        if piece.any():
            yield p, zlib.compress(piece.astype("<i8").tobytes(), 1)


def _sketch(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, data, offsets in shingles.slices(batch.column("text")):
                s, _ = shingles.sets(data, offsets, k)
                counts += np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=len(counts))
        for p, raw in _pieces(counts):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([raw], pa.binary())], names=["part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = None
    for x in table["counts"]:
        piece = np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        total = piece.copy() if total is None else total + piece
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _summed(pieces: DataFrame, bits: int) -> np.ndarray:
    """Counts of all buckets: at most _PARTS rows of fixed size come to the driver."""
    total = np.zeros((_PARTS, (1 << bits) // _PARTS), np.int64)
    for row in pieces.select("part", "counts").groupBy("part").applyInArrow(_add, "part int, counts binary").collect():
        total[row["part"]] = np.frombuffer(row["counts"], "<i8")
    return total.ravel()


def _levels(first: DataFrame) -> np.ndarray:
    """Level of each bucket: 0 unless its count stands out of the mean."""
    total = _summed(first.where("part is not null"), SKETCH_BITS)
    limit = total.mean() + 6 * np.sqrt(total.mean()) + 6
    return np.where(total <= limit, 0, 1 + np.log2(np.maximum(total, 1) / limit) * 2).astype(np.uint8)


def _prefixes(k: int, percent: int, levels, bits: int = SKETCH_BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, offsets in shingles.slices(batch.column("text")):
                s, at = shingles.sets(data, offsets, k)
                n = np.diff(at)
                lv = level[(s >> _U(64 - bits)).astype(np.int64)]
                ids_of = _class_ids(s, at)
                for r in np.unique(np.searchsorted(at, np.flatnonzero(lv), "right") - 1):
                    a, b = at[r], at[r + 1]
                    order = np.argsort(lv[a:b], kind="stable")
                    s[a:b], lv[a:b] = s[a:b][order], lv[a:b][order]
                p = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                to = np.concatenate([[0], np.cumsum(p)])
                take = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], p)
                keys = s[take].astype(np.int64)
                last = np.maximum(at[:-1] + p - 1, 0)
                signed = (s ^ _U(1 << 63)).astype(np.int64)
                some = len(s) > 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), pa.array(ids_of), pa.array(n.astype(np.int32)), pa.array(lv[last].astype(np.int32) if some else np.zeros(len(n), np.int32)), pa.array(signed[last] if some else np.zeros(len(n), np.int64)), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(keys))],
                    names=["doc_id", "cls", "n", "last_level", "last_key", "keys"],
                )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in shingles.slices(batch.column("text")):
                s, at = shingles.sets(data, offsets, k)
                raw = s.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(s, at)), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["cls", "shingles"])

    return run


def _count(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


class _Join:
    """One run; every table that two jobs need is stored in the shared folder."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        first, _ = stored(self.docs.mapInArrow(_first_pass(k), "doc_id long, cls long, n long, part int, counts binary"), "ngram-first")
        self.rows = first.where("part is null").select("doc_id", "cls", F.col("n").alias("n_shingles"))
        self.levels = self.spark.sparkContext.broadcast(_levels(first))  # 2**18 bytes
        self.classes, _ = stored(self.rows.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "ngram-classes")

    def incidence(self) -> None:
        raw = self.docs.mapInArrow(_prefixes(self.k, self.percent, self.levels), PREFIXES)
        own = small_or_not(self.classes.select("rep", F.col("cls").alias("own")), "ngram-reps")
        raw = raw.where("cls <> 0").join(own, (F.col("doc_id") == F.col("rep")) & (F.col("cls") == F.col("own")), "left_semi").drop("doc_id")
        raw = raw.dropDuplicates(["cls"])  # rows that repeat their doc_id
        prefix, where = stored(raw, "ngram-prefix")
        entries = prefix.select("cls", "n", F.posexplode("keys").alias("at", "key"))
        # two classes whose sizes or places leave no room don't make a block; most chance meetings end here
        shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("n").alias("n"), F.min(F.col("n") - F.col("at")).alias("rest"))
        two = (100 * F.col("n") >= self.percent * (F.col("s") - F.col("n"))) & ((100 + self.percent) * F.col("rest") >= self.percent * F.col("s"))
        shared = shared.where("c > 1").select(F.col("key").alias("shared"), ((F.col("c") > 2) | two).alias("block"))
        shared = small_or_not(shared, "ngram-shared")
        every, _ = stored(entries.join(shared, F.col("key") == F.col("shared")).drop("shared"), "ngram-entries")
        self.entries = every.where("block").drop("block")
        keys = every.groupBy("cls").agg(F.collect_list("key").alias("keys"))  # at most a text's prefix
        info = prefix.select("cls", "n", F.size("keys").alias("p"), F.struct("last_level", "last_key").alias("last"))
        self.info, _ = stored(info.join(keys, "cls"), "ngram-info")
        remove(self.spark, where)  # all that follows reads the entries and the info

    def room(self, na, ia, nb, ib):
        """Sizes and places leave room for the overlap that a link needs."""
        need = F.ceil(self.percent * (na + nb) / F.lit(100.0 + self.percent) - 1e-9)
        fits = (100 * na >= self.percent * nb) & (100 * nb >= self.percent * na)
        return fits & (F.least(na - ia, nb - ib) >= need)

    def meet(self, entries: DataFrame, rank: DataFrame) -> DataFrame:
        """(x, a, b): each class x and one member of each of its blocks.

        The member with the fewest prefix shingles of its own is met, as copies
        have most in common with the least edited one; hashes break ties.
        """
        hub = entries.join(small_or_not(rank, "ngram-rank"), "cls").groupBy("key").agg(F.min(F.struct("alone", F.xxhash64("cls", "key").alias("r"), "cls", "n", "at")).alias("h"))
        c = entries.join(hub, "key").where(F.col("cls") != F.col("h.cls"))
        c = c.where(self.room(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at")))
        return c.select(F.col("cls").alias("x"), F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b")).distinct()

    @staticmethod
    def best(near: DataFrame) -> DataFrame:
        """The two pairs of each x that share most."""
        w = Window.partitionBy("x").orderBy(F.desc("share"), "a", "b")  # at most a prefix of rows
        return near.withColumn("k", F.row_number().over(w)).where("k <= 2").select("a", "b").distinct()

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """(x, a, b, share): pairs whose overlap over the prefixes can still reach the threshold."""
        side = lambda s: self.info.select(F.col("cls").alias(s), *[F.col(c).alias(c + s) for c in ("n", "p", "last", "keys")])
        c = pairs.join(side("a"), "a").join(side("b"), "b")
        over = F.size(F.array_intersect("keysa", "keysb"))
        rest = F.when(F.col("lasta") <= F.col("lastb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
        c = c.select("x", "a", "b", over.alias("o"), (over + rest).alias("most"), "na", "nb")
        return c.where((100 + self.percent) * F.col("most") >= self.percent * (F.col("na") + F.col("nb"))).select("x", "a", "b", (F.col("o") / F.least("na", "nb")).alias("share"))

    def counted(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked) with the overlap of the whole sets counted."""
        texts, need = self.texts_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        sets, where = stored(texts.mapInArrow(_set_rows(self.k), "cls long, shingles binary").join(need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "ngram-sets")
        c = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        done, _ = stored(c.mapInArrow(_count(self.percent), "a long, b long, linked boolean"), "ngram-counted")
        remove(self.spark, where)
        return done

    def texts_of(self, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The texts of one document per class of classes(cls), and the classes."""
        need = small_or_not(classes.join(self.classes, "cls").select("rep", "cls"), "ngram-needed")
        return self.docs.join(need.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select("text"), need

    def crowd_entries(self, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries of classes(cls) again that share a key, the prefixes ordered by counts within the crowd.

        With them (cls, alone): how many keys of a class no other class has.
        """
        texts, need = self.texts_of(crowd)
        level = np.round(4 * np.log2(_summed(texts.mapInArrow(_sketch(self.k, CROWD_BITS), "part int, counts binary"), CROWD_BITS) + 1)).astype(np.uint8)
        level = self.spark.sparkContext.broadcast(level)  # 2**CROWD_BITS bytes
        raw = texts.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_prefixes(self.k, self.percent, level, CROWD_BITS), PREFIXES)
        raw = raw.join(need.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
        prefix, where = stored(raw.select("cls", "n", "keys"), "ngram-crowd-prefix")
        entries = prefix.select("cls", "n", F.posexplode("keys").alias("at", "key"))
        shared = small_or_not(entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "ngram-crowd-shared")
        found, _ = stored(entries.join(shared, "key"), "ngram-crowd")
        met = found.groupBy("cls").agg(F.count("*").alias("met"))
        rank = prefix.select("cls", F.size("keys").alias("p")).join(met, "cls").select("cls", (F.col("p") - F.col("met")).alias("alone"))
        rank, _ = stored(rank, "ngram-crowd-alone")
        remove(self.spark, where)
        return found, rank

    def across(self, entries: DataFrame, roots: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of different components from the blocks of at most ``most`` classes; classes of larger blocks."""
        e = entries.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        sizes = e.groupBy("key", "root").agg(F.count("*").alias("c"))
        main = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("members")).where("roots > 1")
        e, _ = stored(e.join(main.select("key", F.col("m.root").alias("main"), "members"), "key"), "ngram-left")
        crowd = e.where(F.col("members") > most).select("cls").distinct() if most else None
        if most:
            e = e.where(F.col("members") <= most)
        few = e.where("root <> main").select("key", F.col("cls").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"))
        every = e.select("key", F.col("cls").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"), "main")
        c = few.join(every, "key").where("ra <> rb").where((F.col("rb") == F.col("main")) | (F.col("ca") < F.col("cb")))
        c = c.where(self.room(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib")))
        return c.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), crowd

    def run(self) -> DataFrame:
        self.incidence()
        rank = self.info.select("cls", (F.col("p") - F.size("keys")).alias("alone"))
        near, _ = stored(self.bounded(self.meet(self.entries, rank)), "ngram-near")
        done = self.counted(self.best(near))
        roots = components(done.where("linked"), "ngram")
        pairs, crowd = self.across(self.entries, roots, CROWD)
        crowd, _ = stored(crowd, "ngram-crowd-classes")
        if not crowd.isEmpty():
            e, rank = self.crowd_entries(crowd)
            near = self.bounded(self.meet(e, rank)).join(done.select("a", "b"), ["a", "b"], "left_anti")
            done = done.unionByName(self.counted(self.best(near)))
            roots = components(done.where("linked"), "ngram")
            pairs = pairs.unionByName(self.across(e, roots)[0])
        left = self.bounded(pairs.distinct().withColumn("x", F.col("a"))).select("a", "b").join(done.select("a", "b"), ["a", "b"], "left_anti")
        left, _ = stored(left, "ngram-rest")
        if not left.isEmpty():
            roots = components(done.unionByName(self.counted(left)).where("linked"), "ngram")
        member = self.classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
        least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
        member = member.join(least, "root").select("cls", "component_id")
        out = self.rows.join(member, "cls", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text, ...).

    Two sets link when 100 * intersection >= percent * union.
    """
    return _Join(docs, k, percent).run()


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component, with all columns.

    A row is told by its doc_id and a hash of its text, so documents that share
    a doc_id, or have none, count on their own.  First is the least doc_id (null
    last), then the least hash; of rows that repeat both, one stays, whichever
    their other columns.  A row without shingles links with nothing and stays.
    """
    mark, own = F.xxhash64("text"), F.col("doc_id").cast("long")
    rows = docs.select(own.alias("_id"), mark.alias("_mark"), F.xxhash64(own, mark).alias("_row"))
    found = ngram_components(docs.select(F.xxhash64(own, mark).alias("doc_id"), "text"), k, percent)
    found = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("_group"))
    keys, _ = stored(rows.groupBy("_row", "_id", "_mark").agg(F.count("*").alias("_n")).join(found, "_row"), "ngram-keys")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))
    first = keys.groupBy("_group").agg(F.min(place).alias("_first"), F.count("*").alias("_c"))
    first = small_or_not(first.where("_c > 1").select("_group", "_first"), "ngram-first-rows")
    gone = keys.join(first, "_group").where(place != F.col("_first")).select("_id", "_mark")
    again, _ = stored(keys.where("_n > 1").join(first, "_group", "left").where(F.coalesce(place == F.col("_first"), F.lit(True))).select("_id", "_mark"), "ngram-again")
    tag = "_"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    told = docs.withColumns({f"{tag}id": own, f"{tag}mark": mark})
    named = lambda t: t.select(F.col("_id").alias(f"{tag}i"), F.col("_mark").alias(f"{tag}m"))
    on = F.col(f"{tag}id").eqNullSafe(F.col(f"{tag}i")) & (F.col(f"{tag}mark") == F.col(f"{tag}m"))
    out = told.join(named(small_or_not(gone.unionByName(again), "ngram-gone")), on, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(told.join(named(again), on, "left_semi").dropDuplicates([f"{tag}id", f"{tag}mark"]))
    return out.select(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


#: The same in DuckDB's SQL: all pairs that share a shingle, then all that can be reached.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w)),
z as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join z a on a.doc_id = x join z b on b.doc_id = y where 100 * o >= 85 * (a.n + b.n - o)),
e as (select x, y from l union all select y, x from l),
reach as (select doc_id, doc_id as root from documents union select e.y, reach.root from reach join e on e.x = reach.doc_id where reach.root < e.y)
select d.doc_id, coalesce(z.n, 0)::bigint n_shingles, m.c component_id from documents d left join z using (doc_id) join (select doc_id, min(root) c from reach group by doc_id) m using (doc_id)
"""
