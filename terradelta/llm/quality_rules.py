"""Quality rules: text statistics and cross-document line frequency.

Line frequency.  Every line of a document is normalised (lower case, digits as
one ``0``, everything else than letters and digits as one space) and hashed.
For each host (the ``source`` column) the operator counts the distinct
documents of each line.  A line above ``max_docs`` documents is removed: ``keep``
returns the texts without it.  Whole copies count once, as copies are for the
deduplication operators to judge: the line must also stand in more than
``max_texts`` different texts (``max_docs`` of them, unless told otherwise; 0 counts
documents alone, copies or not).  A document
whose remaining words are under ``min_left`` of its words is depleted and rejected.

Plan: texts are normalised once, and hash, place and words of each line are
stored with the host and a hash of the text.  The counts aggregate on (host,
line, text) and then on (host, line), both with partial sums before the shuffle,
so a line that a third of the documents hold is one row per task; doc_ids are
counted for the lines above the limit only.  What a document loses depends on its
host and text alone and is joined by these.  Tables are broadcast if their
stored size is under the bounds of ``common.small_or_not`` and otherwise joined by
hash, where the adaptive planner splits skewed partitions.  Texts are never
shuffled by the counts.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; a null host is a host of its own; a row without doc_id is a document of
its own text; repeated rows share one verdict; an empty table gives an empty
result.  Other columns pass through; ``judge`` replaces columns that have the
name of one of its results, ``keep`` none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import GAP, small_or_not, stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MIN_LEFT = 0.5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What with_base() adds.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BLANKS = " \t\n\x0b\f\r"


def repeat_words(windows: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    windows: (hash, place) structs of the windows, sorted.  Equal neighbours
    mark a repeated window; each adds the words that the next one leaves.
    """
    same = lambda x, i, step: F.coalesce(F.get(windows, i + step)["h"] == x["h"], F.lit(False))
    again = F.filter(windows, lambda x, i: same(x, i, -1) | same(x, i, 1))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def with_base(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    d = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_l", lines)
    w, n = F.col("_w"), F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes),
        }
    ).drop("_w", "_l")
    # most texts have no repeated window, which a hash set settles without a sort
    places = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(places)).drop("_h")
    d = d.withColumn("_p", repeat_words(F.col("_s"))).drop("_s")
    steps = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")).drop("_p")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _words_in(line: Column) -> Column:
    """Words of a line; most lines have single spaces only, which need no pattern."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\f":
        odd = odd | F.contains(line, F.lit(c))
    t = F.trim(line)
    plain = F.when(t == "", 0).otherwise(1 + F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))))
    return F.when(odd, F.size(F.array_remove(F.split(line, GAP), ""))).otherwise(plain)


def line_rows(docs: DataFrame) -> DataFrame:
    """(host, doc, copy, hashes, words): of every line of docs(doc_id, source, text); the hash of a line without letters and digits is BLANK."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}0-9\n]+", " "), "[0-9]+", "0")
    hashes = F.transform(F.split(plain, "\n", -1), lambda x: F.xxhash64(F.trim(x)))
    copy = F.xxhash64("text")
    return docs.select(F.col("source").alias("host"), F.coalesce("doc_id", copy).alias("doc"), copy.alias("copy"), hashes.alias("hashes"), F.transform(F.split(text, "\n", -1), _words_in).alias("words"))


def _places(rows: DataFrame) -> DataFrame:
    """(host, doc, copy, at, h) of the lines with letters or digits."""
    return rows.select("host", "doc", "copy", F.posexplode("hashes").alias("at", "h")).where(F.col("h") != F.xxhash64(F.lit("")))


def common_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_texts: int | None = None) -> DataFrame:
    """(host, h) of the lines above the limit; rows as line_rows() gives them."""
    lines = _places(rows).select("host", "doc", "copy", "h")
    texts = lines.groupBy("host", "h", "copy").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n"))
    many = small_or_not(texts.where(F.col("n") > (max_docs if max_texts is None else max_texts)).select(F.col("host").alias("ch"), F.col("h").alias("cl")), "many-texts")
    d = lines.join(many, F.col("host").eqNullSafe(F.col("ch")) & (F.col("h") == F.col("cl")))
    d = d.groupBy("host", "h", "doc").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n"))
    return d.where(F.col("n") > max_docs).select("host", "h")


def losses(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, max_texts: int | None = None) -> DataFrame:
    """(host, copy, gone, n_left, depleted) of the texts that hold common lines; gone are the numbers of these lines."""
    rows, _ = stored(line_rows(docs), "quality-lines")
    common = small_or_not(common_lines(rows, max_docs, max_texts).select(F.col("host").alias("ch"), F.col("h").alias("cl")), "common-lines")
    d = _places(rows).join(common, F.col("host").eqNullSafe(F.col("ch")) & (F.col("h") == F.col("cl"))).select("host", "copy", "at")
    d = d.groupBy("host", "copy", "at").agg(F.lit(1).alias("one")).groupBy("host", "copy").agg(F.collect_list("at").alias("gone"))  # a text's lines
    # words of lines without letters and digits don't count on either side
    counted = F.zip_with("words", "hashes", lambda w, h: F.when(h != F.xxhash64(F.lit("")), w).otherwise(0))
    texts = rows.select(F.col("host").alias("th"), F.col("copy").alias("tc"), counted.alias("words"))
    d = d.join(texts, F.col("host").eqNullSafe(F.col("th")) & (F.col("copy") == F.col("tc"))).groupBy("host", "copy").agg(F.first("gone").alias("gone"), F.first("words").alias("words"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n, lost = total(F.col("words")), total(F.transform("gone", lambda i: F.get("words", i)))
    return d.select("host", "copy", "gone", (n - lost).cast("long").alias("n_left"), (n - lost < min_left * n).alias("depleted"))


def _with_losses(docs: DataFrame, max_docs: int, min_left: float, max_texts: int | None) -> DataFrame:
    """(row, doc_id, text, gone, n_left, depleted): row holds all columns of docs."""
    lost = small_or_not(losses(docs.select("doc_id", "source", "text"), max_docs, min_left, max_texts), "quality-losses")
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.col("source").alias("own"), F.xxhash64("text").alias("own_copy"))
    d = d.join(lost, F.col("own").eqNullSafe(F.col("host")) & (F.col("own_copy") == F.col("copy")), "left")
    return d.select("row", "doc_id", "text", "gone", "n_left", "depleted")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, max_texts: int | None = None) -> DataFrame:
    """docs with the base columns, n_left_words (null if no line is common) and kept."""
    d = with_base(_with_losses(docs, max_docs, min_left, max_texts))
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    found = {**{c: F.col(c) for c in BASE}, "n_left_words": F.col("n_left"), "kept": kept}
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in found], *[v.alias(k) for k, v in found.items()])


def keep(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, max_texts: int | None = None) -> DataFrame:
    """The documents that pass, with their own columns only and without the common lines; n_chars follows, if there."""
    d = _with_losses(docs, max_docs, min_left, max_texts).where(~F.coalesce("depleted", F.lit(False)))
    # a generator keeps the filter, and with it the statistics' lambdas, from being copied below
    d = with_base(d).select(F.inline(F.array(F.struct("row", "text", "gone", "base_failed")))).where(~F.col("base_failed"))
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n")
    d = d.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    return d.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = judge(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB's SQL, with the limits above.
ORACLE = r"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from d),
win as (select r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] g from (select r, ws, unnest(range(1, len(ws) - 1)) i from w)),
again as (select r, i from win qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct i + k) n from again, (values (0), (1), (2)) v(k) group by r),
ln as (select r, source, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) o from d),
own as (select r, count(*) - count(distinct l) n from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
nl as (select r, source, o, trim(regexp_replace(regexp_replace(lower(l), '[^\p{L}\p{M}0-9]+', ' ', 'g'), '[0-9]+', '0', 'g')) g, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) c from ln),
cm as (select nl.source, g from nl join d using (r) where g <> '' group by nl.source, g having count(distinct md5(d.t)) > MAX_DOCS and count(distinct coalesce(d.doc_id::varchar, md5(d.t))) > MAX_DOCS),
lost as (select nl.r, sum(nl.c) filter (cm.g is not null) gone, sum(nl.c) n from nl left join cm on nl.g = cm.g and nl.source is not distinct from cm.source where nl.g <> '' group by nl.r),
bad as (select r from lost where n - gone < MIN_LEFT * n),
b as (select d.r, doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(own.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
from d join w using (r) left join rep using (r) left join own using (r)),
f as (select *, n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words base_failed from b)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.r is null kept from f left join bad using (r)
""".replace("MAX_DOCS", str(MAX_DOCS)).replace("MIN_LEFT", str(MIN_LEFT)).replace("MIN_WORDS", str(MIN_WORDS)).replace("MAX_REPEAT", str(MAX_REPEAT_PERCENT))
