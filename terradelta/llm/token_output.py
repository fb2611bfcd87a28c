"""Token ids as Parquet lists, in document order, for selective reads.

Documents are dealt by ranges of doc_id and sorted; each task encodes its texts
and writes one file of rows (doc_id, part, n_tokens, ids).  ``ids`` is a list
column whose values are dictionary encoded while the dictionary pays and delta
encoded (format version 2) after that; row groups and pages have set sizes, and
the writer adds page indexes, so a reader can take metadata without tokens, or
the tokens of some doc_ids, and skip all other pages.  Spark's committer writes
the files: a lost executor repeats its own part only.

Encoding.  The tokenizers library encodes each distinct run of text between
safe cuts once (``runs.RunIds``), and a word with signs behind it, such as
"word,", from the ids of the word and of the signs; a cut before a single space, or around a single
line break, between two other characters never falls inside a pre-token, so the
ids of the runs, one after the other, are the ids of the whole text.  This holds
for byte-level pre-tokenizers without a normaliser; with any other tokenizer a
text is one run.

Each row also stores its file's number and the tokens before it in that file, so
``start`` is its place in the files, whatever doc_ids repeat.  ``read_metadata``
reads no tokens, ``read_tokens`` only the pages of the doc_ids that are asked for.

Edge cases: a null or empty text has only the end id; repeated doc_ids keep
all rows, ordered by their text in the files; an empty table gives an empty
result; other columns are not written and may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import scratch, ship
from terradelta.llm.runs import RunIds, groups, ragged

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
#: White space of Python's and of the pre-tokenizer's rules other than space and line break.
_OTHER_BLANKS = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words in one call's string; longer strings take longer for each word.
_JOINED = 200
#: A word of Latin letters and ASCII signs behind it; the pre-tokenizer always cuts between them.
_WORD_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> np.ndarray:
    """The code point that byte-level vocabularies use for each byte: itself if it prints, else the next from 256 on."""
    prints = np.zeros(256, bool)
    for a, b in ((33, 127), (161, 173), (174, 256)):
        prints[a:b] = True
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u4")


def _cuttable(path: str) -> bool:
    """Whether the tokenizer's own rules allow the cuts."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    before = rules.get("pre_tokenizer") or {}
    return not rules.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


class Encoder:
    """Ids of texts.  A run after a space is named by what follows the space, all others have a line break before."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import Split

        self.tokenizer, self.cuttable = Tokenizer.from_file(path), _cuttable(path)
        self.spaced = self.whole = None
        if self.cuttable:
            pieces = self.tokenizer.get_vocab()
            self.spaced = np.zeros(max(pieces.values()) + 1, bool)
            self.spaced[[i for x, i in pieces.items() if x[0] in "Ġ "]] = True
            added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
            if all(re.search("[A-Za-z]", x) and re.search("[!-/:-@]", x) for x in added):  # none lies within a word or its signs
                self.whole, self.letters = Tokenizer.from_file(path), _byte_letters()
                self.whole.pre_tokenizer = Split("Ġ", "merged_with_next")
        self.runs = RunIds(self._learn)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, words: list[str]) -> list[list[int]]:
        return self._ids([" " + " ".join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)])

    def _letter_ids(self, words: list[str]) -> list[list[int]]:
        """As _spaced_ids, for words of letters alone: their bytes are mapped here and spaces are the only cuts to look for."""
        joined = []
        for at in range(0, len(words), _JOINED):
            raw = np.frombuffer((" " + " ".join(words[at : at + _JOINED])).encode(), np.uint8)
            joined.append(self.letters[raw].tobytes().decode("utf-32-le"))
        return [x.ids for x in self.whole.encode_batch_fast(joined, add_special_tokens=False)]

    def _words(self, words: list[str], joined: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word with a space before it has, and all of them; many words in one call.

        Each word's first id has a space in front, so as many of these as words tell them apart.
        """
        if self.spaced is not None:
            ids = np.fromiter(chain.from_iterable(joined(words)), np.int32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(words):
                return np.diff(np.append(starts, len(ids))), ids
        found = self._ids([" " + x for x in words])
        return np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.int32)

    def _learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run has, and all of them: each is one or two parts, and a part is encoded once."""
        words, signs, spaced, others = {}, {}, [], []  # parts, with their places; runs that are no word with signs
        first, second = np.empty(len(runs), np.int64), np.full(len(runs), -1)
        for i, x in enumerate(runs):
            if self.whole is not None and (m := _WORD_SIGNS.fullmatch(x)):
                word, sign = m.groups()
                first[i] = words.setdefault(word, len(words))
                if sign:
                    second[i] = signs.setdefault(sign, len(signs))
            elif "\n" in x:
                others.append(i)
            else:
                spaced.append(i)
        n, ids = self._words(list(words), self._letter_ids)
        m, more = self._words([runs[i] for i in spaced], self._spaced_ids)
        rest = self._ids([*signs, *(runs[i][1:] if runs[i][0] == "\n" else " " + runs[i] for i in others)])
        counts = np.concatenate([n, m, np.fromiter(map(len, rest), np.int64, len(rest))])
        ids = np.concatenate([ids, more, np.fromiter(chain.from_iterable(rest), np.int32)])
        first[spaced] = len(n) + np.arange(len(spaced))
        first[others] = len(n) + len(m) + len(signs) + np.arange(len(others))
        parts = np.stack([first, np.where(second >= 0, len(n) + len(m) + second, len(counts))], axis=1)
        counts = np.append(counts, 0)  # the last part is none
        lengths = counts[parts]
        return lengths.sum(axis=1), ids[ragged((np.cumsum(counts) - counts)[parts].ravel(), lengths.ravel())]

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.cuttable:
            return ["\n" + text]
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in ("  ", " \n", "\n ", "\n\n")) or any(x in text for x in _OTHER_BLANKS):
            first, *rest = _CUT.split(text)
            return ["\n" + first, *rest]
        return ("\n" + text.replace("\n", " \n\n")).split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        return self.runs.take([self._cut(x) for x in texts])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, before = encoder(path), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in groups(pc.utf8_length(texts).to_pylist()):
                ids, n = e.encode(texts.slice(a, b - a).to_pylist())
                at = np.concatenate([[0], np.cumsum(n + 1)])
                values = np.full(at[-1], END_ID, np.int32)
                inner = np.ones(at[-1], bool)
                inner[at[1:] - 1] = False
                values[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array((n + 1).astype(np.int32)), pa.array(before + at[:-1]), lists], names=["doc_id", "n_tokens", "before", "ids"])
                before += int(at[-1])

    return run


def write_tokens(docs: DataFrame, where: str, tokenizer: str | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write the ids of docs(doc_id, text) below where, ascending by doc_id and part."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    d = d.mapInArrow(_encode(tokenizer or default_tokenizer()), "doc_id long, n_tokens int, before long, ids array<int>")
    d = d.select("doc_id", F.spark_partition_id().alias("part"), "n_tokens", "before", "ids")
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
    }
    d.write.options(**options).parquet(where)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4"))
        at = lists.offsets.to_numpy()
        raw = memoryview(values).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("before"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_metadata(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, part, n_tokens, before) of each row; the token column is not read."""
    return spark.read.parquet(where).select("doc_id", "part", "n_tokens", "before")


def read_tokens(spark: SparkSession, where: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents: row groups by statistics and pages by the page index."""
    return spark.read.parquet(where).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def read_digest(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, from the files."""
    total, starts = 0, []
    for row in read_metadata(spark, where).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row per file
        starts.append((row["part"], total))
        total += row["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    rows = spark.read.parquet(where).select("part", "doc_id", "before", "ids").mapInArrow(_digest, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), where)
    return read_digest(spark, where)
