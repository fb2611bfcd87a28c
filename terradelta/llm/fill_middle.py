"""Fill-in-middle: cut each text at two of its boundaries and move the middle to the end.

A text becomes a numpy array of UTF-32 code points.  Every code point has a
class; a boundary lies wherever neighbouring classes differ, and at both ends.
Two boundaries, chosen by rank from a hash of the document's id, give prefix,
middle and suffix, which are sliced from the array and encoded again:

* plain: the text as it is, for an empty text, a text that holds one of the
  marks, and a share of all others;
* psm: <P>prefix<S>suffix<M>middle;
* spm: <S>suffix<P>prefix<M>middle.

restored() takes an output apart again from its form and marks alone.  Marks
are found from the left; as no part of a cut text holds a mark and "<" only
starts one, the first of each is the one that was put there.

With units="points" each code point is a class of its own, so every place is a
boundary; units="classes" keeps letters, digits, white space and other signs
together, so that no word or number is cut.

Edge cases: a null text counts as empty (plain, n = 0); a null doc_id hashes as
an empty number; repeated rows give equal rows; bytes that are no UTF-8 stay as
they are; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many are cut, and of 100 cut ones so many start with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary"
#: Texts of a batch that leaves a task have about so many bytes.
BATCH_BYTES = 4 << 20


def points(raw: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes; a byte that is no UTF-8 becomes a lone surrogate."""
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(codes: np.ndarray) -> bytes:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def each_point(codes: np.ndarray) -> np.ndarray:
    return np.arange(len(codes))


def kinds(codes: np.ndarray) -> np.ndarray:
    """0 white space, 1 digit, 2 other ASCII signs, 3 letters and all beyond ASCII."""
    table = np.array([0 if chr(i).isspace() else 1 if chr(i).isdigit() else 3 if chr(i).isalpha() else 2 for i in range(128)], np.int8)
    return np.where(codes < 128, table[np.minimum(codes, 127)], 3)


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"points": each_point, "classes": kinds}


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Places where neighbouring classes differ, and both ends."""
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(classes)]]) if len(classes) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(raw: bytes, draw: list[int], units: str = "points") -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, those of the prefix and of the middle, output) of one text."""
    codes = points(raw)
    if not len(codes) or any(m.encode() in raw for m in MARKS) or draw[2] % 100 >= CUT:
        return len(codes), "plain", None, None, raw
    cuts = boundaries(UNITS[units](codes))
    a, b = sorted(int(cuts[d % len(cuts)]) for d in draw[:2])
    prefix, middle, suffix = (encoded(codes[x:y]) for x, y in ((0, a), (a, b), (b, len(codes))))
    p, s, m = (x.encode() for x in MARKS)
    if draw[3] % 100 < SUFFIX_FIRST:
        return len(codes), "spm", a, b - a, b"".join([s, suffix, p, prefix, m, middle])
    return len(codes), "psm", a, b - a, b"".join([p, prefix, s, suffix, m, middle])


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in MARKS)
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"an output of the form {form} starts with {first.decode()}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _rows(seed: int, units: str):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"), strict=True):
                raw = raw.as_py() or b""
                n, form, prefix, middle, output = transformed(raw, draws(doc_id, seed), units)
                rows.append((doc_id, n, form, prefix, middle, output, restored(output, form)))
                size += 2 * len(output)
                if size > BATCH_BYTES:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, units: str = "points") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of each row of docs(doc_id, text, ...).

    output and restored are UTF-8 bytes; a cast makes them strings.
    """
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    ship(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(_rows(seed, units), SCHEMA)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: The same in DuckDB's SQL.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
x as (select *, length(t) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b from x),
c as (select *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) s from f)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from c
"""
