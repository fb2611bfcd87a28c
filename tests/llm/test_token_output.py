import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from terradelta.llm import token_output as t

TEXTS = ["it's  we'll\n\n x  y <|endoftext|> z<|endoftext|>", " ", "\n", None, "", " lead", "trail ", "a b  c", "日本語 の テキスト", "one two  three\tfour " * 500, "x" * 3000, "😀 emoji", "One, two.\nThree... (four), 5, é. ª.\n's, x_.\n—. a\n\tb c\u2028d, e\x1c f.", "\nlead", "a.\nb.\nc."]


def test_runs_equal_whole_texts():
    path = t.default_tokenizer()
    whole = Tokenizer.from_file(path)
    e = t.Encoder(path)
    for bound in (e.runs.bound, 4000):  # the second forgets all the time
        e.runs.bound = bound
        for texts in (TEXTS, TEXTS[::-1], TEXTS):
            ids, n = e.encode(texts)
            for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert part.tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    e, whole = t.Encoder(path), Tokenizer.from_file(path)
    assert not e.cuttable
    ids, n = e.encode(TEXTS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_start_is_the_place_in_the_file(spark, tmp_path):
    docs = spark.createDataFrame([(5, x) for x in ("a b c d e", "b", "c d e", "d", None)], "doc_id long, text string")
    t.write_tokens(docs, f"{tmp_path}/s")
    rows = spark.read.parquet(f"{tmp_path}/s").select("part", "before", "ids").orderBy("part", "before").collect()
    got = t.read_digest(spark, f"{tmp_path}/s").orderBy("start").collect()
    start = 0
    for row, digest in zip(rows, got, strict=True):
        assert (digest.start, digest.n_tokens, digest.ids_crc32) == (start, len(row.ids), zlib.crc32(np.array(row.ids, "<u4").tobytes()))
        start += len(row.ids)


def test_selective_reads(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('word ', id, repeat(concat(' text ', id * 7), 30)) text").coalesce(1)
    t.write_tokens(docs, f"{tmp_path}/r", row_group_bytes=1 << 20, page_bytes=4096)
    meta = t.read_metadata(spark, f"{tmp_path}/r")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    some = t.read_tokens(spark, f"{tmp_path}/r", [17, 3001])
    assert sorted(r.doc_id for r in some.collect()) == [17, 3001]
    scan = spark.read.parquet(f"{tmp_path}/r").where("doc_id in (17, 3001)").select("doc_id", "ids")
    plan = scan._jdf.queryExecution().executedPlan()
    scan._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 2000  # the page index skips the other pages


def test_files_and_digest(spark, tmp_path):
    rows = [(7 * i % 101, x, "s") for i, x in enumerate(TEXTS)] + [(500, "twice", "s"), (500, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    t.write_tokens(docs, f"{tmp_path}/t")
    whole = Tokenizer.from_file(t.default_tokenizer())
    want, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(map(tuple, t.read_digest(spark, f"{tmp_path}/t").collect()), key=lambda r: r[1])
    assert sorted((d, n, c) for d, _, n, c in got) == sorted(want) and [r[0] for r in got] == sorted(r[0] for r in rows)
    for _, s, n, _ in got:
        assert s == start
        start += n
    files = sorted((tmp_path / "t").glob("*.parquet"))
    last = -1
    for f in files:
        ids = pq.read_table(f)["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] >= last)
        last = ids[-1] if ids else last
        meta = pq.ParquetFile(f).metadata
        columns = [meta.row_group(0).column(i) for i in range(meta.num_columns)]
        assert all(c.has_column_index for c in columns) and any("RLE_DICTIONARY" in c.encodings for c in columns)
    assert t.read_digest(spark, f"{tmp_path}/t").columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    t.write_tokens(docs, f"{tmp_path}/e")
    assert t.read_digest(spark, f"{tmp_path}/e").count() == 0


def test_words_with_signs_have_the_library_s_ids():
    import random

    e = t.Encoder(t.default_tokenizer())
    parts = ["don't", "ab,", "x'", "é,,", "Straße...", "×a", "a×,", "ɏ!", "ɐ!", "_a_", "a_", "12,", "a1,", "日本,", "<|endoftext|>", "a<|endoftext|>", "<|", "á,", "$$", "word$$$", "\t", "  ", "Ġa", "a­,", " ", "µ,", "ª", "'s,", "ÿ'", "İ,", "…,"]
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    ids, n = e.encode(texts)
    assert e.whole is not None and n.tolist() == [len(x) for x in e._ids(texts)]
    assert ids.tolist() == [i for x in e._ids(texts) for i in x]
