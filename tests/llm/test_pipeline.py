"""The stages one after the other against the brute-force versions of the operators' tests."""

import random

import sentencepiece

import corpus_pipeline
from terradelta.llm.common import stored
from tests.llm import test_line_dedup, test_mixing, test_ngram_join, test_quality_rules
from terradelta.llm import mixing, quality_rules, sentencepiece_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append("\n".join(prose(rnd.choice([12, 30, 60])) for _ in range(rnd.randrange(2, 5))))
    for i in range(20):
        w = rows[i].split(" ")
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
        rows.append(" ".join(w))
    rows += [None, "", "short", rows[0], "rep eat ed " * 40]
    return [(i, t, "en", rnd.choice(["a", "b", "c"]), len(t or "")) for i, t in enumerate(rows)]


def test_stages_and_run(spark, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {d: (t, s) for d, s, t in test_quality_rules.kept([(r[0], r[3], r[1]) for r in rows], quality_rules.MAX_DOCS, quality_rules.MIN_LEFT)}
    want = [(r[0], left[r[0]][0], r[2], r[3], r[4] if left[r[0]][0] == r[1] else len(left[r[0]][0])) for r in rows if r[0] in left]
    docs = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == sorted(want)

    drop = test_line_dedup.brute([(r[0], r[1]) for r in want])
    left = []
    for r in want:
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in drop.get(r[0], ()))
        if text.strip():
            left.append((r[0], text, r[2], r[3], len(text)))
    docs, _ = stored(docs, "a", keep=True)
    docs = corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert sorted(map(tuple, docs.collect())) == sorted(left) and len(left) < len(want)

    first = {d for d, _, c in test_ngram_join.brute([(r[0], r[1], "") for r in left], 5, 80) if d == c}
    docs, _ = stored(docs, "b", keep=True)
    docs = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(first)

    left = [r for r in left if r[0] in first]
    size = {r[0]: len(r[1].split()) for r in left}
    docs, _ = stored(docs, "c", keep=True)
    docs = corpus_pipeline.mix(spark, docs, str(tmp_path))
    docs, _ = stored(docs, "d", keep=True)
    mixed = docs.collect()
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    for s, want_words in zip("abc", mixing.fill([sum(size[r[0]] for r in left if r[3] == x) for x in "abc"], [5, 2, 1], 1.5 * sum(size.values()), 2)):
        assert abs(sum(size[r.doc_id] for r in mixed if r.source == s) - want_words) <= max(size.values())

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in out) == sorted((r.doc_id, tuple(library.encode(r.text))) for r in mixed)
    assert all(r.round_trip for r in out)


def test_tables_of_which_nothing_stays(spark, tmp_path):
    for name, rows in (("none", []), ("rejected", [(1, "too short", "en", "a", 9), (None, None, None, None, None)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.collect() == [] and "ids" in out.columns


assert test_mixing  # the mix itself is held against brute force there
