import itertools
import random
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece

from terradelta.llm import sentencepiece_codec as s

TEXTS = ["a  b\n\tc  ", " lead", "  two", "ﬁ Å", "x\0y", "<0x0A> <s> </s>", "日本語のテキスト" * 60, "aaaa" * 200, "   ", "hello" * 300, "😀 emoji", "abcabcabc" * 100 + " " + "the" * 400, "=-=-=-" * 200, "Étion dans, çouelle un éonierç", "x", ""]


def test_ids_equal_the_library():
    path = s.default_model()
    m, library = s.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    texts = TEXTS + ["".join(chr(rnd.randrange(32, 0x2000)) for _ in range(300)) for _ in range(20)] + ["".join(rnd.choice("abcdehinorst  ") for _ in range(rnd.randrange(400))) for _ in range(60)] + ["a▁b", "▁"]
    for text in texts:
        assert m.encode(text) == library.encode(text), text[:40]
        if "▁" not in text:
            assert m.decode(m.encode(text)) == text
    assert m.encode(None) == []


def test_lattices_of_words_equal_merging():
    rnd = random.Random(5)
    for _ in range(25):
        scores, made = {c: -100.0 for c in "abcd"}, list("abcd")
        while len(scores) < 22:
            x = rnd.choice(made) + rnd.choice(made)
            if len(x) < 9 and x not in scores:
                scores[x] = -float(len(scores))
                made.append(x)
        m = s.Pieces({k: (i, v) for i, (k, v) in enumerate(scores.items())}, None, 99, True)
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 14))) for _ in range(80)]
        counts, symbols, where, codes = m.lattice.segment(words)
        ends = iter(where.tolist())
        at = 0
        for word, n in zip(words, counts.tolist(), strict=True):
            cuts = [next(ends) + 1 - at for _ in range(n)]
            got = [word[a:b] for a, b in itertools.pairwise([0, *cuts])]
            assert got == m.merges.merged(word)[0] == list(m.segments(word))
            at += len(word)


def test_other_rules_are_refused(monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def encode(self, text, **options):
            return super().encode(text.strip(), **options)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        s.Pieces.load(s.default_model())


def test_unigram_lattice_is_the_best_path():
    rnd = random.Random(3)
    for _ in range(60):
        vocabulary = {c: -rnd.random() * 9 for c in "abc"} | {"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 5))): -rnd.random() * 12 for _ in range(12)}
        m = s.Pieces({k: (i, v) for i, (k, v) in enumerate(vocabulary.items())}, None, 99, False)
        text = "".join(rnd.choice("abc") for _ in range(11))
        best = max(
            sum(vocabulary[p] for p in parts)
            for cuts in itertools.product((0, 1), repeat=len(text) - 1)
            for parts in [[text[a:b] for a, b in itertools.pairwise([0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)])]]
            if all(p in vocabulary for p in parts)
        )
        got = list(m.segments(text))
        assert "".join(got) == text and abs(sum(vocabulary[p] for p in got) - best) < 1e-9


def test_window_stays_bounded():
    m = s.Pieces.load(s.default_model())
    given = m.segments(c for c in "ab" * 50_000)
    assert sum(map(len, given)) == 100_000 and m.commits > 4000


def test_rows(spark):
    rows = [(1, "a b", "q"), (2, None, "q"), (3, "", "q"), (1, "a b", "q"), (4, "a▁b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = s.encode_documents(docs).collect()
    assert len(got) == 5 and [r.round_trip for r in sorted(got)] == [True, True, True, True, False]
    assert sorted(r.n_ids for r in got)[:2] == [0, 0]
    assert s.encode_documents(docs.limit(0), with_ids=False).count() == 0


def test_memory_is_bounded_by_a_group():
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abcdehinorst") for _ in range(8)) for _ in range(400)) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    path = s.default_model()
    run, library = s._run(path, True), sentencepiece.SentencePieceProcessor(model_file=path)
    s.pieces(path)
    tracemalloc.start()
    most = [0]
    for out in run(iter([batch])):
        most.append(tracemalloc.get_traced_memory()[1])
        for i, ids in zip(out["doc_id"].to_pylist(), out["ids"].to_pylist(), strict=True):
            if i % 50 == 0 or not texts[i]:
                assert ids == library.encode(texts[i] or "")
    tracemalloc.stop()
    assert len(most) > 3 and max(most) < 120 << 20
