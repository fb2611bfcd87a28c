"""Fill-in-middle: exact round trips, forms, boundaries and edge cases."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from terradelta.llm import fill_middle as f

SCHEMA = "doc_id long, text string, n long, form string"


def plain_python(doc_id, text):
    """The contract, read once more without numpy."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet=st.sampled_from("<>PSMab é\U0001f600\n\x00"), max_size=40), st.sampled_from(sorted(f.UNITS)))
def test_round_trip(doc_id, text, units):
    n, form, a, m, out = f.transformed(text.encode(), f.draws(doc_id, 1), units)
    assert n == len(text) and f.restored(out, form) == text.encode()
    if units == "points":
        assert (n, form, a, m, out.decode()) == plain_python(doc_id, text)


def test_boundaries_of_classes():
    codes = f.points("ab 12,é x".encode())
    assert f.boundaries(f.kinds(codes)).tolist() == [0, 2, 3, 5, 6, 7, 8, 9]
    assert f.boundaries(f.each_point(codes)).tolist() == list(range(10)) and f.boundaries(codes[:0]).tolist() == [0]
    raw = b"ok \xff\xfe caf\xc3"
    assert f.encoded(f.points(raw)) == raw


def test_rows_and_edge_cases(spark):
    texts = [(1, None, 5, "clash"), (None, "no id here", 5, None), (2, "", 0, "x"), (3, "a <M> b", 1, "y"), (4, "\U0001f600é" * 40_000, 1, "z"), (5, "twice the same", 1, "z"), (5, "twice the same", 1, "z")]
    texts += [(k, f"text {k} words", 0, "") for k in range(100, 300)]
    got = f.fill_in_middle(spark.createDataFrame(texts, SCHEMA)).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, bytes(r.restored).decode()): r for r in got}
    for doc_id, text, *_ in texts:
        r = by[doc_id, text or ""]
        want = plain_python("" if doc_id is None else doc_id, text or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"} and by[3, "a <M> b"].form == "plain" and by[1, ""].n == 0
    assert f.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_stay_whole(spark):
    words = "alpha beta 12345 gamma, delta"
    got = f.fill_in_middle(spark.createDataFrame([(k, words, 0, "") for k in range(60)], SCHEMA), seed=7, units="classes").collect()
    cuts = {r.prefix_chars for r in got if r.form != "plain"} | {r.prefix_chars + r.middle_chars for r in got if r.form != "plain"}
    assert len(cuts) > 5 and cuts <= set(f.boundaries(f.kinds(f.points(words.encode()))).tolist())
