import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from terradelta.llm import quality_rules as q

WORD = "[^\x20\x09-\x0d]+"


def base(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\W_]+", " ", line.lower())).strip(" ")


def common(rows, limit):
    """Per row: numbers of the lines that go, words of all and of these."""
    texts, docs, per = defaultdict(set), defaultdict(set), []
    for doc, source, text in rows:
        lines = [(k, normal(x), len(re.findall(WORD, x))) for k, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        per.append((source, lines))
        for _, x, _ in lines:
            texts[source, x].add(text)
            docs[source, x].add(doc if doc is not None else text)
    out = []
    for source, lines in per:
        gone = [(k, w) for k, x, w in lines if len(texts[source, x]) > limit and len(docs[source, x]) > limit]
        out.append(({k for k, _ in gone}, sum(w for _, _, w in lines), sum(w for _, w in gone)))
    return out


def kept(rows, limit, left):
    """The rows that pass, without their common lines."""
    out = []
    for (doc, source, text), (gone, n, lost) in zip(rows, common(rows, limit), strict=True):
        if not base(text)[5] and n - lost >= left * n:
            out.append((doc, source, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)))
    return out


def rows_of(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["#x", "<b>", "ä|ö"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    licence = prose(40)
    rows = []
    for i in range(80):
        lines = [prose(rnd.choice([3, 20, 60])) for _ in range(rnd.randrange(1, 5))]
        if i % 2:
            lines.insert(rnd.randrange(len(lines) + 1), licence.upper() if i % 3 else licence)
        rows.append((i, rnd.choice(["a", "b", None]), "\n".join(lines)))
    copy = "\n".join(prose(30) for _ in range(4))
    rows += [(100 + i, "a", copy) for i in range(40)]
    rows += [(200, "a", None), (201, "a", ""), (202, "a", "x y z " * 30), (203, "b", "a b c d\n" * 20), (204, None, " \t\n"), rows[3]]
    return rows


def test_base_and_verdict(spark):
    rows = rows_of() + [(None, "a", "x y z " * 20), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    want = kept(rows, 5, 0.5)
    assert any("\n".join(r[2].split("\n")) != r[2] or r not in rows for r in want)  # some lose lines
    assert {r[0] for r in want} >= set(range(100, 140))  # copies are not boilerplate
    got = q.judge(docs, max_docs=5).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[2] for r in rows[:-2]}
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
    assert sorted(r.doc_id for r in got if r.kept) == sorted(r[0] for r in want)
    left = q.keep(docs, max_docs=5)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def test_rows_of_one_document_are_one_document(spark):
    rows = [(1, "a", "the very same line of many words\nown " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(60))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(map(tuple, q.keep(docs).collect())) == sorted(rows)
    other = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], docs.schema)
    assert all(r.text.startswith("own") for r in q.keep(other).collect())


def test_a_block_of_lines_goes(spark):
    block = "\n".join(f"clause {c} of the notice" for c in ("one", "two", "three", "four"))
    rows = [(i, "a", f"head {chr(97 + i % 26)}{chr(97 + i // 26)}\n{block}\n" + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(60)), 9, "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, gone string")
    got = q.keep(docs).collect()
    assert len(got) == 100 and not any("clause" in r.text for r in got) and all(r.n_chars == len(r.text) and r.gone == "x" for r in got)


def test_long_empty_and_clashing_columns(spark):
    long = " ".join(f"t{i % 5000}" for i in range(30_000))
    docs = spark.createDataFrame([(1, "a", long, 5, "n")], "doc_id long, source string, text string, n_words int, h string")
    got = q.judge(docs).first()
    assert got.n_repeat_words == 30_000 and got.n_words == 30_000 and got.h == "n"
    more = docs.selectExpr("*", "'q' kept", "1 row", "2 depleted", "3 copy", "4 host", "5 n_left", "6 _w")
    got = q.keep(more.where("doc_id < 0"))
    assert got.columns == more.columns and got.count() == 0
    fine = more.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("t"), i.cast("string"))), " "))
    assert tuple(q.keep(fine).first()) == tuple(fine.first())
    assert q.judge(docs.limit(0)).count() == 0 and q.keep(docs.limit(0)).columns == docs.columns


def test_inner_lines_of_a_block_go(spark):
    block = "\n".join(f"clause {c} " + " ".join(f"{c}{j}" for j in "pqrstuvwxy") for c in "abcdefgh")
    docs = spark.createDataFrame([(i, "a", f"{block}\nown " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20))) for i in range(12)], "doc_id long, source string, text string")
    assert q.common_lines(q.line_rows(docs), 5).count() == 8
    assert not any(r.kept for r in q.judge(docs, max_docs=5).collect()) and q.keep(docs, max_docs=5).count() == 0


def test_copies_count_as_documents_if_told(spark):
    text = "a notice of these very words\nown " + " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60))
    docs = spark.createDataFrame([(i, "a", text) for i in range(100)] + [(i, "b", text) for i in range(100, 115)], "doc_id long, source string, text string")
    assert q.keep(docs).count() == 115  # one text
    assert sorted(r.doc_id for r in q.keep(docs, max_texts=0).collect()) == list(range(100, 115))
    assert q.common_lines(q.line_rows(docs), max_texts=0).count() == 2
