import random
import re

from pyspark.sql import functions as F

from terradelta.llm import line_dedup


def apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, near=line_dedup.NEAR_WORDS):
    seen, gone = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            w = re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ").split(" ")
            if w == [""]:
                continue
            if any(v == w or len(w) >= near and len(v) >= near and apart(v, w) for v in seen):
                gone.setdefault(doc, set()).add(at)
            seen.append(w)
    return gone


def rows_of(seed):
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(40)]
    pool = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 7, 8, 9, 12, 30]))] for _ in range(40)] + [["a"] * 8, ["a"] * 9, ["a"] * 10]
    pool.append([rnd.choice(words) for _ in range(200)])
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rnd.randrange(8)):
            line = list(rnd.choice(pool))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(line))
                line[at : at + rnd.randrange(2)] = [rnd.choice(words)] * rnd.randrange(2)
                line = line or ["x"]
            lines.append("  ".join(line).upper() if rnd.random() < 0.1 else " ".join(line))
        rows.append((doc, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[5][1])]


def test_matches_brute_force(spark):
    for seed, near in ((1, line_dedup.NEAR_WORDS), (2, line_dedup.NEAR_WORDS), (3, 2), (4, 3), (5, 9)):
        rows = rows_of(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {}
        for r in line_dedup.removed_lines(docs, near).collect():
            got.setdefault(r.doc_id, set()).add(r.at)
        assert got == brute(rows, near)


def test_dedup_keeps_rows_and_columns(spark):
    rows = [(2, "one two three four", "x", 18, 1), (1, "ONE  two three four\nrest stays here", "x", 35, 2), (3, None, "y", 0, 3), (4, "", "y", 0, 4), (5, "hi", "y", 2, 5), (6, "hi", "y", 2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, n_chars long, at int")
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert sorted(got) == [1, 3, 4, 5] and line_dedup.dedup(docs).columns == docs.columns
    assert got[1].text == rows[1][1] and got[3].text is None and got[4].at == 4
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_prefix_xor_over_blocks(spark):
    for n in (1, 63, 64, 65, 200):
        values = [(i * 7919) % 1013 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<bigint>").select(line_dedup.prefix_xor(F.col("v")).alias("p")).first().p
        want = [0]
        for v in values:
            want.append(want[-1] ^ v)
        assert got == want


def test_rows_are_documents(spark):
    rows = [(0, "a line that is there first of all lines"), (1, "a line that is there first of all lines"), (1, "totally unique line text"), (None, "no name has this text\na LINE that is there first of all lines"), (None, "no name has this text"), (2, "totally  unique line text\nmore"), (3, "same\nrow"), (3, "same\nrow")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, gone int, near int, row int, left int").repartition(3)
    got = line_dedup.dedup(docs)
    assert got.columns == docs.columns and all(tuple(r)[2:] == (1, 2, 3, 4) for r in got.collect())
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert (1, "totally unique line text") in texts and (2, "more") in texts and texts.count((3, "same\nrow")) == 1
    assert sum("first of all lines" in t for _, t in texts) == 1 and sum("no name" in t for _, t in texts) == 1


def test_repeated_rows_keep_one(spark, tmp_path):
    rows = [(7, "a b c\n\nd e f g h i j k", x) for x in (1, 2, 3)] + [(8, "a b c\nown words", 4), (None, "no id", 5), (None, "no id", 6), (9, " \n", 7), (9, " \n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(7, rows[0][1]), (8, "own words"), (None, "no id"), (9, " \n"), (9, " \n")], key=str)
    again = {tuple(r) for r in line_dedup.dedup(docs.repartition(2)).collect()}
    assert again == {tuple(r) for r in line_dedup.dedup(docs).collect()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    told = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_chars_left) for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect() if r.doc_id in (7, 8, 9))
    assert told == [(7, 3, 0, 22), (7, 3, 2, 0), (7, 3, 2, 0), (8, 2, 1, 9), (9, 2, 0, 2), (9, 2, 0, 2)]


def test_a_text_is_cut_once_not_for_every_line(spark):
    assert str(line_dedup._left()).count("split(") == 1
    docs = spark.createDataFrame([("a\nb\n\nc", [1, 2]), ("a\nb", None), ("a", [0])], "text string, gone array<int>")
    assert [r.left for r in docs.select(line_dedup._left().alias("left")).collect()] == ["a\nc", "a\nb", ""]
