"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from terradelta.llm import spelling as s

SCHEMA = "doc_id long, text string, n long, form string"


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    blocks = {}  # two words one apart share a half up to one code point
    for w in n:
        for k in {("a", w[: len(w) // 2]), ("b", w[len(w) - len(w) // 2 :]), ("a", w[: (len(w) - 1) // 2]), ("b", w[len(w) - (len(w) - 1) // 2 :]), ("a", w[: (len(w) + 1) // 2]), ("b", w[len(w) - (len(w) + 1) // 2 :])}:
            blocks.setdefault(k, []).append(w)
    near = {w: set() for w in n}
    for group in blocks.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if b not in near[a] and one_apart(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(spark, rows):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in s.spelling_variants(d).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_neighbourhood_is_every_distinct_neighbour():
    a = s.Alphabet(list("abcé"))
    for words in (["aabbca", "abcabc", "éééééé"], ["a"], ["abab"]):
        numbers = a.numbers(words)
        got = [[] for _ in words]
        for w, at, cut, letter, keys in s.neighbourhood(numbers, a):
            for i, p, x, k in zip(w, at, letter, keys, strict=True):
                text = words[i][:p] + ("" if x < 0 else str(a.letters[x])) + words[i][p + cut :]
                got[i].append(text)
                if text:
                    assert s.word_keys(a.numbers([text]), a)[0] == k
        for word, texts in zip(words, got, strict=True):
            n = len(word)
            want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + x + word[i + 1 :] for i in range(n) for x in "abcé"} | {word[:i] + x + word[i:] for i in range(n + 1) for x in "abcé"}
            assert len(texts) == len(set(texts)) and set(texts) == want - {word}


def test_invented_words(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    words = base + [w[:2] + rnd.choice("abÿ") + w[2:] for w in base] + [w[:-1] for w in base] + ["aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 2999 + "y"]
    rows = []
    for i in range(200):
        rows.append((i if i % 17 else None, " ".join(rnd.choices(words, weights=[100 if w in base[:20] else 9 if w in base else 3 for w in words], k=60)).title() if i % 5 else " ".join(rnd.choices(words, k=80))))
    rows += [(400 + i, "lampion " * 19 + "lampioon " * 2 + ("lamppioon" if i < 8 else "")) for i in range(30)]
    rows += [(1, None), (2, ""), (3, "12 34 ., short"), (4, ("ABCdef×÷ÀÖØöøÿ-" * 4))] + [(77, "Repeated repeated REPEATED repeateds")] * 6 + [(9, "x" * 3000)] * 9
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[0] == "lamppioon" and r[1] == "lampioon" and r[2] == "lampion" for r in got) and max(r[4] for r in got) > 3
    assert any(len(r[0]) > 2000 and r[4] for r in got)


def test_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, "too few"), (None, None)]) == []


def test_bits_beyond_the_bound_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(s, "MOST_BITS", 16)
    rows = [(i, " ".join(f"{a}{b}wordlike" for a in "abc" for b in "abcdef")) for i in range(12)]
    assert found(spark, rows) == brute(rows)
    assert int(np.sum([r[4] for r in brute(rows)])) > 20
