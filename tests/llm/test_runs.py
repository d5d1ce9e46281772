"""Periodic runs against plain comparison of every period, and digests against a second spelling."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import runs
from wayfold.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every maximal stretch for every period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end > n:
                break
            if end - start >= max(6, 4 * q):
                found.setdefault((start, end - start), q)
            start = max(start + 1, end - q + 1)
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*words, word] if w]


def plain_row(doc_id, text):
    words = plain_words(text)
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    milli = 1000 * longest[1] // longest[2] if found else None
    return [
        len(found),
        *longest,
        milli,
        hashlib.sha256(digest.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    ]


def numbered(documents):
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    return np.array([w for d in documents for w in d], dtype=np.int64), lengths


def test_runs_equal_plain_comparison():
    random.seed(11)
    documents = []
    for _ in range(600):
        kind = random.random()
        letters = random.choice([1, 2, 2, 3, 5])
        length = random.randint(0, 60)
        if kind < 0.5:
            documents.append(random.choices(range(letters), k=length))
        else:
            # Repeats within repeats.
            inner = random.choices(range(letters), k=random.randint(1, 4)) * random.randint(1, 7)
            whole = (inner + random.choices(range(letters), k=random.randint(0, 3))) * random.randint(1, 6)
            documents.append(random.choices(range(letters), k=random.randint(0, 5)) + whole)
    documents += [[], [0] * 5, [0] * 6, [0] * 200, [0, 1] * 100, [0, 1, 2] * 4, [0, 1, 2] * 3 + [0, 1]]
    for found, document in zip(runs.find_runs(*numbered(documents)), documents, strict=True):
        assert [tuple(r) for r in found.tolist()] == plain_runs(document), document


def test_suffix_array_is_sorted_with_common_prefixes():
    random.seed(2)
    text = random.choices(range(2), k=300) + [0] * 200
    array = runs.suffix_array(np.array(text), np.full(len(text), len(text)))
    expected = sorted(range(len(text)), key=lambda i: text[i:])
    # Words are ranked by number here, so the order is the usual one.
    assert array.order.tolist() == expected
    for k in range(1, len(text)):
        a, b = text[expected[k - 1] :], text[expected[k] :]
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert array.lcp[k] == common


def odd_documents():
    random.seed(9)
    texts = [
        None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b  a\ta\na a\x0ba a\x0c c",
        "x y " * 20, "s\x1cs " * 8, "é é " * 7, "A a " * 9, "no runs here at all",
        ("p q r " * 5 + "z ") * 5, "long " * 60_000, " ".join(f"w{k % 5000}" for k in range(25_000)),
    ]
    texts += [" ".join(random.choices("abc", k=random.randint(1, 90))) for _ in range(150)]
    rows = [*enumerate(texts)]
    return rows + [(4, "other text"), (5, texts[5]), (5, texts[5]), (None, "k k k k k k"), (None, None)]


def test_query_rows_equal_a_plain_version(make_docs):
    rows = [r for r in odd_documents() if r[1] is None or len(r[1]) < 5000]
    found = runs.digests(runs.mark_runs(runs.with_periods(make_docs(rows)))).collect()
    assert sorted(map(str, (list(r) for r in found))) == sorted(
        str([i, *plain_row(i, t)]) for i, t in rows
    )


def test_very_long_texts_and_every_row_once(make_docs):
    rows = odd_documents()
    found = runs.mark_runs(make_docs(rows)).collect()
    assert len(found) == len(rows)
    by_text = {r["n_words"]: r for r in found}
    assert [tuple(x) for x in by_text[60_000]["runs"]] == [(0, 60_000, 1)]
    assert by_text[60_000]["collapsed"] == "long"
    assert [tuple(x) for x in by_text[25_000]["runs"]] == [(0, 25_000, 5000)]


def test_clashing_columns_and_empty_table(spark, make_docs):
    docs = make_docs([(1, "a a a a a a a"), (2, "b")]).withColumns(
        {"runs": F.lit(1), "collapsed": F.lit("x"), "n_words": F.lit(0), "_longest": F.lit(2)}
    )
    found = {r["doc_id"]: r for r in runs.digests(runs.mark_runs(docs)).collect()}
    assert found[1]["n_runs"] == 1 and found[1]["exponent_milli"] == 7000 and found[2]["start"] is None
    assert runs.digests(runs.mark_runs(make_docs([]))).count() == 0


def test_documents_do_not_see_each_other():
    found = runs.find_runs(*numbered([[0, 0, 0], [0, 0, 0], [0] * 6]))
    assert [len(f) for f in found] == [0, 0, 1]


@pytest.mark.parametrize("tested", [1, 7])
def test_small_steps_change_nothing(monkeypatch, tested):
    document = [0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 0]
    monkeypatch.setattr(runs, "TESTED", tested)
    found = runs.find_runs(*numbered([document, document]))
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(document)] * 2


def test_registered_query_equals_a_plain_version(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in texts if len(r["text"]) < 6000]
    small = {i for i, _ in rows}
    found = [list(r) for r in QUERIES["op12_runs"](spark, FOLDER).collect()]
    assert len(found) == len(texts)
    assert sorted(r for r in map(str, (r for r in found if r[0] in small))) == sorted(
        str([i, *plain_row(i, t)]) for i, t in rows
    )
    assert any(r[1] for r in found)
