"""The filter audit against every order played out document by document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import types as T

from wayfold.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(text, doc_id, firsts):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
        out.add("C")
    if set(text) & set("#$%&*|"):
        out.add("D")
    if doc_id is not None and firsts[text] < doc_id:
        out.add("E")
    return out


def brute(docs, labels):
    firsts = defaultdict(lambda: float("inf"))
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(firsts[text or ""], doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for doc_id, text, source in docs:
        parts[source or ""].append((doc_id, fails(text, doc_id, firsts)))
    rows = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = sum(letter in f for _, f in members)
                rows[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    failing - len(gone),
                    sum(f == {letter} for _, f in members),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
                shapley[letter] += len(gone)
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def played(spark, docs, labels):
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("source", T.StringType()),
            # Names the operator uses itself.
            *[T.StructField(n, T.LongType()) for n in ("part", "mask", "digest", "own", "first_id", "good")],
        ]
    )
    frame = spark.createDataFrame([(*d, 1, 1, 1, 1, 1, 1) for d in docs], schema)
    found = audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    rows = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found}
    assert len(rows) == len(found)
    return rows


def odd_corpus():
    random.seed(5)
    words = ["sun", "Moon", "TREE", "x#", "é", "𝒳", "a b", " ", "s\x1cs"]
    docs = []
    for i in range(120):
        many = random.random() < 0.6
        vocabulary = [f"w{k}" for k in range(80)] if random.random() < 0.5 else words
        text = random.choice([" ", "\t", "\n", "\x0b "]).join(
            random.choices(vocabulary, k=random.randint(45, 90) if many else random.randint(0, 6))
        )
        docs.append((i, text, random.choice(["a", "b", None, ""])))
    docs += [(200 + k, docs[3][1], "hot") for k in range(40)]
    docs += [(None, docs[3][1], "a"), (None, "", None), (None, None, "b"), (7, docs[7][1], "a"), (7, "other", "b")]
    docs += [(300, None, "a"), (301, "", "b"), (302, "Word " * 30_000, "long"), (303, "x" * 200_000, "long")]
    docs += [(304, "|", "d"), (305, "A" + "b" * 19, "d"), (306, "A" + "b" * 18, "d")]
    labels = [(i, i % 3 % 2, i % 5 == 0) for i in range(0, 210, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    labels += [(4, 1, 1), (4, None, None), (None, 1, 1), (9999, 1, 1), (6, None, 1), (7, 1, 0)]
    return docs, labels


def test_audit_equals_playing_every_order(spark):
    docs, labels = odd_corpus()
    assert played(spark, docs, labels) == brute(docs, labels)


def test_audit_by_shuffle_joins(spark, shuffled):
    docs, labels = odd_corpus()
    assert played(spark, docs, labels) == brute(docs, labels)


def test_shares_add_up_to_what_all_filters_remove(spark):
    docs, labels = odd_corpus()
    rows = played(spark, docs, labels)
    for part in {p for p, _, _ in rows}:
        whole = [rows[part, "ABCDE", k] for k in range(1, 6)]
        assert sum(r[6] for r in whole) == 120 * sum(r[1] for r in whole)


def test_audit_of_nothing(spark):
    assert played(spark, [], []) == {}
    rows = played(spark, [(1, "short", "s")], [])
    assert len(rows) == 600 and rows["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    assert rows["s", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("copies", [2, 300])
def test_only_larger_ids_are_copies(spark, copies):
    text = " ".join(f"w{k}" for k in range(60))
    docs = [(k, text, str(k % 2)) for k in range(copies)]
    rows = played(spark, docs, [])
    removed = sum(rows[p, "EABCD", 1][1] for p in ("0", "1"))
    assert removed == copies - 1 and rows["0", "EABCD", 1][0] == 1
