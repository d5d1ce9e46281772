"""The registered queries over whole tables, and plain versions of scores and spans."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check_queries import compare, database
from wayfold.llm import quality, secrets
from wayfold.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")

# Columns each result has at least; one row for each document but where told otherwise.
CONTRACT = {
    "op1_quality": "doc_id held_out score predicted",
    "op4_jaccard": "doc_id n_shingles component_id",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_langid": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def test_everything_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_one_row_for_each_document(spark, texts, name):
    found = QUERIES[name](spark, FOLDER)
    assert set(CONTRACT[name].split()) <= set(found.columns)
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        if "held_out" in found.columns:
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        if "score" in found.columns:
            assert 0 <= row["score"] <= 1
        if name == "op5_secrets":
            base = plain_base(texts[row["doc_id"]])
            assert row["base_sha256"] == base[1] and [row["n_assign"], row["n_access"], row["n_hex"]] == base[2]
            assert set(base[0]) <= set(row["spans"].split(",")) or not base[0]


@pytest.mark.parametrize("name", ["op2_warc", "op11_audit"])
def test_queries_equal_their_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLE_SQL[name]) == ""


def test_pipeline_packs_all_that_its_stages_keep(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    placed = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["length"]
    assert set(placed) == set(left) and left
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    assert placed == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_score_equals_a_plain_evaluation_of_the_rules(spark, make_docs):
    random.seed(2)
    docs = make_docs([(i, " ".join(random.choices(["word", "WORD!!", "x.", "9"], k=i % 50))) for i in range(200)])
    stats = quality.with_statistics(docs)
    rules = tuple(
        (tuple((random.randrange(len(quality.NAMES)), random.random() < 0.5, random.random()) for _ in range(k % 3 + 1)),
         random.uniform(-1, 1))
        for k in range(40)
    )
    linear = tuple((i, 0.1, 0.7, random.uniform(-1, 1)) for i in (0, 4, 9))
    model = quality.RuleModel(0.3, rules, linear)
    values = {r["doc_id"]: r for r in stats.collect()}
    for row in quality.score(stats, model).collect():
        numbers = [values[row["doc_id"]][n] for n in quality.NAMES]
        total = 0.3
        for conditions, weight in rules:
            if all(numbers[i] > bound if up else numbers[i] <= bound for i, up, bound in conditions):
                total += weight
        total += sum(w * min(max(numbers[i], low), high) for i, low, high, w in linear)
        assert math.isclose(row["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
        assert row["predicted"] == int(row["score"] >= 0.7)


def plain_base(text):
    """Base spans by trying every start, without patterns: spans, digest and counts by kind."""
    text = text or ""
    low = text.lower()
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    spans = []

    def stretch(start, allowed):
        end = start
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        name = next((n for n in names if low.startswith(n, at) and text[at : at + len(n)].isascii()), None)
        end = None
        if name:
            # A quote is optional, so both readings are tried, the greedy one first.
            for after in [at + len(name) + 1] * (text[at + len(name) : at + len(name) + 1] in ('"', "'") and True) + [at + len(name)]:
                mark = stretch(after, " ")
                if mark < len(text) and text[mark] in ":=":
                    begin = stretch(mark + 1, " ")
                    if begin < len(text) and text[begin] in "\"'":
                        begin += 1
                    stop = stretch(begin, value)
                    if stop > begin:
                        end = stop
                        break
        if end is None:
            at += 1
            continue
        if end - begin >= 6:
            spans.append((at, 0, end))
        at = end
    at = text.find("AKIA")
    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    while at >= 0:
        end = stretch(at + 4, upper)
        if end > at + 4:
            if end - at >= 20:
                spans.append((at, 1, end))
            at = text.find("AKIA", end)
        else:
            at = text.find("AKIA", at + 1)
    at = 0
    while at < len(text):
        end = stretch(at, set("0123456789abcdef"))
        if end - at >= 24:
            spans.append((at, 2, end))
        at = max(end, at + 1)
    kinds = ("assign", "access", "hex")
    written = [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans)]
    digest = hashlib.sha256(",".join(written).encode()).hexdigest()
    return written, digest, [sum(k == n for _, k, _ in spans) for n in range(3)]


def test_base_spans_equal_a_scan_without_patterns(make_docs):
    random.seed(14)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", " ", '"', "'", ":", "=", "  ", "AKIA", "ABCDEFGH0123456789",
             "0123456789abcdef", "deadbeef", "é", "x", "\\n", "value.of/it-", "short", "K", "ſecret"]
    rows = [(i, "".join(random.choices(parts, k=random.randint(0, 30)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "token=" + "a" * 200_000), (903, "0" * 100_000), (5, rows[5][1])]
    docs = make_docs(rows)
    for row in secrets.scan(docs, secrets.learn(docs)).collect():
        wanted = plain_base(dict(rows)[row["doc_id"]])
        assert row["base_sha256"] == wanted[1] and [row["n_assign"], row["n_access"], row["n_hex"]] == wanted[2]
