"""The transducer lexicon against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import lexicon
from wayfold.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello world, it's a test.\n\n  Two  spaces and\ttabs ",
    "Übergrößen straße ñandú — “quotes” … 😀👩‍👩‍👧 é",
    "数字１２３ ½ ² Ⅷ नमस्ते العربية 　 x ภาษาไทย",
    "unassigned ա՘ա a֌a ࢏𞤀𑄀 ౜1",
    "a" * 3000 + " " + "ab" * 900,
    " " * 50 + "x\r\n\r\n",
    "before <|endoftext|> after<|endoftext|><|endoftext|>\n<|endoftext",
    "<|endoftext|>",
    "\x00\x1f\x7f \x1cx don't WE'LL they're",
    "the word the word the word " * 4000,
    "",
    None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return lexicon.TokenizerFile.read(PATH, public_tokenizers.PATTERN)


def held(entries):
    return lexicon.Transducer(np.frombuffer(lexicon.flat(lexicon.minimal_transducer(entries)), dtype="<i4"))


def split(ids, sizes):
    return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


def test_transducer_holds_exactly_its_words():
    random.seed(4)
    for letters, most in ((b"ab", 6), (b"abcdefgh", 5), ("é世".encode(), 4)):
        words = {bytes(random.choices(letters, k=random.randint(1, most))) for _ in range(200)}
        entries = [(w, tuple(random.choices(range(5), k=random.randint(0, 4)))) for w in sorted(words)]
        found = held(entries)
        other = {bytes(random.choices(letters, k=random.randint(0, most + 1))) for _ in range(200)} - words
        asked = [w for w, _ in entries] + sorted(other) + [b"a" * 100]
        ids, sizes, inside = found.look_up(asked)
        assert inside.tolist() == [w in words for w in asked]
        wanted = [*(i for _, i in entries), *[()] * (len(asked) - len(entries))]
        assert split(ids, sizes) == wanted


def reachable(state):
    seen, open_ = {id(state)}, [state]
    while open_:
        for _, target in open_.pop().arcs.values():
            if id(target) not in seen:
                seen.add(id(target))
                open_.append(target)
    return len(seen)


def test_equal_suffixes_share_states():
    endings = [b"ing", b"ings", b"ed"]
    entries = sorted((stem + end, (n,)) for n, stem in enumerate([b"walk", b"talk", b"jump"]) for end in endings)
    # Outputs come with the first letter, so walk and talk share the rest: the first state, 3 inside -alk, 3 inside
    # jump-, where stems end, 1 inside -ed, 3 of -ing, and the last state of -ed and -ings.
    assert reachable(lexicon.minimal_transducer(entries)) == 1 + 3 + 3 + 1 + 1 + 3 + 1
    assert reachable(lexicon.minimal_transducer([(bytes([97, x]), (7,)) for x in range(50)])) == 3
    nothing = held([])
    assert nothing.look_up([b"", b"a"])[2].tolist() == [False, False]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_ids_equal_the_library_whatever_the_lexicon_holds(make_docs, library, tokenizer, most):
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[1]), (None, None)]
    docs = make_docs(rows).withColumns({"ids": F.lit("x"), "n": F.lit(1), "word": F.lit("w")})
    compiled = lexicon.compile_lexicon(docs, tokenizer, most=most)
    assert compiled.words <= most
    found = lexicon.decode(lexicon.encode(docs, compiled), tokenizer).collect()
    wanted = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, wanted))


def test_every_character_as_the_library_splits_it(library, tokenizer):
    model, pattern = tokenizer.get()
    empty = held([])
    random.seed(6)
    texts = []
    for begin in range(0, 0x110000, 16):
        chars = [chr(c) for c in range(begin, begin + 16) if not 0xD800 <= c <= 0xDFFF]
        # Every block below U+3000, every ninth above.
        if chars and (begin < 0x3000 or begin % 144 == 0):
            texts.append("".join(f"a{c}b {c}1{c}! {c}  {c}" for c in chars))
    found = lexicon.encode_texts(texts, model, pattern, empty)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:4]


def test_random_texts(library, tokenizer):
    model, pattern = tokenizer.get()
    random.seed(8)
    alphabet = "aab' \n\t1.é世😀́  \x1c" + "st"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(2000)]
    words = sorted({w.encode() for t in texts[:500] for w in regex.findall(public_tokenizers.PATTERN, t)})
    short = [w for w in words if len(w) <= lexicon.LEXICON_BYTES]
    some = held([(w, tuple(ids)) for w, ids in zip(short, model.merge(short))])
    for text, ids in zip(texts, lexicon.encode_texts(texts, model, pattern, some), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts_cover_all_texts_and_the_most_frequent_words_are_taken(spark, make_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(lexicon, "COUNTED_WORDS", 2)
    docs = make_docs([(i, "sun " * (i + 1) + "w" * 40 + f" u{i}") for i in range(20)])
    counts = lexicon.word_counts(docs, tokenizer)
    found = {bytes(r["word"]): r["n"] for r in counts.collect()}
    assert found[b"sun"] == 20 and found[b" sun"] == sum(range(20)) and b"w" * 40 not in found
    assert set(lexicon.frequent_words(counts, 2)) == {b" sun"}
    assert {b" sun", b"sun", b" u"} <= set(lexicon.frequent_words(counts, 5))
    assert lexicon.frequent_words(counts, 0) == []


def test_decoding_split_characters_and_wrong_ids(spark, library, tokenizer):
    ids = library.encode("😀世").ids
    rows = [(1, ids), (2, ids[:1]), (3, ids[1:]), (4, []), (5, None), (6, [50256, 50256])]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in lexicon.decode(frame, tokenizer).collect()}
    assert found == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}
    wrong = spark.createDataFrame([(1, [50257])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        lexicon.decode(wrong, tokenizer).collect()


def test_empty_table(make_docs, tokenizer):
    docs = make_docs([])
    compiled = lexicon.compile_lexicon(docs, tokenizer)
    assert lexicon.digests(lexicon.decode(lexicon.encode(docs, compiled), tokenizer)).count() == 0


def test_registered_query_equals_the_library(spark, library):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    wanted = {}
    for row in texts:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        spelled = ",".join(map(str, ids))
        text = library.decode(ids, skip_special_tokens=False)
        wanted[row["doc_id"]] = (
            len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )
    found = QUERIES["op13_lexicon"](spark, FOLDER).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == wanted and len(found) == len(texts)
