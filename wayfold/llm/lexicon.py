"""BPE with a lexicon of frequent words as a minimal acyclic transducer.

Words are counted over the whole corpus. The frequent ones and their ids are compiled into an acyclic automaton
whose equal suffixes share states and whose arcs put out ids as early as they are certain. It is one flat file,
mapped into memory by the Python workers, and the distinct words of a batch walk through it together,
one byte at a time. Words that it does not hold are merged by the vocabulary's own BPE model, so ids never
depend on what the lexicon holds.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wayfold.llm.bpe import byte_characters, split_words
from wayfold.llm.tables import share_file, slices, stored

# Words in the lexicon at most, and bytes of its longest word.
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 32
# Distinct words a task counts before it hands its counts on.
COUNTED_WORDS = 200_000
# Counts are told apart by so many leading bits when the least count of the lexicon is chosen.
COUNT_BITS = 5
# Characters of text whose words are looked up together.
TOGETHER = 1 << 22


class State:
    """A state under construction: arcs by byte with output and target, final output or None."""

    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.final: tuple[int, ...] | None = None

    def signature(self) -> tuple:
        return self.final, tuple((b, out, id(target)) for b, (out, target) in self.arcs.items())


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    length = 0
    for x, y in zip(a, b):
        if x != y:
            break
        length += 1
    return length


def minimal_transducer(entries: list[tuple[bytes, tuple[int, ...]]]) -> State:
    """First state of the smallest automaton that puts out the ids of each word.

    ``entries`` are sorted and distinct. Only the path of the last word is still open; every other state is
    final in form and kept once per signature.
    """
    known: dict[tuple, State] = {}
    path = [State()]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            same = known.setdefault(state.signature(), state)
            path[-1].arcs[last[len(path) - 1]][1] = same

    for word, ids in entries:
        common = _shared(tuple(word), tuple(last))
        close(common)
        for byte in word[common:]:
            state = State()
            path[-1].arcs[byte] = [(), state]
            path.append(state)
        last = word
        # What both words put out stays on the shared path; the rest moves one state on.
        for at in range(common):
            arc = path[at].arcs[word[at]]
            keep = _shared(arc[0], ids)
            moved, arc[0] = arc[0][keep:], arc[0][:keep]
            if moved:
                behind = path[at + 1]
                for later in behind.arcs.values():
                    later[0] = moved + later[0]
                if behind.final is not None:
                    behind.final = moved + behind.final
            ids = ids[keep:]
        if common < len(word):
            path[common].arcs[word[common]][0] = ids
            path[-1].final = ()
        else:
            path[-1].final = ids
    close(0)
    return path[0]


# One array after another, each after its length; little-endian 32-bit integers.
_PARTS = ("keys", "targets", "arc_starts", "arc_lengths", "final_starts", "final_lengths", "outputs")


def flat(first: State) -> bytes:
    """The automaton as one file: arcs sorted by state and byte, outputs in one list."""
    numbers = {id(first): 0}
    order = [first]
    for state in order:
        for _, target in state.arcs.values():
            if id(target) not in numbers:
                numbers[id(target)] = len(order)
                order.append(target)
    if len(order) >= 1 << 23:
        raise ValueError("too many states for the file")
    outputs: list[int] = []
    places: dict[tuple[int, ...], int] = {}

    def place(ids: tuple[int, ...]) -> int:
        if ids not in places:
            places[ids] = len(outputs)
            outputs.extend(ids)
        return places[ids]

    columns: dict[str, list[int]] = {name: [] for name in _PARTS[:-1]}
    for number, state in enumerate(order):
        for byte in sorted(state.arcs):
            out, target = state.arcs[byte]
            columns["keys"].append(number * 256 + byte)
            columns["targets"].append(numbers[id(target)])
            columns["arc_starts"].append(place(out))
            columns["arc_lengths"].append(len(out))
        # -1: no word ends here.
        columns["final_starts"].append(0 if state.final is None else place(state.final))
        columns["final_lengths"].append(-1 if state.final is None else len(state.final))
    parts = [*columns.values(), outputs]
    return b"".join(
        np.array([len(p)], dtype="<i4").tobytes() + np.array(p, dtype="<i4").tobytes() for p in parts
    )


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ranges one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Transducer:
    """A compiled lexicon over arrays that may be mapped into memory."""

    def __init__(self, data: np.ndarray):
        at = 0
        for name in _PARTS:
            length = int(data[at])
            setattr(self, name, data[at + 1 : at + 1 + length])
            at += 1 + length

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        return cls(np.memmap(path, dtype="<i4", mode="r"))

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, number of ids of each, and which words are held."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero(lengths <= LEXICON_BYTES)
        held = np.zeros(n, dtype=bool)
        who, starts, counts = [], [], []
        for depth in range(LEXICON_BYTES + 1):
            ended = lengths[alive] == depth
            done = alive[ended]
            final = self.final_lengths[state[done]]
            held[done] = final >= 0
            who.append(done)
            starts.append(self.final_starts[state[done]])
            counts.append(np.maximum(final, 0))
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] * 256 + text[begins[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            alive, arc = alive[known], arc[known]
            state[alive] = self.targets[arc]
            who.append(alive)
            starts.append(self.arc_starts[arc])
            counts.append(self.arc_lengths[arc])
        who, starts, counts = map(np.concatenate, (who, starts, counts))
        # Pieces of a word follow each other in the order they were put out; pieces of others fall away.
        kept = np.flatnonzero(held[who])
        kept = kept[np.argsort(who[kept], kind="stable")]
        counts = counts[kept].astype(np.int64)
        ids = self.outputs[_ranges(starts[kept].astype(np.int64), counts)]
        sizes = np.bincount(who[kept], weights=counts, minlength=n).astype(np.int64)
        return np.asarray(ids), sizes, held


class WordModel:
    """The parts of a tokenizer file: added tokens, word pattern, byte characters and merges."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        whole = Tokenizer.from_str(data.decode())
        pre, decoder = file.get("pre_tokenizer") or {}, file.get("decoder") or {}
        if file.get("normalizer") or pre.get("type") != "ByteLevel" or decoder.get("type") != "ByteLevel":
            raise ValueError("only byte-level tokenizers without normalizer")
        if pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only tokenizers that split by the pattern and add no space")
        self.model = whole.model
        self.splitter = whole.pre_tokenizer
        added = file.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain text")
        self.added = {t["content"]: t["id"] for t in added}
        # The longer of two tokens that begin alike comes first, as in the library.
        names = sorted(self.added, key=lambda c: (-len(c), c))
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        chars = byte_characters()
        self.spelling = {i: c for i, c in enumerate(chars)}
        back = {c: i for i, c in enumerate(chars)}
        tokens = {**{i: t for t, i in file["model"]["vocab"].items()}, **{i: t for t, i in self.added.items()}}
        self.token_bytes = [b""] * (max(tokens, default=-1) + 1)
        for i, token in tokens.items():
            known = all(c in back for c in token)
            self.token_bytes[i] = bytes(map(back.__getitem__, token)) if known else token.encode()

    def words(self, text: str, pattern: regex.Pattern) -> list[str]:
        """Words of a stretch without added tokens."""
        return split_words(text, pattern, self.splitter)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by the vocabulary's merges."""
        spelled = b"".join(words).decode("latin-1").translate(self.spelling)
        tokenize = self.model.tokenize
        ends = list(accumulate(map(len, words), initial=0))
        # One character for each byte, so the words lie where their bytes did.
        return [[t.id for t in tokenize(spelled[a:b])] for a, b in zip(ends, ends[1:])]


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file as it travels to the tasks: a few MB, read once on the driver."""

    data: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> TokenizerFile:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def get(self) -> tuple[WordModel, regex.Pattern]:
        return _model(self.data), regex.compile(self.pattern)


@lru_cache(maxsize=2)
def _model(data: bytes) -> WordModel:
    return WordModel(data)


@lru_cache(maxsize=2)
def _transducer(name: str) -> Transducer:
    return Transducer.mapped(SparkFiles.get(name))


def _stretches(text: str, model: WordModel) -> list[str]:
    """The text cut at added tokens; those are at odd places."""
    return model.marks.split(text) if model.marks else [text]


def word_counts(docs: DataFrame, tokenizer: TokenizerFile, text_col: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n``: how often each word short enough for the lexicon occurs in all texts.

    Each task adds up its own words before the shuffle, so a word that is everywhere is a few rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def handed(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = [w.encode() for w in counts]
        frame = {"word": pa.array(words, pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
        whole = pa.RecordBatch.from_pydict(frame)
        for start in range(0, whole.num_rows, 10_000):
            yield whole.slice(start, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pattern = shipped.value.get()
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for stretch in _stretches(text or "", model)[::2]:
                    counts.update(model.words(stretch, pattern))
                if len(counts) >= COUNTED_WORDS:
                    yield from handed(counts)
                    counts.clear()
        yield from handed(counts)

    partial = docs.select(text_col).mapInArrow(run, "word binary, n long")
    short = partial.where(F.octet_length("word") <= LEXICON_BYTES)
    return short.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words, ``most`` at most: all that reach one least count.

    Least counts are the numbers of few leading bits, so a histogram of a few hundred rows tells
    which one leaves few enough words; only these come to the driver.
    """
    counts = stored(counts, "word-counts")
    step = F.greatest(F.length(F.bin("n")) - COUNT_BITS, F.lit(0))
    least = F.expr("n").cast("long") - F.pmod(F.col("n"), F.pow(F.lit(2), step).cast("long"))
    histogram = counts.groupBy(least.alias("least")).count().orderBy(F.desc("least")).collect()
    total, reached = 0, None
    for row in histogram:
        total += row["count"]
        if total > most:
            break
        reached = row["least"]
    if reached is None:
        return []
    return [bytes(r["word"]) for r in counts.where(F.col("n") >= reached).select("word").collect()]


@dataclass(frozen=True)
class Lexicon:
    """A tokenizer file and the shared file of its compiled frequent words."""

    tokenizer: TokenizerFile
    file: str
    words: int


def compile_lexicon(
    docs: DataFrame, tokenizer: TokenizerFile, text_col: str = "text", most: int = LEXICON_WORDS
) -> Lexicon:
    """Count all words of the corpus and compile the frequent ones; every executor gets the file once."""
    model, _ = tokenizer.get()
    words = sorted(frequent_words(word_counts(docs, tokenizer, text_col), most))
    entries = [(w, tuple(ids)) for w, ids in zip(words, model.merge(words))]
    name = share_file(docs.sparkSession, flat(minimal_transducer(entries)), "lexicon")
    return Lexicon(tokenizer, name, len(words))


def _word_ids(
    words: list[str], model: WordModel, transducer: Transducer
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after another and the number of ids of each."""
    spelled = [w.encode() for w in words]
    ids, sizes, held = transducer.look_up(spelled)
    missed = np.flatnonzero(~held)
    if not len(missed):
        return ids, sizes
    merged = model.merge([spelled[i] for i in missed.tolist()])
    sizes[missed] = list(map(len, merged))
    # Held words keep their order, merged ones go between them.
    result = np.empty(int(sizes.sum()), dtype=np.int32)
    from_lexicon = np.repeat(held, sizes)
    result[from_lexicon] = ids
    result[~from_lexicon] = list(chain.from_iterable(merged))
    return result, sizes


def encode_texts(
    texts: list[str], model: WordModel, pattern: regex.Pattern, transducer: Transducer
) -> list[np.ndarray]:
    """Ids of each text. Words are looked up once per call, however often they occur."""
    # A new word gets the next number. The empty word stands for added tokens and has no ids of its own.
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    numbers[""]
    tokens: list[int] = []
    counts = []
    marks: list[tuple[int, int]] = []
    for text in texts:
        before = len(tokens)
        for number, stretch in enumerate(_stretches(text, model)):
            if number % 2:
                marks.append((len(tokens), model.added[stretch]))
                tokens.append(0)
            else:
                tokens.extend(map(numbers.__getitem__, model.words(stretch, pattern)))
        counts.append(len(tokens) - before)
    ids, sizes = _word_ids(list(numbers), model, transducer)
    begins = np.cumsum(sizes) - sizes
    codes = np.array(tokens, dtype=np.int64)
    starts, lengths = begins[codes], sizes[codes]
    if marks:
        added = np.array([i for _, i in marks], dtype=np.int32)
        at = np.array([p for p, _ in marks])
        starts[at], lengths[at] = len(ids) + np.arange(len(marks)), 1
        ids = np.append(ids, added)
    whole = ids[_ranges(starts, lengths)].astype(np.int32)
    ends = np.append(0, np.cumsum(lengths))
    edges = ends[np.append(0, np.cumsum(counts)).astype(int)]
    return [whole[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _together(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts of rows whose texts together are about so long, or one row that is longer alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(1).to_pylist()]
        start = stop


def encode(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, as the tokenizers library gives them without special tokens around.

    Strings of added tokens in a text become those tokens, as in the library. A null text counts as empty and
    has no ids. Every input row gives one row of id and ``ids``, also when ids are null or repeated; other
    columns are left out, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon.tokenizer)
    name = lexicon.file
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pattern = shipped.value.get()
        transducer = _transducer(name)
        for batch in batches:
            for part, texts in _together(batch):
                ids = pa.array(encode_texts(texts, model, pattern, transducer), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode(
    frame: DataFrame, tokenizer: TokenizerFile, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``text`` of arrays of ids beside id and ids, added tokens spelled out.

    Bytes that are no UTF-8 become the replacement character. Null or empty arrays give empty text; an id
    outside the vocabulary is an error.
    """
    shipped = frame.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType(
        [
            T.StructField(id_col, frame.schema[id_col].dataType),
            T.StructField(ids_col, T.ArrayType(T.IntegerType())),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = shipped.value.get()
        size = len(model.token_bytes)
        for batch in slices(batches):
            ids = batch.column(1)
            flat = ids.flatten().to_numpy()
            if len(flat) and not (0 <= flat.min() and flat.max() < size):
                raise ValueError("ids outside the vocabulary")
            spelled = list(map(model.token_bytes.__getitem__, flat.tolist()))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
            texts = [b"".join(spelled[a:b]).decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, ids_col, "text"])

    ids = F.col(ids_col).cast("array<int>").alias(ids_col)
    return frame.select(id_col, ids).mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids and SHA-256 of the decimal ids joined by commas and of the decoded text."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
