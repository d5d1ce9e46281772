"""Byte-level BPE encoding and decoding with the models of the tokenizers library.

Text is cut by the pattern into words, each word's UTF-8 bytes become one printable character per byte,
and the library's BPE model merges them. Words repeat, so their ids are kept in a bounded
table per Python worker; what a word yields never depends on that table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from wayfold.llm.tables import keeps, slices, working

# Words kept per Python worker, and the longest word kept.
KEPT_WORDS = 400_000
KEPT_LENGTH = 48

# In these characters the short classes below mean the same as \p{L}, \p{N} and the pattern's \s. The separators
# U+001C to U+001F are not among them: they are white space here and not in the pattern.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ɏ]*")
# Below this character the regex module's classes are those of the tokenizing libraries, whose Unicode version is older.
_AGREED = re.compile("[\x00-ԯ]*")
_PLAIN_WORDS = re.compile(
    r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)


def split_words(text: str, pattern: regex.Pattern, splitter: pre_tokenizers.PreTokenizer) -> list[str]:
    """Matches of the pattern, as the library's splitter has them, by the fastest of three ways that agree on the text."""
    if _PLAIN.fullmatch(text):
        return _PLAIN_WORDS.findall(text)
    if _AGREED.fullmatch(text):
        return pattern.findall(text)
    return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files.

    Printable Latin-1 characters stand for themselves; the other bytes take the characters from
    256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, following = [], 256
    for byte in range(256):
        table.append(chr(byte if byte in own else following))
        following += byte not in own
    return table


class WordIds(dict):
    """Ids of words as little-endian 32-bit integers, filled on demand."""

    def __init__(self, model: models.BPE):
        super().__init__()
        self.model = model
        self.table = {i: c for i, c in enumerate(byte_characters())}

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.table)
        ids = np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """One vocabulary: words to ids, ids to bytes."""

    def __init__(
        self,
        model: models.BPE,
        token_bytes: dict[int, bytes],
        pattern: str,
        added: dict[str, int] | None = None,
    ):
        self.model = model
        self.pattern = regex.compile(pattern)
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.added = {c: np.array([i], dtype="<u4").tobytes() for c, i in (added or {}).items()}
        # The longer of two tokens that begin alike comes first, as in the library.
        names = sorted(self.added, key=lambda c: (-len(c), c))
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.words = WordIds(model)
        size = max(token_bytes, default=-1) + 1
        self.token_bytes = [token_bytes.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    @classmethod
    def from_json(cls, data: bytes, pattern: str) -> ByteBpe:
        """From a tokenizer file. Strings of added tokens in a text become those tokens, as in the library."""
        whole = Tokenizer.from_str(data.decode())
        back = {c: i for i, c in enumerate(byte_characters())}
        file = json.loads(data)
        listed = file.get("added_tokens") or []
        if any(t[k] for t in listed for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be plain text")
        vocab = file["model"]["vocab"]
        spelled = {i: bytes(back[c] for c in t) for t, i in vocab.items() if set(t) <= set(back)}
        added = {t["content"]: t["id"] for t in listed}
        spelled.update((i, c.encode()) for c, i in added.items())
        return cls(whole.model, spelled, pattern, added)

    @classmethod
    def from_ranks(cls, data: bytes, pattern: str) -> ByteBpe:
        """From a file of base64 tokens and ranks; the merges follow from the ranks."""
        ranks = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        chars = byte_characters()

        def spell(token: bytes) -> str:
            return "".join(chars[b] for b in token)

        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            if len(token) > 1:
                parts = _parts_below(token, ranks)
                if len(parts) == 2:
                    merges.append((spell(parts[0]), spell(parts[1])))
        vocab = {spell(t): r for t, r in ranks.items()}
        model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        return cls(model, {r: t for t, r in ranks.items()}, pattern)

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        return split_words(text, self.pattern, self.splitter)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not self.marks or not self.marks.search(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), dtype="<u4")
        found = []
        for number, stretch in enumerate(self.marks.split(text)):
            if number % 2:
                found.append(self.added[stretch])
            else:
                found.extend(map(self.words.__getitem__, self.split(stretch)))
        return np.frombuffer(b"".join(found), dtype="<u4")

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a run of ids. A character split between ids is whole again in the joined bytes."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First character and end of each id, in code points.

        An id that holds only a part of a character covers that whole character.
        """
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        # Number of characters begun up to and including each byte.
        begun = np.cumsum((data & 0xC0) != 0x80)
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids]).astype(int)
        starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ids) else ends
        return (begun[starts] - 1).tolist(), begun[ends - 1].tolist()


def _parts_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by ranks below the token's own leaves of it."""
    limit = ranks[token]
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, at = min(options)
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def _loaded(kind: str, data: bytes, pattern: str) -> ByteBpe:
    return (ByteBpe.from_json if kind == "json" else ByteBpe.from_ranks)(data, pattern)


keeps("bpe", _loaded.cache_clear)


class Vocabulary:
    """A vocabulary file as it travels to the tasks: a few MB, read once on the driver.

    Built per Python worker on first use.
    """

    def __init__(self, path: str, pattern: str):
        self.kind = "json" if path.endswith(".json") else "ranks"
        self.pattern = pattern
        with open(path, "rb") as file:
            self.data = file.read()

    def get(self) -> ByteBpe:
        working("bpe")
        return _loaded(self.kind, self.data, self.pattern)


FIELDS = {
    "ids": ("ids array<int>", pa.list_(pa.int32())),
    "starts": ("starts array<int>", pa.list_(pa.int32())),
    "ends": ("ends array<int>", pa.list_(pa.int32())),
    "decoded": ("decoded string", pa.string()),
    "n_tokens": ("n_tokens long", pa.int64()),
    "ids_sha256": ("ids_sha256 string", pa.string()),
    "decoded_sha256": ("decoded_sha256 string", pa.string()),
}


def encode_decode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    columns: tuple[str, ...] = ("ids", "starts", "ends"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``columns`` of the result, after the id: ``ids``; ``starts`` and ``ends`` of each id in code points;
    ``decoded`` text of the ids; ``n_tokens``; SHA-256 of the decimal ids joined by one space and
    of the decoded bytes.

    A null text counts as empty: no ids, and the digests of nothing. Every input row gives one
    row, also when ids are null or repeated; other columns are left out, whatever their names.
    """
    unknown = [c for c in columns if c not in FIELDS]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = ", ".join(FIELDS[c][0] for c in columns)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.value.get()
        for batch in slices(batches):
            out: dict[str, list] = {c: [] for c in columns}
            for text in batch.column(1).to_pylist():
                text = text or ""
                array = bpe.encode(text)
                ids = array.tolist()
                if "ids" in out:
                    out["ids"].append(array.astype(np.int32))
                if "starts" in out or "ends" in out:
                    starts, ends = bpe.offsets(text, ids)
                    for name, values in (("starts", starts), ("ends", ends)):
                        if name in out:
                            out[name].append(values)
                if "n_tokens" in out:
                    out["n_tokens"].append(len(ids))
                if "ids_sha256" in out:
                    joined = " ".join(map(bpe.decimal.__getitem__, ids))
                    out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                if "decoded" in out or "decoded_sha256" in out:
                    data = bpe.decode(ids)
                    if "decoded" in out:
                        out["decoded"].append(data.decode("utf-8", "replace"))
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            arrays = [batch.column(0)] + [pa.array(out[c], FIELDS[c][1]) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *columns])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {fields}")


def decode(
    frame: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Texts of arrays of ids: id and ``text``.

    Bytes which are no UTF-8, as when a run of ids begins or ends inside a character, become the
    replacement character. Null or empty arrays give empty text; an id outside the vocabulary is an
    error.
    """
    shipped = frame.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [T.StructField(id_col, frame.schema[id_col].dataType), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.value.get()
        for batch in slices(batches):
            texts = []
            for ids in batch.column(1).to_pylist():
                wrong = [i for i in ids or [] if not 0 <= i < len(bpe.token_bytes)]
                if wrong:
                    raise ValueError(f"ids outside the vocabulary: {wrong[:5]}")
                texts.append(bpe.decode(ids or []).decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "text"])

    return frame.select(id_col, ids_col).mapInArrow(run, schema)
