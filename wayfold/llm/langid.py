"""Language identification by compression with per-language dictionaries.

Each language has a zstandard dictionary of raw content: words of a bounded sample of labelled texts. A text
is compressed with each of them and takes the language of the smallest result. Texts that no dictionary
shortens clearly more than the next are rejected. A long text is compressed in pieces and their sizes are
summed, since a dictionary saves only so many bytes of one run: the margin is then alike at any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import held_out, keeps, slices, working

UNKNOWN = "und"
# Learned from at most so many labelled texts a language, and from so many stretches of so many characters, spread
# over the whole of a text.
SAMPLE_TEXTS = 256
STRETCHES, STRETCH_CHARS = 8, 256
# Texts are drawn by hash with so many times their wanted number expected.
DRAWN = 4
# Content of a dictionary, and languages at most: together the bound of what travels to the tasks.
DICTIONARY_BYTES = 96 << 10
MAX_LANGUAGES = 256
LEVEL = 6
# Longer texts are cut into equal pieces of at most so many bytes.
PIECE_BYTES = 32 << 10
# Rejected when the best dictionary saves less than this share over the next one.
MARGIN = 0.004
# Bytes that make a language e times likelier, for the score.
BYTES_PER_NAT = 2.0

# Marks belong to the letter before them.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters_of(text: str | None) -> bytes:
    """The words of a text in lower case, as they are compressed; empty when it has no letter."""
    return " ".join(_LETTERS.findall((text or "").lower())).encode()


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, bytes]:
    """Dictionary content by language, most frequent first, from texts whose id is not held out.

    At most ``SAMPLE_TEXTS`` texts of each language, in the order of a hash of their ids, each with stretches from
    all over it: a bounded sample to learn from. A hash below a bound taken from the number of texts draws
    it, so no language is gathered in one task. Null languages and null or letterless texts
    teach nothing.
    """
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"),
        F.col(text_col).alias("_text"),
        F.xxhash64(F.col(id_col)).alias("_order"),
    )
    counts = labelled.groupBy("_lang").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_order").alias("different")
    )
    found = counts.limit(MAX_LANGUAGES + 1).collect()
    frequency = {r["_lang"]: r["n"] for r in found}
    if len(frequency) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; so many dictionaries are not shipped")
    drawn = F.lit(False)
    for row in found:
        share = min(1.0, DRAWN * SAMPLE_TEXTS / max(1, row["different"]))
        below = F.pmod("_order", F.lit(1 << 20)) < math.ceil(share * (1 << 20))
        drawn = drawn | ((F.col("_lang") == row["_lang"]) & below)
    sample = (
        labelled.where(drawn & F.col("_text").isNotNull())
        .select("_lang", "_order", spread(F.col("_text")).alias("_text"))
        .distinct()
    )
    texts: dict[str, dict[bytes, None]] = {}
    for row in sorted(sample.collect()):
        data = letters_of(row["_text"])
        mine = texts.setdefault(row["_lang"], {})
        if data and len(mine) < SAMPLE_TEXTS:
            mine[data] = None
    ranked = sorted((x for x in texts if texts[x]), key=lambda lang: (-frequency[lang], lang))
    return {lang: _content(list(texts[lang])) for lang in ranked}


def spread(text: Column) -> Column:
    """A text, or stretches at equal distances from its begin to its end when it is longer than they are."""
    room = F.length(text) - STRETCH_CHARS
    starts = [1 + F.call_function("div", room * k, F.lit(STRETCHES - 1)).cast("int") for k in range(STRETCHES)]
    pieces = F.concat_ws(" ", *[F.substring(text, s, F.lit(STRETCH_CHARS)) for s in starts])
    return F.when(F.length(text) <= STRETCHES * STRETCH_CHARS, text).otherwise(pieces)


def _content(texts: list[bytes]) -> bytes:
    """An equal share of each text, up to the size of a dictionary."""
    share = max(64, DICTIONARY_BYTES // len(texts))
    return b"\n".join(_shortened(t, share) for t in texts)[:DICTIONARY_BYTES]


def _shortened(data: bytes, share: int) -> bytes:
    """Up to four equal pieces from all over the data, ``share`` bytes together."""
    if len(data) <= share:
        return data
    pieces = min(4, share // 64)
    length = share // pieces
    starts = [(len(data) - length) * k // max(1, pieces - 1) for k in range(pieces)]
    return b"".join(data[s : s + length] for s in starts)


class Classifier:
    """Compressors of all languages, and one without content to compare with."""

    def __init__(self, contents: tuple[tuple[str, bytes], ...]):
        self.languages = [lang for lang, _ in contents]
        self.compressors = []
        for _, content in contents:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin over the next and whether the text is rejected."""
        data = letters_of(text)
        if not data or not self.languages:
            return UNKNOWN, 0.0, 0.0, True
        pieces = _pieces(data)
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
        # What compresses as well without a dictionary is in none of the languages.
        ranked = sorted([*sizes, sum(len(self.plain.compress(p)) for p in pieces)])
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = max(0.0, (ranked[1] - sizes[best]) / ranked[1])
        weights = sum(math.exp(max(-700.0, (sizes[best] - s) / BYTES_PER_NAT)) for s in sizes)
        return self.languages[best], 1.0 / weights, margin, margin < MARGIN


def _pieces(data: bytes) -> list[bytes]:
    """Equal pieces that cover the whole text; a character cut in two costs every compressor alike."""
    step = math.ceil(len(data) / math.ceil(len(data) / PIECE_BYTES))
    return [data[i : i + step] for i in range(0, len(data), step)]


# One: compressors with their dictionaries take some MB a language.
@lru_cache(maxsize=1)
def _classifier(contents: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(contents)


keeps("langid", _classifier.cache_clear)


def identify(
    docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, then ``lang_pred``, ``score``, ``margin`` and ``rejected``.

    The prediction is always a learned language, but for texts which are null or have no letter, or when
    nothing was learned: these are ``und`` with score 0 and rejected. Equal sizes go to the
    language that comes first in ``contents``. Every row gives one row; columns of ``docs`` that have one of the
    four names are replaced.
    """
    added = ["lang_pred", "score", "margin", "rejected"]
    kept = [c for c in docs.columns if c not in added]
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(contents.items()))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("langid")
        classifier = _classifier(shipped.value)
        for batch in slices(batches):
            found = [classifier.classify(t) for t in batch.column(at).to_pylist()]
            langs, scores, margins, rejected = zip(*found) if found else ((), (), (), ())
            arrays = [
                *batch.columns,
                pa.array(langs, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(margins, pa.float64()),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema = f"{fields}, lang_pred string, score double, margin double, rejected boolean"
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
