"""Fuzzy line deduplication with native columns only.

Lines are normalised and equal ones united. Two lines are linked when they reach an edit similarity over words. Of every
connected group of lines the first occurrence stays.

Lines within ``d`` edits keep all but ``3 d`` of the longer one's runs of three words, so they share one of the rarest
``3 d + 1`` of each in any fixed order (prefix filter). Runs that no two lines hold are dropped in the one pass that deals
them all; only lines that are left with some take part in what follows, by classes of length, so that the runs never lie
on disk together. Their SimHashes come first: lines of one class meet on pairs of the four blocks of their SimHash. Then
lines meet at the runs they share. What a pair cannot exceed in its lengths and in the parities of its words is checked
before the edits are counted, and accepted pairs are checked on their words.

Links are looked for as little as the components need: first with a pivot of each key, in turns until hardly any
line is joined by that, then only between lines that are still in different components, so a thousand variants of one
line cost a row each, not a pair for every two.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.components import connected_components
from wayfold.llm.tables import discard, release, stored
from wayfold.operators.joins import Lookup, lookup_join

# Edit similarity over words: 1 - inserted, deleted and replaced words / words of the longer line.
SIMILARITY = 0.8
# Fewer words than this allow no edit, so such lines only have equal ones.
LEAST_WORDS = 4
# Words are ordered by whether they are among so many of the commonest in so many lines, then long ones first.
# Runs of words likewise. The order changes the work only, never the result.
SAMPLE_LINES = 1 << 16
COMMON = 4_096
# Rare words that vote on the SimHash at most, so that votes fit in seven bits; its blocks, and which of them meet together.
VOTES = 127
BLOCK_BITS = 16
BLOCK_PAIRS = list(combinations(range(64 // BLOCK_BITS), 2))
# Lines of up to so many words are compared by one and by two of the four parts of the parities.
ONE_PART, TWO_PARTS = 63, 127
PARITIES = ["p0", "p1", "p2", "p3"]
# Words of a run that lines meet by. Lines of up to so many words may share none and meet by all their pairs of words, too.
RUN = 3
SHORT_LINE = 5
# Bits of a word's hash in its number, under its length; runs are sums of such numbers. Common words and runs come beyond all others.
WORD_BITS = 54
BEYOND = 1 << 62
# Lines meet a pivot of each of their keys, another in each turn, so often at most and until a turn finds so few links.
PIVOT_TURNS = 4
FEW_LINKS = 1024
# Runs that are dealt at once; classes of length are taken together up to that.
KEYS_AT_ONCE = 1 << 25
# Letters that words are turned into.
LETTERS = 1 << 20


def normalised(line: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line: id, ``line_no`` from 0, ``norm`` and two hashes of it. Null texts have no lines."""
    lines = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line_no", "line"),
    )
    lines = lines.select("id", "line_no", normalised(F.col("line")).alias("norm"))
    return lines.withColumns(
        {"h": F.xxhash64("norm"), "g": F.xxhash64(F.lit("second"), F.col("norm"))}
    )


def sample(lines: DataFrame) -> DataFrame:
    """At most about ``SAMPLE_LINES`` of stored lines, chosen by a hash."""
    share = min(1.0, SAMPLE_LINES / max(1, lines.count()))
    return lines.where(F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1 << 20)) < int(share * (1 << 20)))


def commonest(numbers: DataFrame) -> list[int]:
    """The commonest values of ``x``, a bounded number."""
    counted = numbers.groupBy("x").count().where("count > 1")
    # What is above a least count is at most twice as many as wanted; only these come to the driver.
    levels = F.floor(F.log2("count")).cast("int").alias("level")
    counted = stored(counted, "word-counts")
    total, least = 0, None
    for row in counted.groupBy(levels).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        least = row["level"]
        if total >= COMMON:
            break
    if least is None:
        return []
    order = [F.desc("count"), F.col("x")]
    rows = counted.where(F.col("count") >= (1 << least)).orderBy(*order).limit(COMMON).collect()
    discard(numbers.sparkSession, counted)
    return [r["x"] for r in rows]


def common_words(lines: DataFrame) -> list[int]:
    """The numbers of the commonest words of a sample of lines."""
    return commonest(sample(lines).select(F.explode(word_runs(F.split("norm", " "), 1, [])).alias("x")))


def common_runs(lines: DataFrame) -> list[int]:
    """The commonest of the runs that a sample of lines would meet by."""
    runs = sample(lines).where(F.col("words") >= LEAST_WORDS).select(F.explode(rare_runs([])).alias("x"))
    return commonest(runs)


def allowed_edits(words: Column) -> Column:
    """Edits by which a line may differ from one that is not longer."""
    return F.floor(words * (1 - SIMILARITY) + 1e-9).cast("int")


def word_runs(words: Column, length: int, common: list[int]) -> Column:
    """A number for each run of so many words: rare runs before common ones, those of long words before short ones.

    It is the sum of a number for each word, so the order of the words does not tell; what meets by it is compared anyway.
    """
    codes = F.transform(
        words,
        lambda w: F.shiftleft(63 - F.least(F.octet_length(w).cast("long"), F.lit(63)), WORD_BITS)
        + F.xxhash64(w).bitwiseAND(F.lit((1 << WORD_BITS) - 1)),
    )

    def summed(codes: Column) -> Column:
        starts = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - (length - 1), F.lit(0)))
        return F.transform(starts, lambda first, at: reduce(lambda x, k: x + F.get(codes, at + k), range(1, length), first))

    # A list of one, so that the words are hashed once.
    runs = F.transform(F.array(codes), summed)[0]
    return F.transform(runs, lambda x: F.when(x.isin(common), x + F.lit(BEYOND)).otherwise(x)) if common else runs


def runs_needed() -> Column:
    """How many of its rarest runs a line of more than ``SHORT_LINE`` words meets others by.

    An edit changes ``RUN`` runs at most, so ``d`` edits leave ``words - RUN + 1 - RUN * d`` runs of the longer line; among its
    rarest ``RUN * d + 1`` and so many of the shorter line as it may lack besides is one of both. The shorter line's own ``d``
    can be one less, which the rest of its words by the step of ``d`` makes up for.
    """
    words = F.col("words")
    step = round(1 / (1 - SIMILARITY))
    return RUN * allowed_edits(words) + 1 + F.greatest(words % step - (step - RUN), F.lit(0))


def rare_runs(common: list[int]) -> Column:
    """The different runs a line meets others by."""
    words = F.split("norm", " ")
    runs = word_runs(words, RUN, common)
    # Lines of four and of five words keep two pairs of words, but maybe no run of three.
    short = F.concat(runs, word_runs(words, RUN - 1, []))
    rarest = F.slice(F.sort_array(runs), F.lit(1), runs_needed())
    return F.array_distinct(F.when(F.col("words") <= SHORT_LINE, short).otherwise(rarest))


def parities(word: Column) -> list[Column]:
    """Sums of a line's words to 256 bits as four numbers: bit ``i`` tells whether the number of words with hash ``i`` is odd."""
    x = F.xxhash64(word)
    bit = _bit(x.bitwiseAND(F.lit(63)).cast("int"))
    part = F.shiftright(x, 6).bitwiseAND(F.lit(3))
    return [F.bit_xor(F.when(part == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(len(PARITIES))]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def simhash(tokens: Column) -> Column:
    """64 bits: bit ``i`` is set when more than half of the tokens have bit ``i`` of their hash set.

    Eight numbers hold the votes, a byte for each bit, so at most ``VOTES`` tokens vote.
    """
    voters = F.slice(tokens, 1, VOTES)
    ones, every_second = F.lit(0x0101010101010101), F.lit(0x00FF00FF00FF00FF)

    def counted(votes: Column) -> Column:
        def count(row: int) -> Column:
            return F.aggregate(
                votes, F.lit(0).cast("long"), lambda sum_, x: sum_ + F.shiftrightunsigned(x, row).bitwiseAND(ones)
            )

        return F.struct(*[count(row).alias(f"c{row}") for row in range(8)], F.size(votes).alias("n"))

    def decided(counts: Column) -> Column:
        # What is added makes the highest bit of a byte tell whether its count is above half of the votes.
        above = (127 - F.floor(counts["n"] / 2)) * F.lit(0x0001000100010001)

        def bits(row: int, half: int) -> Column:
            bytes_ = F.shiftrightunsigned(counts[f"c{row}"], 8 * half).bitwiseAND(every_second)
            told = F.shiftrightunsigned((bytes_ + above).bitwiseAND(F.lit(0x0080008000800080)), 7)
            return F.shiftleft(told, 8 * half + row)

        return reduce(lambda a, b: a.bitwiseOR(b), [bits(row, half) for row in range(8) for half in range(2)])

    # Lists of one, so that votes are hashed once and counted once for each row of bits.
    votes = F.transform(voters, lambda t: F.xxhash64(F.lit("vote"), t))
    return F.transform(F.transform(F.array(votes), counted), decided)[0]


def united_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each different normalised line, stored: ``line`` (a number), ``h``, ``g``, ``first``
    occurrence, ``norm`` and ``words`` (how many). Lines without letters and digits are none."""
    lines = occurrences(docs, id_col, text_col)
    first = F.min(F.struct("id", "line_no", "norm")).alias("first")
    united = (
        lines.where(F.col("id").isNotNull() & (F.col("norm") != ""))
        .groupBy("h", "g")
        .agg(first)
        .select("h", "g", F.struct("first.id", "first.line_no").alias("first"), F.col("first.norm").alias("norm"))
    )
    return stored(
        united.select(F.monotonically_increasing_id().alias("line"), "*", F.size(F.split("norm", " ")).alias("words")),
        "lines",
    )


def signatures(lines: DataFrame) -> DataFrame:
    """``line``, ``words`` and parities of stored lines of ``LEAST_WORDS`` or more."""
    words = lines.where(F.col("words") >= LEAST_WORDS).select("line", "words", F.explode(F.split("norm", " ")).alias("word"))
    return words.groupBy("line", "words").agg(*[c.alias(name) for c, name in zip(parities(F.col("word")), PARITIES)])


def rare_words(lines: DataFrame) -> DataFrame:
    """``line``, its ``rare`` words, one more than edits are allowed, and the SimHash ``sim`` of these; of stored lines as above."""
    words = word_runs(F.split("norm", " "), 1, common_words(lines))
    rare = F.array_distinct(F.slice(F.sort_array(words), F.lit(1), allowed_edits(F.col("words")) + 1))
    rows = lines.where(F.col("words") >= LEAST_WORDS).select("line", rare.alias("rare"))
    return rows.withColumn("sim", simhash(F.col("rare")))


def different_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The different lines of documents with the signatures of all, stored."""
    lines = united_lines(docs, id_col, text_col)
    whole = lines.join(signatures(lines).drop("words"), "line", "left").join(rare_words(lines), "line", "left")
    return stored(whole, "lines")


def shared_runs(lines: DataFrame) -> list[DataFrame]:
    """``key`` and ``line`` of the rarest runs of lines that another line of a like length meets by, too. Stored tables."""
    common = common_runs(lines)
    batches = []
    for number, sizes in enumerate(key_batches(lines)):
        here = F.exists(_classes(), lambda size: size.isin(sizes))
        mine = lines.where(F.col("words") >= LEAST_WORDS).where(here)
        keys = mine.select("line", F.explode(rare_runs(common)).alias("run"))
        keys = keys.select(F.xxhash64("run", F.lit(number)).alias("key"), "line")
        held = F.count(F.lit(1)).over(Window.partitionBy("key"))
        batches.append(stored(keys.withColumn("held", held).where("held > 1").select("key", "line"), "shared-runs"))
        release(lines.sparkSession)
    return batches


def line_keys(lines: DataFrame, tokens: Column) -> DataFrame:
    """``size``, ``key``, ``line``, ``words`` and parities: a row for each token and class of length a line may meet others in.

    Classes of length double; a line near the upper end of its class also enters the next one, since
    similar lines are at most ``1 / SIMILARITY`` times as long. Parities are folded as far as the class allows.
    """
    lines = lines.where(F.col("words") >= LEAST_WORDS).withColumn("tokens", tokens)
    rows = lines.select("line", "words", "tokens", *PARITIES, F.explode(_classes()).alias("size"))
    one, two = (F.col("size") <= F.floor(F.log2(F.lit(n))).cast("int") for n in (ONE_PART, TWO_PARTS))
    none = F.lit(0).cast("long")
    p0, p1, p2, p3 = map(F.col, PARITIES)
    even, odd = p0.bitwiseXOR(p2), p1.bitwiseXOR(p3)
    folded = [
        F.when(one, even.bitwiseXOR(odd)).when(two, even).otherwise(p0),
        F.when(one, none).when(two, odd).otherwise(p1),
        F.when(two, none).otherwise(p2),
        F.when(two, none).otherwise(p3),
    ]
    rows = rows.select(
        "line", "words", "size", "tokens", *[c.alias(name) for c, name in zip(folded, PARITIES)]
    )
    rows = rows.select("line", "words", "size", *PARITIES, F.explode("tokens").alias("token"))
    return rows.select("size", F.xxhash64("token", "size").alias("key"), "line", "words", *PARITIES)


def _classes() -> Column:
    own = F.floor(F.log2("words") + 1e-9).cast("int")
    return F.sequence(own, F.floor(F.log2(F.col("words") / SIMILARITY) + 1e-9).cast("int"))


def block_tokens() -> Column:
    """A token for every pair of blocks of the SimHash."""
    low = F.lit((1 << BLOCK_BITS) - 1)

    def block(number: int) -> Column:
        return F.shiftrightunsigned("sim", number * BLOCK_BITS).bitwiseAND(low)

    return F.array(
        *[
            F.shiftleft(block(a), BLOCK_BITS).bitwiseOR(block(b)).bitwiseOR(F.lit(number << 2 * BLOCK_BITS))
            for number, (a, b) in enumerate(BLOCK_PAIRS)
        ]
    )


def key_batches(lines: DataFrame) -> list[list[int]]:
    """Classes of length in groups whose runs number ``KEYS_AT_ONCE`` at most, or one class alone."""
    counts = (
        lines.where(F.col("words") >= LEAST_WORDS)
        .select(F.explode(_classes()).alias("size"), runs_needed().alias("n"))
        .groupBy("size")
        .agg(F.sum("n").alias("n"))
    )
    batches: list[list[int]] = []
    room = 0
    # As many rows as there are classes: a logarithm.
    for row in counts.orderBy("size").collect():
        if not batches or row["n"] > room:
            batches.append([])
            room = KEYS_AT_ONCE
        batches[-1].append(row["size"])
        room -= row["n"]
    return batches


def edit_links(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of stored pairs, dropped here, whose lines reach the edit similarity. Stored.

    Edits of words are counted as edits of letters, one for each word by its hash. In the few accepted pairs where
    different words have one letter, letters are dealt anew by the words of that pair.
    """
    spark = pairs.sparkSession
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct()
    wanted = Lookup.stage(wanted, ["line"], "llm-wanted-lines")
    texts = lookup_join(lines.select("line", "norm", "words"), wanted, ["line"], "inner")
    texts = stored(
        texts.select("line", "words", word_letters(F.col("norm")).alias("letters")), "line-texts"
    )
    both = pairs.join(texts.toDF("a", "n", "x"), "a").join(texts.toDF("b", "m", "y"), "b")
    both = both.withColumn("allowed", allowed_edits(F.greatest("n", "m"))).where(F.abs(F.col("n") - F.col("m")) <= F.col("allowed"))
    close = stored(both.where("levenshtein(x, y, allowed) >= 0").select("a", "b", "allowed"), "close-lines")
    discard(spark, texts)
    discard(spark, pairs)
    discard(spark, wanted.df)
    norms = lines.select("line", "norm")
    links = (
        close.join(norms.toDF("a", "x"), "a")
        .join(norms.toDF("b", "y"), "b")
        .where(same_by_words(F.col("x"), F.col("y"), F.col("allowed")))
    )
    links = stored(links.select("a", "b"), "line-links")
    discard(spark, close)
    return links


def word_letters(norm: Column) -> Column:
    """A line as one letter for each word, from a hash of the word, so that edits of letters are edits of words."""
    return _as_letters(F.transform(F.split(norm, " "), lambda w: F.pmod(F.xxhash64(w), F.lit(LETTERS))))


def _as_letters(numbers: Column) -> Column:
    """Numbers below ``LETTERS`` as the letters beyond the first plane."""
    codes = F.transform(numbers, lambda n: F.lpad(F.hex(n + 0x10000), 8, "0"))
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def same_by_words(x: Column, y: Column, allowed: Column) -> Column:
    """Whether two lines whose letters are within the allowed edits are so by their words.

    When the two lines have as many different letters as words, no two words share a letter and nothing has to be
    counted again; else each word takes its place among the words of both.
    """
    one, two = F.split(x, " "), F.split(y, " ")
    words = F.array_distinct(F.concat(one, two))
    letters = F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(LETTERS))))

    def placed(line: Column) -> Column:
        return _as_letters(F.transform(line, lambda w: F.array_position(words, w)))

    again = F.call_function("levenshtein", placed(one), placed(two), allowed) >= 0
    return F.when(F.size(words) == F.size(letters), True).otherwise(again)


def _labelled(keys: DataFrame, labels: Lookup | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("component", F.col("line"))
    return lookup_join(keys, labels, ["line"]).withColumn(
        "component", F.coalesce("component", "line")
    )


def _dealt(keys: DataFrame, labels: Lookup | None) -> DataFrame:
    """Keys with the components so far, dealt by key.

    Neither number is ever null. A join puts that condition on its own side only; with it on each, Spark sees that all
    uses deal the same rows and writes them once.
    """
    there = F.col("line").isNotNull() & F.col("component").isNotNull()
    return _labelled(keys, labels).where(there).repartition("key")


def _united(labels: Lookup | None, links: DataFrame) -> Lookup:
    """``line`` and ``component`` of the linked lines once the stored links are added; drops those.

    New links are taken as links between the components so far, so each round unites only what its
    own links join.
    """
    between = links
    if labels is not None:
        for end in ("a", "b"):
            named = lookup_join(between.withColumnRenamed(end, "line"), labels, ["line"])
            between = named.withColumn(end, F.coalesce("component", "line")).select("a", "b")
    found = connected_components(between)
    if labels is None:
        whole = found.withColumnRenamed("node", "line")
    else:
        joined = Lookup.stage(found.toDF("old", "root"), ["old"], "llm-line-joined")
        moved = lookup_join(labels.df, joined, ["component"]).select(
            "line", F.coalesce("root", "component").alias("component")
        )
        fresh = joined.df.toDF("line", "component").join(labels.df, "line", "left_anti")
        whole = moved.union(fresh)
    whole = Lookup.stage(whole, ["line"], "llm-line-components")
    for done in [links, *([labels.df, joined.df] if labels is not None else [])]:
        discard(links.sparkSession, done)
    return whole


def line_components(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``node`` (number of a line) and ``component`` of the lines that are linked, from the lines of the keys."""
    spark = lines.sparkSession
    own = ["line", "words", *PARITIES]
    signs = Lookup.stage(signatures(lines), ["line"], "llm-line-signatures")
    # Pivots of SimHash blocks first. Dealt once for both the pivots and what meets them.
    hashed = stored(lookup_join(rare_words(lines).select("line", "sim"), signs, ["line"], "inner"), "line-hashes")
    labelled = _dealt(line_keys(hashed, block_tokens()).drop("size"), None)
    pairs = _close(_pivot_pairs(labelled, F.min(F.struct(*own, "component")), own))
    release(spark)
    discard(spark, hashed)
    labels = _united(None, edit_links(pairs, lines))
    for turn in range(PIVOT_TURNS):
        chosen = F.max(F.struct(F.xxhash64(F.lit(turn), "line").alias("order"), "line", "component"))
        met = stored(_pivot_pairs(_dealt(keys, labels), chosen, ["line"]).distinct(), "line-meetings")
        release(spark)
        pairs = _close(_signed(_signed(met, signs, ""), signs, "_b"))
        discard(spark, met)
        links = edit_links(pairs, lines)
        found = links.count()
        if found:
            labels = _united(labels, links)
        else:
            discard(spark, links)
        if found <= FEW_LINKS:
            break
    labelled = _dealt(keys, labels)
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("key")
    )
    # No number is ever null; said here so that both sides of the join are dealt once, as above.
    rest = stored(labelled.join(open_keys, "key", "left_semi").select("key", "line", "component"), "open-runs")
    release(spark)
    there = F.col("line").isNotNull() & F.col("component").isNotNull()
    signed = _signed(rest, signs, "").where(there).repartition("key")
    other = signed.select("key", *[F.col(c).alias(f"{c}_b") for c in [*own, "component"]])
    met = signed.join(other, "key").where("component <> component_b and line < line_b")
    pairs = _close(met)
    release(spark)
    discard(spark, rest)
    discard(spark, signs.df)
    if pairs.isEmpty():
        discard(spark, pairs)
    else:
        labels = _united(labels, edit_links(pairs, lines))
    return labels.df.withColumnRenamed("line", "node")


def _signed(met: DataFrame, signs: Lookup, end: str) -> DataFrame:
    """Adds the words and parities of one end's line."""
    named = Lookup(signs.df.toDF(*[f"{c}{end}" for c in signs.df.columns]), (f"line{end}",), signs.bytes)
    return lookup_join(met, named, [f"line{end}"], "inner")


def _pivot_pairs(labelled: DataFrame, pivot: Column, own: list[str]) -> DataFrame:
    """Every line with the pivot of each of its keys, when that is of another component."""
    pivots = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), pivot.alias("p")
    )
    met = labelled.join(pivots.where("low < high"), "key").where("component <> p.component")
    return met.select(*own, *[F.col(f"p.{c}").alias(f"{c}_b") for c in own])


def _close(met: DataFrame) -> DataFrame:
    """Different pairs whose lengths and parities differ by no more than the allowed edits explain. Stored.

    An inserted or deleted word changes one parity at most, a replaced one two.
    """
    allowed = allowed_edits(F.greatest("words", "words_b"))
    apart = F.abs(F.col("words") - F.col("words_b"))
    changed = reduce(
        lambda a, b: a + b, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in PARITIES]
    )
    close = met.where((apart <= allowed) & (changed <= 2 * allowed - apart))
    ends = [f("line", "line_b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]
    return stored(close.select(*ends).distinct(), "line-pairs")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line of every document: id, ``line_no``, ``kept``, ``kept_id`` and ``kept_line``.

    ``kept_id`` and ``kept_line`` name the occurrence that stays for the line's group: the first by id,
    then by number. Lines without letters or digits are kept and have no group, as are
    the lines of rows with a null id. Null texts have no lines; an empty text has one. Rows that
    repeat an id count as one document: their equal lines at one place are one occurrence. Other
    columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    lines = united_lines(docs, id_col, text_col)
    # The shuffle of all lines' texts.
    release(spark)
    batches = shared_runs(lines)
    labelled = lines.withColumn("component", F.col("line"))
    united = None
    if batches:
        keys = reduce(DataFrame.union, batches)
        some = Lookup.stage(keys.select("line").distinct(), ["line"], "llm-meeting-lines")
        meeting = stored(lookup_join(lines.drop("g", "first"), some, ["line"], "inner"), "meeting-lines")
        discard(spark, some.df)
        united = line_components(meeting, keys)
        for done in (meeting, *batches):
            discard(spark, done)
        labelled = lines.join(united.withColumnRenamed("node", "line"), "line", "left").withColumn(
            "component", F.coalesce("component", "line")
        )
    labelled = labelled.select("h", "g", "first", "component")
    firsts = labelled.groupBy("component").agg(F.min("first").alias("stays"))
    stays = stored(labelled.join(firsts, "component").select("h", "g", "stays"), "line-groups")
    for done in (lines, united):
        if done is not None:
            discard(spark, done)
    found = occurrences(docs, id_col, text_col).drop("norm")
    named = found.where(F.col("id").isNotNull()).join(stays, ["h", "g"], "left")
    unnamed = found.where(F.col("id").isNull()).withColumn("stays", F.lit(None))
    here = (F.col("stays.id") == F.col("id")) & (F.col("stays.line_no") == F.col("line_no"))
    return named.select("id", "line_no", "stays").union(
        unnamed.select("id", "line_no", F.col("stays").cast(stays.schema["stays"].dataType))
    ).select(
        F.col("id").alias(id_col),
        "line_no",
        F.coalesce(here, F.lit(True)).alias("kept"),
        F.col("stays.id").alias("kept_id"),
        F.col("stays.line_no").alias("kept_line"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept; other columns and rows stay as they are.

    Rows that repeat an id with another text are documents of their own here: each loses the lines that it
    holds later than another row, by id, then by a hash of the text. Rows with equal id and text lose the same lines. Null
    texts and rows with a null id stay as they are. Other columns may have any name.
    """
    row, gone = _unused("_row", docs), _unused("_gone", docs)
    text = F.col(f"`{text_col}`")
    named = F.when(F.col(f"`{id_col}`").isNotNull(), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t")))
    keyed = docs.withColumn(row, named)
    removed = (
        mark(keyed.select(row, F.col(f"`{text_col}`")), row, text_col)
        .where(~F.col("kept"))
        .groupBy(row)
        .agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    )
    lookup = Lookup.stage(removed, [row], "llm-removed")
    found = lookup_join(keyed, lookup, [row])
    def without(lines: Column) -> Column:
        # What lies between removed lines, taken in one go each, so that the work follows the number of lines.
        first = F.concat(F.array(F.lit(-1)), F.col(gone))
        after = F.concat(F.col(gone), F.array(F.size(lines)))
        return F.flatten(F.zip_with(first, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))

    # A list of one, so that the text is split once.
    kept = F.transform(F.array(F.split(text, "\n")), without)[0]
    rest = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return found.withColumn(text_col, rest).select(*[F.col(f"`{c}`") for c in docs.columns])


def _unused(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
