"""Resolve place names and score pairs of them by the deepest level they share."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.places import COUNTRY_LEVEL, common_ancestor_level
from wayfold.functions.text import is_empty, normalize_name
from wayfold.operators import joins
from wayfold.operators.hierarchy import Gazetteer, ancestor_names
from wayfold.operators.intervals import with_shared_level
from wayfold.operators.joins import Lookup, hot_keys, lookup_join
from wayfold.operators.typos import near_names, nearest_names
from wayfold.plans.scratch import staged

# Stands for NULL in a join key; a folded name never ends in white space.
_NO_NAME = " "

PAIR_COLUMNS = ("city_1", "state_1", "city_2", "state_2")


def name_key(col: str) -> Column:
    """Folded name, NULL when the raw value is blank so that it can match nothing."""
    plain = re.fullmatch(r"[A-Za-z_][\w.]*", col)
    folded = normalize_name(col if plain else "`" + col.replace("`", "``") + "`")
    return F.when(folded != "", folded).when(~is_empty(col), "")


def resolve(
    df: DataFrame,
    gaz: Gazetteer,
    city: str = "city",
    state: str = "state",
    suffix: str = "",
    country: str | None = None,
    strict_state: bool = False,
) -> DataFrame:
    """Add the matches of ``(city, state)``: ``n`` and ``first`` (a place), plus the key used.

    With a state, places below an ancestor of that name are taken. When there are none, or no
    state is given, all places with the city's name are. ``strict_state`` turns that fallback
    off. Every row stays exactly one row. ``matched_state`` is the state of the key that matched
    (NULL when the name alone did).
    """
    side = _Side(city, state, country, suffix)
    return _drop_keys(_attach(_with_keys(df, gaz, [side]), gaz, [side], strict_state), gaz, [side])


def resolve_pairs(
    pairs: DataFrame,
    gaz: Gazetteer,
    country: tuple[str, str] | None = None,
    strict_state: bool = False,
) -> DataFrame:
    """Resolve both sides of a pair table; absent city or state columns read as NULL."""
    keyed, sides = _keyed_pairs(pairs, gaz, country, ("_1", "_2"))
    absent = [c for c in PAIR_COLUMNS if c not in pairs.columns]
    return _drop_keys(_attach(keyed, gaz, sides, strict_state), gaz, sides).drop(*absent)


def _keyed_pairs(
    pairs: DataFrame,
    gaz: Gazetteer,
    country: tuple[str, str] | None,
    suffixes: tuple[str, str],
) -> tuple[DataFrame, list[_Side]]:
    absent = [c for c in PAIR_COLUMNS if c not in pairs.columns]
    df = pairs.withColumns({c: F.lit(None).cast("string") for c in absent})
    countries = country or (None, None)
    sides = [
        _Side("city_1", "state_1", countries[0], suffixes[0]),
        _Side("city_2", "state_2", countries[1], suffixes[1]),
    ]
    return _with_keys(df, gaz, sides), sides


@dataclass(frozen=True)
class _Side:
    """The columns naming one place, and the suffix of the columns made for it."""

    city: str
    state: str
    country: str | None
    suffix: str

    def keys(self, gaz: Gazetteer) -> list[str]:
        """City, state marker and, for a gazetteer of several countries, the country."""
        keys = [f"_wf_city{self.suffix}", f"_wf_state{self.suffix}"]
        return [f"_wf_country{self.suffix}", *keys] if gaz.has_country else keys


def _with_keys(df: DataFrame, gaz: Gazetteer, sides: list[_Side]) -> DataFrame:
    keys = {}
    for side in sides:
        keys[f"_wf_city{side.suffix}"] = name_key(side.city)
        keys[f"_wf_state{side.suffix}"] = name_key(side.state)
        if gaz.has_country:
            if side.country is None:
                raise ValueError("this gazetteer needs a country column")
            keys[f"_wf_country{side.suffix}"] = name_key(side.country)
    return df.withColumns(keys)


def _drop_keys(df: DataFrame, gaz: Gazetteer, sides: list[_Side]) -> DataFrame:
    return df.drop(*[key for side in sides for key in side.keys(gaz)])


def _attach(
    keyed: DataFrame, gaz: Gazetteer, sides: list[_Side], strict_state: bool
) -> DataFrame:
    """Add the match columns of every side to a frame with keys.

    With small lookups each row probes them directly. With large ones the distinct keys are
    matched first, so that rows are joined once per side and not once per lookup.
    """
    small = max(gaz.by_city.bytes, gaz.by_city_state.bytes) <= joins.BROADCAST_BYTES
    if small or keyed.isStreaming:
        for side in sides:
            keyed = _probe(keyed, gaz, side, strict_state)
        return keyed
    plain = _Side("", "", None, "")
    keys = reduce(
        DataFrame.union,
        [
            keyed.select(
                [F.col(k).alias(p) for k, p in zip(s.keys(gaz), plain.keys(gaz))]
            )
            for s in sides
        ],
    )
    keys = staged(keys.where(F.col("_wf_city").isNotNull()).distinct(), "place-keys")
    matched = _probe(keys, gaz, plain, strict_state).withColumn(
        "_wf_state", F.coalesce("_wf_state", F.lit(_NO_NAME))
    )
    table = Lookup.stage(matched, plain.keys(gaz), "matched-keys")
    marked = keyed.withColumns(
        {
            f"_wf_state{s.suffix}": F.coalesce(f"_wf_state{s.suffix}", F.lit(_NO_NAME))
            for s in sides
        }
    )
    hots = hot_keys(marked, [s.keys(gaz) for s in sides])
    made = ("n", "first", "matched_city", "matched_state")
    for side, hot in zip(sides, hots):
        payload = table.df.withColumnsRenamed({c: f"{c}{side.suffix}" for c in made})
        named = Lookup(payload, table.keys, table.bytes)
        marked = lookup_join(marked, named, side.keys(gaz), hot=hot).withColumn(
            f"n{side.suffix}", F.coalesce(f"n{side.suffix}", F.lit(0).cast("long"))
        )
    return marked


def _probe(
    keyed: DataFrame, gaz: Gazetteer, side: _Side, strict_state: bool
) -> DataFrame:
    """Match one side through the two lookups."""
    *scope, city, state = side.keys(gaz)
    exact = _renamed(gaz.by_city_state, "_exact")
    named = _renamed(gaz.by_city, "_named")
    joined = lookup_join(keyed, exact, [*scope, city, state])
    joined = lookup_join(joined, named, [*scope, city])
    hit = F.col("_n_exact").isNotNull()
    if strict_state:
        fallback = F.col(state).isNull() | (F.col(state) == F.col(city))
    else:
        fallback = F.lit(True)
    suffix = side.suffix
    return joined.withColumns(
        {
            f"n{suffix}": F.when(hit, F.col("_n_exact"))
            .when(fallback, F.coalesce("_n_named", F.lit(0)))
            .otherwise(0)
            .cast("long"),
            f"first{suffix}": F.when(hit, F.col("_first_exact")).when(
                fallback, F.col("_first_named")
            ),
            f"matched_city{suffix}": F.col(city),
            f"matched_state{suffix}": F.when(hit, F.col(state)),
        }
    ).drop("_n_exact", "_first_exact", "_n_named", "_first_named")


def _renamed(lookup: Lookup, tag: str) -> Lookup:
    payload = {"n": f"_n{tag}", "first": f"_first{tag}"}
    return Lookup(lookup.df.withColumnsRenamed(payload), lookup.keys, lookup.bytes)


def match_levels(
    pairs: DataFrame,
    gaz: Gazetteer,
    mode: str = "first",
    country: tuple[str, str] | None = None,
    strict_state: bool = False,
) -> DataFrame:
    """Add ``expected_level`` and ``is_ambiguous`` to a pair table.

    ``first`` compares the first match of each side in document order, ``best`` the deepest level
    over all combinations of matches. Rows, duplicates and other columns are kept; result columns
    the table already has are replaced.
    """
    if mode not in ("first", "best"):
        raise ValueError(f"unknown mode {mode!r}")
    pairs = pairs.drop("expected_level", "is_ambiguous")
    keyed, sides = _keyed_pairs(pairs, gaz, country, (_ONE, _TWO))
    if mode == "first":
        levels = _with_first_level(_attach(keyed, gaz, sides, strict_state), gaz)
        scored = _scored(levels, F.col("_wf_level"))
        return scored.select(*pairs.columns, "expected_level", "is_ambiguous")
    if pairs.isStreaming:
        raise ValueError("the best level needs the distinct keys of a finite table")
    keys = [key for side in sides for key in side.keys(gaz)]
    distinct = staged(keyed.select(keys).distinct(), "pair-keys")
    scored = _best_scored(_attach(distinct, gaz, sides, strict_state), gaz)
    known = {key: F.coalesce(key, F.lit(_NO_NAME)) for key in keys}
    table = Lookup.stage(
        scored.select(*keys, "expected_level", "is_ambiguous").withColumns(known),
        keys,
        "pair-scores",
    )
    return lookup_join(keyed.withColumns(known), table, keys).select(
        *pairs.columns, "expected_level", "is_ambiguous"
    )


# Suffixes of the columns made while scoring, chosen not to meet columns of the pair table.
_ONE, _TWO = "__wayfold_1", "__wayfold_2"


def _several() -> Column:
    return (F.col(f"n{_ONE}") > 1) | (F.col(f"n{_TWO}") > 1)


def _unmatched() -> Column:
    return (F.col(f"n{_ONE}") == 0) | (F.col(f"n{_TWO}") == 0)


def _with_first_level(resolved: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Add the level shared by the first matches, by their intervals or their ancestor chains."""
    one, two = f"first{_ONE}", f"first{_TWO}"
    if gaz.ranges is None:
        return resolved.withColumn("_wf_level", common_ancestor_level(F.col(one), F.col(two)))
    return with_shared_level(resolved, one, two, gaz.ranges, "_wf_level")


def _scored(resolved: DataFrame, level: Column) -> DataFrame:
    return resolved.withColumns(
        {
            "expected_level": F.when(_unmatched(), COUNTRY_LEVEL)
            .otherwise(level)
            .cast("int"),
            "is_ambiguous": _several().cast("int"),
        }
    )


def _best_scored(resolved: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Score resolved distinct keys by the best combination of their matches.

    The sides are ordered so that the one with fewer matches comes first: the score is symmetric,
    and the work for a key pair then follows the smaller side.
    """

    def key(suffix: str) -> Column:
        parts = [
            F.col(f"matched_city{suffix}").alias("city"),
            F.col(f"matched_state{suffix}").alias("state"),
        ]
        if gaz.has_country:
            parts.insert(0, F.col(f"_wf_country{suffix}").alias("country"))
        return F.to_json(F.struct(*parts))

    one, two = key(_ONE), key(_TWO)
    n_one, n_two = F.col(f"n{_ONE}"), F.col(f"n{_TWO}")
    swap = (n_one > n_two) | ((n_one == n_two) & (one > two))
    wanted = _several() & ~_unmatched()
    resolved = staged(
        resolved.withColumns(
            {
                "_few": F.when(wanted, F.when(swap, two).otherwise(one)),
                "_many": F.when(wanted, F.when(swap, one).otherwise(two)),
            }
        ),
        "resolved-keys",
    )
    key_pairs = (
        resolved.where(F.col("_few").isNotNull())
        .select(
            F.col("_few").alias("few"),
            F.col("_many").alias("many"),
            (n_one * n_two).alias("combinations"),
        )
        .distinct()
    )
    best = best_levels(staged(key_pairs, "key-pairs"), gaz)
    table = Lookup.stage(best, ["few", "many"], "best-levels")
    found = lookup_join(_with_first_level(resolved, gaz), table, ["_few", "_many"])
    return _scored(found, F.coalesce("_best", "_wf_level"))


def best_levels(key_pairs: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Deepest shared level over all combinations of two keys' matches, without forming them.

    ``key_pairs`` has ``few`` and ``many`` (keys as JSON text) and ``combinations``, the number of
    match combinations. For every place ``a`` above matches of both keys let ``n_few(a)`` and
    ``n_many(a)`` count the matches at or below it. A combination is *nested* when one match
    contains the other; it scores the container's level. Each match has few ancestors, so nested
    combinations are counted from the ancestor chains. If more combinations lie below ``a`` than
    nested ones, some combination meets at ``a`` by the ordinary rule and scores its level, at
    least the country level. If not all combinations are nested, the country level is reached
    anyway. The work is linear in the matches of the smaller side.
    """
    few_keys = key_pairs.select(F.col("few").alias("key"))
    wanted = few_keys.union(key_pairs.select(F.col("many").alias("key"))).distinct()
    counts = Lookup.stage(_matches_above(gaz, wanted), ["key"], "matches-above")
    few = counts.df.select(
        F.col("key").alias("few"),
        "above",
        "chain",
        F.col("n").alias("n_few"),
        F.col("is_match").alias("match_few"),
    )
    many = counts.df.select(
        F.col("key").alias("many"),
        "above",
        F.col("n").alias("n_many"),
        F.col("is_match").alias("match_many"),
    )
    spread = lookup_join(
        key_pairs, Lookup(few, ("few",), counts.bytes), ["few"], "inner"
    )
    shared = lookup_join(
        spread,
        Lookup(many, ("many", "above"), counts.bytes),
        ["many", "above"],
        "inner",
    ).withColumn(
        "nested",
        F.col("match_few") * F.col("n_many")
        + F.col("match_many") * F.col("n_few")
        - F.col("match_few") * F.col("match_many"),
    )
    at = F.col("up.id") == F.col("above")
    contains = at & ((F.col("match_few") + F.col("match_many")) > 0)
    per_place = (
        shared.withColumn("up", F.explode("chain"))
        .groupBy("few", "many", "combinations", F.col("up.id").alias("place"))
        .agg(
            F.any_value("up.level").alias("level"),
            F.sum("nested").alias("nested_below"),
            F.sum(F.when(at, F.col("nested")).otherwise(0)).alias("nested_here"),
            F.max(F.when(at, F.col("n_few") * F.col("n_many"))).alias("below"),
            F.max(F.when(contains, F.col("up.level"))).alias("container_level"),
        )
    )
    meets = F.when(
        F.col("below") > F.col("nested_below"),
        F.greatest(F.lit(COUNTRY_LEVEL), F.col("level")),
    )
    scored = per_place.groupBy("few", "many", "combinations").agg(
        F.max(F.greatest(meets, F.col("container_level"))).alias("score"),
        F.sum("nested_here").alias("nested"),
    )
    # Key pairs sharing no place at all have no row here: every combination is at country level.
    floor = F.when(
        F.col("combinations") > F.coalesce("nested", F.lit(0)), F.lit(COUNTRY_LEVEL)
    )
    return (
        key_pairs.join(scored.drop("combinations"), ["few", "many"], "left")
        .select("few", "many", F.greatest("score", floor).alias("_best"))
    )


def _matches_above(gaz: Gazetteer, wanted: DataFrame) -> DataFrame:
    """For each wanted key and each place at or above its matches: how many lie below.

    ``chain`` is the place's own ancestor chain and ``is_match`` tells whether it is a match.
    """
    states = F.concat(F.array(F.lit(None).cast("string")), ancestor_names())
    parts = [F.col("name").alias("city"), F.col("state").alias("state")]
    if gaz.has_country:
        parts.insert(0, F.col("country").alias("country"))
    places = gaz.nodes.select("*", F.explode(states).alias("state")).select(
        F.to_json(F.struct(*parts)).alias("key"),
        F.col("id").alias("match"),
        F.transform(
            "ancestors",
            lambda a: F.struct(a["id"].alias("id"), a["level"].alias("level")),
        ).alias("whole"),
    )
    return (
        places.join(wanted, "key", "left_semi")
        .select("key", "match", "whole", F.posexplode("whole").alias("pos", "up"))
        .groupBy("key", F.col("up.id").alias("above"))
        .agg(
            F.any_value(
                F.slice("whole", F.col("pos") + 1, F.size("whole"))
            ).alias("chain"),
            F.count(F.lit(1)).alias("n"),
            F.max((F.col("up.id") == F.col("match")).cast("long")).alias("is_match"),
        )
    )


def resolve_fuzzy(
    df: DataFrame,
    gaz: Gazetteer,
    city: str = "city",
    state: str = "state",
    max_distance: int = 1,
    country: str | None = None,
    correct_state: bool = False,
) -> DataFrame:
    """As :func:`resolve`, with names that match nothing replaced by the nearest known name.

    The nearest name is the one with the smallest edit distance within ``max_distance``, the
    alphabetically first of equals; in a gazetteer of several countries, among those of the row's
    country. Adds ``corrected_city`` (NULL when nothing was corrected).

    ``correct_state`` corrects both names together where a state is given and the pair is not known:
    of all known pairs with both names within ``max_distance``, the one with the smallest sum of distances
    is taken, then the smallest distance of the city, then the first by city and state. Without such a pair the
    city alone is corrected. Adds ``corrected_state``, too.
    """
    side = _Side(city, state, country, "")
    keyed = _with_keys(df, gaz, [side])
    *scope, city_key, state_key = side.keys(gaz)
    known = gaz.by_city.df.select(*scope_names(gaz), "name").withColumnsRenamed(_scoped(gaz, scope))
    cities = keyed.select(*scope, F.col(city_key).alias("name")).distinct()
    unknown = cities.join(known, [*scope, "name"], "left_anti")
    nearest = nearest_names(unknown, known, max_distance, scope)
    fixes = Lookup.stage(nearest, [*scope, "name"], "name-fixes")
    fixed = lookup_join(keyed, fixes, [*scope, city_key])
    new_city, new_state = F.coalesce("nearest", city_key), F.col(state_key)
    if correct_state:
        pairs = Lookup.stage(
            _nearest_pairs(keyed, gaz, [*scope, city_key, state_key], max_distance),
            [*scope, city_key, state_key],
            "pair-fixes",
        )
        fixed = lookup_join(fixed, pairs, [*scope, city_key, state_key])
        new_city, new_state = F.coalesce("_wf_pair.city", new_city), F.coalesce("_wf_pair.state", state_key)
    fixed = fixed.withColumns(
        {
            "corrected_city": F.when(new_city != F.col(city_key), new_city),
            "corrected_state": F.when(new_state != F.col(state_key), new_state),
            city_key: new_city,
            state_key: new_state,
        }
    ).drop("nearest", "_wf_pair")
    resolved = _drop_keys(_attach(fixed, gaz, [side], False), gaz, [side])
    return resolved if correct_state else resolved.drop("corrected_state")


def scope_names(gaz: Gazetteer) -> list[str]:
    return ["country"] if gaz.has_country else []


def _scoped(gaz: Gazetteer, scope: list[str]) -> dict[str, str]:
    return dict(zip(scope_names(gaz), scope))


def _nearest_pairs(
    keyed: DataFrame, gaz: Gazetteer, keys: list[str], max_distance: int
) -> DataFrame:
    """The keys whose city and state are given but not known together, with the nearest known pair."""
    *scope, city, state = keys
    pairs = gaz.by_city_state.df.select(*scope_names(gaz), "name", "state").withColumnsRenamed(
        {**_scoped(gaz, scope), "name": "candidate", "state": "known_state"}
    )
    exact = pairs.withColumnsRenamed({"candidate": city, "known_state": state})
    wanted = (
        keyed.select(*keys)
        .where(F.col(city).isNotNull() & F.col(state).isNotNull())
        .distinct()
        .join(exact, keys, "left_anti")
    )
    wanted = staged(wanted, "unknown-pairs")
    cities = wanted.select(*scope, F.col(city).alias("name"))
    near = near_names(cities, pairs.withColumnRenamed("candidate", "name"), max_distance, scope)
    near = Lookup.stage(near.withColumnRenamed("distance", "of_city"), [*scope, "name"], "near-cities")
    met = lookup_join(wanted, near, [*scope, city], "inner")
    states = Lookup.stage(pairs, [*scope, "candidate"], "known-pairs")
    both = lookup_join(met, states, [*scope, "candidate"], "inner").withColumn(
        "of_state", F.levenshtein(state, "known_state", max_distance)
    )
    order = F.struct(F.col("of_city") + F.col("of_state"), "of_city", "candidate", "known_state")
    pair = F.struct(F.col("candidate").alias("city"), F.col("known_state").alias("state"))
    return both.where("of_state >= 0").groupBy(*keys).agg(F.min_by(pair, order).alias("_wf_pair"))
