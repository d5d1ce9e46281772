"""Expressions over a located place: its ancestor chain, path text and shared level.

A place is a struct ``(id, level, ancestors)`` whose ``ancestors`` array of structs
``(id, name, level)`` runs from the place itself to the root.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative levels of the data model.
COUNTRY_LEVEL = 2
STATE_LEVELS = (4, 6)
STATE_FALLBACK_LEVEL = 7


def path_string(ancestors: Column | str, separator: str = " > ") -> Column:
    """Names from the place up to the root joined into one text."""
    chain = F.col(ancestors) if isinstance(ancestors, str) else ancestors
    return F.array_join(F.transform(chain, lambda a: a["name"]), separator)


def primary_state(ancestors: Column | str) -> Column:
    """Nearest state-level name on the chain, else the nearest fallback level, else NULL."""
    chain = F.col(ancestors) if isinstance(ancestors, str) else ancestors
    states = F.filter(chain, lambda a: a["level"].isin(*STATE_LEVELS))
    fallback = F.filter(chain, lambda a: a["level"] == STATE_FALLBACK_LEVEL)
    first = F.lit(1)
    return F.coalesce(
        F.try_element_at(states, first)["name"],
        F.try_element_at(fallback, first)["name"],
    )


def common_ancestor_level(left: Column, right: Column) -> Column:
    """Level two places share, from their ancestor chains."""
    shared = F.array_intersect(left["ancestors"], right["ancestors"])
    deepest = F.array_max(F.transform(shared, lambda a: a["level"]))
    return shared_level(
        left,
        right,
        F.array_contains(right["ancestors"]["id"], left["id"]),
        F.array_contains(left["ancestors"]["id"], right["id"]),
        deepest,
    )


def shared_level(
    left: Column, right: Column, left_above: Column, right_above: Column, deepest: Column
) -> Column:
    """Level two places share.

    The same place gives its level, a container gives the container's level; otherwise the
    highest level among shared ancestors, never below the country level. The order of the cases
    matters when levels do not grow down the tree.
    """
    return (
        F.when(left["id"] == right["id"], left["level"])
        .when(left_above, left["level"])
        .when(right_above, right["level"])
        .otherwise(F.greatest(F.lit(COUNTRY_LEVEL), deepest))
    )
