"""Display labels and category groups for the spending hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Office codes and race names in display order, leaf names of a candidate in
# order with their long labels, names of the other nodes, and the display category of each
# party code, race name and leaf name.
OFFICE_LABELS = {"P": "Presidential", "S": "Senate", "H": "House"}
LEAF_LABELS = {
    "Inside": "Direct Campaign Spending",
    "Outside Support": "Independent Support",
    "Outside Oppose": "Independent Opposition",
}
OTHERS, ROOT_NAME, ROOT_LABEL = "Others", "root", "All Races"
CATEGORIES = {
    "party": {"DEM": "dem", "DFL": "dem", "REP": "rep"},
    "race": {"Presidential": "president", "Senate": "senate", "House": "house"},
    "leaf": {"Inside": "president", "Outside Support": "house", "Outside Oppose": "rep"},
}
NO_CATEGORY = "neutral"

OFFICE_ORDER, LEAF_NAMES = list(OFFICE_LABELS), list(LEAF_LABELS)


def looked_up(names: dict[str, str], key: Column | str) -> Column:
    """The name of a key, null if it has none: one map literal, one lookup."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.element_at(table, F.col(key) if isinstance(key, str) else key)


def office_label(office: Column | str) -> Column:
    return looked_up(OFFICE_LABELS, office)


def leaf_label(leaf: Column | str) -> Column:
    """The long label of a leaf; other names stay as they are."""
    return F.coalesce(looked_up(LEAF_LABELS, leaf), F.col(leaf) if isinstance(leaf, str) else leaf)


def display_category(kind: str, key: Column | str) -> Column:
    """Category of a party code, race name or leaf name (``kind``)."""
    return F.coalesce(looked_up(CATEGORIES[kind], key), F.lit(NO_CATEGORY))
