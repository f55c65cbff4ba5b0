"""Slugs of header names across scripts. Spark has no compatibility decomposition, so these run over distinct names in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin spellings of Cyrillic letters (fixed values).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi",
    "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Letters that the reviewing slug leaves alone (fixed values).
NOT_REVIEWED = "ґєії"
#: Groups of header names that mean the same; the first names the group (fixed values).
SYNONYMS = (("month", "months", "mon", "mth", "місяць", "міс"), ("city", "city_name", "town", "місто"), ("age", "years", "yrs"))

_ALL = str.maketrans(CYRILLIC)
_REVIEW = str.maketrans({k: v for k, v in CYRILLIC.items() if k not in NOT_REVIEWED})


def latin_slug(name: str | None) -> str:
    """Lower-case Latin words of a name: transliterated, without accents, other signs as single spaces."""
    plain = unicodedata.normalize("NFKD", (name or "").lower().translate(_ALL))
    return " ".join(re.findall("[a-z0-9]+", "".join(c for c in plain if not unicodedata.combining(c))))


def review_slug(name: str | None) -> str:
    """As latin_slug(), but letters of other scripts stay and the smaller table is used."""
    plain = unicodedata.normalize("NFKD", (name or "").strip().lower().translate(_REVIEW))
    return " ".join(re.sub(r"[\W_]+", " ", plain).split())


def aliases(groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> dict[str, str]:
    """The group's slug by each member's slug."""
    found: dict[str, str] = {}
    for group in groups:
        slugs = [s for s in map(latin_slug, group) if s]
        found |= {s: slugs[0] for s in slugs}
    return found


@F.pandas_udf(StringType())
def latin_slugs(names: pd.Series) -> pd.Series:
    return names.map(latin_slug, na_action=None)


@F.pandas_udf(StringType())
def review_slugs(names: pd.Series) -> pd.Series:
    return names.map(review_slug, na_action=None)
