"""Named entities by gazetteer: whole-token, case-insensitive, longest name first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scans
from .core import dedupe_ci, find_all, sql_text, strip
from .lexicons import ENTITY_NOISE_TLDS, MALWARE_NAMES, PRODUCT_NAMES


def name_pattern(names) -> str:
    """Names as whole tokens, the longest first. What a name can begin with is tried before the boundary, which costs more."""
    longest_first = sorted(set(names), key=lambda n: (-len(n), n))
    begin = "".join(f"[{''.join(re.escape(c) for c in sorted(set(letters)))}]" for letters in zip(*(n[:3] for n in longest_first)))
    return rf"(?iU)(?={begin})\b(?:" + "|".join(longest_first) + r")\b"


NAMES = name_pattern([*MALWARE_NAMES, *PRODUCT_NAMES])

# Fixed value: entities that are really indicators. The CVE branch ends after one digit of the
# number, so a full CVE id is not covered; results depend on that.
ENTITY_NOISE = (
    r"(?iU)\A(CVE-\d{4}-\d|(\d{1,3}\.){3}\d{1,3}|[a-z0-9-]+\.("
    + "|".join(ENTITY_NOISE_TLDS)
    + r"))\z"
)


def names_in(text: Column) -> Column:
    """Every known malware or product name in text order, repeats included."""
    around = scans.near(text, [*MALWARE_NAMES, *PRODUCT_NAMES], 1)
    return F.when(around == "", F.array().cast("array<string>")).otherwise(find_all(around, NAMES))


def without_names(text: Column) -> Column:
    """The text with every known malware or product name taken out, so that no longer name can run
    across one: rule names override others."""
    return F.regexp_replace(text, NAMES, "\u0001")


def is_noise(entity: Column) -> Column:
    return entity.rlike(ENTITY_NOISE)


def drop_ioc_noise(entities: Column) -> Column:
    return F.filter(F.transform(entities, strip), lambda e: ~is_noise(e))


def bucket(names: str, lexicon) -> Column:
    """The members of the array column `names` that belong to one lexicon, de-duplicated."""
    members = ", ".join(sql_text(name) for name in lexicon)
    return dedupe_ci(f"filter({names}, n -> lower(n) IN ({members}))")


def malware(names: str) -> Column:
    return bucket(names, MALWARE_NAMES)


def products(names: str) -> Column:
    return bucket(names, PRODUCT_NAMES)
