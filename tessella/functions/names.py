"""Column naming rules. All of them work on the schema, never on rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from ..errors import NameCollision

# What a name may keep, and what replaces the rest.
NOT_ALPHANUMERIC = r"[^A-Za-z0-9]+"
NOT_WORD = r"\W+"
REPLACEMENT = "a"


def require_unique(names: Sequence[str]) -> list[str]:
    """Spark resolves names without regard to case, so collisions are judged the same way."""
    repeated = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if repeated:
        raise NameCollision(f"names collide after renaming: {sorted(repeated)}")
    return list(names)


def dataset_names(columns: Iterable[str], suffix: int | str, replacement: str = REPLACEMENT) -> list[str]:
    """Alphanumeric names that stay unique across the datasets of a project."""
    return require_unique([f"{re.sub(NOT_ALPHANUMERIC, replacement, c)}_{suffix}" for c in columns])


def sanitize_columns(df: DataFrame, suffix: int | str, replacement: str = REPLACEMENT) -> DataFrame:
    return df.toDF(*dataset_names(df.columns, suffix, replacement))


def rename_spaces(df: DataFrame) -> DataFrame:
    return df.toDF(*require_unique([c.replace(" ", "_") for c in df.columns]))


def key_name(left: str, right: str) -> str:
    """Name of the one column that a linked pair becomes."""
    shown = re.sub(NOT_WORD, "", left)
    return shown if left == right else f"{shown}_{re.sub(NOT_WORD, '', right)}"
