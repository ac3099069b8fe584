"""Column-name normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame

_QUOTES = re.compile(r"[\"'`‘’“”]")
_LOWER_THEN_UPPER = re.compile(r"([a-z0-9])([A-Z])")
_ACRONYM_THEN_WORD = re.compile(r"([A-Z]+)([A-Z][a-z])")
_NOT_ALNUM = re.compile(r"[^A-Za-z0-9]+")


def snake_case(name: str) -> str:
    """One name in snake case; ``x`` is put before a leading digit or an empty name."""
    text = _QUOTES.sub("", name).replace("%", "_percent_").replace("#", "_number_")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = _ACRONYM_THEN_WORD.sub(r"\1_\2", _LOWER_THEN_UPPER.sub(r"\1_\2", text))
    text = _NOT_ALNUM.sub("_", text).strip("_").lower()
    return text if text[:1].isalpha() else f"x{text}"


def clean_name_list(names: Iterable[str]) -> list[str]:
    """Snake-case names made unique: the second ``a`` becomes ``a_2``."""
    out: list[str] = []
    for base in map(snake_case, names):
        candidate, n = base, 1
        while candidate in out:
            n += 1
            candidate = f"{base}_{n}"
        out.append(candidate)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column of ``df``; a pure projection, so pruning still reaches the scan."""
    return df.toDF(*clean_name_list(df.columns))


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming every column of ``columns`` that ``df`` lacks."""
    missing = [c for c in dict.fromkeys(columns) if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s): {', '.join(missing)}")


def domain_list(domains: Iterable[str] | str) -> list[str]:
    """The domain names as a list; empty lists and duplicates are rejected."""
    names = [domains] if isinstance(domains, str) else list(domains)
    if not names:
        raise ValueError("at least one domain is needed")
    repeated = sorted({d for d in names if names.count(d) > 1})
    if repeated:
        raise ValueError(f"repeated domain(s): {', '.join(repeated)}")
    return names


def column_list(columns: Iterable[str] | str) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)
