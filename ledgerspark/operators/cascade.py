"""Deletion along the keys that tables hold of each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """Rows of child go with the row of parent that their key names."""

    parent: str
    parent_key: str
    child: str
    child_key: str


#: The library's own tables.
REFERENCES = (
    Reference("companies", "id", "filings", "company_id"),
    Reference("filings", "id", "contents", "filing_id"),
    Reference("filings", "id", "facts", "filing_id"),
    Reference("filings", "id", "sections", "filing_id"),
    Reference("contents", "sha256", "documents", "sha256"),
)


def order(tables: Sequence[str], references: Sequence[Reference]) -> list[str]:
    """Tables with every parent before its children; a circle is an error."""
    left, out = list(tables), []
    while left:
        ready = [t for t in left if not any(r.child == t and r.parent in left for r in references)]
        if not ready:
            raise ValueError(f"references go in a circle: {', '.join(left)}")
        out += ready
        left = [t for t in left if t not in ready]
    return out


def cascade(tables: Mapping[str, DataFrame], references: Sequence[Reference], root: str, ids: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What stays and what goes of each table once the rows of root with these ids go.

    One plan for all: a table's going rows are a semi-join with its parents' going
    keys, so only keys travel down and no intermediate result is collected. ids
    has the one column of root's key. A child of several parents goes with any of
    them; a row whose key is null stays.
    """
    (key,) = ids.columns
    known = [r for r in references if r.parent in tables and r.child in tables]
    gone: dict[str, list[tuple[str, DataFrame]]] = {root: [(key, ids)]}
    out = {}
    for name in order(list(tables), known):
        df, causes = tables[name], gone.get(name, [])
        if not causes:
            out[name] = (df, df.limit(0))
            continue
        goes, stays, mark = df, df, []
        for i, (own, keys) in enumerate(causes):
            side = keys.toDF(f"__k{i}").where(f"__k{i} is not null").distinct()
            stays = stays.join(side, F.col(own) == F.col(f"__k{i}"), "left_anti")
            if len(causes) == 1:
                goes = goes.join(side, F.col(own) == F.col(f"__k{i}"), "left_semi")
            else:
                goes = goes.join(side, F.col(own) == F.col(f"__k{i}"), "left")
                mark.append(F.col(f"__k{i}").isNotNull())
        if mark:
            goes = goes.where(reduce(lambda a, b: a | b, mark)).select(*df.columns)
        out[name] = (stays, goes)
        for r in known:
            if r.parent == name:
                gone.setdefault(r.child, []).append((r.child_key, goes.select(r.parent_key)))
    return out


def cascade_counts(result: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """table_name, n_kept, n_removed."""
    rows = [stays.agg(F.count("*").alias("n_kept")).crossJoin(goes.agg(F.count("*").alias("n_removed"))).select(F.lit(name).alias("table_name"), "n_kept", "n_removed") for name, (stays, goes) in result.items()]  # one row each
    return reduce(DataFrame.unionAll, rows)
