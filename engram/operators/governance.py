"""Authorization as row predicates and masks that plans take along.

A reader's statements are folded on the driver, once a request, to what a view needs:
for each kind one predicate over its rows, the paths to mask and a cap. Nothing is
decided row by row outside the plan, and predicates reach the scans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("CONCEPT", "PROPOSITION", "ASSERTION", "EVIDENCE", "ACTIVITY")


@dataclass(frozen=True)
class Statement:
    """Who may (or may not) do what to which rows.

    :param principals, actions, kinds, spaces: null means any.
    :param where: a further condition on rows, as SQL; null means none.
    :param mask: paths that read as null under this statement.
    :param max_results: cap on the rows of a result under this statement.
    """

    allow: bool
    principals: frozenset[str] | None = None
    actions: frozenset[str] | None = None
    kinds: frozenset[str] | None = None
    spaces: frozenset[str] | None = None
    where: str | None = None
    mask: frozenset[tuple[str, ...]] = frozenset()
    max_results: int | None = None

    def meets(self, principal: str, action: str, kind: str) -> bool:
        return all(own is None or x in own for own, x in ((self.principals, principal), (self.actions, action), (self.kinds, kind)))

    def rows(self) -> Column:
        held = F.lit(True) if self.spaces is None else F.col("space").isin(*sorted(self.spaces))
        return F.coalesce(held if self.where is None else held & F.expr(self.where), F.lit(False))


@dataclass(frozen=True)
class Authority:
    """visible and masked as ``StoreView`` takes them; kinds without any allowed row are visible to nobody."""

    visible: dict[str, Column]
    masked: dict[str, set[tuple[str, ...]]]
    max_results: int | None


def authorize(statements: Iterable[Statement], principal: str, action: str = "read") -> Authority:
    """Rows are allowed by any statement that allows them and by none that denies them; nothing said is a denial.

    Of several allowing statements the least restrictive holds: a path is masked, and a
    result capped, only if all that allow anything of the kind say so (the mask and cap
    of a reader, not of a row).
    """
    statements = list(statements)
    visible, masked, caps = {}, {}, []
    for kind in KINDS:
        met = [s for s in statements if s.meets(principal, action, kind)]
        allowed, denied = [s for s in met if s.allow], [s for s in met if not s.allow]
        may = reduce(Column.__or__, [s.rows() for s in allowed]) if allowed else F.lit(False)
        visible[kind] = reduce(lambda c, s: c & ~s.rows(), denied, may)
        if allowed:
            common = frozenset.intersection(*(s.mask for s in allowed))
            if common:
                masked[kind] = set(common)
            caps.append(None if any(s.max_results is None for s in allowed) else max(s.max_results for s in allowed))
    return Authority(visible, masked, None if not caps or None in caps else max(caps))
