"""Constraints as predicates over element columns: by tag, by layer, and by the tags of the neighbours.

An element is a struct with ``tag`` and ``value``, and, for layers, ``layer``. A constraint is a function from an element (and
an array of its neighbours' tags, null for vacant places) to a boolean column, so any number of them is one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Constraint = Callable[[Column, Column | None], Column]


def of_tag(tag: str, test: Callable[[Column], Column] | None = None) -> Constraint:
    """Elements of a tag whose value passes the test; elements of other tags cannot bond."""
    return lambda e, _=None: F.coalesce((e["tag"] == tag) & (test(e["value"]) if test else F.lit(True)), F.lit(False))


def aligned(layer: str, inner: Constraint) -> Constraint:
    """An inner constraint that only elements of the same layer can meet."""
    return lambda e, near=None: F.coalesce(e["layer"] == layer, F.lit(False)) & inner(e, near)


def in_context(inner: Constraint, needs: list[str], grammar: dict[str, list[str]] | None = None) -> Constraint:
    """An inner constraint whose place has occupied neighbours of all needed tags, and only such as the grammar lets stand beside the element."""
    def test(e: Column, near: Column | None = None) -> Column:
        tags = F.filter(near, lambda x: x.isNotNull())
        there = F.lit(True)
        for tag in needs:
            there = there & F.array_contains(tags, tag)
        if grammar is not None:
            table = F.create_map(*[x for k, v in grammar.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
            there = there & F.forall(tags, lambda x: F.coalesce(F.array_contains(F.try_element_at(table, e["tag"]), x), F.lit(False)))
        return inner(e, near) & F.coalesce(there, F.lit(False))

    return test


def all_of(*constraints: Constraint) -> Constraint:
    """An envelope: elements must meet every constraint."""
    def test(e: Column, near: Column | None = None) -> Column:
        out = F.lit(True)
        for c in constraints:
            out = out & c(e, near)
        return out

    return test


def dissolves(e: Column) -> Column:
    """Whether an element goes back to the pool when its structure dissolves: not if it is ``sticky``."""
    return ~F.coalesce(e["sticky"], F.lit(False))
