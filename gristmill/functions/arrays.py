"""Helpers for expressions over arrays."""

from __future__ import annotations


def let(body: str, **values: str) -> str:
    """SQL of body in which each name stands for its value, worked out once: an optimizer that merges projections cannot move it into a loop.

    `element_at` keeps its type, which an index in brackets would work out for every row, all names within anew.
    """
    for name, value in reversed(values.items()):
        body = f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return body
