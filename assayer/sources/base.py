"""The common face of sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass
class Source:
    """Rows of a table with what the plan must know of them.

    ``text``: every column is text that has to be cast.  ``placed`` is the frame with
    the columns of ``block``, which give the file order: a task reads the rows of a
    block in order, and blocks sort as they follow each other.  Only the order pass reads it.
    """

    frame: DataFrame
    text: bool
    placed: DataFrame | None = None
    block: list[Column] = field(default_factory=list)

    @property
    def ordered(self) -> bool:
        return self.placed is not None
