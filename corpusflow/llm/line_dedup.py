"""Line dedup: passages of three lines that occur again are cut out of all but their first place.

Every window of ``width`` consecutive lines is hashed (128 bits).  A window that occurs more than once
keeps its first place in the order (document id, position); at any later place its lines are
covered, and covered lines go.  Everything is DataFrame functions.

* A null text stays null and an empty text empty; both have no windows.
* A text with fewer lines than the window is left alone; so are windows of blank lines only.
* A document whose lines are all covered keeps its row, with an empty text.
* Repeated rows (same id, same text) are one occurrence: they keep or lose the same lines.
  Rows that share an id but not the text are ordered by a digest of the text.
* A null id counts as the smallest.  Extra columns pass through, whatever their names; one named like
  the count is replaced.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpusflow.llm.spans import cut_repeats


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, count_col: str | None = "lines_removed"
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``, and the number of lines cut.

    ``count_col=None`` returns the columns of ``docs`` alone.
    """
    return cut_repeats(
        docs, id_col, text_col, width, count_col=count_col, glue="\n",
        cut=lambda text: F.split(text, "\n", -1),
        digest=lambda run: F.concat_ws("\n", *run),
        counts=lambda run: reduce(lambda a, b: a | b, [F.trim(line) != "" for line in run]),
    )
