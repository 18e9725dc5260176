"""Level texts: rows of tiles joined by newlines. Seven tiles: # wall, blank floor, @ player, $ box, . goal, * box on goal, + player on goal.

All functions take and return columns; a null text gives null unless said otherwise. Images are gathered by Arrow batch
(a few microseconds a text; the same as nested lambdas over rows took more than a hundred), all else stays in the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions import images

#: The tiles in order of their ids.
TILES = "# @$.*+"
SIDE, MOST_CELLS = 10, 128


def bound(value: Column, body) -> Column:
    """`body(value)` with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def rows_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def text_of(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def count_of(text: Column, tiles: str) -> Column:
    """FN-2: how many of the tiles a text holds."""
    return F.length(text) - F.length(F.translate(text, tiles, ""))


def players(text: Column) -> Column:
    return count_of(text, "@+")


def boxes(text: Column) -> Column:
    return count_of(text, "$*")


def goals(text: Column) -> Column:
    return count_of(text, ".*+")


def is_valid(text: Column) -> Column:
    """FN-1: ten rows of ten known tiles, one player, as many boxes as goals and at least one. Null is not valid."""
    shape = F.length(text) == SIDE * SIDE + SIDE - 1
    square = bound(rows_of(text), lambda r: (F.size(r) == SIDE) & F.forall(r, lambda x: F.length(x) == SIDE))
    known = F.length(F.translate(text, TILES + "\n", "")) == 0
    good = shape & square & known & (players(text) == 1) & (boxes(text) >= 1) & (boxes(text) == goals(text))
    return F.coalesce(good, F.lit(False))


def normalised(text: Column) -> Column:
    """FN-4: no carriage returns at the end of rows, no blank rows at either end, ragged rows padded with floor, - and _ as floor (a row of them is no blank one)."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r+$", ""))
    full = lambda x: x.rlike(r"(?U)\S")

    def trimmed(r: Column) -> Column:
        used = F.filter(F.transform(r, lambda x, i: F.when(full(x), i)), lambda i: i.isNotNull())
        return bound(used, lambda u: F.when(F.size(u) == 0, F.array().cast("array<string>")).otherwise(F.slice(r, F.element_at(u, 1) + 1, F.element_at(u, -1) - F.element_at(u, 1) + 1)))

    def padded(r: Column) -> Column:
        width = F.array_max(F.transform(r, lambda x: F.length(x)))
        return bound(width, lambda w: text_of(F.transform(r, lambda x: F.rpad(F.translate(x, "-_", "  "), w, " "))))

    return bound(bound(lines, trimmed), lambda r: F.when(F.size(r) == 0, F.lit("")).otherwise(padded(r)))


def parse_error(text: Column) -> Column:
    """FN-3: the first fault of a normalised text, null if there is none; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    width = F.array_max(F.transform(rows_of(t), lambda x: F.length(x)))
    unknown = F.translate(t, TILES + "\n", "")
    flat = F.regexp_instr(t, F.lit(r"[^# @$.*+\n]"))
    before = F.substring(t, F.lit(1), flat - 1)
    row = F.size(F.split(before, "\n", -1)) - 1
    column = F.length(F.element_at(F.split(before, "\n", -1), -1))
    return (
        F.when(F.length(t) == 0, "empty")
        .when(width * F.size(rows_of(t)) > MOST_CELLS, "too large")
        .when(F.length(unknown) > 0, F.concat(F.lit("unknown tile at row "), row.cast("string"), F.lit(" column "), column.cast("string")))
        .when(players(t) != 1, "players")
        .when(boxes(t) == 0, "no boxes")
        .when(boxes(t) != goals(t), "boxes and goals")
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _images(text: pa.Array) -> pa.Array:
    return images.all_images(text)


@F.arrow_udf(T.StringType())
def _image(text: pa.Array, k: pa.Array) -> pa.Array:
    return images.one_image(text, k)


@F.arrow_udf(T.StringType())
def _least(text: pa.Array) -> pa.Array:
    return images.least_image(text)


def orbit(text: Column) -> Column:
    """FN-6: the eight images, image k turned clockwise k % 4 times and mirrored from 4 on; null for ragged texts."""
    return _images(text)


def transform(text: Column, k: Column | int) -> Column:
    """FN-5: image k of a text; null for a ragged text or a k beyond 0 to 7."""
    return _image(text, (F.lit(k) if isinstance(k, int) else k).cast("int"))


def canonical(text: Column) -> Column:
    """FN-7: the least image in binary order; null for a ragged text."""
    return _least(text)


def level_id(source: Column, file: Column, index: Column) -> Column:
    """FN-11: source/FFF#index."""
    return F.format_string("%s/%03d#%d", source, file, index)


def bucket_of(moves: Column, edges: Column) -> Column:
    """FN-12: how many edges do not exceed the moves; null for null moves."""
    return F.when(moves.isNotNull(), F.size(F.filter(edges, lambda e: e <= moves)))


def bucket_labels(edges: Column, style: str = "assigned") -> Column:
    """FN-13: move ranges of the buckets. `assigned` fits bucket_of; `upper` counts an edge to the bucket below."""
    shift = 1 if style == "assigned" else 0
    low = F.transform(edges, lambda e: (F.ceil(e) if shift else F.floor(e) + 1).cast("int"))
    high = F.transform(edges, lambda e: (F.ceil(e) - 1 if shift else F.floor(e)).cast("int"))

    def label(a: Column, i: Column) -> Column:
        b = F.get(high, i + 1)
        return F.when(b.isNull(), F.concat(F.lit("≥ "), a.cast("string"))).when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("–"), b.cast("string")))

    first = F.concat(F.lit("≤ "), F.element_at(high, 1).cast("string"))
    return F.concat(F.array(first), F.transform(low, label))


def path_moves(path: Column) -> Column:
    """FN-15: the moves of a path."""
    return F.length(path)


def path_pushes(path: Column) -> Column:
    return F.length(F.regexp_replace(path, "[^A-Z]", ""))


def sample_status(text: Column, valid: Column, status: Column) -> Column:
    """FN-16: undecodable, invalid, or the solver's status."""
    return F.when(text.isNull(), "undecodable").when(~valid, "invalid").otherwise(status)
