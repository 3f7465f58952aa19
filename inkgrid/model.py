"""Boxes, intervals, points and their one validator; schemas of the tables.

Coordinates are pixels from the top left; right and bottom ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T


class InvalidInput(ValueError):
    """Input that a plan must not be built from."""


@dataclass(frozen=True)
class Box:
    x1: int
    y1: int
    x2: int
    y2: int

    @property
    def width(self) -> int:
        return self.x2 - self.x1

    @property
    def height(self) -> int:
        return self.y2 - self.y1

    def checked(self, name: str = "box", size: tuple[int, int] | None = None) -> Box:
        """The box itself if it is ordered, not negative and (with a size) on the page."""
        if min(self.x1, self.y1) < 0:
            raise InvalidInput(f"{name}: negative coordinates in {self}")
        if self.x1 >= self.x2 or self.y1 >= self.y2:
            raise InvalidInput(f"{name}: ends must come after beginnings in {self}")
        if size and (self.x2 > size[0] or self.y2 > size[1]):
            raise InvalidInput(f"{name}: {self} leaves a page of {size[0]} x {size[1]}")
        return self

    def clipped(self, size: tuple[int, int]) -> Box | None:
        """What lies on the page; None if nothing does."""
        box = Box(max(0, self.x1), max(0, self.y1), min(size[0], self.x2), min(size[1], self.y2))
        return box if box.x1 < box.x2 and box.y1 < box.y2 else None


def _integers(text: str, n: int, name: str) -> list[int]:
    try:
        found = [int(p) for p in text.split(",")]
    except ValueError as e:
        raise InvalidInput(f"{name}: {text!r} holds no integers") from e
    if len(found) != n:
        raise InvalidInput(f"{name}: {text!r} must hold {n} integers")
    return found


def parse_box(text: str, name: str = "box", size: tuple[int, int] | None = None) -> Box:
    return Box(*_integers(text, 4, name)).checked(name, size)


def parse_boxes(text: str, name: str = "boxes", size: tuple[int, int] | None = None) -> list[Box]:
    return [parse_box(part, name, size) for part in text.split(";") if part.strip()]


def parse_point(text: str, name: str = "point") -> tuple[int, int]:
    x, y = _integers(text, 2, name)
    return x, y


def parse_interval(text: str, name: str = "interval") -> tuple[int, int]:
    a, b = _integers(text, 2, name)
    if a >= b:
        raise InvalidInput(f"{name}: {a} must come before {b}")
    return a, b


def parse_reference(text: str, size: tuple[int, int] | None = None) -> tuple[str, Box]:
    """``character=x1,y1,x2,y2``."""
    char, sep, box = text.partition("=")
    if not sep or not char:
        raise InvalidInput(f"reference: {text!r} must look like c=x1,y1,x2,y2")
    return char, parse_box(box, f"reference {char}", size)


def parse_references(texts: list[str], size: tuple[int, int] | None = None) -> dict[str, Box]:
    """References by character; a later one of the same character replaces the earlier."""
    return dict(parse_reference(t, size) for t in texts)


def parse_colour(text: str) -> tuple[int, int, int]:
    r, g, b = _integers(text, 3, "colour")
    if not all(0 <= v <= 255 for v in (r, g, b)):
        raise InvalidInput(f"colour: {text!r} leaves 0..255")
    return r, g, b


def parse_strengths(text: str) -> list[float]:
    """Comma-separated numbers; empty items are dropped, each must be finite and not negative."""
    try:
        return [finite(float(p), "strength") for p in text.split(",") if p.strip()]
    except ValueError as e:
        raise InvalidInput(f"strengths: {e}") from e


def parse_filter(text: str | None) -> list[str]:
    """Comma-separated keywords without empty ones."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def parse_candidates(text: str) -> list[tuple[str, str]]:
    """``name=file`` items, separated by commas."""
    found = []
    for item in parse_filter(text):
        name, sep, file = item.partition("=")
        if not sep or not name or not file:
            raise InvalidInput(f"candidates: {item!r} must look like name=file")
        found.append((name, file))
    return found


def finite(value: float, name: str, least: float = 0.0) -> float:
    if not math.isfinite(value) or value < least:
        raise InvalidInput(f"{name}: {value} must be finite and at least {least}")
    return value


def page_points(width: int, height: int, dpi: float) -> tuple[float, float]:
    """Page size in points of a raster."""
    if not (math.isfinite(dpi) and dpi > 0):
        raise InvalidInput(f"dpi: {dpi} must be a positive number")
    return width * 72 / dpi, height * 72 / dpi


def check_page_size(width: float, height: float) -> tuple[float, float]:
    if not all(math.isfinite(v) and v > 0 for v in (width, height)):
        raise InvalidInput(f"page size: {width} x {height} must be finite and positive")
    return width, height


@dataclass(frozen=True)
class Move:
    """A block of rows moved up by ``shift`` (down if negative)."""

    x: tuple[int, int]
    y: tuple[int, int]
    shift: int

    def checked(self, size: tuple[int, int]) -> Move:
        (x1, x2), (y1, y2) = self.x, self.y
        if not 0 <= x1 < x2 <= size[0]:
            raise InvalidInput(f"move: columns {self.x} leave a page of width {size[0]}")
        if not 0 <= y1 < y2 <= size[1]:
            raise InvalidInput(f"move: rows {self.y} leave a page of height {size[1]}")
        if y1 - self.shift < 0 or y2 - self.shift > size[1]:
            raise InvalidInput(f"move: rows {self.y} shifted by {self.shift} leave the page")
        return self

    @property
    def cleanup(self) -> Box:
        """Where the block was and no longer is; empty if it moves down."""
        return Box(self.x[0], self.y[1] - self.shift, self.x[1], self.y[1])


def text_crop_box(position: tuple[int, int], page: tuple[int, int], text: str, size: int) -> Box:
    """The preview around a line of text: estimated from its length and font size."""
    x, y = position
    width = max(len(text) * size, 200)
    return Box(max(0, x - 60), max(0, y - 50), min(page[0], x + width + 60), min(page[1], y + int(size * 2.4) + 50))


PIXELS = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b"))])
BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")])
SIZE = T.StructType([T.StructField("w", T.DoubleType()), T.StructField("h", T.DoubleType())])
VERIFY_CASE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("source_page", T.LongType()),
        T.StructField("final_page", T.LongType()),
        T.StructField("expected_page", T.LongType()),
        T.StructField("page_size", SIZE),
        T.StructField("expected_sha256", T.StringType()),
        T.StructField("allowed_boxes", T.ArrayType(BOX)),
        T.StructField("expected_changed_pixels", T.LongType()),
        T.StructField("expected_changed_bbox", BOX),
        T.StructField("blank_box", BOX),
        T.StructField("blank_dark_limit", T.LongType()),
        T.StructField("preserve_box", BOX),
        T.StructField("dark_box", BOX),
        T.StructField("dark_threshold", T.IntegerType()),
        T.StructField("dark_limit", T.LongType()),
        T.StructField("expected_pages", T.IntegerType()),
        T.StructField("page_index", T.IntegerType()),
    ]
)
#: What a case that leaves a field out means.
CASE_DEFAULTS = {"blank_dark_limit": 0, "dark_threshold": 180, "dark_limit": 0, "expected_pages": 1, "page_index": 0}
