"""Image area of a page from its drawing operators: a stack of transforms, the unit square clipped to the view."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def concat(m: Matrix, n: Matrix) -> Matrix:
    """n applied first, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def clipped_square(m: Matrix, view: tuple[float, float, float, float]) -> float:
    """Area of the unit square's bounding box under m inside the view."""
    a, b, c, d, e, f = m
    xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
    x0, y0, x1, y1 = view
    return max(0.0, min(max(xs), x1) - max(min(xs), x0)) * max(0.0, min(max(ys), y1) - max(min(ys), y0))


def _numbers(x: object, n: int | None = None) -> list[float] | None:
    ok = isinstance(x, list) and (n is None or len(x) == n) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x)
    return list(map(float, x)) if ok else None


def image_areas(operators: list[list], view: tuple[float, float, float, float]) -> tuple[float, list[str]]:
    """Summed image area by the view's, at most 1, and warnings; images that overlap count twice.

    Operators: ["save"], ["restore"], ["transform", a, b, c, d, e, f], ["form", [a, b, c, d, e, f] or null],
    ["form_end"], ["image"], ["image_repeat", x scale, y scale, [x, y, ...]], ["image_group", [matrix, ...]] and
    ["mask_repeat", x scale, x skew, y skew, y scale, [x, y, ...]]. What has no proper numbers is left out and noted.
    """
    area = (view[2] - view[0]) * (view[3] - view[1])
    if area <= 0:
        return 0.0, []
    total, now, stack, warnings = 0.0, IDENTITY, [], {}
    for name, *args in operators:
        if name == "save":
            stack.append(now)
        elif name in ("restore", "form_end"):
            now = stack.pop() if stack else IDENTITY
        elif name == "transform":
            if m := _numbers(args, 6):
                now = concat(now, tuple(m))
            else:
                warnings["INVALID_IMAGE_TRANSFORM"] = True
        elif name == "form":
            stack.append(now)
            if args and (m := _numbers(args[0], 6)):
                now = concat(now, tuple(m))
        elif name == "image":
            total += clipped_square(now, view)
        elif name in ("image_repeat", "mask_repeat"):
            scales, places = _numbers(args[:-1], 2 if name == "image_repeat" else 4), _numbers(args[-1]) if args else None
            if scales and places is not None:
                a, b, c, d = (scales[0], 0.0, 0.0, scales[1]) if len(scales) == 2 else scales
                total += sum(clipped_square(concat(now, (a, b, c, d, x, y)), view) for x, y in zip(places[::2], places[1::2], strict=False))
            else:
                warnings["INVALID_IMAGE_REPEAT" if name == "image_repeat" else "INVALID_IMAGE_MASK_REPEAT"] = True
        elif name == "image_group":
            for entry in args[0] if args and isinstance(args[0], list) else [None]:
                if m := _numbers(entry, 6):
                    total += clipped_square(concat(now, tuple(m)), view)
                else:
                    warnings["INVALID_IMAGE_GROUP"] = True
    return min(1.0, total / area), list(warnings)


def image_area_ratio(operators: list[list], view: tuple[float, float, float, float]) -> float:
    return image_areas(operators, view)[0]


@F.pandas_udf(DoubleType())
def image_ratio(operators: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Of JSON operator lists; null stays null."""
    return pd.Series([None if o is None else image_area_ratio(json.loads(o), (0.0, 0.0, float(w), float(h))) for o, w, h in zip(operators, width, height, strict=True)], dtype=float)
