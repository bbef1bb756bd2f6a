"""Box geometry as SQL expressions, shared by DataFrame operators; a and b name the two rows of a pair.

Expressions are written in the dialect that Spark and DuckDB share. Ratios divide doubles; comparisons of lengths stay in
whole numbers.
"""

from __future__ import annotations


def area(r: str) -> str:
    return f"(({r}.right_x - {r}.left_x) * ({r}.bottom_y - {r}.top_y))"


def overlap_width(a: str = "a", b: str = "b") -> str:
    return f"greatest(0, least({a}.right_x, {b}.right_x) - greatest({a}.left_x, {b}.left_x))"


def overlap_height(a: str = "a", b: str = "b") -> str:
    return f"greatest(0, least({a}.bottom_y, {b}.bottom_y) - greatest({a}.top_y, {b}.top_y))"


def intersection(a: str = "a", b: str = "b") -> str:
    return f"({overlap_width(a, b)} * {overlap_height(a, b)})"


def iou(a: str = "a", b: str = "b") -> str:
    union = f"({area(a)} + {area(b)} - {intersection(a, b)})"
    return f"(case when {union} <= 0 then cast(0 as double) else cast({intersection(a, b)} as double) / {union} end)"


def union_area(a: str = "a", b: str = "b") -> str:
    wide = f"(greatest({a}.right_x, {b}.right_x) - least({a}.left_x, {b}.left_x))"
    return f"({wide} * (greatest({a}.bottom_y, {b}.bottom_y) - least({a}.top_y, {b}.top_y)))"


def density(a: str = "a", b: str = "b") -> str:
    """Both areas over that of the box around both; 0 without area."""
    whole = union_area(a, b)
    return f"(case when {whole} <= 0 then cast(0 as double) else cast({area(a)} + {area(b)} as double) / {whole} end)"


def width_ratio(a: str = "a", b: str = "b") -> str:
    least = f"least({a}.right_x - {a}.left_x, {b}.right_x - {b}.left_x)"
    return f"(case when {least} <= 0 then cast(0 as double) else cast({overlap_width(a, b)} as double) / {least} end)"


def height_ratio(a: str = "a", b: str = "b") -> str:
    least = f"least({a}.bottom_y - {a}.top_y, {b}.bottom_y - {b}.top_y)"
    return f"(case when {least} <= 0 then cast(0 as double) else cast({overlap_height(a, b)} as double) / {least} end)"


def connected(min_x: float, min_y: float, a: str = "a", b: str = "b") -> str:
    """Dense together, and aligned by width or by height. Gaps between the boxes make no difference."""
    return f"({density(a, b)} >= 0.15 and ({height_ratio(a, b)} >= {min_y} or {width_ratio(a, b)} >= {min_x}))"


def gap_x(a: str = "a", b: str = "b") -> str:
    return f"greatest(0, {b}.left_x - {a}.right_x, {a}.left_x - {b}.right_x)"


def gap_y(a: str = "a", b: str = "b") -> str:
    return f"greatest(0, {b}.top_y - {a}.bottom_y, {a}.top_y - {b}.bottom_y)"


def distance_squared(a: str = "a", b: str = "b") -> str:
    return f"({gap_x(a, b)} * {gap_x(a, b)} + {gap_y(a, b)} * {gap_y(a, b)})"


def contained(inner: str = "a", outer: str = "b") -> str:
    return (
        f"({inner}.left_x >= {outer}.left_x and {inner}.right_x <= {outer}.right_x "
        f"and {inner}.top_y >= {outer}.top_y and {inner}.bottom_y <= {outer}.bottom_y)"
    )


def adjacent(threshold: int = 50, a: str = "a", b: str = "b") -> str:
    """Both intervals meet when inflated by the threshold, ends included."""
    return (
        f"({a}.left_x - {threshold} <= {b}.right_x and {b}.left_x - {threshold} <= {a}.right_x "
        f"and {a}.top_y - {threshold} <= {b}.bottom_y and {b}.top_y - {threshold} <= {a}.bottom_y)"
    )


def smaller_overlap(a: str = "a", b: str = "b") -> str:
    """Intersection over the smaller area, which counts as 1 if either is 0."""
    least = f"(case when {area(a)} <> 0 and {area(b)} <> 0 then least({area(a)}, {area(b)}) else 1 end)"
    return f"(cast({intersection(a, b)} as double) / {least})"


def close_enough(max_x: int = 20, max_y: int = 20, min_x: float = 0.3, min_y: float = 0.0, a: str = "a", b: str = "b") -> str:
    """Near by a gap or aligned; two texts on one line: near by a more lenient horizontal gap alone."""
    least_h = f"least({a}.bottom_y - {a}.top_y, {b}.bottom_y - {b}.top_y)"
    least_w = f"least({a}.right_x - {a}.left_x, {b}.right_x - {b}.left_x)"
    # Centres differ by less than half the lesser height, in doubled units.
    same_line = f"({a}.type = 'text' and {b}.type = 'text' and abs({a}.top_y + {a}.bottom_y - {b}.top_y - {b}.bottom_y) < {least_h})"
    width = f"(case when {least_w} > 0 then {least_w} else 1 end)"
    height = f"(case when {least_h} > 0 then {least_h} else 1 end)"
    aligned = f"(cast({overlap_width(a, b)} as double) / {width} >= {min_x} or cast({overlap_height(a, b)} as double) / {height} >= {min_y})"
    near = f"({gap_x(a, b)} <= {max_x} or {gap_y(a, b)} <= {max_y})"
    # A gap of at most the larger of twice max_x and half the lesser width.
    lenient = f"({gap_x(a, b)} <= {2 * max_x} or 2 * {gap_x(a, b)} <= {least_w})"
    return f"(case when {same_line} then {lenient} else ({near} or {aligned}) end)"
