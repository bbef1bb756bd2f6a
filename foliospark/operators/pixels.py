"""Pixel kernels on single images as numpy arrays, and the scans that apply them to image rows.

Grey images are float or uint8 arrays (height, width). Results follow the usual definitions of these filters; they are not
bit-exact with any one library, so tests hold them to tolerances.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCALES = (1.0, 0.75, 0.5)


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luminance of a BGR image, rounded to uint8."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def _rows(image: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    half = len(kernel) // 2
    wide = np.pad(image.astype(np.float64), ((0, 0), (half, half)), mode=mode)
    return sum(k * wide[:, i : i + image.shape[1]] for i, k in enumerate(kernel))


def separable(image: np.ndarray, across: np.ndarray, down: np.ndarray, mode: str = "reflect") -> np.ndarray:
    if min(image.shape) <= max(len(across), len(down)) // 2:
        mode = "edge"
    return _rows(_rows(image, across, mode).T, down, mode).T


def gaussian(image: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    return separable(image, kernel, kernel, mode)


def adaptive_threshold(image: np.ndarray, size: int, offset: float, inverse: bool = False) -> np.ndarray:
    """255 where a pixel exceeds its Gaussian neighbourhood less the offset (inverse: where it doesn't), else 0."""
    above = image > np.rint(gaussian(image, size, "edge")) - offset
    return np.where(above != inverse, 255, 0).astype(np.uint8)


def _extreme(image: np.ndarray, size: int, pick: Callable, fill: int) -> np.ndarray:
    before, after = size // 2, size - 1 - size // 2
    wide = np.pad(image, ((before, after), (before, after)), constant_values=fill)
    across = pick.reduce([wide[:, i : i + image.shape[1]] for i in range(size)])
    return pick.reduce([across[i : i + image.shape[0]] for i in range(size)])


def dilate(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _extreme(mask, size, np.maximum, 0)
    return mask


def erode(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _extreme(mask, size, np.minimum, 255)
    return mask


def close(mask: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(mask, size), size)


def open_(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, size), size)


def _runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end of the runs of set pixels, and for each the first run of its part.

    Touching runs of neighbouring rows are of one part; diagonal: also those that touch at a corner.
    """
    set_ = np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8)
    y, edge = np.nonzero(np.diff(set_, axis=1))
    row, begin, end = y[::2], edge[::2], edge[1::2]
    parent = np.arange(len(row))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    reach = int(diagonal)
    for r in range(1, mask.shape[0]):
        i, j = int(first[r - 1]), int(first[r])
        while i < first[r] and j < first[r + 1]:
            if begin[i] < end[j] + reach and begin[j] < end[i] + reach:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    return row, begin, end, np.array([find(k) for k in range(len(row))], np.int64)


def _painted(shape: tuple[int, int], row: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An array with each run's value in its place, 0 elsewhere; runs don't overlap."""
    steps = np.zeros((shape[0], shape[1] + 1), np.int64)
    np.add.at(steps, (row, begin), values)
    np.subtract.at(steps, (row, end), values)
    return np.cumsum(steps, axis=1)[:, :-1]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of the 8-connected parts of a mask, in the order of their first pixel."""
    found: dict[int, list[int]] = {}
    for y, begin, end, part in zip(*(x.tolist() for x in _runs(mask, True))):
        box = found.setdefault(part, [1 << 30, y, 0, 0, 0])
        box[0], box[2] = min(box[0], begin), max(box[2], end)
        box[3], box[4] = y + 1, box[4] + end - begin
    return [(x, top, right - x, bottom - top, n) for x, top, right, bottom, n in found.values()]


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with everything set that its parts enclose: all but the background that reaches the border."""
    ground = np.pad(mask == 0, 1, constant_values=True)
    row, begin, end, part = _runs(ground, False)
    outside = part == 0
    open_ground = _painted(ground.shape, row[outside], begin[outside], end[outside], np.ones(int(outside.sum()), np.int64))
    return np.where(open_ground[1:-1, 1:-1] > 0, 0, 255).astype(np.uint8)


def outlines(mask: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(x, y, w, h, area) of the outer outlines of a mask's parts, none of what lies inside another: in the order of their first pixel.

    The area is that of the outline through the centres of outer pixels: of four neighbouring centres, a whole unit if all are set, half of
    one if three are. A thin line has none.
    """
    mask = filled(mask)
    row, begin, end, part = _runs(mask, True)
    label = _painted(mask.shape, row, begin, end, part + 1)
    corners = [label[a : a + mask.shape[0] - 1, b : b + mask.shape[1] - 1] for a in (0, 1) for b in (0, 1)]
    count = sum((c > 0).astype(np.int8) for c in corners)
    # All set pixels of four neighbours are of one part.
    owner = np.maximum.reduce(corners)
    area = np.bincount(owner[count == 4], minlength=len(row) + 1) + 0.5 * np.bincount(owner[count == 3], minlength=len(row) + 1)
    firsts = np.unique(part).tolist()
    return [(x, y, w, h, float(area[k + 1])) for (x, y, w, h, _), k in zip(components(mask), firsts)]


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    return separable(image, d, s), separable(image, s, d)


def edge_density(roi: np.ndarray) -> float:
    """Share of pixels whose gradient, stretched to 0..255, exceeds 50."""
    if not roi.size:
        return 0.0
    dx, dy = sobel(roi)
    size = np.hypot(dx, dy)
    low, high = size.min(), size.max()
    return float(np.mean((size - low) * (255 / (high - low)) > 50)) if high > low else 0.0


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: local maxima of the gradient across its direction that reach ``high`` or touch, over ones above ``low``, one that does."""
    dx, dy = sobel(image)
    size = np.abs(dx) + np.abs(dy)
    wide = np.pad(size, 1)
    at = lambda oy, ox: wide[1 + oy : 1 + oy + size.shape[0], 1 + ox : 1 + ox + size.shape[1]]
    steep = np.abs(dy) > 2.414 * np.abs(dx)
    flat = np.abs(dy) < 0.4142 * np.abs(dx)
    rising = dx * dy >= 0
    a = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(rising, at(-1, -1), at(-1, 1))))
    b = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(rising, at(1, 1), at(1, -1))))
    thin = (size > a) & (size >= b) & (size > low)
    kept = thin & (size > high)
    while True:
        grown = thin & (dilate(kept.astype(np.uint8) * 255, 3) > 0)
        if (grown == kept).all():
            return np.where(kept, 255, 0).astype(np.uint8)
        kept = grown


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, m - 1), at - low

    y0, y1, fy = places(height, image.shape[0])
    x0, x1, fx = places(width, image.shape[1])
    image = image.astype(np.float64)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    bottom = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.rint(top * (1 - fy)[:, None] + bottom * fy[:, None]).astype(np.uint8)


def equalized(image: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalization over a grid of tiles, blended bilinearly."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    maps = np.empty((tiles, tiles, 256))
    most = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            count = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(count - most, 0).sum())
            maps[i, j] = np.cumsum(np.minimum(count, most) + over / 256) * 255 / (th * tw)

    def blend(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = blend(h, th), blend(w, tw)
    value = lambda y, x: maps[y[:, None], x[None, :], image]
    top = value(y0, x0) * (1 - fx) + value(y0, x1) * fx
    bottom = value(y1, x0) * (1 - fx) + value(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy)[:, None] + bottom * fy[:, None]), 0, 255).astype(np.uint8)


def denoised(image: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: the mean over the search window, weighted by likeness of patches."""
    half = search // 2
    image = image.astype(np.float64)
    wide = np.pad(image, half, mode="reflect" if min(image.shape) > half else "edge")
    kernel = np.full(patch, 1 / patch)
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for oy in range(search):
        for ox in range(search):
            moved = wide[oy : oy + image.shape[0], ox : ox + image.shape[1]]
            w = np.exp(-separable((moved - image) ** 2, kernel, kernel) / (strength * strength))
            total += w * moved
            weight += w
    return np.rint(total / weight).astype(np.uint8)


def text_image(image: np.ndarray) -> np.ndarray:
    """A page made ready for recognition: denoised, contrast raised, thresholded, small specks and gaps removed."""
    ready = adaptive_threshold(equalized(denoised(image), 1.5), 15, 5)
    return close(open_(ready, 2), 2)


def text_mask(image: np.ndarray) -> np.ndarray:
    return close(dilate(adaptive_threshold(image, 11, 2, inverse=True), 5, 3), 5)


def text_rois(image: np.ndarray, pad: int = 5) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) of likely text, padded within the page: outer outlines whose area is large enough."""
    h, w = image.shape
    out = []
    for x, y, bw, bh, area in outlines(text_mask(image)):
        if area >= 1e-4 * h * w:
            left, top = max(0, x - pad), max(0, y - pad)
            out.append((left, top, min(w - left, bw + 2 * pad), min(h - top, bh + 2 * pad)))
    return out


def mask_of_boxes(height: int, width: int, boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """255 inside boxes (left, top, right, bottom), ends excluded, cut to whole numbers."""
    mask = np.zeros((height, width), np.uint8)
    for left, top, right, bottom in boxes:
        mask[max(0, int(top)) : max(0, int(bottom)), max(0, int(left)) : max(0, int(right))] = 255
    return mask


def object_candidates(image: np.ndarray, mask: np.ndarray) -> list[tuple[float, int, int, int, int, float, float]]:
    """(scale, x, y, w, h, edge density, text density) of the outer outlines of edges at each scale, before any filter but size 0."""
    smooth, out = np.rint(gaussian(image, 5)).astype(np.uint8), []
    for scale in SCALES:
        size = (int(image.shape[1] * scale), int(image.shape[0] * scale))
        if not all(size):
            continue
        at, text = (smooth, mask) if scale == 1 else (resized(smooth, *size), resized(mask, *size))
        for x, y, w, h, _ in outlines(canny(at, 50, 150)):
            roi, covered = at[y : y + h, x : x + w], text[y : y + h, x : x + w]
            out.append((scale, x, y, w, h, edge_density(roi), float(np.count_nonzero(covered)) / (w * h)))
    return out


def image_blocks(image: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(left, top, right, bottom, edge density) of picture-like parts by morphology, none inside an earlier one."""
    h, w = image.shape
    ready = open_(close(adaptive_threshold(np.rint(gaussian(image, 5)), 11, 2, inverse=True), 20), 5)
    out: list[tuple[int, int, int, int, float]] = []
    for x, y, bw, bh, area in outlines(ready):
        if area < 0.001 * h * w or bw <= 50 or bh <= 50:
            continue
        edges = np.count_nonzero(canny(image[y : y + bh, x : x + bw], 50, 150)) / (bw * bh)
        text = np.count_nonzero(mask[y : y + bh, x : x + bw]) / (bw * bh)
        inside = any(x >= a and y >= b and x + bw <= c and y + bh <= d for a, b, c, d, _ in out)
        if edges > 0.05 and text < 0.8 and not inside:
            out.append((x, y, x + bw, y + bh, edges))
    return out


def segments(image: np.ndarray, votes: int = 30, least: float = 30, gap: int = 10) -> list[tuple[int, int, int, int]]:
    """Straight segments (x1, y1, x2, y2) among the edges of a thresholded page, strongest line first.

    Lines are peaks of the accumulator at whole degrees and pixels; a line's edge pixels are cut where they are further
    apart than the gap, and are used up by the segments they make. Votes are counted angle by angle, and the best peak of each angle is kept, so
    no table of all pixels and angles is made.
    """
    edges = canny(adaptive_threshold(image, 11, 2), 50, 150) > 0
    y, x = np.nonzero(edges)
    angle = np.deg2rad(np.arange(180))
    cos, sin = np.cos(angle), np.sin(angle)
    reach, out = int(np.hypot(*image.shape)) + 1, []
    place = lambda on, a: np.rint(x[on] * cos[a] + y[on] * sin[a]).astype(np.int32) + reach
    free, every = np.ones(len(x), bool), np.arange(len(x))
    table = np.stack([np.bincount(place(every, a), minlength=2 * reach + 1) for a in range(180)], axis=1).astype(np.int32) if len(x) else np.zeros((1, 180), np.int32)
    best = table.max(axis=0)
    while best.max() >= votes:
        # The strongest line, of equally strong ones that nearest to the origin's side, then by angle.
        tied = np.flatnonzero(best == best.max())
        r, a = min((int(table[:, k].argmax()), int(k)) for k in tied)
        on = np.flatnonzero(free)
        on = on[place(on, a) == r]
        along = -x[on] * sin[a] + y[on] * cos[a]
        on = on[np.argsort(along, kind="stable")]
        parts = np.split(on, np.flatnonzero(np.diff(np.sort(along)) > gap) + 1) if len(on) else []
        for part in parts:
            p, q = part[0], part[-1]
            if np.hypot(x[q] - x[p], y[q] - y[p]) >= least:
                ends = sorted([(int(x[p]), int(y[p])), (int(x[q]), int(y[q]))])
                out.append((*ends[0], *ends[1]))
        free[on] = False
        for k in range(180):
            np.subtract.at(table[:, k], place(on, k), 1)
        table[r, a] = 0
        best = table.max(axis=0)
    return out


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours at distances 1 + t, t, 1 - t, 2 - t of cubic convolution with a = -0.75."""
    a = -0.75
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """The image turned about its centre on a canvas that holds it; sampled by cubic convolution, edges continued."""
    h, w = image.shape[:2]
    cos, sin = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
    nw, nh = int(h * abs(sin) + w * abs(cos)), int(h * abs(cos) + w * abs(sin))
    u, v = np.meshgrid(np.arange(nw) - nw / 2, np.arange(nh) - nh / 2)
    x, y = cos * u - sin * v + w // 2, sin * u + cos * v + h // 2
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    across, down = _cubic(x - x0), _cubic(y - y0)
    image = image.astype(np.float64)
    value = np.zeros((nh, nw, *image.shape[2:]))
    for j in range(4):
        yj = np.clip(y0 + j - 1, 0, h - 1)
        for i in range(4):
            weight = across[i] * down[j]
            value += image[yj, np.clip(x0 + i - 1, 0, w - 1)] * (weight[..., None] if image.ndim == 3 else weight)
    return np.clip(np.rint(value), 0, 255).astype(np.uint8)


def rotated_ready(image: np.ndarray, angle: float, border: int) -> np.ndarray:
    """A page turned and made ready for recognition: contrast raised, thresholded, with a white border."""
    ready = adaptive_threshold(equalized(rotated(image, angle), 2.0), 11, 2)
    return np.pad(ready, border, constant_values=255)


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """image_id and a row for each tuple that the kernel makes of an image's grey array.

    images: image_id, height, width, channels, data (rows of BGR or grey bytes). One image is in memory at a time.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                found = kernel(grey(pixels) if row.channels >= 3 else pixels[..., 0])
                if found:
                    yield pd.DataFrame(found, columns=names).assign(image_id=row.image_id)[["image_id", *names]]

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(apply, f"image_id long, {schema}")


def rois(images: DataFrame) -> DataFrame:
    return per_image(images, text_rois, "x long, y long, w long, h long")


def line_segments(images: DataFrame) -> DataFrame:
    return per_image(images, segments, "x1 long, y1 long, x2 long, y2 long")


def recognise(images: DataFrame, provider: Callable[[], Callable[[np.ndarray], list[tuple]]], first: Callable[[np.ndarray], list[tuple]] = text_rois) -> DataFrame:
    """image_id, roi_x, roi_y, box, text, confidence: what a recogniser finds in each likely text region.

    provider makes, once for each partition, the function from a grey array to (box of points, text, confidence) tuples;
    a missing confidence counts as 0.8.
    """
    schema = "image_id long, roi_x long, roi_y long, box array<struct<x:double,y:double>>, text string, confidence double"

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for pdf in frames:
            read = read or provider()
            out = []
            for row in pdf.itertuples():
                pixels = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                page = grey(pixels) if row.channels >= 3 else pixels[..., 0]
                for x, y, w, h in first(page):
                    for box, text, *sure in read(page[y : y + h, x : x + w]):
                        points = [{"x": float(p[0]), "y": float(p[1])} for p in box]
                        out.append((row.image_id, x, y, points, text, float(sure[0]) if sure else 0.8))
            yield pd.DataFrame(out, columns=["image_id", "roi_x", "roi_y", "box", "text", "confidence"])

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(apply, schema)
