"""Decoded NV12 frames to model inputs (P-03 P-04 P-05): dense arithmetic over pixels, in numpy by Arrow batches.

Luma is sampled bilinearly, chroma nearest; BT.601 limited range; planes in RGB or BGR order, each (value + offset) * scale, in 32-bit floats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grey of the padding, and the conversion's factors (fixed values).
PAD = 114.0
LUMA, RED_V, GREEN_U, GREEN_V, BLUE_U = 1.164, 1.596, 0.392, 0.813, 2.017


def _sampled(data: bytes, width: int, height: int, rect, sx, sy):
    """Planes r, g, b at the grid of source places sx (columns) by sy (rows) within rect, its edges replicated."""
    import numpy as np

    f = np.float32
    left, top, w, h = rect
    plane = np.frombuffer(data, np.uint8, width * height).reshape(height, width)
    chroma = np.frombuffer(data, np.uint8, width * height // 2, width * height).reshape(height // 2, width // 2, 2)
    sx, sy = np.clip(sx, f(0), f(w - 1)), np.clip(sy, f(0), f(h - 1))
    x0, y0 = sx.astype(np.int64), sy.astype(np.int64)
    fx, fy = (sx - x0).astype(f), (sy - y0).astype(f)[:, None]
    x1, y1 = left + np.minimum(x0 + 1, w - 1), top + np.minimum(y0 + 1, h - 1)
    x0, y0 = left + x0, top + y0
    row = lambda y: plane[np.ix_(y, x0)].astype(f) * (f(1) - fx) + plane[np.ix_(y, x1)].astype(f) * fx
    luma = (row(y0) * (f(1) - fy) + row(y1) * fy - f(16)) * f(LUMA)
    uv = chroma[np.ix_(np.minimum(y0 >> 1, len(chroma) - 1), np.minimum(x0 >> 1, chroma.shape[1] - 1))].astype(f) - f(128)
    u, v = uv[..., 0], uv[..., 1]
    return [np.clip(c, f(0), f(255)) for c in (luma + f(RED_V) * v, luma - f(GREEN_U) * u - f(GREEN_V) * v, luma + f(BLUE_U) * u)]


def _planes(rgb, norm, color: str):
    import numpy as np

    offset, scale = norm
    order = rgb if color == "rgb" else rgb[::-1]
    return np.concatenate([((p + np.float32(o)) * np.float32(s)).ravel() for p, o, s in zip(order, offset, scale, strict=True)])


def letterboxed(data: bytes, width: int, height: int, rect, net_w: int, net_h: int, scale: float, pad_x: int, pad_y: int, norm, color: str = "rgb"):
    """The rect of a frame, scaled and padded to the net's size: 3 * net_h * net_w floats."""
    import numpy as np

    f = np.float32
    w, h = min(int(rect[2] * f(scale)), net_w - pad_x), min(int(rect[3] * f(scale)), net_h - pad_y)
    place = lambda n: ((np.arange(n, dtype=f) + f(0.5)) / f(scale) - f(0.5)).astype(f)
    inner = _sampled(data, width, height, rect, place(w), place(h))
    out = []
    for p in inner:
        full = np.full((net_h, net_w), PAD, f)
        full[pad_y : pad_y + h, pad_x : pad_x + w] = p
        out.append(full)
    return _planes(out, norm, color)


def cropped(data: bytes, width: int, height: int, rect, out_w: int, out_h: int, norm, color: str = "bgr"):
    """The rect of a frame, stretched to the child's size."""
    import numpy as np

    f = np.float32
    place = lambda n, size: ((np.arange(n, dtype=f) + f(0.5)) * f(size) / f(n) - f(0.5)).astype(f)
    return _planes(_sampled(data, width, height, rect, place(out_w, rect[2]), place(out_h, rect[3])), norm, color)


def _column(make, data: Column, width: Column, height: Column, rect: Column, lb: Column | None) -> Column:
    names = ("scale", "pad_x", "pad_y")
    numbers = [rect[c] for c in "xywh"] + ([lb[c] for c in names] if lb is not None else [])

    @F.arrow_udf("array<float>")
    def run(data, width, height, *numbers):
        import numpy as np
        import pyarrow as pa

        rows = zip(data.to_pylist(), width.to_pylist(), height.to_pylist(), *(n.to_pylist() for n in numbers), strict=True)
        made = [None if r[0] is None else make(r[0], r[1], r[2], r[3:7], *r[7:]) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([0 if m is None else len(m) for m in made])]).astype(np.int32)
        flat = np.concatenate([m for m in made if m is not None]) if any(m is not None for m in made) else np.empty(0, np.float32)
        nulls = np.append([m is None for m in made], False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=nulls) if nulls.any() else pa.array(offsets), pa.array(flat, pa.float32()))

    return run(data, width.cast("int"), height.cast("int"), *numbers)


def letterbox_tensor(data: Column, width: Column, height: Column, rect: Column, lb: Column, net: tuple[int, int], norm, color: str) -> Column:
    """net: (width, height). A null frame gives null."""
    return _column(lambda d, w, h, rect, scale, px, py: letterboxed(d, w, h, rect, *net, scale, px, py, norm, color), data, width, height, rect, lb)


def crop_tensor(data: Column, width: Column, height: Column, rect: Column, out: tuple[int, int], norm, color: str) -> Column:
    return _column(lambda d, w, h, rect: cropped(d, w, h, rect, *out, norm, color), data, width, height, rect, None)
