"""Raw images to RGB bytes, run-length depth images, and pixel statistics."""

from __future__ import annotations

import numpy as np


def rgb(data: bytes, encoding: str, height: int, width: int) -> np.ndarray:
    """(height, width, 3) of uint8. Depth in floats is stretched between its own least and greatest value."""
    if encoding in ("16UC1", "mono16"):
        grey = (np.frombuffer(data, "<u2")[: height * width].reshape(height, width) >> 8).astype(np.uint8)
        return np.repeat(grey[..., None], 3, 2)
    if encoding == "32FC1":
        v = np.frombuffer(data, "<f4")[: height * width].reshape(height, width)
        ok = np.isfinite(v)
        lo, hi = (float(v[ok].min()), float(v[ok].max())) if ok.any() else (0.0, 0.0)
        scaled = np.where(ok, (v - lo) / (hi - lo) * 255 if hi > lo else 0, 0)
        return np.repeat(scaled.astype(np.uint8)[..., None], 3, 2)
    channels = {"rgb8": 3, "bgr8": 3, "rgba8": 4, "bgra8": 4, "mono8": 1, "8UC1": 1, "8UC3": 3, "8UC4": 4}
    if encoding not in channels:
        raise ValueError(f"unknown encoding {encoding!r}")
    px = np.frombuffer(data, np.uint8)[: height * width * channels[encoding]].reshape(height, width, -1)
    if channels[encoding] == 1:
        return np.repeat(px, 3, 2)
    return px[..., [2, 1, 0]] if encoding in ("bgr8", "bgra8", "8UC3", "8UC4") else px[..., :3]


def rvl(data: bytes, count: int) -> np.ndarray:
    """Depth values of a stream of nibbles: runs of zeros, then runs of zig-zag differences."""
    nibbles = np.frombuffer(data, "<u4")
    flat = ((nibbles[:, None] >> np.arange(28, -1, -4, dtype=np.uint32)) & 15).ravel().tolist()
    out, at, last, k = [0] * count, 0, 0, 0

    def number() -> int:
        nonlocal k
        value = shift = 0
        while True:
            if k >= len(flat):
                raise ValueError("the depth stream ends early")
            n = flat[k]
            k += 1
            value |= (n & 7) << shift
            if not n & 8:
                return value
            shift += 3

    while at < count:
        zeros = number()
        at += zeros
        if at > count:
            raise ValueError("the depth stream is too long")
        for _ in range(number() if at < count else 0):
            if at >= count:
                raise ValueError("the depth stream is too long")
            v = number()
            last = (last + ((v >> 1) ^ -(v & 1))) & 0xFFFF
            out[at] = last
            at += 1
    return np.array(out, np.uint16)


def levels(image: np.ndarray, target: int = 150, limit: int = 300) -> np.ndarray:
    """Counts (channels, 256) of an image's levels, of every n-th pixel if a side is large."""
    side = max(image.shape[:2])
    step = max(1, side // target) if side >= limit else 1
    px = image[::step, ::step]
    return np.stack([np.bincount(px[..., c].ravel(), minlength=256) for c in range(px.shape[2])])
