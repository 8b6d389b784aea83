"""Code-point tables shared by the text classifiers."""

from __future__ import annotations

import functools

import numpy as np

TOP = 0x110000


@functools.cache
def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    table = np.zeros(TOP, np.uint32)
    for c in range(0x20000):  # letters above are caseless ideographs
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0, dtype=np.uint32)
    return table


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (None: empty), one blank after each, and where each text starts (plus the end)."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) // 4 + 1 for r in raw], out=starts[1:])
    blank = b" \0\0\0"
    return np.frombuffer(blank.join(raw) + blank, np.uint32), starts
