"""Character n-grams of whole Arrow batches with numpy: letters of all texts as one stream, texts and words bounded by 0."""

from __future__ import annotations

from functools import cache

import numpy as np

from vecspark.llm import textscan

#: Code points.
ALL = 0x110000


@cache
def lower_letters() -> np.ndarray:
    """By code point: the lower-case letter's code point, 0 for what is no letter."""
    out = np.zeros(ALL, np.uint32)
    for i in range(ALL):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and their number before each text."""
    data, at = textscan.buffers(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    return points, before


def letter_stream(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters with single zeros for whatever lies between words or texts; it begins and ends with 0.

    Also the place in the stream of the zero before each text's first letter (of one more text at the end), and the
    number of letters of each text.
    """
    points, before = code_points(texts)
    letters = lower_letters()[points]
    is_letter = letters != 0
    total = np.concatenate([[0], np.cumsum(is_letter)])
    n = np.diff(total[before])
    marked = np.insert(letters, before[:-1], 0) if len(before) > 1 else letters  # a zero before each text
    marked = np.append(marked, np.uint32(0))
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] != 0) | (marked[:-1] != 0)
    place = np.cumsum(keep) - 1
    return marked[keep], place[before + np.arange(len(before))], n


def owners(at: np.ndarray, size: int) -> np.ndarray:
    """The text of each place of the stream."""
    out = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.concatenate([out, np.full(size - len(out), max(0, len(at) - 2))])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))
