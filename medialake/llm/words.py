"""Words of a text, and the rows of a batch laid end to end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: A run of letters, digits or underscores.
WORD = re.compile(r"\w+")
words = WORD.findall


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where each row starts when rows of these sizes are laid end to end."""
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each row's values along the first axis; 0 for rows without any."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts_of(sizes)[some], axis=0)
    return out


def stretches(texts: list[str], size: int = 4_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about `size` characters; a longer text is a list of its own."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part
