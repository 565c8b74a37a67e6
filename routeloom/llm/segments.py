"""A bounded memory of segments that were encoded before, shared by the tokenizer operators."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

from .common import expand

#: Segments and ids kept before the memory starts anew.
MAX_SEGMENTS, MAX_IDS = 800_000, 6_000_000


class SegmentEncoder(dict):
    """Encodes lists of segments; each distinct segment goes through ``encode`` once.

    ``encode`` takes a list of strings and returns a list of id lists.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], max_segments: int = MAX_SEGMENTS, max_ids: int = MAX_IDS):
        super().__init__()
        self._encode, self._most = encode, (max_segments, max_ids)
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._new: list[str] = []
        self._starts, self._ids = array("q", [0]), array("i")

    def __missing__(self, segment: str) -> int:
        self._new.append(segment)
        self[segment] = code = len(self)
        return code

    def known(self, segment: str) -> list[int] | None:
        """Ids of a segment that was encoded before."""
        code = self.get(segment)
        if code is None or code + 1 >= len(self._starts):
            return None
        return self._ids[self._starts[code] : self._starts[code + 1]].tolist()

    def ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each segment has."""
        if len(self) > self._most[0] or len(self._ids) > self._most[1]:
            self._reset()
        codes = np.fromiter(map(self.__getitem__, segments), np.int64, len(segments))
        if self._new:
            for found in self._encode(self._new):
                self._ids.extend(found)
                self._starts.append(len(self._ids))
            self._new = []
        starts = np.frombuffer(self._starts, np.int64)
        counts = starts[codes + 1] - starts[codes]
        flat = np.frombuffer(self._ids, np.int32) if len(self._ids) else np.zeros(0, np.int32)
        return flat[expand(starts[codes], counts)], counts
