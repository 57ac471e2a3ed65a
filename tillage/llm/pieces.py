"""A cache of the ids of byte pieces, with two generations: a full young one becomes the old one."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from .texts import ragged


class PieceIds:
    """Ids of pieces, resolved in lots where the cache lacks them (a lot of pieces in, all their ids and the number of
    ids of each out); memory is bounded by the number of pieces kept."""

    def __init__(self, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.resolve, self.most = resolve, most
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.table, self.old_table = _Table(), _Table()

    def _keep(self, lot: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.young.update(zip(lot, range(len(self.young), len(self.young) + len(lot))))
        self.table.add(ids, counts)

    def encode(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that data is cut into, one after the other, and the number of ids of each. Each piece is looked up
        once, however often it is there."""
        n = len(cuts) - 1
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids, counts = self.encode_pieces(each.dictionary.to_pylist())
        piece = each.indices.to_numpy()
        return ids[ragged((np.cumsum(counts) - counts)[piece], counts[piece])], counts[piece]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that are apart already, and the number of ids of each."""
        if len(self.young) > self.most:
            self.old, self.old_table, self.young, self.table = self.young, self.table, {}, _Table()
        piece = np.array(list(map(self.young.get, pieces, repeat(-1))), np.int64)
        missing = np.flatnonzero(piece < 0)
        if missing.size:
            own = [pieces[k] for k in missing.tolist()]
            lot = list(dict.fromkeys(own))
            before = np.array([self.old.get(p, -1) for p in lot], np.int64)
            known = np.flatnonzero(before >= 0)
            if known.size:
                self._keep([lot[k] for k in known.tolist()], *self.old_table.of(before[known]))
            fresh = [lot[k] for k in np.flatnonzero(before < 0).tolist()]
            if fresh:
                self._keep(fresh, *self.resolve(fresh))
            piece[missing] = [self.young[p] for p in own]
        return self.table.of(piece)


class _Table:
    """Id lists of numbered pieces, end to end, in arrays that double."""

    def __init__(self) -> None:
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.n = self.used = 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.append(x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype))

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = self.n + len(counts), self.used + len(ids)
        self.starts, self.counts, self.ids = self._room(self.starts, n), self._room(self.counts, n), self._room(self.ids, used)
        self.starts[self.n : n] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : n] = counts
        self.ids[self.used : used] = ids
        self.n, self.used = n, used

    def of(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[piece]
        return self.ids[ragged(self.starts[piece], counts)], counts
