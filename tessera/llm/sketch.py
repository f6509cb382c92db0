"""Count-min sketches of 64-bit hashes: counted in tasks, merged by ranges of cells, kept as one bit a cell (does it reach a count?).

Counts only ever add up, so a hash whose every cell falls short occurs less often than that; one whose cells all reach it may do so by others' counts. A task sends its cells as gaps
and counts of a byte or so each, merged cells never meet on the driver, and workers read the bits from the shared folder. The number of cells follows the number of hashes, up to MOST_CELLS (128 MB of bits a worker):
beyond it more hashes than need be pass, which costs work later and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.words import U, mix
from tessera.llm.work import Work, lean

MOST_CELLS, LEAST_CELLS = 1 << 29, 1 << 18
#: Rows of the sketch.
DEPTH = 2
#: Cells that are merged side by side.
SHARD = 1 << 18
SCHEMA = "shard int, gaps binary, counts binary"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def width_for(hashes: int) -> int:
    """Cells of a row of the sketch for about so many hashes: whole shards."""
    return min(MOST_CELLS, max(LEAST_CELLS, -(-int(hashes) // SHARD) * SHARD))


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(hashes * U(_ODD[row])) % U(width)).astype(np.int64) + row * width


def _gaps(at: np.ndarray) -> np.ndarray:
    """Rising places as the steps between them, a byte each; 255 stands for a longer step that goes on."""
    step = np.diff(at, prepend=0)
    more = step // 255
    end = np.cumsum(more + 1) - 1
    out = np.full(int(end[-1]) + 1, 255, np.uint8)
    out[end] = step % 255
    return out


def _places(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.int64)[gaps != 255]


def partial(hashes: np.ndarray, width: int, most: int) -> pa.RecordBatch:
    """The sketch of some hashes, a row a shard; most: counts stop there (255 at most)."""
    distinct, n = np.unique(hashes, return_counts=True)
    shards, gaps, counts = [], [], []
    for row in range(DEPTH):
        at = cells(distinct, row, width)
        order = np.argsort(at)
        at, own = at[order], np.minimum(n[order], most)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        own = np.minimum(np.add.reduceat(own, first), most).astype(np.uint8) if len(at) else own
        at = at[first]
        cut = np.flatnonzero(np.diff(at // SHARD, prepend=-1)).tolist()
        for p, q in zip(cut, [*cut[1:], len(at)][: len(cut)], strict=True):
            shards.append(int(at[p] // SHARD))
            gaps.append(_gaps(at[p:q] % SHARD).tobytes())
            counts.append(own[p:q].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], ["shard", "gaps", "counts"])


def merge(partials: DataFrame, width: int, least: int, work: Work, name: str) -> tuple[str, int]:
    """Adds up partial sketches and keeps which cells reach least; what Bits opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for shard, gaps, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if shard != now:
                    if now is not None:
                        yield _bits(now, total, least)
                    now, total = shard, np.zeros(SHARD, np.uint16)
                at = _places(np.frombuffer(gaps.as_buffer(), np.uint8))
                total[at] = np.minimum(total[at] + np.frombuffer(counts.as_buffer(), np.uint8), least)
        if now is not None:
            yield _bits(now, total, least)

    parts = min(DEPTH * width // SHARD, max(1, int(work.spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    kept = work.keep(partials.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lean(run), "shard int, bits binary"), name)
    return kept.kept_path, width


def _bits(shard: int, total: np.ndarray, least: int) -> pa.RecordBatch:
    bits = np.packbits(total >= least, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits], pa.binary())], ["shard", "bits"])


_open: dict[str, np.ndarray] = {}


class Bits:
    """The merged sketch, read by a worker once."""

    def __init__(self, kept: tuple[str, int]):
        path, self.width = kept
        if path not in _open:
            _open.clear()
            _open[path] = self._read(path)
        self.bits = _open[path]

    def _read(self, path: str) -> np.ndarray:
        from pyarrow import fs as pfs
        from pyarrow import parquet as pq

        store, root = pfs.FileSystem.from_uri(path)
        out = np.zeros(DEPTH * self.width // 8, np.uint8)
        for f in store.get_file_info(pfs.FileSelector(root)):
            if f.base_name.endswith(".parquet"):
                for b in pq.ParquetFile(f.path, filesystem=store).iter_batches(64):
                    for shard, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                        out[shard * SHARD // 8 : (shard + 1) * SHARD // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
        return out

    def reach(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a hash may occur as often as asked for: never False for one that does."""
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            at = cells(hashes, row, self.width)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out
