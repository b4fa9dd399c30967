"""A keyed table that batches extend exactly once, read and compacted piece by piece.

Rows are dealt by the hash of their key into slots.  Each batch writes one piece per slot it touches, in a folder of its own, and then a
manifest: the list of all pieces that make up the table.  A batch always starts from the manifest of an earlier batch, so a
batch that is written again after a lost driver replaces its own pieces and manifest and nothing is doubled.

Pieces of one slot and level are merged when there are ``fan_in`` of them; a merged piece of more than ``piece_rows`` rows is dealt into
``fan_in`` narrower slots.  So a key lies in a few pieces of bounded size, whatever the history, and a batch reads only the
pieces of its own keys.  The manifest has a row per piece, not per batch or key.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "level int, bits int, slot bigint, piece string, rows bigint"
#: Slots that a batch may touch before it simply reads the whole table.
MANY_SLOTS = 1 << 16


@dataclass(frozen=True)
class Piece:
    level: int
    bits: int
    slot: int
    piece: str
    rows: int


@dataclass
class Snapshot:
    """The table at ``path`` with columns ``schema``, keyed by ``keys`` (a batch reads all pieces in which one of its keys may be)."""

    spark: SparkSession
    path: str
    schema: str | StructType
    keys: Sequence[str]
    bits: int = 4
    fan_bits: int = 2
    piece_rows: int = 1 << 20
    #: The manifest read last, which a batch needs twice.
    _held: tuple[int, list[Piece]] | None = field(default=None, init=False, repr=False)

    @property
    def fan_in(self) -> int:
        return 1 << self.fan_bits

    # --- what is there ---

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """Identifiers of the batches whose manifest was finished."""
        files, path = self._hadoop("_manifest")
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if files.exists(self._hadoop(f"_manifest/{n}/_SUCCESS")[1]))

    def pieces(self, before: int | None = None) -> list[Piece]:
        """Pieces of the table after the last batch, or after the last one before ``before``."""
        done = [b for b in self.batches() if before is None or b < before]
        if not done:
            return []
        if self._held is None or self._held[0] != done[-1] or before is None:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifest/batch={done[-1]}").collect()
            self._held = done[-1], [Piece(**r.asDict()) for r in rows]
        return self._held[1]

    def slot_of(self, bits: int | None = None) -> Column:
        return F.xxhash64(*self.keys).bitwiseAND(F.lit((1 << (self.bits if bits is None else bits)) - 1))

    def _rows(self, pieces: Sequence[Piece]) -> DataFrame:
        if not pieces:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p.piece}" for p in pieces])

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self.pieces(before))

    def touched(self, batch: DataFrame, pieces: Sequence[Piece]) -> list[Piece]:
        """Of ``pieces`` those in which a key of ``batch`` may be."""
        if not pieces:
            return []
        widest = max(p.bits for p in pieces)
        slots = [r[0] for r in batch.select(self.slot_of(widest)).distinct().limit(MANY_SLOTS + 1).collect()]
        if len(slots) > MANY_SLOTS:
            return list(pieces)
        own = {bits: {s & ((1 << bits) - 1) for s in slots} for bits in {p.bits for p in pieces}}
        return [p for p in pieces if p.slot in own[p.bits]]

    def known(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of earlier batches that may share a key with ``batch``."""
        return self._rows(self.touched(batch, self.pieces(batch_id)))

    # --- a batch ---

    def _write(self, rows: DataFrame, folder: str, level: int, bits: int) -> list[Piece]:
        dealt = rows.withColumn("_slot", self.slot_of(bits)).hint("rebalance", "_slot")
        dealt.write.mode("overwrite").partitionBy("_slot").parquet(f"{self.path}/{folder}")
        found = self.spark.read.parquet(f"{self.path}/{folder}") if self._has_parts(folder) else None
        counts = found.groupBy("_slot").count().collect() if found is not None else []
        return [Piece(level, bits, int(r["_slot"]), f"{folder}/_slot={r['_slot']}", r["count"]) for r in counts]

    def _has_parts(self, folder: str) -> bool:
        files, path = self._hadoop(folder)
        return any(s.isDirectory() and s.getPath().getName().startswith("_slot=") for s in files.listStatus(path))

    def commit(self, rows: DataFrame, batch_id: int, merged: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Add ``rows`` as batch ``batch_id``, in place of what that batch wrote before.

        ``merged`` may reduce the rows of pieces that are merged, for instance to the latest row of a key.
        """
        before = self.pieces(batch_id)
        folder = f"data/batch={batch_id}"
        after = before + self._write(rows, f"{folder}/new", 0, self.bits)
        groups: dict[tuple[int, int, int], list[Piece]] = defaultdict(list)
        for p in after:
            groups[p.level, p.bits, p.slot].append(p)
        jobs: dict[tuple[int, int, int], list[Piece]] = defaultdict(list)
        for (level, bits, _), own in groups.items():
            if len(own) >= self.fan_in:
                wide = sum(p.rows for p in own) > self.piece_rows
                jobs[level, bits, bits + self.fan_bits * wide] += own
        for (level, bits, to), own in jobs.items():
            rows = self._rows(own)
            written = self._write(merged(rows) if merged else rows, f"{folder}/merged-{level}-{bits}-{to}", level + 1, to)
            gone = {p.piece for p in own}
            after = [p for p in after if p.piece not in gone] + written
        manifest = self.spark.createDataFrame([(p.level, p.bits, p.slot, p.piece, p.rows) for p in after], MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/batch={batch_id}")
        self._held = None

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests before the last ``keep`` and the pieces that only those name; returns how many folders went."""
        done = self.batches()
        old, kept = done[:-keep], done[-keep:]
        used = {p.piece for b in kept for p in self.pieces(b + 1)}
        gone = Counter()
        for b in old:
            for p in self.pieces(b + 1):
                if p.piece not in used:
                    files, path = self._hadoop(p.piece)
                    gone[p.piece] += files.delete(path, True)
            files, path = self._hadoop(f"_manifest/batch={b}")
            files.delete(path, True)
        return sum(gone.values())
