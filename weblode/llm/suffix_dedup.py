"""Removal of repeated substrings by a hash-compared suffix sort.

A byte goes if it is covered by a string of ``length`` bytes that starts anywhere else too.  Sorting every suffix of the corpus would
move each text many times over, so suffixes are met at anchors: in each window of ``length`` bytes the leftmost smallest hash of its
k-grams.  Equal windows have equal anchors at the same place, and neighbouring windows share one, so an anchor stands for a
run of windows (its context, under 2 * length bytes).

Anchors are shuffled by the hash of their k-gram.  A context met twice in whole repeats all its windows.  What is left, contexts whose
k-gram repeats but whose whole does not (the ends of repeats), is met by window where a k-gram has very many (128-bit digests of the
bytes, repeats within a task told at once, so a passage of any number of texts costs each task one row), else sorted by suffix: a merge sort compares two suffixes by the
longest common extension that binary search finds on polynomial prefix hashes, and equal neighbours are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, blocks, byte_codes, mix, powers, prefix_hash, stored, whole_text

GRAM = 50
CHUNK = 1 << 20
#: Contexts of a k-gram that one task sorts; with more, each window is dealt out by its digest, once per block of a task.
CONTEXTS = 4096
#: Windows of a block.
BLOCK = 200_000
ANCHOR = "gram long, context long, text_id long, low long, ahead int, windows int"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a block of texts: hash of the k-gram, of the context, text number, first window, anchor's distance, windows."""
    last = np.repeat(offsets[1:], np.diff(offsets))  # end of the text that holds each byte
    for start in range(0, len(data) - length + 1, chunk):
        part = data[start : start + chunk + length - 1]
        prefix = prefix_hash(byte_codes(part))
        back = powers(len(prefix))[1]
        hashes = mix((prefix[gram:] - prefix[:-gram]) * back[: len(part) - gram + 1])
        bits = np.uint64(21)
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        width, wanted = 1, length - gram + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = np.arange(len(part) - length + 1)
        at = at[at + start + length <= last[at + start]]
        if not len(at):
            continue
        anchor = (least[at] & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        low, anchor = at[first], anchor[first]
        count = np.diff(np.append(first, len(at)))
        end = low + count - 1 + length
        context = mix((prefix[end] - prefix[low]) * back[low] + (anchor - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - low).astype(np.uint64))
        text = np.searchsorted(offsets, low + start, "right") - 1
        # empty texts share an offset; the one that holds the byte is the last of them
        yield hashes[anchor], context, text, low + start - offsets[text], anchor - low, count


def third_or_later(values: np.ndarray) -> np.ndarray:
    """Whether a value has stood at least twice before in the array."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    out = np.zeros(len(values), bool)
    out[order[2:]] = ordered[2:] == ordered[:-2]
    return out


def _anchors(length: int, chunk: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # a third copy in one task adds nothing to the second
        for batch in batches:
            ids = batch.column("text_id").to_numpy()
            keep = []
            for i, x in enumerate(ids.tolist()):
                seen[x] = seen.get(x, 0) + 1
                if seen[x] <= 2:
                    keep.append(i)
            ids = ids[keep]
            data, offsets = binary_parts(batch.column("text").take(pa.array(keep, pa.int64())))
            for first, _, part, off in blocks(data, offsets):
                for gram, context, text, low, ahead, count in anchors(part, off, length, chunk=chunk):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[first + text]), pa.array(low),
                            pa.array(ahead.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(third_or_later(context)),
                        ],
                        names=[*(c.split()[0] for c in ANCHOR.split(", ")), "sure"],
                    )

    return task


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram and context: contexts met more than once (kind 0), and one row of each context of a gram that has
    several (kind 1: met once, to be sorted; kind 2: met more often, as a partner)."""
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    # rows that are sure to repeat stand first and pass through; two more of their context are among the others
    held = None  # rows of the last run of equal contexts, of which only the first two are needed, and if another context came before
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if "sure" in batch.schema.names:
            sure = batch.column("sure").to_numpy(zero_copy_only=False)
            if sure.any():
                yield _rows(cols, np.flatnonzero(sure), 0)
                cols = [c[~sure] for c in cols]
        marks = None
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols, strict=True)]
            marks = held
        n = len(cols[0])
        if not n:
            continue
        gram, context = cols[0], cols[1]
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        other_before = ~new_gram[starts]
        if marks is not None:
            other_before[0] = marks[1]
        done = np.zeros(len(starts), bool)
        if marks is not None:
            done[0] = marks[2]
        follows = np.append(~new_gram[starts[1:]], False)
        tail = starts[-1]
        # the last run may go on in the next batch: it is told when it has ended
        closed = np.ones(len(starts), bool)
        closed[-1] = False
        yield from _told(cols, starts, size, other_before, follows, closed, held)
        run = [c[tail:] for c in cols]
        twice = size[-1] >= 2
        if twice:  # rows of a repeated context can go at once; one stays to stand for the run
            fresh = np.arange(tail, n)
            if held is not None and len(starts) == 1 and held[2]:
                fresh = fresh[1:]
            yield _rows(cols, fresh, 0)
            run = [c[:1] for c in run]
        held = (run, bool(other_before[-1]), bool(twice or (held is not None and len(starts) == 1 and held[2])))
    if held is not None and held[1]:
        yield _rows(held[0], np.zeros(1, np.int64), 2 if held[2] else 1)


def _told(cols, starts, size, other_before, follows, closed, held) -> Iterator[pa.RecordBatch]:
    repeated = size >= 2
    gone = np.zeros(len(cols[0]), bool)
    if held is not None and held[2]:
        repeated[0] = True
        gone[0] = True  # stood for a run already reported
    each = np.repeat(repeated & closed, size)
    yield _rows(cols, np.flatnonzero(each & ~gone), 0)
    several = closed & (other_before | follows)
    yield _rows(cols, starts[several & ~repeated], 1)
    yield _rows(cols, starts[several & repeated], 2)


def _rows(cols, at: np.ndarray, kind: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    types = [np.int64] * 4 + [np.int32] * 2
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c[at].astype(t)) for c, t in zip(cols, types, strict=True)), pa.array(np.full(len(at), kind, np.int32))],
        names=[*names, "kind"],
    )


def _contexts(length: int):
    """Cut the contexts of a text out of it (lot 0); of a k-gram with too many, each different window of a block once (no piece;
    gram and lot are its digest) and, as runs of ``ahead`` windows dealt anywhere (kind 3), the windows that repeat in the block."""

    def windows(block: list[tuple]) -> list[tuple]:
        first: dict[bytes, int] = {}
        again = np.zeros(len(block), bool)
        for i, (digest, _, _) in enumerate(block):
            j = first.setdefault(digest, i)
            if j != i:
                again[i] = again[j] = True
        out = []
        for digest, i in first.items():
            gram, lot = np.frombuffer(digest, np.int64).tolist()
            out.append((gram, lot | 1, block[i][1], block[i][2], 1, 1, None, None))
        start = count = 0
        for i in np.flatnonzero(again).tolist():
            if count and block[i][1:] == (block[start][1], block[start][2] + count):
                count += 1
                continue
            if count:
                out.append((hash(block[start][1:]), 0, *block[start][1:], count, 3, None, None))
            start, count = i, 1
        if count:
            out.append((hash(block[start][1:]), 0, *block[start][1:], count, 3, None, None))
        return out

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "lot", "text_id", "low", "ahead", "kind", "at", "piece"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        block: list[tuple] = []
        for batch in batches:
            out = []
            for text_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text_id", "body", "wanted")), strict=True):
                if text_id in done:
                    continue
                done.add(text_id)
                for w in wanted:
                    piece = text[w["low"] : w["low"] + w["windows"] - 1 + length]
                    if w["lots"] == 1:
                        out.append((w["gram"], 0, text_id, w["low"], w["ahead"], w["kind"], np.arange(w["windows"], dtype="<i4").tobytes(), piece))
                        continue
                    block += [(hashlib.blake2b(piece[a : a + length], digest_size=16).digest(), text_id, w["low"] + a) for a in range(w["windows"])]
                    if len(block) >= BLOCK:
                        yield rows(windows(block))
                        block = []
            yield rows(out)
        yield rows(windows(block))

    return task


class Suffixes:
    """Suffixes of a byte string compared by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hash(byte_codes(data))
        self.back = powers(len(self.prefix))[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b, up to ``length``, by binary search on the prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) // 2
            same = (self.prefix[a + mid] - self.prefix[a]) * self.back[a] == (self.prefix[b + mid] - self.prefix[b]) * self.back[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        full = n == self.length
        n = np.minimum(n, self.length - 1)
        return np.where(full, or_equal, self.data[a + n] < self.data[b + n])

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order in which each segment's suffixes are sorted (segments stand together already): all merges of a level at once."""
        n = len(at)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        run = 1
        while n and run < size.max():
            place = np.arange(n)
            mine = (place - begin) // run
            own = begin + mine * run
            other = begin + (mine ^ 1) * run
            low = np.minimum(other, end)
            stop = np.minimum(other + run, end)
            high = stop.copy()
            busy = np.flatnonzero(low < high)
            while len(busy):
                mid = (low[busy] + high[busy]) // 2
                # a later run's equals come after an earlier run's
                before = self.less(at[order[mid]], at[order[busy]], (mine[busy] & 1) == 1)
                low[busy] = np.where(before, mid + 1, low[busy])
                high[busy] = np.where(before, high[busy], mid)
                busy = busy[low[busy] < high[busy]]
            to = np.minimum(own, other) + (place - own) + (low - np.minimum(other, end))
            moved = np.empty_like(order)
            moved[to] = order
            order, run = moved, run * 2
        return order


def repeated(pieces: list[bytes], ahead: list[int], windows: list[np.ndarray], group: list[int], length: int) -> list[np.ndarray]:
    """For each context which of its windows stand in another context of its group too (True by window given)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    size = np.array([len(w) for w in windows])
    owner = np.repeat(np.arange(len(pieces)), size)
    within = np.concatenate(windows) if windows else np.zeros(0, np.int64)
    at = starts[owner] + within
    # windows can only be equal if the anchor stands at the same place in them
    place = np.array(ahead)[owner] - within
    segment = np.array(group)[owner] * (2 * length) + place
    by = np.argsort(segment, kind="stable")
    suffixes = Suffixes(data, length)
    order = by[suffixes.sort(at[by], segment[by])]
    near = np.flatnonzero(segment[order[1:]] == segment[order[:-1]])
    near = near[suffixes.common(at[order[near]], at[order[near + 1]]) == length]
    equal = np.ones(len(near), bool)
    for lot in range(0, len(near), 4096):
        a, b = (at[order[near[lot : lot + 4096] + k]][:, None] + np.arange(length) for k in (0, 1))
        equal[lot : lot + 4096] = (data[a] == data[b]).all(1)
    found = np.zeros(len(at), bool)
    if equal.all():
        found[order[near]] = found[order[near + 1]] = True
    else:  # hashes collided, so the order cannot be trusted: by the bytes themselves
        keys = [(int(s), data[x : x + length].tobytes()) for s, x in zip(segment, at, strict=True)]
        times: dict[tuple, int] = {}
        for k in keys:
            times[k] = times.get(k, 0) + 1
        found = np.array([times[k] > 1 for k in keys])
    return np.split(found, np.cumsum(size)[:-1]) if len(size) else []


def _sorted_contexts(length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        met: list[tuple] = []  # spans of windows
        last = None  # key of the last window, its span until it is met again

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*met, strict=True)) or [[]] * 3], names=["text_id", "low", "high"])
            met.clear()
            return batch

        def spans(lot: list[tuple]) -> pa.RecordBatch:
            keys = {k: i for i, k in enumerate(dict.fromkeys((r[0], r[1]) for r in lot))}
            windows = [np.frombuffer(r[6], "<i4").astype(np.int64) for r in lot]
            marks = repeated([r[7] for r in lot], [r[4] for r in lot], windows, [keys[r[0], r[1]] for r in lot], length)
            ids, low, high = [], [], []
            for r, at, mark in zip(lot, windows, marks, strict=True):
                hit = at[mark]
                if r[5] != 1 or not len(hit):
                    continue
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True):
                    ids.append(r[2])
                    low.append(r[3] + a)
                    high.append(r[3] + b + length)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["text_id", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "lot", "text_id", "low", "ahead", "kind", "at", "piece")), strict=True):
                if row[7] is None:
                    span = (row[2], row[3], row[3] + row[4] - 1 + length)
                    if row[5] == 3:
                        met.append(span)
                    elif last is not None and last[0] == row[:2]:
                        met += [span] if last[1] is None else [last[1], span]
                        last = row[:2], None
                    else:
                        last = row[:2], span
                    if len(met) >= 10_000:
                        yield told()
                    continue
                if len(rows) >= 2048 and rows[-1][:2] != row[:2]:
                    yield spans(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield spans(rows)
        yield told()

    return task


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, body, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "spans")), strict=True):
                edge = np.zeros(len(body) + 1, np.int64)
                for s in spans or ():
                    edge[s["low"]] += 1
                    edge[s["high"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            names = [c.split()[0] for c in RESULT.split(", ")] + ["kept"] * keep_text
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    return task


def repeated_spans(rows: DataFrame, length: int, chunk: int = CHUNK, contexts: int = CONTEXTS) -> DataFrame:
    """Spans to remove of each text: (text_id, low, high), from rows (text_id, doc_id, body)."""
    found = rows.select("text_id", F.col("body").alias("text")).mapInArrow(_anchors(length, chunk), f"{ANCHOR}, sure boolean")
    # a very common line has rows without end: what a task knows to repeat need not meet the others of its k-gram
    place = F.when(F.col("sure"), F.xxhash64("text_id", "low")).otherwise(F.col("gram"))
    sifted = stored(
        found.repartition(place).sortWithinPartitions("sure", "gram", "context").mapInArrow(_sift, f"{ANCHOR}, kind int"), "suffix-anchors"
    )
    whole = sifted.filter("kind = 0").select("text_id", "low", (F.col("low") + F.col("windows") - 1 + length).alias("high"))
    several = sifted.filter("kind > 0")
    lots = several.groupBy("gram").agg(
        F.ceil(F.count(F.lit(1)) / contexts).cast("int").alias("lots"), F.min("kind").alias("least")
    ).filter("least = 1").drop("least")
    wanted = several.join(lots, "gram").groupBy("text_id").agg(
        F.collect_list(F.struct("gram", "low", "ahead", "windows", "kind", "lots")).alias("wanted")
    )
    pieces = rows.join(wanted, "text_id").select("text_id", "body", "wanted").mapInArrow(
        _contexts(length), "gram long, lot long, text_id long, low long, ahead int, kind int, at binary, piece binary"
    )
    ends = pieces.repartition("gram", "lot").sortWithinPartitions("gram", "lot").mapInArrow(
        _sorted_contexts(length), "text_id long, low long, high long"
    )
    return whole.unionByName(ends).distinct()


def remove_repeats(docs: DataFrame, length: int = 200, *, row_id: str = "doc_id", text: str = "text", keep_text: bool = False, **tuning: int) -> DataFrame:
    """Every row with doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes).

    Texts are UTF-8 bytes, NULL is empty; matches never cross rows.  Strings are judged on the input.  Copies of a text of at least
    ``length`` bytes remove each other wholly.  Rows are told apart by a 64-bit hash of the text, so repeated and NULL
    identifiers do no harm.  An empty table gives no rows; other columns are not read.
    """
    body = whole_text(text).cast("binary")
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_id"), body.alias("body"))
    spans = stored(repeated_spans(rows, length, **tuning), "suffix-spans")
    by_text = stored(spans.groupBy("text_id").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "suffix-lists")
    return rows.join(by_text, "text_id", "left").select("doc_id", "body", "spans").mapInArrow(
        _cut(keep_text), RESULT + ", kept binary" * keep_text
    )
