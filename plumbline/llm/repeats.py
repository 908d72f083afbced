"""Removal of passages that repeat across documents, by merging Burrows-Wheeler transforms.

The texts are cut into shards, equal texts in one shard, where the least document settles the others.
Every window of ``length`` bytes has an anchor, the least hash of the 24-byte strings inside it (shorter
ones would meet by chance more and more often as texts grow); equal windows have equal anchors, so neighbouring windows of one anchor
form a unit, and only units whose anchor stands in several documents can repeat. Those units meet in
buckets by anchor. In a bucket, the units of every shard that share a longer anchor with another unit
become a Burrows-Wheeler transform; the transforms are merged by refining their interleave one byte at
a time, and after ``length`` rounds the blocks of the interleave are the repeated intervals: all windows
of equal bytes side by side, whatever document, shard or unit they come from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import partitions
from plumbline.session import materialise_and_clear

LENGTH = 50
_GRAM = 24
_FINE_GRAM = 32
_ANCHOR_BYTES = 5
_CHUNK = 1 << 15
_SHARD_BYTES = (4 << 20, 128 << 20)
# A group of equal texts with more than one in so many of a shard's bytes or rows is shared out.
_CROWD = 4
_BUCKET_BYTES = (32 << 20, 512 << 20)
# An anchor that stands in more shards than this is replaced by much longer ones.
_HOT_SHARDS = 256
_MERGED_SHARDS = 4
_SORT_BYTES = 1 << 16
_MERGE_BYTES = 1 << 19
_NOBODY = np.iinfo(np.int64).max
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number; data must have seven bytes to spare."""
    n = len(data) - 7
    out = np.empty(max(0, n), np.uint64)
    for i in range(min(8, n)):
        part = out[i::8]
        part[:] = np.frombuffer(data[i:i + 8 * len(part)].tobytes(), "<u8")
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    return x * _M3


def _anchors(data: np.ndarray, length: int, gram: int = _GRAM) -> np.ndarray:
    """The least hash of the ``gram``-byte strings inside every window of ``length`` bytes."""
    span = length - gram + 1
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    for at in range(0, len(out), _CHUNK):
        part = data[at:at + _CHUNK + length - 1]
        words = _words(part)
        grams = len(part) - gram + 1
        least = _mix(words[gram - 8:gram - 8 + grams] ^ _M2)
        for j in range(gram - 16, -1, -8):
            least = _mix(words[j:j + grams] ^ least)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(part) - length + 1
        out[at:at + n] = np.minimum(least[:n], least[span - width:span - width + n])
    return out


@dataclass
class Units:
    """Runs of windows with one anchor: first window, number of windows, anchor, row of the document."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    row: np.ndarray

    def take(self, which: np.ndarray) -> Units:
        return Units(self.first[which], self.count[which], self.anchor[which], self.row[which])


def _gram(length: int) -> int:
    """Bytes of the strings whose least hash is a window's anchor; short windows have shorter ones."""
    return _GRAM if length >= 2 * _GRAM else 16


def _units(data: np.ndarray, starts: np.ndarray, length: int, gram: int = _GRAM) -> Units:
    """Units of texts laid end to end; ``starts`` has one more entry than there are texts.

    A unit has at most length - gram + 1 windows, as many as one place of an anchor can have.
    """
    least = _anchors(data, length, gram)
    windows = np.maximum(0, np.diff(starts) - length + 1)
    rows = np.flatnonzero(windows)
    if not len(rows):
        none = np.empty(0, np.int64)
        return Units(none, none, none.astype(np.uint64), none)
    begin, stop = starts[rows], starts[rows] + windows[rows]
    change = np.zeros(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    change[begin] = True
    change[stop] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(least))
    row = rows[np.searchsorted(begin, edges, side="right") - 1] if len(edges) else edges
    inside = (edges < starts[row] + windows[row]) & (edges >= begin[0])
    edges, ends, row = edges[inside], ends[inside], row[inside]
    most = length - gram + 1
    pieces = -(-(ends - edges) // most)
    first = np.repeat(edges, pieces) + most * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(most, np.repeat(ends, pieces) - first)
    return Units(first, count, least[first], np.repeat(row, pieces))


def _hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """A hash of every string data[first:first + size] of at least eight and at most ``longest`` bytes."""
    words = _words(data)
    out = _mix(size.astype(np.uint64))  # mixed first, as a size and a first byte could make up for each other
    for j in range(0, longest, 8):
        out = _mix(out ^ words[np.minimum(first + j, first + size - 8)])
    return out


def _distinct(anchor: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal (anchor, hash) together, and where each group starts in it."""
    order = np.lexsort((hashed, anchor))
    a, h = anchor[order], hashed[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    return order, np.flatnonzero(new)


def _lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


# --- the transform of one shard, and the merge -------------------------------------------------


def shard_transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``strings`` in order, and the Burrows-Wheeler transform that goes with it.

    Every string ends in a terminator, below all bytes; terminators are ordered by their string.
    Returns places (in the strings laid end to end with terminators) and the symbols before them:
    byte + 1, or 0 before the start of a string. Strings must be short, as suffixes are sorted whole.
    """
    data, starts = _lay([s + b"\0" for s in strings])
    shifted = data.astype(np.uint8) + np.uint8(1)  # 255 does not occur in UTF-8
    ends = starts[1:] - 1
    shifted[ends] = 0
    longest = int(np.diff(starts).max())
    padded = np.concatenate([shifted, np.zeros(longest, np.uint8)])
    left = np.repeat(ends, np.diff(starts)) - np.arange(len(data))
    table = np.lib.stride_tricks.sliding_window_view(padded, longest)[:len(data)].copy()
    table[np.arange(longest)[None, :] >= left[:, None]] = 0
    order = np.argsort(table.view(f"S{longest}").ravel(), kind="stable")
    before = np.concatenate([[0], shifted[:-1]])
    before[starts[:-1]] = 0
    return order, before[order]


def merge_transforms(transforms: list[np.ndarray], counts: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of several shards' transforms and its blocks after ``rounds`` refinements.

    ``counts`` has the number of strings of every shard. The interleave says which shard each suffix
    of the merged order comes from; it starts as the shards one after another, and a round reads
    the symbols in its order and deals them out stably by symbol, which sorts the suffixes by one more
    byte. Two neighbours fall into different blocks in the round that first tells them apart, so
    after ``rounds`` rounds a block is all suffixes that share their first ``rounds`` bytes (and
    the round is their common prefix plus one). Terminators are told apart at once. No suffix is
    compared or sorted again.
    """
    symbols = np.concatenate(transforms)
    sizes = np.array([len(t) for t in transforms])
    kind = np.uint8 if len(sizes) <= 256 else np.uint16
    shard = np.repeat(np.arange(len(sizes), dtype=kind), sizes)
    ended = int(np.sum(counts))
    terminators = np.repeat(np.arange(len(sizes), dtype=kind), counts)
    block = np.zeros(len(symbols), np.int32)
    for _ in range(rounds):
        read = np.empty(len(symbols), np.uint8)
        read[np.argsort(shard, kind="stable")] = symbols
        dealt = np.argsort(read, kind="stable")
        shard, last, read = shard[dealt], block[dealt], read[dealt]
        shard[:ended] = terminators
        new = np.ones(len(block), bool)
        new[1:] = (read[1:] != read[:-1]) | (last[1:] != last[:-1])
        new[:ended] = True
        block = np.cumsum(new, dtype=np.int32) - 1
    return shard, block


def _interval_owners(strings: list[bytes], owner: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For every window of all strings, end to end, the least owner of a string that has the window.

    ``group`` is the shard of each string, ascending.
    """
    transforms, counts, places = [], [], []
    base = 0
    position = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(strings)]]))):
        order, transform = shard_transform(strings[lo:hi])
        transforms.append(transform)
        counts.append(hi - lo)
        places.append(order + base)
        base = int(position[hi])
    shard, block = merge_transforms(transforms, counts, length)
    place = np.empty(base, np.int64)
    place[np.argsort(shard, kind="stable")] = np.concatenate(places)
    string = np.searchsorted(position, place, side="right") - 1
    least = np.minimum.reduceat(owner[string], np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])))
    per_place = np.empty(base, np.int64)
    per_place[place] = least[block]
    whole = position[string + 1] - 1 - place >= length
    keep = np.zeros(base, bool)
    keep[place[whole]] = True
    return per_place[keep]


def _alone(anchor: np.ndarray) -> np.ndarray:
    """Which of the sorted anchors stand there once."""
    out = np.ones(len(anchor), bool)
    out[1:] &= anchor[1:] != anchor[:-1]
    out[:-1] &= anchor[1:] != anchor[:-1]
    return out


def _window_owners(strings: list[bytes], owner: np.ndarray, source: np.ndarray, length: int) -> np.ndarray:
    """For every window of all strings, end to end, the least owner; ``source`` is each string's shard.

    Equal windows share the least hash of their longer grams: the strings are cut once more, into runs
    of windows with one longer anchor. Equal runs are one, with their least owner; a run whose
    anchor no other run has is settled. The rest are merged in parts by that anchor, each of about half
    a megabyte, which bounds what a task holds.
    """
    counts = np.fromiter((len(s) - length + 1 for s in strings), np.int64, len(strings))
    owners = np.repeat(owner, counts)
    if not len(strings):
        return owners
    begin = np.cumsum(counts) - counts
    data, starts = _lay(strings)
    gram = min(_FINE_GRAM, length - 8) // 8 * 8
    runs = _units(data, starts, length, gram)
    by, groups = _distinct(runs.anchor, _hashes(data, runs.first, runs.count + length - 1, 2 * length - gram))
    runs = runs.take(by)
    least = np.minimum.reduceat(owner[runs.row], groups)
    members = np.diff(np.append(groups, len(by)))
    one = runs.take(groups)
    result = np.repeat(least, one.count)
    result_at = np.cumsum(one.count) - one.count
    open_ = np.flatnonzero(~_alone(one.anchor))
    parts = int(max(1, -(-(one.count[open_] + length - 1).sum() // _MERGE_BYTES)))
    part = _bucket_of(one.anchor[open_], parts)
    raw = data.tobytes()
    for p in range(parts):
        mine = open_[part == p]
        if not len(mine):
            continue
        mine = mine[np.argsort(source[one.row[mine]], kind="stable")]
        u = one.take(mine)
        ends = u.first + u.count + length - 1
        shards = max(1, min(len(mine), max(_MERGED_SHARDS, int((ends - u.first).sum()) // _SORT_BYTES)))
        group = np.arange(len(mine)) * shards // len(mine)
        texts = [raw[s:e] for s, e in zip(u.first.tolist(), ends.tolist())]
        result[_ranges(result_at[mine], u.count)] = _interval_owners(texts, least[mine], group, length)
    place = _ranges(begin[runs.row] + runs.first - starts[runs.row], runs.count)
    owners[place] = result[_ranges(np.repeat(result_at, members), runs.count)]
    return owners


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for every pair, end to end."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


# --- the three steps that Spark deals out ----------------------------------------------------------


@dataclass
class Rows:
    """Rows of a shard in a fixed order: their places in the table, ids, which are copies, and the texts laid out."""

    order: list[int]
    ids: np.ndarray
    copies: np.ndarray
    data: np.ndarray
    starts: np.ndarray


def _rows(table: pa.Table, length: int) -> Rows:
    """Rows without an id have no text here, nor have copies: texts that a smaller id of the shard has as well.

    All windows of a copy start in a smaller document, and it owns none.
    """
    ids, texts = table["__id"].to_pylist(), table["__text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
    least: dict[bytes, int] = {}
    copies = np.zeros(len(order), bool)
    laid = []
    for place, i in enumerate(order):
        text = (texts[i] or b"") if ids[i] is not None else b""
        copies[place] = len(text) >= length and least.setdefault(text, ids[i]) < ids[i]
        laid.append(b"" if copies[place] else text)
    data, starts = _lay(laid)
    return Rows(order, np.array([_NOBODY if ids[i] is None else ids[i] for i in order], np.int64), copies, data, starts)


def _short(anchor: np.ndarray) -> bytes:
    """The lower bytes of each anchor. With the bucket, which mixes all eight, that is enough to
    keep chance meetings rare; a chance meeting costs a comparison and changes no result."""
    return np.ascontiguousarray(anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES]).tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // _ANCHOR_BYTES, 8), np.uint8)
    out[:, :_ANCHOR_BYTES] = np.frombuffer(short, np.uint8).reshape(-1, _ANCHOR_BYTES)
    return out.view("<u8").ravel()


def _bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(anchor) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _split(table_key: np.ndarray, *arrays: np.ndarray):
    """Pieces of arrays that are sorted by ``table_key``, with their key."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(table_key)) + 1, [len(table_key)]])
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            yield (int(table_key[lo]), *(a[lo:hi] for a in arrays))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _list_anchors(length: int, buckets: int):
    """Step 1, a shard: its anchors by bucket, and which of them stand in several documents."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["__shard"][0].as_py()
        rows = _rows(table, length)
        units = _units(rows.data, rows.starts, length, _gram(length))
        order = np.lexsort((rows.ids[units.row], units.anchor))
        anchor, owner = units.anchor[order], rows.ids[units.row][order]
        if not len(anchor):
            return _table([], names, types)
        at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        anchor = anchor[at]
        bucket = _bucket_of(anchor, buckets)
        by = np.argsort(bucket, kind="stable")
        return _table([(b, shard, _short(a), np.packbits(s).tobytes()) for b, a, s in _split(bucket[by], anchor[by], several[by])], names, types)

    names, types = ["bucket", "shard", "anchors", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return run


def _find_repeated(table: pa.Table, hot_shards: int) -> pa.Table:
    """Step 2, a bucket: of every shard the anchors that stand in several documents, and which are hot."""
    bucket = table["bucket"][0].as_py()
    lists = [_long(a) for a in table["anchors"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(a)).astype(bool) for s, a in zip(table["several"].to_pylist(), lists)]
    every, times = np.unique(np.concatenate(lists), return_counts=True)
    flagged = np.concatenate([a[f] for a, f in zip(lists, flags)])
    repeated = (times > 1) | np.isin(every, flagged)
    rows = []
    for shard, anchors in zip(table["shard"].to_pylist(), lists):
        at = np.searchsorted(every, anchors)
        mine = repeated[at]
        if mine.any():
            rows.append((shard, bucket, _short(anchors[mine]), np.packbits(times[at[mine]] > hot_shards).tobytes()))
    return _table(rows, ["shard", "bucket", "anchors", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _with_longer_anchors(units: Units, hot: np.ndarray, data: np.ndarray, length: int) -> Units:
    """Units of hot anchors cut again, by the least hash of grams almost as long as a window.

    Equal windows have equal anchors of either length, so they still meet, but a crowd around one
    short string is dealt out by what stands beside it; its equal windows are equal units.
    """
    if not hot.any():
        return units
    crowd, rest = units.take(hot), units.take(~hot)
    raw = data.tobytes()
    ends = crowd.first + crowd.count + length - 1
    inner, starts = _lay([raw[s:e] for s, e in zip(crowd.first.tolist(), ends.tolist())])
    cut = _units(inner, starts, length, length // 8 * 8)
    cut = Units(crowd.first[cut.row] + cut.first - starts[cut.row], cut.count, cut.anchor, crowd.row[cut.row])
    return Units(*(np.concatenate([getattr(rest, n), getattr(cut, n)]) for n in ("first", "count", "anchor", "row")))


def _listed(anchor: np.ndarray, lists: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors a shard's lists hold, and which of them are hot; compared bucket by bucket, as sent."""
    found, hot = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    bucket = _bucket_of(anchor, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, sent = bucket[order], (anchor & np.uint64((1 << 8 * _ANCHOR_BYTES) - 1))[order]
    for b, short, flags in zip(lists["bucket"].to_pylist(), lists["anchors"].to_pylist(), lists["hot"].to_pylist()):
        known = _long(short)
        by = np.argsort(known, kind="stable")
        known, crowded = known[by], np.unpackbits(np.frombuffer(flags, np.uint8), count=len(known))[by].astype(bool)
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        at = np.minimum(np.searchsorted(known, sent[lo:hi]), len(known) - 1)
        same = known[at] == sent[lo:hi]
        found[order[lo:hi]] = same
        hot[order[lo:hi]] = same & crowded[at]
    return found, hot


def _candidates(table: pa.Table, lists: pa.Table, length: int, buckets: int):
    """Units of a shard whose anchor repeats, grouped by equal strings, in a fixed order."""
    rows = _rows(table, length)
    units = _units(rows.data, rows.starts, length, _gram(length))
    found, hot = _listed(units.anchor, lists, buckets)
    units = _with_longer_anchors(units.take(found), hot[found], rows.data, length)
    hashed = _hashes(rows.data, units.first, units.count + length - 1, 2 * length - _gram(length)) if len(units.first) else units.anchor
    by, groups = _distinct(units.anchor, hashed)
    return rows, units.take(by), groups


def _send_units(length: int, buckets: int):
    """Step 3, a shard: every distinct candidate unit, with its least document, to its bucket."""

    def run(key, table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows or not lists.num_rows:
            return _table([], names, types)
        laid, units, groups = _candidates(table, lists, length, buckets)
        if not len(groups):
            return _table([], names, types)
        least = np.minimum.reduceat(laid.ids[units.row], groups)
        one = units.take(groups)
        bucket = _bucket_of(one.anchor, buckets)
        by = np.argsort(bucket, kind="stable")
        raw, pack = laid.data.tobytes(), zstandard.ZstdCompressor(level=3).compress
        rows = []
        for b, i in _split(bucket[by], by):
            first, count = one.first[i], one.count[i]
            strings = b"".join(raw[s:e] for s, e in zip(first.tolist(), (first + count + length - 1).tolist()))
            rows.append((b, key[0].as_py(), _short(one.anchor[i]), pack(least[i].tobytes()), pack(np.diff(i, prepend=0).astype(np.int32).tobytes()),
                         pack(count.astype(np.uint8).tobytes()), pack(strings)))
        return _table(rows, names, types)

    names = ["bucket", "shard", "anchors", "owners", "numbers", "counts", "strings"]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return run


def _merge_bucket(length: int):
    """Step 4, a bucket: the least document of every window, told to the shards that need to know."""

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress

        def flat(name):
            return b"".join(map(unpack, table[name].to_pylist()))

        lists = table["anchors"].to_pylist()
        anchor, count = _long(b"".join(lists)), np.frombuffer(flat("counts"), np.uint8).astype(np.int64)
        owner = np.frombuffer(flat("owners"), "<i8")
        number = np.concatenate([np.cumsum(np.frombuffer(unpack(x), "<i4")) for x in table["numbers"].to_pylist()])
        raw = flat("strings")
        data = np.frombuffer(raw, np.uint8)
        source = np.repeat(np.arange(table.num_rows), [len(x) // _ANCHOR_BYTES for x in lists])
        size = count + length - 1
        first = np.cumsum(size) - size
        by, groups = _distinct(anchor, _hashes(data, first, size, 2 * length - _gram(length)))
        which = np.empty(len(anchor), np.int64)
        which[by] = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(by))))
        least = np.minimum.reduceat(owner[by], groups)
        one = by[groups]
        # Units whose anchor no other unit has are settled; the others' windows are merged.
        alone = _alone(anchor[one])
        offset = np.full(len(one), -1, np.int64)
        meet = np.flatnonzero(~alone)
        offset[meet] = np.cumsum(count[one[meet]]) - count[one[meet]]
        owners = _window_owners(
            [raw[s:e] for s, e in zip(first[one[meet]].tolist(), (first + size)[one[meet]].tolist())],
            least[meet], source[one[meet]], length)
        # Every unit's windows: first the settled ones as one run each, then runs of equal owners.
        rows_of = np.split(np.arange(len(anchor)), np.flatnonzero(np.diff(source)) + 1)
        rows = []
        for shard, i in zip(table["shard"].to_pylist(), rows_of):
            w = which[i]
            settled = alone[w] & (least[w] < owner[i])
            parts = [(number[i][settled], np.zeros(settled.sum(), np.int64), count[i][settled], least[w][settled])]
            open_ = np.flatnonzero(~alone[w])
            if len(open_):
                n = count[i][open_]
                unit = np.repeat(open_, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found = owners[offset[w[unit]] + at]
                new = np.ones(len(unit), bool)
                new[1:] = (unit[1:] != unit[:-1]) | (found[1:] != found[:-1])
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(unit))
                use = found[s] < owner[i][unit[s]]
                s, e = s[use], e[use]
                parts.append((number[i][unit[s]], at[s], e - s, found[s]))
            numbers, firsts, counts, owned = (np.concatenate(x) for x in zip(*parts))
            if len(numbers):
                rows.append((shard, numbers.astype("<i4").tobytes(), firsts.astype(np.uint8).tobytes(),
                             counts.astype(np.uint8).tobytes(), owned.astype("<i8").tobytes()))
        return _table(rows, names, types)

    names, types = ["shard", "numbers", "firsts", "counts", "owners"], [pa.int64(), *[pa.binary()] * 4]
    return run


def _spans(length: int, ids: np.ndarray, starts: np.ndarray, units: Units, groups: np.ndarray, told: pa.Table, size: int) -> np.ndarray:
    """A byte per place: whether it is removed."""
    covered = np.zeros(size + length + 1, np.int32)
    if len(groups):
        least = np.minimum.reduceat(ids[units.row], groups)
        repeats = np.diff(np.append(groups, len(units.first)))
        group = np.repeat(np.arange(len(groups)), repeats)
        gone = least[group] < ids[units.row]
        first, stop = units.first[gone], units.first[gone] + units.count[gone] + length - 1
        np.add.at(covered, first, 1)
        np.add.at(covered, stop, -1)
        if told.num_rows:
            number, at, count, owner = (
                np.frombuffer(b"".join(told[n].to_pylist()), k) for n, k in
                (("numbers", "<i4"), ("firsts", np.uint8), ("counts", np.uint8), ("owners", "<i8")))
            # Each told run holds for all places of its unit in this shard.
            times = repeats[number]
            run = np.repeat(np.arange(len(number)), times)
            place = groups[number][run] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            gone = owner[run] < ids[units.row[place]]
            first = units.first[place[gone]] + at[run[gone]].astype(np.int64)
            np.add.at(covered, first, 1)
            np.add.at(covered, first + count[run[gone]].astype(np.int64) + length - 1, -1)
    return np.cumsum(covered)[:size] > 0


def _cut(length: int, buckets: int, schema: pa.Schema, whole_characters: bool):
    """Step 5, a shard: the rows with what is left of their bytes and the removed runs."""

    def run(key, table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        lists = table_of(told, "anchors")
        laid, units, groups = _candidates(table, lists, length, buckets)
        order, starts = laid.order, laid.starts
        removed = _spans(length, laid.ids, starts, units, groups, table_of(told, "numbers"), len(laid.data))
        texts = table["__text"].to_pylist()
        kept, spans, sizes = [None] * len(order), [None] * len(order), [0] * len(order)
        for place, i in enumerate(order):
            text = texts[i] or b""
            flags = removed[int(starts[place]):int(starts[place + 1])]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            runs = [(0, len(text))] if laid.copies[place] else [(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2])]
            if whole_characters:
                runs = _whole_characters(runs, text)
            parts, at = [], 0
            for x, y in runs:
                parts.append(text[at:x])
                at = y
            kept[i] = b"".join([*parts, text[at:]])
            spans[i] = [{"start": x, "length": y - x} for x, y in runs]
            sizes[i] = len(text)
        new = {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()),
               "spans": pa.array(spans, schema.field("spans").type)}
        return pa.table([new[n] if n in new else table[n].combine_chunks().cast(schema.field(n).type) for n in schema.names], schema=schema)

    def table_of(told: pa.Table, column: str) -> pa.Table:
        return told.filter(pc.is_valid(told[column]))

    return run


def _whole_characters(runs: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """Runs narrowed so that they start and end between characters."""
    out = []
    for s, e in runs:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """The rows of ``docs`` without the bytes that an earlier document has as well.

    A byte goes if a string of ``length`` bytes over it also starts in a document of smaller doc_id;
    all is judged on the texts as given. Reads doc_id (an integer) and text; the text column gives way
    to kept (binary, the bytes that stay), n_bytes and spans (array of start, length: the removed
    runs), other columns stay, but for any of these names. ``whole_characters`` narrows runs to whole UTF-8 characters, so
    that kept is text.

    Null and short texts stay whole. Rows of one id do not remove from each other, and a null id is
    neither smaller nor larger than any: such rows stay whole and remove nothing. No rows give
    no rows. ``length`` is 24 to 250.

    Texts go to shards by a hash, equal texts to one shard unless there are very many of them; anchors
    travel as five bytes, candidate units once. Inside a shard equal units are one with their least
    document, so a passage in a third of all documents reaches its bucket as one unit per shard and
    context. The lists of repeated anchors and the merged owners are written, and what was shuffled for
    them is deleted, so that the texts stand beside one step's exchange at a time.
    """
    if not 24 <= length <= 250:
        raise ValueError("length must be 24 to 250")
    docs = docs.drop("kept", "n_bytes", "spans")
    size = F.octet_length("text")
    sums = docs.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).first()
    total = sums["bytes"] or 0
    shards = max(1, -(-total // min(_SHARD_BYTES[1], max(_SHARD_BYTES[0], min(2 * _SHARD_BYTES[0], total // 1024), total // 4096))))
    buckets = max(partitions(docs.sparkSession), -(-total // min(_BUCKET_BYTES[1], max(_BUCKET_BYTES[0], total // 1024))))
    # At most 2 * _CROWD for each shard.
    alike = docs.where(size >= length).groupBy(F.xxhash64("text").alias("key")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    crowds = [r["key"] for r in alike.where(F.col("rows") > 1).where(
        (F.col("bytes") * shards * _CROWD > total) | (F.col("rows") * shards * _CROWD > sums["rows"])).select("key").collect()]
    others = [c for c in docs.columns if c != "text"]
    base = docs.select(
        *others, F.col("doc_id").cast("long").alias("__id"), F.encode("text", "UTF-8").alias("__text"),
        F.pmod(F.when((size >= length) & ~F.xxhash64("text").isin(crowds), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", "text")),
               F.lit(shards)).cast("long").alias("__shard"))
    hot_shards = _HOT_SHARDS

    def find(table: pa.Table) -> pa.Table:
        return _find_repeated(table, hot_shards)

    lists = materialise_and_clear(
        base.groupBy("__shard").applyInArrow(_list_anchors(length, buckets), "bucket long, shard long, anchors binary, several binary")
        .groupBy("bucket").applyInArrow(find, "shard long, bucket long, anchors binary, hot binary"), "repeats-lists")
    sent = base.groupBy("__shard").cogroup(lists.groupBy("shard")).applyInArrow(
        _send_units(length, buckets),
        "bucket long, shard long, anchors binary, owners binary, numbers binary, counts binary, strings binary")
    told = materialise_and_clear(sent.groupBy("bucket").applyInArrow(
        _merge_bucket(length), "shard long, numbers binary, firsts binary, counts binary, owners binary"), "repeats-told")
    both = lists.unionByName(told, allowMissingColumns=True)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = to_arrow_schema(T.StructType(fields))
    for name, kind in (("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", span)):
        schema = schema.append(pa.field(name, kind))
    result = T.StructType([*fields, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType(
                               [T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])
    return base.groupBy("__shard").cogroup(both.groupBy("shard")).applyInArrow(
        _cut(length, buckets, schema, whole_characters), result)
