"""Packing documents into sequences by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.tokens import encode, vocabulary_path

CAPACITY = 2048
END = 1
BATCH_DOCS = 1024
BATCH_IDS = 2_000_000
_TASK_BITS = 40


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items dealt into ``windows`` groups of near-equal sums, as lists of item numbers.

    Karmarkar-Karp: every item is a partial partition with one filled group. The two partial
    partitions of largest imbalance are merged again and again, the largest group of one with the
    smallest of the other, so that their imbalances cancel. Sums are kept relative to the smallest.
    """
    # A partial partition: its non-zero sums in descending order, and the tree of items behind each.
    heap = [(-size, i, [size], [(i, None)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, trees_a = heapq.heappop(heap)
        _, _, b, trees_b = heapq.heappop(heap)
        free = windows - len(a)
        overlap = max(0, len(b) - free)
        # The smallest sums of b find free places; its largest meet a's smallest.
        pairs = [(a[-1 - i] + b[i], (trees_a[-1 - i], trees_b[i])) for i in range(overlap)]
        pairs += list(zip(a[: len(a) - overlap], trees_a)) + list(zip(b[overlap:], trees_b[overlap:]))
        pairs.sort(key=lambda x: -x[0])
        least = pairs[-1][0] if len(pairs) == windows else 0
        sums = [x[0] - least for x in pairs]
        count += 1
        heapq.heappush(heap, (-sums[0], count, sums, [x[1] for x in pairs]))
    groups: list[list[int]] = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [tree]
        while stack:
            left, right = stack.pop()
            if right is None:
                items.append(left)
            else:
                stack += [left, right]
        groups.append(items)
    return groups


def plan_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length) that hold all items, none above ``capacity``.

    Whole windows are cut from the front of longer items. The rests are dealt by differencing
    into as many windows as their sum needs. The windows come out near-equal, not equal: the few
    ids that one has above capacity are cut off and fill windows that have room, and only if none
    is left the count rises. So a batch leaves less than one window of padding.
    """
    windows = [[(i, at, capacity)] for i, n in enumerate(sizes) for at in range(0, n - capacity + 1, capacity)]
    rests = [(i, n // capacity * capacity, n % capacity) for i, n in enumerate(sizes) if n % capacity]
    if not rests:
        return windows
    total = sum(n for _, _, n in rests)
    count = max(1, total // capacity)
    while total > count * capacity:
        count += 1
    over, room = [], []
    for group in differencing([n for _, _, n in rests], count):
        pieces = sorted((rests[g] for g in group), key=lambda x: x[2])
        excess = sum(x[2] for x in pieces) - capacity
        while excess > 0:
            item, start, n = pieces.pop()
            cut = min(n, excess)
            over.append((item, start + n - cut, cut))
            if n > cut:
                pieces.append((item, start, n - cut))
            excess -= cut
        windows.append(pieces)
        if excess < 0:
            room.append([-excess, pieces])
    while len(room) < count and sum(x[0] for x in room) < sum(x[2] for x in over):
        windows.append([])
        room.append([capacity, windows[-1]])
    room.sort(key=lambda x: x[0])
    for item, start, n in sorted(over, key=lambda x: x[2]):
        while n:
            gap, pieces = room[-1]
            take = min(gap, n)
            pieces.append((item, start, take))
            start, n = start + take, n - take
            room[-1][0] -= take
            if not room[-1][0]:
                room.pop()
    return windows


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` ids.

    Reads doc_id and text; other columns are ignored. A document is its token ids (added tokens of
    the vocabulary file by their own ids) and the end id 1; null text is the end id alone. Each task packs its rows as they come, in batches of about a
    thousand documents, so nothing is shuffled; at most one window's worth of padding is left per
    batch. Sequence ids are unique: the task's number and a running one. Returns doc_id, start,
    length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, sequence_length.
    Equal rows are packed as rows of their own; no rows give no rows. A task holds one batch of ids,
    of which the longest document is part.
    """
    path = vocabulary or vocabulary_path()
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << _TASK_BITS
        names: list[object] = []
        bodies: list[np.ndarray] = []
        kind, held = pa.int64(), 0

        def out() -> pa.RecordBatch:
            nonlocal sequence, held
            rows = []
            for window in plan_windows([len(x) for x in bodies], capacity):
                at, filled = 0, sum(n for _, _, n in window)
                for item, start, n in window:
                    body = bodies[item]
                    rows.append((names[item], start, n, body[start:start + n].tobytes(), len(body), sequence, at, filled))
                    at += n
                sequence += 1
            columns = list(zip(*rows))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names.clear()
            bodies.clear()
            held = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(values, t) for values, t in zip(columns, types)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        end = np.array([END], np.uint32)
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc_id)
                bodies.append(np.concatenate([encode(path, text.as_py(), added=True), end]))
                held += len(bodies[-1])
                if len(bodies) >= BATCH_DOCS or held >= BATCH_IDS:
                    yield out()
        if bodies:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long",
    )
