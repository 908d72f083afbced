"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import string
import struct
from fractions import Fraction

import xxhash


def repeats(rows: list[tuple], length: int = 50) -> dict:
    """Per (doc_id, text): bytes, removed bytes, runs and digest of what is left."""
    owner: dict[bytes, int] = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if owner.get(w, doc_id) >= doc_id:
                owner[w] = doc_id
    out = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if doc_id is not None:
            for i in range(len(b) - length + 1):
                if owner[b[i:i + length]] < doc_id:
                    gone[i:i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id, text] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Shares of the whole size by weight, with the excess over a cap reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        whole = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / whole for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else float(most * sizes[s]) for s in order}
        stopped |= above


def mix(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source) with distinct ids."""
    sized = [(i, len(words(t)), s) for i, t, s in rows]
    sizes: dict = {}
    for _, n, s in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes), []
    for source, size in sizes.items():
        epochs = min(3, int(goal[source] // size)) if size else 0
        left = int(goal[source]) - epochs * size
        mine = [(i, n) for i, n, s in sized if s == source]
        for i, n in sorted(mine, key=lambda x: hashlib.md5(f"mix{x[0]}".encode()).hexdigest()):
            extra = max(0, min(n, left))
            left -= extra
            out.append((i, n, size, goal[source], epochs * n + extra))
    return out


def simhash(text: str | None) -> int:
    w = words("".join(c.lower() if c in string.ascii_uppercase else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value


def components(values: list[int], radius: int = 4) -> list[int]:
    """For each value the position of the first one reachable by links."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def _chain(values: list, seed: int = 42) -> int:
    """The engine's xxhash64 of several values: each hashed with the last one's result as seed."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return _signed(seed)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def order_minhash(text: str | None) -> list[int]:
    pieces = re.findall(r"[^\x20\x09-\x0D]{1,6}", text or "")
    if not pieces:
        return []
    seen: dict[int, int] = {}
    low = (1 << 24) - 1
    numbered = []
    for i in range(max(1, len(pieces) - 2)):
        kmer = _chain([*pieces[i:i + 3]] + [None] * 3)
        kmer >>= 24
        numbered.append((_signed(_chain_int32(kmer, seen.get(kmer, 0)) & ~low), i))
        seen[kmer] = seen.get(kmer, 0) + 1
    bins: dict[int, list] = {}
    for h, i in sorted(numbered):
        bins.setdefault((h & (1 << 64) - 1) >> 58, []).append((i, h >> 24))
    return [_chain([b, *[h for _, h in sorted(kept[:2])]]) for b, kept in bins.items()]


def _chain_int32(value: int, times: int) -> int:
    """xxhash64 of a long and then an int, as the engine mixes a 32-bit value."""
    seed = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
    return _signed(xxhash.xxh64_intdigest(struct.pack("<i", times), seed))
