"""Draws by md5 for many keys and replicates at once, and sums weighted by them: what tasks of the bootstrap do with their batches."""

from __future__ import annotations

import hashlib
import sys
import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle

#: Thresholds of Poisson(1): a uniform number's multiplicity is how many of them it reaches.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]

_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _md5_start(words: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """First 64 bits of the digests of one-block messages, as whole numbers; words are 16 arrays that broadcast to the shape, None is zero."""
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in first)
    t = np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        a += t
        a += _SINES[i]
        if words[_WORD[i]] is not None:
            a += words[_WORD[i]]
        np.left_shift(a, np.uint32(_TURNS[i]), out=t)
        a >>= np.uint32(32 - _TURNS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += first[0]
    b += first[1]
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def poisson_draws(keys: Sequence[str | None], replicates: int, seed: int = 42) -> np.ndarray:
    """Poisson(1) multiplicities (keys x replicates) from the md5 of 'seed-replicate-key', the replicates from 1 on; a null key has 'seed-replicate'.

    A digest's first 13 hexadecimal digits are a number in [0, 1). Messages of one block of md5 are hashed together, longer ones each on its own.
    """
    bounds = np.array([math.ceil(t * 2**52) for t in POISSON], np.uint64)
    out = np.zeros((len(keys), replicates))
    tails = [b"" if k is None else b"-" + k.encode() for k in keys]
    heads = [f"{seed}-{r}".encode() for r in range(1, replicates + 1)]
    most = max(map(len, heads), default=0)
    short = np.array([k for k, tail in enumerate(tails) if most + len(tail) <= 55], np.int64)
    for k in sorted(set(range(len(tails))) - set(short.tolist())):
        numbers = np.array([int.from_bytes(hashlib.md5(h + tails[k]).digest()[:8], "big") >> 12 for h in heads], np.uint64)
        out[k] = np.searchsorted(bounds, numbers, side="right")
    for size in sorted(set(map(len, heads))):
        these = [r for r, h in enumerate(heads) if len(h) == size]
        head = np.zeros((len(these), 64), np.uint8)
        head[:, :size] = np.frombuffer(b"".join(heads[r] for r in these), np.uint8).reshape(-1, size)
        head = head.view("<u4")
        step = max(1, 65_536 // len(these))
        for at in range(0, len(short), step):
            own = short[at : at + step]
            blocks = b"".join((bytes(size) + tails[k] + b"\x80").ljust(56, b"\0") + (8 * (size + len(tails[k]))).to_bytes(8, "little") for k in own)
            tail = np.frombuffer(blocks, "<u4").reshape(-1, 16)
            words = [x if x.any() else None for x in (tail[:, j : j + 1] | head[None, :, j] for j in range(-(-size // 4)))]
            words += [np.ascontiguousarray(tail[:, j : j + 1]) if tail[:, j].any() else None for j in range(-(-size // 4), 16)]
            numbers = _md5_start(words, (len(own), len(these))) >> np.uint64(12)
            found = np.zeros(numbers.shape)
            for bound in bounds:
                found += numbers >= bound
            out[np.ix_(own, these)] = found
    return out


def group_codes(columns: Sequence) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's group by Arrow columns, and the groups' values; null is a value."""
    codes, names = np.zeros(len(columns[0]) if columns else 0, np.int64), [()]
    for column in columns:
        d = column.dictionary_encode()
        values = [*d.dictionary.to_pylist(), None]
        code = d.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        both, codes = np.unique(codes * len(values) + code, return_inverse=True)
        names = [(*names[b // len(values)], values[b % len(values)]) for b in both.tolist()]
    return codes, names


def weighted_sums(batches: Iterator, names: Sequence[str], replicates: int, seed: int, most: int = 20_000_000) -> Iterator:
    """Batches of (key string, the named columns, v array) to (the named columns, g): for each group the sums of v by replicate, row by row,
    each row as often as its key is drawn. A key draws once for all of its rows that stand together."""
    import pyarrow as pa

    held: dict = {}
    kinds, width = [], 1

    def out():
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], names=[*names, "g"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.column(1 + i).type for i in range(len(names))]
        key = batch.column(0).dictionary_encode()
        values = [*key.dictionary.to_pylist(), None]
        which = key.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False)
        codes, groups = group_codes([batch.column(1 + i) for i in range(len(names))])
        v = batch.column(1 + len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        width = v.shape[1]
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], range(0, len(values) + 2_000, 2_000))
        for a in range(0, len(values), 2_000):  # so many keys' draws at a time
            own = order[ends[a // 2_000] : ends[a // 2_000 + 1]]
            if not len(own):
                continue
            drawn = poisson_draws(values[a : a + 2_000], replicates, seed)
            by = own[np.argsort(codes[own], kind="stable")]
            for part in np.split(by, np.flatnonzero(np.diff(codes[by])) + 1):
                group = groups[codes[part[0]]]
                held[group] = held.get(group, 0) + drawn[which[part] - a].T @ v[part]
        if len(held) * replicates * width > most:
            yield out()
            held.clear()
    if held:
        yield out()


def added_sums(batches: Iterator, names: Sequence[str], width: int, most: int = 20_000_000) -> Iterator:
    """Batches of (the named columns, g) to (the named columns, r, v): the sums of a group's g, a row for each replicate, numbered from 1 on."""
    import pyarrow as pa

    held: dict = {}
    kinds: list = []

    def out():
        for group, g in held.items():
            v = g.reshape(-1, width)
            same = [pa.array([x] * len(v), kind) for x, kind in zip(group, kinds)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(range(1, len(v) + 1), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], names=[*names, "r", "v"])

    for batch in batches:
        kinds = [batch.column(i).type for i in range(len(names))]
        for row in range(batch.num_rows):
            group = tuple(batch.column(i)[row].as_py() for i in range(len(names)))
            held[group] = held.get(group, 0) + batch.column(len(names))[row].values.to_numpy(zero_copy_only=False)
        if held and len(held) * next(iter(held.values())).size > most:
            yield from out()
            held.clear()
    yield from out()


# What tasks call travels with them: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
