"""Encoders of the block and archive formats, for tests only."""

from __future__ import annotations

import random

from quire.functions.decode import BLOCK_MAGIC
from quire.sources.archive import BLOCKS_MAGIC, DIRECTORY_MAGIC


def ops(items: list[tuple]) -> bytes:
    """Compressed bytes of ops: ('lit', byte), ('run', n, byte) and ('copy', distance, n)."""
    out, flags, held = bytearray(), [], bytearray()

    def flush() -> None:
        word = 0
        for i, f in enumerate(flags):
            word |= f << (15 - i)
        out.extend(word.to_bytes(2, "little") + held)
        flags.clear()
        held.clear()

    for item in items:
        if item[0] == "lit":
            flags.append(0)
            held.append(item[1])
        elif item[0] == "run":
            _, n, byte = item
            flags.append(1)
            held.extend([n - 3, byte] if n <= 18 else [16 | (n - 19) & 15, (n - 19) >> 4, byte])
        else:
            _, distance, n = item
            flags.append(1)
            d = distance - 3
            held.extend([n << 4 | d & 15, d >> 4] if 3 <= n <= 15 else [32 | d & 15, d >> 4, n - 16])
        if len(flags) == 16:
            flush()
    if flags:
        flush()
    return bytes(out)


def compress(data: bytes) -> bytes:
    """Greedy runs and copies; every kind of op occurs where the data have it."""
    items, i = [], 0
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i + n] == data[i] and n < 4000:
            n += 1
        if n >= 3:
            items.append(("run", n, data[i]))
            i += n
            continue
        best = (0, 0)
        for distance in range(3, min(i, 4096) + 1):
            m = 0
            while m < 271 and i + m < len(data) and data[i + m] == data[i + m - distance]:
                m += 1
            if m > best[1]:
                best = (distance, m)
        if best[1] >= 3:
            items.append(("copy", *best))
            i += best[1]
        else:
            items.append(("lit", data[i]))
            i += 1
    return ops(items)


def chunk(data: bytes) -> bytes:
    return len(data).to_bytes(2, "little") + data


def raw_chunk(data: bytes) -> bytes:
    return (65536 - len(data)).to_bytes(2, "little") + data


def block(*chunks: bytes, end: bool = True) -> bytes:
    return BLOCK_MAGIC + b"".join(chunks) + (b"\0\0" if end else b"")


def directory_archive(entries: list[tuple[bytes, bytes]], zero: frozenset[int] = frozenset()) -> bytes:
    """Entries (name, raw bytes) behind one another; those in ``zero`` get no offset."""
    names = b"".join(n for n, _ in entries)
    start = 16 + 16 * len(entries) + 1 + len(names)
    table, at, name_at = bytearray(), start, 0
    for i, (name, raw) in enumerate(entries):
        row = bytearray(16)
        row[1:4] = name_at.to_bytes(3, "little")
        row[5] = len(name)
        row[9:13] = (0 if i in zero else at).to_bytes(4, "little")
        row[13:15] = (len(raw) % 65536).to_bytes(2, "little")
        table += row
        name_at += len(name)
        at += len(raw)
    head = bytearray(16)
    head[:8] = DIRECTORY_MAGIC
    head[9:12] = len(entries).to_bytes(3, "little")
    head[13:16] = len(names).to_bytes(3, "little")
    return bytes(head) + bytes(table) + b"\0" + names + b"".join(r for _, r in entries)


def blocks_archive(payloads: list[bytes]) -> bytes:
    return BLOCKS_MAGIC + b"".join(block(raw_chunk(p)) for p in payloads)


def random_bytes(rng: random.Random, n: int) -> bytes:
    out = bytearray()
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            out += bytes([rng.randrange(256)]) * rng.choice((3, 10, 18, 19, 40, 300))
        elif kind == 1 and len(out) > 8:
            at = rng.randrange(len(out) - 3)
            out += out[at : at + rng.choice((3, 9, 15, 16, 60, 200))]
        else:
            out += bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9)))
    return bytes(out[:n])
