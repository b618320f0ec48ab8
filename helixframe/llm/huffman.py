"""Canonical length-limited Huffman codes over token ids, vectorised."""

from __future__ import annotations

import numpy as np

#: Longest code, so that a decoding table of 2**MAX_BITS entries fits a cache.
MAX_BITS = 17


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for the symbols with a count over 0, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols need codes longer than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    weights, levels = leaf, []
    for _ in range(most - 1):
        n = len(weights) // 2 * 2
        packages = weights[:n:2] + weights[1:n:2]
        merged = np.concatenate([leaf, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank)
        weights = merged[rank]
    take = 2 * (len(order) - 1)
    lengths = np.zeros(len(order), dtype=np.int64)
    for rank in reversed(levels):
        chosen = rank[:take]
        leaves = chosen[chosen < len(order)]
        lengths[leaves] += 1
        take = 2 * (len(chosen) - len(leaves))
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol, counting up."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    code, last = 0, 0
    for bits in np.unique(lengths[order]):
        code <<= int(bits) - last
        last = int(bits)
        these = order[lengths[order] == bits]
        codes[these] = code + np.arange(len(these), dtype=np.uint32)
        code += len(these)
    return codes


def decoding_table(lengths: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """For every ``most`` bits the symbol that begins there and its length: symbol << 8 | length."""
    table = np.zeros(1 << most, dtype=np.int64)
    codes = canonical_codes(lengths)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    width = np.int64(1) << (most - lengths[order].astype(np.int64))
    filled = np.repeat((order.astype(np.int64) << 8) | lengths[order], width)
    table[: len(filled)] = filled
    assert not len(order) or codes[order[0]] == 0
    return table


def _put(value: np.ndarray, n: np.ndarray, at: np.ndarray, size: int) -> bytes:
    """``size`` bytes with each code ``value`` of ``n`` bits from bit ``at`` on; places must ascend."""
    words = np.zeros(size // 4 + 3, dtype=np.uint64)
    if len(value):
        word, shift = at >> 5, at & 31
        moved = value.astype(np.uint64) << (64 - n - shift).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        packed = np.bitwise_or.reduceat(moved, first)
        words[word[first]] |= packed >> np.uint64(32)
        words[word[first] + 1] |= packed & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[:size]


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ``ids``, padded to whole bytes, and the bit offset of each id and of the end."""
    n = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    return _put(codes[ids], n, at[:-1], (int(at[-1]) + 7) // 8), at


def encode_many(parts: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray, every: int) -> list[bytes]:
    """For each part u64 bits | bit string | u64 bit offsets of every ``every``-th id but the first; packed in one go."""
    count = np.array([len(p) for p in parts])
    flat = np.concatenate(parts)
    n = lengths[flat].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    edge = np.concatenate([[0], np.cumsum(count)])
    bits = at[edge[1:]] - at[edge[:-1]]
    size = (bits + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)])
    local = at[:-1] - np.repeat(at[edge[:-1]], count)
    body = _put(codes[flat], n, local + np.repeat(8 * start[:-1], count), int(start[-1]))
    return [int(b).to_bytes(8, "little") + body[s:t] + local[e + every : f : every].astype("<u8").tobytes() for b, s, t, e, f in zip(bits.tolist(), start[:-1].tolist(), start[1:].tolist(), edge[:-1].tolist(), edge[1:].tolist())]


def decode(bits: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """All ids of several stretches of a bit string, decoded side by side: ``counts`` ids from each bit of ``starts``.

    The ids come stretch after stretch.
    """
    data = np.concatenate([bits, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), dtype=np.uint32)
    order = np.argsort(-counts, kind="stable")
    pos, left, put = starts[order].astype(np.int64), counts[order], begin[:-1][order]
    for step in range(int(counts.max()) if len(counts) else 0):
        live = int(np.searchsorted(-left, -step, "left"))
        if live < len(pos):
            pos, left, put = pos[:live], left[:live], put[:live]
        peek = (window[pos >> 3] >> (32 - most - (pos & 7)).astype(np.uint32)) & np.uint32((1 << most) - 1)
        entry = table[peek]
        out[put + step] = entry >> 8
        pos = pos + (entry & 255)
    return out
