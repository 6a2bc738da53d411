"""Plain Python versions of the hashes and sketches, as an independent check."""

import math

M64 = (1 << 64) - 1


def splitmix64(v):
    z = (v + 0x9E3779B97F4A7C15) & M64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
    return z ^ (z >> 31)


def rank(word, width):
    return width - word.bit_length() + 1


def registers(values, k, width=64, hash64=splitmix64):
    out = {}
    for v in values:
        h = hash64(v) >> (64 - width)
        idx, rest = h >> (width - k), h & ((1 << (width - k)) - 1)
        out[idx] = max(out.get(idx, 0), rank(rest, width - k))
    return out


def loglog(values, k):
    m = 1 << k
    return math.floor(0.39701 * m * 2 ** (sum(registers(values, k, 32).values()) / m))


def hyperloglog(values, k):
    m = 1 << k
    regs = registers(values, k, 32)
    alpha = {4: 0.673, 5: 0.697, 6: 0.709}.get(k, 0.7213 / (1 + 1.079 / m))
    raw = alpha * m * m / (sum(2.0**-r for r in regs.values()) + m - len(regs))
    if raw <= 2.5 * m and len(regs) < m:
        return math.floor(m * math.log(m / (m - len(regs))))
    return math.floor(raw)


def probabilistic(values, length):
    bitmap = 0
    for v in values:
        x = (splitmix64(v) >> 32) & ((1 << length) - 1)
        bitmap |= x & -x
    ones = 0
    while ones < length and bitmap >> ones & 1:
        ones += 1
    return math.floor(2**ones / 0.77351)


def sparse_list_bits(values, k):
    entries = []
    for idx, rho in registers(values, 25).items():
        payload = rho * 2 + 1 if idx & ((1 << (25 - k)) - 1) == 0 else 0
        entries.append(idx << 7 | payload)
    total, before = 0, 0
    for entry in sorted(entries):
        delta, before = entry - before, entry
        total += 8 * max(1, math.ceil(delta.bit_length() / 7))
    return len(entries), total
