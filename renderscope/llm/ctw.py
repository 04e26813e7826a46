"""Context-tree weighting over bytes, on sorted arrays of counted grams.

A gram of depth D is a byte and the D bytes before it, packed into 64 bits: the
byte lowest, its nearest neighbour next, so that dropping the highest byte
gives the gram of the next shallower context. A byte is eight binary decisions,
each with a context tree of its own. The tree of a decision at context s mixes
the Krichevsky-Trofimov estimate at s with the product of its children, half
and half; after training that is, at every node, a weight w for stopping there:

    p(s, bit) = w * KT(s, bit) + (1 - w) * p(child of s, bit)

Nodes without counts predict one half.
"""

from __future__ import annotations

import numpy as np

#: Bytes before and after a text, and its end.
END = 0x0A
LN2 = float(np.log(2))


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 1/2: Stirling's series after a shift by 8."""
    shifted = np.log(x)
    for i in range(1, 8):
        shifted += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - shifted


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT block probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def canonical(text: str | None) -> tuple[bytes, list[bytes]]:
    """What is scored: the words in lower case (A-Z only), one space between, and the end byte. Also the words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words) + b"\n", words


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all bytes of canonical texts, and the number of bytes of each text."""
    pad = bytes([END]) * depth
    data = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    code = data[depth:].copy()
    for d in range(1, depth + 1):
        code |= data[depth - d : len(data) - d] << np.uint64(8 * d)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(lengths) + depth * np.arange(len(texts))
    for d in range(depth):
        keep[ends[:-1] + d] = False
    return code[keep], lengths


def low(depth: int) -> np.uint64:
    """Mask of a gram with ``depth`` bytes of context."""
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each value array summed over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes (context and bits so far) on the way to each gram's byte, and the bits taken: (8, n)."""
    step = np.arange(8, dtype=np.uint64)[:, None]
    byte = code & np.uint64(0xFF)
    prefix = (np.uint64(1) << step) | (byte >> (np.uint64(8) - step))
    return (code & ~np.uint64(0xFF)) | prefix, (byte >> (np.uint64(7) - step)) & np.uint64(1)


class Level:
    """Nodes of one depth, in order: counts of both bits, log weighted probability, weight of stopping."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        stop = kt_log(zeros, ones)
        if below is None:
            self.log, self.stop = stop, np.ones(len(nodes))
        else:
            self.log = np.logaddexp(stop, below) - LN2
            self.stop = np.exp(stop - LN2 - self.log)

    def parents(self, depth: int) -> tuple[np.ndarray, ...]:
        """Nodes one byte of context shallower: their counts, and the product of their children, in logs."""
        return summed(self.nodes & low(depth - 1), self.zeros, self.ones, self.log)

    def mixed(self, nodes: np.ndarray, bits: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bits at these nodes, given that of the next deeper context."""
        if not len(self.nodes):
            return np.full(nodes.shape, 0.5)
        at = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        zeros, ones = self.zeros[at], self.ones[at]
        p = (np.where(bits == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
        if deeper is not None:
            p = self.stop[at] * p + (1 - self.stop[at]) * deeper
        return np.where(self.nodes[at] == nodes, p, 0.5)


def deepest(code: np.ndarray, count: np.ndarray) -> Level:
    """Leaves of the trees from counted grams."""
    seen = count > 0
    nodes, bits = decisions(code[seen])
    n = np.broadcast_to(count[seen].astype(np.float64), nodes.shape)
    return Level(*summed(nodes.ravel(), np.where(bits == 0, n, 0).ravel(), np.where(bits == 1, n, 0).ravel()), None)


def trees(code: np.ndarray, count: np.ndarray, depth: int, shallowest: int) -> list[Level]:
    """Levels from ``depth`` up to ``shallowest``."""
    levels = [deepest(code, count)]
    for d in range(depth, shallowest, -1):
        levels.append(Level(*levels[-1].parents(d)))
    return levels


def predict(code: np.ndarray, levels: list[Level], depth: int, deeper: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of the eight bits of each gram, (8, n), mixed over the levels from ``depth`` upwards."""
    for i, level in enumerate(levels):
        nodes, bits = decisions(code & low(depth - i))
        deeper = level.mixed(nodes, bits, deeper)
    return deeper
