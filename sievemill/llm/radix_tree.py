"""An adaptive radix tree over byte strings whose units have a fixed width, and what is told about each unit-aligned prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

#: Sizes a node's layout grows through. The two small ones keep sorted labels, the third an index by byte, the last a slot for every byte.
LAYOUTS = (4, 16, 48, 256)


class Value(NamedTuple):
    """What is known of one key: its members, the smallest of them, and a size for each unit."""

    members: int
    least: int
    sizes: Sequence[int]


class Node:
    """Bytes that all keys below share (``prefix``), the value of the key that ends here, and children by their next byte."""

    __slots__ = ("prefix", "value", "layout", "labels", "slots")

    def __init__(self, prefix: bytes, value: Value | None = None):
        self.prefix, self.value, self.layout = prefix, value, LAYOUTS[0]
        self.labels, self.slots = bytearray(), []

    def child(self, label: int) -> Node | None:
        if self.layout == 256:
            return self.slots[label]
        if self.layout == 48:
            at = self.labels[label]
            return self.slots[at - 1] if at else None
        at = self.labels.find(label)
        return self.slots[at] if at >= 0 else None

    def put(self, label: int, node: Node) -> None:
        """Set or add a child; a full layout grows into the next one."""
        if self.layout == 256:
            self.slots[label] = node
        elif self.layout == 48:
            if self.labels[label]:
                self.slots[self.labels[label] - 1] = node
            elif len(self.slots) < 48:
                self.slots.append(node)
                self.labels[label] = len(self.slots)
            else:
                self._grow()
                self.put(label, node)
        else:
            at = self.labels.find(label)
            if at >= 0:
                self.slots[at] = node
            elif len(self.slots) < self.layout:
                at = sum(x < label for x in self.labels)
                self.labels.insert(at, label)
                self.slots.insert(at, node)
            else:
                self._grow()
                self.put(label, node)

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for k, label in enumerate(self.labels):
                index[label] = k + 1
            self.labels, self.layout = index, 48
        else:
            every: list[Node | None] = [None] * 256
            for label, node in self.children():
                every[label] = node
            self.labels, self.slots, self.layout = bytearray(), every, 256

    def children(self) -> Iterator[tuple[int, Node]]:
        """Labels and children, ascending."""
        if self.layout == 256:
            yield from ((label, node) for label, node in enumerate(self.slots) if node is not None)
        elif self.layout == 48:
            yield from ((label, self.slots[at - 1]) for label, at in enumerate(self.labels) if at)
        else:
            yield from zip(self.labels, self.slots)


def _common(a: bytes, b: bytes) -> int:
    """Length of the bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: Value) -> None:
        """Add a key that isn't there yet."""
        node, at, above, label = self.root, 0, None, 0
        while True:
            rest = key[at : at + len(node.prefix)]
            n = _common(node.prefix, rest)
            if n < len(node.prefix):  # the key leaves inside the compressed path: cut it there
                upper = Node(node.prefix[:n])
                upper.put(node.prefix[n], node)
                node.prefix = node.prefix[n + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(label, upper)
                node = upper
            at += n
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, label, node, at = node, key[at], below, at + 1


class Told(NamedTuple):
    """A unit-aligned prefix: its digest and its parent's, depth in units, size of the last unit, members and the smallest; then what lies below: children, childless prefixes (itself if it has none), and sizes times repeats, itself included. ``inner_*``: the same over those children that are not on the edge, and without itself."""

    id: bytes
    parent: bytes | None
    depth: int
    size: int
    members: int
    least: int
    children: int
    leaves: int
    saved: int
    edge: bool
    inner_children: int
    inner_leaves: int
    inner_saved: int


def prefix_ids(key: bytes, width: int) -> list[bytes]:
    """Digests of all unit-aligned prefixes of a key, from the empty one."""
    state = hashlib.sha256()
    ids = [state.digest()]
    for at in range(0, len(key), width):
        state.update(key[at : at + width])
        ids.append(state.digest())
    return ids


def told(tree: RadixTree, width: int, edge: frozenset[bytes] = frozenset()) -> Iterator[Told]:
    """Every unit-aligned prefix of the keys, children before parents; edge: digests of prefixes that other trees may hold too.

    A stack instead of recursion, as conversations may be long.
    """
    # Frames: node, bytes before it, digests of the prefixes its own bytes complete, the parent's digest, state, children left, and sums.
    start = hashlib.sha256()
    stack = [_Frame(tree.root, b"", start, None, True, 0, b"", width)]
    while stack:
        frame = stack[-1]
        below = next(frame.waiting, None)
        if below is not None:
            label, node = below
            stack.append(_Frame(node, bytes([label]), frame.state, frame.last, False, frame.end, frame.open, width))
            continue
        stack.pop()
        yield from frame.finish(edge)
        if stack:
            stack[-1].add(frame)


class _Frame:
    __slots__ = ("node", "end", "state", "open", "marks", "last", "above", "waiting", "members", "least", "sizes", "heads", "leaves", "saved", "inner")

    def __init__(self, node: Node, label: bytes, state, above: bytes | None, root: bool, begin: int, opened: bytes, width: int):
        self.node, self.above = node, above
        #: (digest, depth) of the prefixes completed on the way to the end of this node's path.
        self.marks: list[tuple[bytes, int]] = [(state.digest(), 0)] if root else []
        #: Bytes of a unit that isn't complete yet; the state holds whole units only.
        rest = opened + label + node.prefix
        whole = len(rest) - len(rest) % width
        self.state = state.copy() if whole else state
        self.end = begin + len(label) + len(node.prefix)
        depth = (begin - len(opened)) // width
        for at in range(0, whole, width):
            self.state.update(rest[at : at + width])
            depth += 1
            self.marks.append((self.state.digest(), depth))
        self.open = rest[whole:]
        self.last = self.marks[-1][0] if self.marks else above
        self.waiting = node.children()
        value = node.value
        self.members, self.least, self.sizes = value if value else (0, None, None)
        self.heads = self.leaves = self.saved = 0
        self.inner = (0, 0, 0)

    def add(self, below: _Frame) -> None:
        self.members += below.members
        self.least = below.least if self.least is None else min(self.least, below.least)
        self.sizes = self.sizes if self.sizes is not None and len(self.sizes) >= len(below.sizes) else below.sizes
        self.heads += below.heads
        self.leaves += below.leaves
        self.saved += below.saved
        self.inner = tuple(a + b for a, b in zip(self.inner, below.inner))

    def finish(self, edge: frozenset[bytes]) -> Iterator[Told]:
        """Prefixes of this node's path, from its end upwards; afterwards the sums are those of its topmost one."""
        if not self.members:
            return
        for k in reversed(range(len(self.marks))):
            digest, depth = self.marks[k]
            parent = self.marks[k - 1][0] if k else self.above
            size = self.sizes[depth - 1] if depth else 0
            children, inner = self.heads, self.inner
            self.leaves = self.leaves if children else 1
            self.saved += (self.members - 1) * size
            on_edge = digest in edge
            yield Told(digest, parent, depth, size, self.members, self.least, children, self.leaves, self.saved, on_edge, *inner)
            self.heads = 1
            self.inner = (0, 0, 0) if on_edge else (1, self.leaves, self.saved)
