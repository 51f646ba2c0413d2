"""An adaptive radix tree over byte strings: resizable node layouts and path compression.

Only what a conversation trie needs: keys arrive in ascending order, one partition at a
time, and nothing is deleted, so nodes grow and never shrink.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Layouts by the number of branches they hold: sorted keys up to 16, an index up to 48, then a slot per byte.
SORTED, INDEXED, FULL = 16, 48, 256


class Node:
    """A node, with the compressed path that leads to it from its parent's branch byte."""

    __slots__ = ("edge", "keys", "kids", "index", "value")

    def __init__(self, edge: bytes) -> None:
        self.edge = edge  # the branch byte and the compressed path after it
        self.keys: bytearray | None = bytearray()  # the sorted layouts: branch bytes, beside kids
        self.index: bytearray | None = None  # the indexed layout: slot of each byte, plus 1
        self.kids: list[Node | None] = []
        self.value = None  # what ends here

    def child(self, byte: int) -> Node | None:
        if self.keys is not None:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.index is not None:
            slot = self.index[byte]
            return self.kids[slot - 1] if slot else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add or replace a branch; a full layout is exchanged for the next larger one."""
        if self.keys is not None:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = kid
            elif len(self.keys) < SORTED:
                at = len(self.keys)
                while at and self.keys[at - 1] > byte:
                    at -= 1
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
            else:
                self.index = bytearray(FULL)
                for slot, known in enumerate(self.keys):
                    self.index[known] = slot + 1
                self.keys = None
                self.put(byte, kid)
        elif self.index is not None:
            slot = self.index[byte]
            if slot:
                self.kids[slot - 1] = kid
            elif len(self.kids) < INDEXED:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
            else:
                full: list[Node | None] = [None] * FULL
                for known, slot in enumerate(self.index):
                    if slot:
                        full[known] = self.kids[slot - 1]
                self.kids, self.index = full, None
                self.kids[byte] = kid
        else:
            self.kids[byte] = kid

    def branches(self) -> Iterator[Node]:
        """The children in the order of their branch bytes."""
        if self.index is not None:
            yield from (self.kids[slot - 1] for slot in self.index if slot)
        else:
            yield from (kid for kid in self.kids if kid is not None)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes) -> Node:
        """The node at which the key ends, made if need be."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.child(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.put(key[at], kid)
                return kid
            rest = key[at : at + len(kid.edge)]
            same = _common(kid.edge, rest)
            if same < len(kid.edge):  # split the compressed path
                upper = Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                upper.put(kid.edge[0], kid)
                node.put(key[at], upper)
                kid = upper
            node, at = kid, at + same
        return node

    def path(self, key: bytes) -> list[Node]:
        """The nodes from the root to the end of a key that is in the tree."""
        found, at = [self.root], 0
        while at < len(key):
            found.append(found[-1].child(key[at]))
            at += len(found[-1].edge)
        return found
