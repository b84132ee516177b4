"""A compressed radix trie over byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def shared_length(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    return int(np.argmax(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)))


class Node:
    __slots__ = ("label", "kids", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.kids, self.owner = label, {}, owner


class RadixTrie:
    """Byte strings with an owner each; an edge carries as many bytes as its strings share."""

    def __init__(self):
        self.root, self.stored = Node(b""), 0

    def at(self, key: bytes) -> Node:
        """The terminal node of a key, made where it is missing."""
        node, place = self.root, 0
        while place < len(key):
            kid = node.kids.get(key[place])
            if kid is None:
                kid = node.kids[key[place]] = Node(key[place:])
                self.stored += len(kid.label) + 64
                return kid
            if not key.startswith(kid.label, place):
                shared = shared_length(kid.label, key[place : place + len(kid.label)])
                upper = node.kids[key[place]] = Node(kid.label[:shared])
                kid.label = kid.label[shared:]
                upper.kids[kid.label[0]] = kid
                self.stored += 64
                kid = upper
            node, place = kid, place + len(kid.label)
        return node

    def owners(self) -> Iterator:
        """Owners of all terminal nodes, subtree by subtree."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner
            stack.extend(node.kids.values())
