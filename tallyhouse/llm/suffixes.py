"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

#: Depth in bytes from which groups of strings with a common prefix go to a blind trie, and bytes compared at a time above it.
SHALLOW, STEP = 64, 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - 1 - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() - 1) // 8


class BlindTrie:
    """A compacted trie that stores, at each branching, only its depth and the next byte of each branch.

    A search compares single bytes at the branchings and so may end at a wrong leaf, but one that shares
    the longest prefix that any leaf does; a single comparison with that leaf's string then shows where to
    branch. Ends of strings branch as -1, before every byte.
    """

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list = [None, [members[0]]]  # [None, equal strings] is a leaf, [depth, {byte: node}] a branching
        for m in members[1:]:
            self._add(m)

    def _add(self, m: int) -> None:
        s = self.strings[m]
        node, path = self.root, []
        while node[0] is not None:
            byte = s[node[0]] if node[0] < len(s) else -1
            path.append((node, byte))
            node = node[1].get(byte) or next(iter(node[1].values()))
        t = self.strings[node[1][0]]
        deep = common(s, t)
        if deep == len(s) == len(t):
            node[1].append(m)
            return
        ours, theirs = (s[deep] if deep < len(s) else -1), (t[deep] if deep < len(t) else -1)
        parent, via = None, -1
        node = self.root
        for at, byte in path:
            if at[0] >= deep:
                node = at
                break
            parent, via = at, byte
            node = at[1].get(byte) or next(iter(at[1].values()))
        if node[0] == deep:
            node[1][ours] = [None, [m]]
            return
        branch = [deep, {theirs: node, ours: [None, [m]]}]
        if parent is None:
            self.root = branch
        else:
            key = via if parent[1].get(via) is node else next(k for k, v in parent[1].items() if v is node)
            parent[1][key] = branch

    def in_order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Indices of strings in ascending order."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= SHALLOW:
            out += BlindTrie(strings, group).in_order()
        else:
            part = [strings[i][depth : depth + STEP] for i in group]
            pivot = sorted((part[0], part[len(part) // 2], part[-1]))[1]
            less = [i for i, p in zip(group, part, strict=True) if p < pivot]
            same = [i for i, p in zip(group, part, strict=True) if p == pivot]
            more = [i for i, p in zip(group, part, strict=True) if p > pivot]
            stack.append((more, depth))
            if len(pivot) < STEP:  # strings that end here are all equal
                stack += [([i], depth) for i in reversed(same)]
            else:
                stack.append((same, depth + STEP))
            stack.append((less, depth))
    return out


def neighbours(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order, and for each place in it the common prefix with the one before (0 for the first)."""
    order = deep_shallow_order(strings)
    return order, [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def widest(left: list[bytes], right: list[bytes], size: int) -> list[tuple[int, int] | None]:
    """For strings given as pairs, the reversed bytes before a point and the bytes from it on: how far before and behind it the bytes are covered by parts of size or more bytes around the point that another of the strings has too; None if there are none.

    Sorting the right parts gives the nested groups that share so many bytes behind the point; in each of
    them, neighbours in the order of the left parts share the most bytes before it.
    """
    n = len(right)
    best: list[tuple[int, int] | None] = [None] * n
    if n < 2:
        return best

    def meet(members: list[int], deep: int) -> None:
        shared = [common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        for k, x in enumerate(members):
            far = max(shared[k - 1] if k else -1, shared[k] if k < len(shared) else -1)
            if far + deep >= size:
                old = best[x] or (0, 0)
                best[x] = (max(old[0], far), max(old[1], deep))

    if n == 2:
        meet([0, 1], common(right[0], right[1]))
        return best
    order, lcp = neighbours(right)
    rank = [0] * n
    for k, i in enumerate(deep_shallow_order(left)):
        rank[i] = k
    reach = size - max(map(len, left))
    stack: list[tuple[int, int]] = []  # (depth, first place) of the groups that are open
    for place in range(1, n + 1):
        deep, first = (lcp[place] if place < n else -1), place - 1
        while stack and stack[-1][0] > deep:
            depth, first = stack.pop()
            if depth >= reach:
                meet(sorted(order[first:place], key=rank.__getitem__), depth)
        if deep >= 0 and (not stack or stack[-1][0] < deep):
            stack.append((deep, first))
    return best
