"""Hierarchical navigable small-world graph over packed bit vectors, in numpy.

A graph is built in batches: nodes are ordered by falling level, then by a mixed key,
so the nodes of a layer are a prefix of the order, ids that follow the vectors do no
harm, and every layer is one flat ``(nodes, degree)`` array of neighbour positions.
All members of a batch walk the graph in lockstep, which turns the pointer chasing of
the textbook algorithm into gathers, XORs and population counts over whole arrays; a
batch is also compared with itself, since its members are not in the graph yet.  Links
are chosen for diversity: a candidate closer to a chosen neighbour than to the node
gives way to others.
"""

from __future__ import annotations

import numpy as np

NO_LINK = np.uint16(np.iinfo(np.uint16).max)


class Packing:
    """A distance, a node and a flag in one sortable number: 32 bits where the shard allows, else 64.

    The flag is 1 until the node's neighbours have been looked at.
    """

    def __init__(self, nodes: int, width: int) -> None:
        bits = max(1, int(nodes).bit_length())
        self.shift = bits + 1
        self.kind = np.int32 if int(width).bit_length() + self.shift < 31 else np.int64
        self.empty = self.kind(np.iinfo(self.kind).max)
        self.mask = self.kind((1 << self.shift) - 1)

    def keys(self, span: np.ndarray, node: np.ndarray, flag: int) -> np.ndarray:
        return span.astype(self.kind) << self.kind(self.shift) | node.astype(self.kind) << self.kind(1) | self.kind(flag)

    def node(self, keys: np.ndarray) -> np.ndarray:
        return (keys & self.mask) >> self.kind(1)

    def span(self, keys: np.ndarray) -> np.ndarray:
        return keys >> self.kind(self.shift)

    def open(self, keys: np.ndarray) -> np.ndarray:
        return (keys & 1).astype(bool) & (keys != self.empty)


def distances(rows: np.ndarray, left: np.ndarray, queries: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hamming distance of rows[left[i]] and queries[right[i]]."""
    both = rows.take(left, axis=0)
    both ^= queries.take(right, axis=0)
    counts = np.bitwise_count(both)
    words = counts.shape[1]
    if words % 4 or words > 12:
        return counts.sum(axis=1, dtype=np.int64)
    # four byte counts at a time: at most 3 * 64 per byte, so no carry
    quads = counts.view(np.uint32)
    total = quads[:, 0].copy()
    for k in range(1, words // 4):
        total += quads[:, k]
    total = (total & np.uint32(0x00FF00FF)) + ((total >> np.uint32(8)) & np.uint32(0x00FF00FF))
    return ((total & np.uint32(0xFFFF)) + (total >> np.uint32(16))).astype(np.int64)


def beam_search(rows, layer, queries, starts, width, packing):
    """Best ``width`` nodes of one layer for each query, as sorted packed keys.

    ``layer`` has the links of its nodes, free places holding the node itself; ``starts`` holds entry nodes per query, -1 where none.
    """
    count, nodes, degree = len(queries), *layer.shape
    unseen = np.ones(count * nodes, bool)
    beam = np.full((count, width), packing.empty, packing.kind)
    first = np.sort(starts, axis=1)
    fresh = first >= 0
    fresh[:, 1:] &= first[:, 1:] != first[:, :-1]
    row, col = np.nonzero(fresh)
    node = first[row, col]
    unseen[row * nodes + node] = False
    keys = np.full(first.shape, packing.empty, packing.kind)
    keys[row, col] = packing.keys(distances(rows, node, queries, row), node, 1)
    keys.sort(axis=1)
    take = min(width, keys.shape[1])
    beam[:, :take] = keys[:, :take]
    active, now, is_open = np.arange(count), beam, packing.open(beam)
    while True:
        alive = is_open.any(axis=1)
        if not alive.all():
            beam[active] = now
            active, now, is_open = active[alive], now[alive], is_open[alive]
        if not len(active):
            return beam
        own = np.arange(len(active))
        pick = is_open.argmax(axis=1)
        near = layer.take(packing.node(now[own, pick]), axis=0)
        now[own, pick] &= ~packing.kind(1)
        place = (near + (active * nodes)[:, None]).ravel()
        new = np.flatnonzero(unseen.take(place))
        unseen[place.take(new)] = False
        row, near = new // degree, near.ravel().take(new)
        key = packing.keys(distances(rows, near, queries, active.take(row)), near, 1)
        better = np.flatnonzero(key < now[:, -1].take(row))
        key, row = key.take(better), row.take(better)
        if len(key):
            slot = np.arange(len(row)) - np.searchsorted(row, own).take(row)
            wide = np.full((len(active), width + int(slot.max()) + 1), packing.empty, packing.kind)
            wide[:, :width] = now
            wide[row, width + slot] = key
            wide.sort(axis=1)
            now = np.ascontiguousarray(wide[:, :width])
        is_open = packing.open(now)


def add_back_links(links, spans, target, source, span):
    """Enter source into target's list where there is room or a longer link to drop."""
    order = np.lexsort((span, target))
    target, source, span = target[order], source[order], span[order]
    begin = np.r_[0, np.nonzero(np.diff(target))[0] + 1]
    sizes = np.diff(np.r_[begin, len(target)])
    turn = np.arange(len(target)) - np.repeat(begin, sizes)
    turn_order = np.argsort(turn, kind="stable")
    edges = np.searchsorted(turn[turn_order], np.arange(min(int(turn.max()) + 1, links.shape[1]) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        use = turn_order[a:b]
        t, s, d = target[use], source[use], span[use]
        worst = spans[t].argmax(axis=1)
        fits = d < spans[t, worst]
        t, worst = t[fits], worst[fits]
        links[t, worst] = s[fits]
        spans[t, worst] = d[fits]


def diverse(rows, node, span, there, degree):
    """Which candidates to link to, nearest first: those closer to the node than to any chosen before them, then the nearest others."""
    count, pool = node.shape
    keep = np.zeros((count, pool), bool)
    closest = np.full((count, pool), np.iinfo(np.int64).max)
    left = np.full(count, degree)
    for j in range(pool):
        keep[:, j] = there[:, j] & (closest[:, j] > span[:, j]) & (left > 0)
        left -= keep[:, j]
        row = np.nonzero(keep[:, j])[0]
        if len(row) and j + 1 < pool:
            later = node[row, j + 1 :]
            apart = distances(rows, np.repeat(node[row, j], pool - j - 1), rows, later.ravel())
            closest[row, j + 1 :] = np.minimum(closest[row, j + 1 :], apart.reshape(later.shape))
    spare = there & ~keep
    return keep | spare & (np.cumsum(spare, axis=1) <= left[:, None])


def link_layer(rows, links, spans, nodes, beam, degree, packing):
    """Link new nodes to diverse ones of their beam, and back."""
    beam = beam[:, : degree * 3 // 2]
    there = beam != packing.empty
    near, span = np.where(there, packing.node(beam), 0), packing.span(beam)
    row, col = np.nonzero(keep := diverse(rows, near, span, there, degree))
    slot = (np.cumsum(keep, axis=1) - 1)[row, col]
    near, span = near[row, col], span[row, col].astype(np.uint16)
    links[nodes[row], slot] = near
    spans[nodes[row], slot] = span
    if len(row):
        add_back_links(links, spans, near, nodes[row], span)


def mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit keys in an order that has nothing to do with their values: a function of the key alone, so a retried task builds the same graph."""
    out = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def assign_levels(keys: np.ndarray, base: int) -> np.ndarray:
    """Level of each node from its 64-bit key."""
    share = (mixed(keys) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(8, np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(base))).astype(np.int64)


def within_batch(queries, nodes, width, packing):
    """For each node of a batch the ``width`` nearest before it in the batch, as sorted packed keys."""
    size = len(nodes)
    found = np.full((size, width), packing.empty, packing.kind)
    columns = np.ascontiguousarray(queries.T)
    for a in range(0, size, 64):
        b = min(a + 64, size)
        apart = np.empty((b - a, b), np.uint16)
        for c in range(0, b, 256):  # tiles that stay in the cache
            d = min(c + 256, b)
            total = np.zeros((b - a, d - c), np.uint16)
            for k in range(0, len(columns), 3):  # at most 3 * 64 fits in a byte
                part = np.bitwise_count(columns[k, a:b, None] ^ columns[k, None, c:d])
                for word in columns[k + 1 : k + 3]:
                    part += np.bitwise_count(word[a:b, None] ^ word[None, c:d])
                total += part
            apart[:, c:d] = total
        keys = packing.keys(apart, nodes[:b], 0)
        keys[:, a:][np.triu_indices(b - a)] = packing.empty
        if b > width:
            keys = np.partition(keys, width - 1, axis=1)[:, :width]
        keys.sort(axis=1)
        found[a:b, : keys.shape[1]] = keys
    return found


def neighbours_of_neighbours(rows, left, right, span, reach, each, rounds):
    """Pairs within ``reach`` after joining every row with the ``each`` closest partners of its ``each`` closest partners, ``rounds`` times.

    Rows without a partner cost nothing.  The result holds every pair once, smaller position first.
    """
    count = np.int64(len(rows))
    low, high = np.minimum(left, right), np.maximum(left, right)
    code, first = np.unique(low * count + high, return_index=True)
    span = span[first]
    for _ in range(rounds):
        low, high = code // count, code % count
        a, b, d = np.r_[low, high], np.r_[high, low], np.r_[span, span]
        order = np.lexsort((d, a))
        a, b = a[order], b[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < each
        a, b = a[keep], b[keep]
        begin, end = np.searchsorted(a, b), np.searchsorted(a, b, side="right")
        sizes = end - begin
        start = np.repeat(a, sizes)
        goal = b[np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        fresh = np.unique((start * count + goal)[start < goal])
        fresh = fresh[~np.isin(fresh, code)]
        close = np.empty(len(fresh), np.int64)
        for k in range(0, len(fresh), 1 << 18):
            part = fresh[k : k + (1 << 18)]
            close[k : k + (1 << 18)] = distances(rows, part // count, rows, part % count)
        near = close <= reach
        if not near.any():
            break
        code, span = np.r_[code, fresh[near]], np.r_[span, close[near]]
    return code // count, code % count, span


def near_pairs(rows, keys, reach, k=5, degree=16, width=16, batch=1024, again=True, close_partners=True):
    """Pairs of rows within ``reach`` that the graph of these rows finds.

    The search that places a node yields its close predecessors; ``again`` then searches
    every node from its own place in the finished graph.  Beams hold ``width`` entries, or
    three times ``k`` if that is more.  ``close_partners`` at last compares partners of
    partners, which completes groups the walk has entered.  Returns (position, position, distance) arrays; pairs may be
    repeated.
    """
    count = len(rows)
    if count < 2:
        return (np.empty(0, np.int64),) * 3
    width = max(width, 3 * k)
    level = assign_levels(keys, degree)
    order = np.lexsort((mixed(keys), -level))
    rows, level = np.ascontiguousarray(rows[order]), level[order]
    packing = Packing(count, 64 * rows.shape[1])
    top = int(level[0])
    sizes = [int((level >= layer).sum()) for layer in range(top + 1)]
    degrees = [2 * degree] + [degree] * top
    links = [np.repeat(np.arange(n, dtype=np.int32)[:, None], d, axis=1) for n, d in zip(sizes, degrees)]
    spans = [np.full((n, d), NO_LINK, np.uint16) for n, d in zip(sizes, degrees)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def collect(nodes, beam):
        row, col = np.nonzero(packing.span(beam) <= reach)
        near = packing.node(beam[row, col]).astype(np.int64)
        other = near != nodes[row]
        found.append((nodes[row][other], near[other], packing.span(beam[row, col])[other].astype(np.int64)))

    # the scratch bitmap stays near 64 MB however large the shard is
    batch = max(16, min(batch, (1 << 26) // count))
    done = 1
    while done < count:
        size = min(batch, count - done)
        nodes = np.arange(done, done + size)
        queries = rows[nodes]
        mates = within_batch(queries, nodes, width, packing)
        starts = np.zeros((size, 1), np.int64)
        for layer in range(top, -1, -1):
            joins = level[nodes] >= layer
            beam = beam_search(rows, links[layer][: min(done, sizes[layer])], queries, starts, width if joins.any() else 4, packing)
            if layer:
                starts = np.where(beam[:, :4] == packing.empty, -1, packing.node(beam[:, :4]))
            if joins.any():
                own = mates if not layer else np.where(packing.node(mates) < sizes[layer], mates, packing.empty)
                beam = np.sort(np.concatenate([np.where(beam == packing.empty, beam, beam & ~packing.kind(1)), own], axis=1), axis=1)[:, :width]
                link_layer(rows, links[layer], spans[layer], nodes[joins], beam[joins], degree, packing)
        collect(nodes, beam)
        done += size
    for a in range(0, count if again else 0, batch):
        nodes = np.arange(a, min(count, a + batch))
        collect(nodes, beam_search(rows, links[0], rows[nodes], nodes[:, None], width, packing))
    left, right, span = (np.concatenate(x) for x in zip(*found))
    if close_partners:
        left, right, span = neighbours_of_neighbours(rows, left, right, span, reach, max(12, 2 * k), 3)
    return order[left], order[right], span
