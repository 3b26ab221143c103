"""N-gram Jaccard join: sets in one global order, candidates by prefix, verified in tries.

1. A sketch counts shingles, with counters by the size of the input's files; its levels, then the hash, order all shingles,
   rare first.  The order only decides how much work there is: any order gives the same links.
2. Texts with equal sets are one class.  Each class sends the first tokens of its ordered set
   (the prefix that any similar set must touch), with its size and their places.
3. Classes that meet in a token pass the bounds on size, place and parity bits (all of them exact:
   they never drop a link); what stays connected that way is a cluster.
4. Each cluster's whole ordered sets go into a trie.  Every set walks it, sharing partial overlaps
   of common beginnings and leaving subtrees whose remaining lengths cannot reach the threshold.
   Pairs that are connected already are not walked again.
5. Components of the links give each document the smallest id it can reach.

A group of very many similar classes is cut into blocks, and pairs of blocks are walked apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shingles import shingle_sets
from .store import dealt, file_bytes, stored
from .textblocks import blocks, mix, ragged

#: Counters of the sketch at least and at most (powers of 2), bytes of the input's files for each, counters in a row of it, and entries of a token's group before it is cut.
SKETCH, SKETCH_MOST, SKETCH_BYTES, SKETCH_ROW, GROUP = 1 << 21, 1 << 24, 256, 1 << 15, 8192
#: Bits of a bitmap of keys (a power of 2), and in a row of it.
KEY_BITS, KEY_ROW = 1 << 24, 1 << 18
#: Classes of a cluster that one task takes, and tokens of a trie's node.
CLUSTER, NODE = 2048, 64
#: Group sizes up to which bounds on pairs are tried before bitmaps are fetched.
SMALL_GROUP = 32


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Common tokens that sets of sizes a and b need."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def smallest(self, a):
        """Size of the smallest set that can be similar to one of size a."""
        return -(-self.num * a // self.den)

    def prefix(self, a):
        return a - self.smallest(a) + 1

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def packed_counts(row: np.ndarray) -> bytes:
    """A row of counters, compressed: those of one task are small numbers."""
    return zstandard.ZstdCompressor(level=1).compress(row.astype(np.uint8 if row.max() < 256 else np.uint32).tobytes())


def unpacked_counts(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_ROW else np.uint32).astype(np.uint64)


def sketch_counters(size: int) -> int:
    """Counters for an input of ``size`` bytes of files, so that one stands for about as many shingles whatever the size."""
    if size >= 1 << 60:  # not known
        return SKETCH
    return min(SKETCH_MOST, max(SKETCH, 1 << (size // SKETCH_BYTES).bit_length()))


def sketch_levels(docs: DataFrame, size: int) -> np.ndarray:
    """Levels (log2 of counts) of hashed shingles over all documents: an array of ``sketch_counters`` bytes."""
    counters = sketch_counters(file_bytes(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint32)
        for block in blocks(batches, "__text"):
            for s in shingle_sets(block, size):
                np.add.at(total, (s & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            rows = total.reshape(-1, SKETCH_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([packed_counts(r) for r in rows], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = unpacked_counts(counts.as_py())
                sums[part] = sums[part] + row if part in sums else row
        for part, row in sums.items():
            level = np.ceil(np.log2(row + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "counts"])

    parts = docs.select("__text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(counters, np.uint8)
    for r in parts.collect():  # SKETCH_MOST bytes in all at most
        out[r["part"] * SKETCH_ROW : (r["part"] + 1) * SKETCH_ROW] = np.frombuffer(r["counts"], np.uint8)
    return out


def ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The tokens of a sorted set in the global order."""
    return tokens[np.argsort(level_of(tokens, levels), kind="stable")]


def level_of(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)]


def class_of(tokens: np.ndarray) -> int:
    """A set's class: sets are equal if these are."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(tokens)))[0].astype(np.int64))


def parity_bits(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash: sets differ in as many tokens as these do in bits, at least."""
    bits = 1 << min(16, max(8, int(len(tokens)).bit_length()))
    return np.packbits(np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (the last axis) brought to ``words`` words."""
    while (n := bits.shape[-1]) > words:
        bits = bits[..., : n // 2] ^ bits[..., n // 2 :]
    return bits


class Signs:
    """Parity bits of a group's sets; two sets meet at the length of the shorter ones, whatever else is in the group."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(x) // 8 for x in raw])
        self.place, self.folded = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            of = np.flatnonzero(self.words == w)
            self.place[of] = np.arange(len(of))
            self.folded[w, w] = np.frombuffer(b"".join(raw[i] for i in of.tolist()), np.uint64).reshape(len(of), w)

    def _at(self, own: int, words: int) -> np.ndarray:
        if (own, words) not in self.folded:
            self.folded[own, words] = fold(self.folded[own, own], words)
        return self.folded[own, words]

    def differ(self, q: int, others: np.ndarray) -> np.ndarray:
        """In how many tokens set ``q`` and each of ``others`` differ, at least."""
        out, mine = np.zeros(len(others), np.int64), int(self.words[q])
        for w in np.unique(self.words[others]).tolist():
            which = self.words[others] == w
            m = min(w, mine)
            out[which] = np.bitwise_count(self._at(w, m)[self.place[others[which]]] ^ self._at(mine, m)[self.place[q]]).sum(axis=1)
        return out


def key_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``keys`` (one long column): a key without a bit there is not among them."""

    def packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = [zstandard.ZstdCompressor(level=1).compress(np.packbits(x, bitorder="little").tobytes()) for x in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(rows, pa.binary())], names=["part", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(KEY_BITS, bool)
        for batch in batches:
            seen[key_place(batch.column(0).drop_null().to_numpy())] = True
        parts = {i: x for i, x in enumerate(seen.reshape(-1, KEY_ROW)) if x.any()}
        if parts:
            yield packed(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = unpacked_bits(bits)
                parts[part] = parts[part] | row if part in parts else row
        if parts:
            yield packed(parts)

    out = np.zeros(KEY_BITS, bool)
    for r in keys.mapInArrow(mark, "part int, bits binary").repartition("part").mapInArrow(add, "part int, bits binary").collect():  # KEY_BITS bits in all at most
        out[r["part"] * KEY_ROW : (r["part"] + 1) * KEY_ROW] = unpacked_bits(r["bits"])
    return np.packbits(out, bitorder="little")


def unpacked_bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8), bitorder="little").astype(bool)


def key_place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) & np.uint64(KEY_BITS - 1)).astype(np.int64)


def among(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows of ``docs`` (``__key``, ``__text``) with a bit in ``key_bits``, and those without a key."""
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            place = key_place(batch.column(0).fill_null(0).to_numpy())
            there = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield batch.filter(pc.or_(batch.column(0).is_null(), pa.array(there.astype(bool))))

    return docs.select("__key", "__text").mapInArrow(run, "__key long, __text string")


def _rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    yield from zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)


def _col(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def meeting(t: Threshold):
    """Of the rows (token, cell, class, size, place) keep those that may be similar to another of their token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is None:
            return
        token, cell, cls, n, at = (_col(table, c) for c in ("token", "cell", "cls", "n", "at"))
        order = np.lexsort((cls, n, cell, token))
        token, cell, cls, n, at = token[order], cell[order], cls[order], n[order], at[order]
        same = np.concatenate(([False], (token[1:] == token[:-1]) & (cell[1:] == cell[:-1]) & (cls[1:] == cls[:-1])))
        token, cell, cls, n, at = (x[~same] for x in (token, cell, cls, n, at))
        start = np.concatenate(([True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])))
        group = np.cumsum(start) - 1
        count = np.bincount(group)[group]
        keep = count > SMALL_GROUP
        for k in range(1, SMALL_GROUP):
            i = np.flatnonzero((group[:-k] == group[k:]) & (count[:-k] <= SMALL_GROUP)) if k < len(group) else np.zeros(0, int)
            if not len(i):
                break
            j = i + k
            most = 1 + np.minimum(n[i] - 1 - at[i], n[j] - 1 - at[j])
            fits = (most >= t.overlap(n[i], n[j])) & (n[i] >= t.smallest(n[j]))
            keep[i[fits]] = True
            keep[j[fits]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, cell, cls, n, at)], names=["token", "cell", "cls", "n", "at"])

    return run


def candidate_edges(t: Threshold):
    """Edges that connect, within each token's group, all classes whose bounds allow similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is None:
            return
        token, cell, cls, n, at = (_col(table, c) for c in ("token", "cell", "cls", "n", "at"))
        bits = table.column("bits").to_pylist()
        order = np.lexsort((cls, n, cell, token))
        a, b = [], []
        changes = np.flatnonzero((token[order][1:] != token[order][:-1]) | (cell[order][1:] != cell[order][:-1])) + 1
        for rows in np.split(order, changes):
            if len(rows) < 2:
                continue
            signs = Signs([bits[r] for r in rows.tolist()])
            size, place, names = n[rows], at[rows], cls[rows]
            left = np.arange(len(rows))
            while len(left) > 1:  # breadth first from the first class left
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    q = queue.pop()
                    most = 1 + np.minimum(size[q] - 1 - place[q], size[left] - 1 - place[left])
                    need = t.overlap(size[q], size[left])
                    ok = (most >= need) & (np.minimum(size[q], size[left]) >= t.smallest(np.maximum(size[q], size[left])))
                    at_most = size[q] + size[left] - 2 * need  # tokens in which linked sets can differ
                    ok[ok] = signs.differ(q, left[ok]) <= at_most[ok]
                    found = left[ok]
                    a += [names[q]] * len(found)
                    b += names[found].tolist()
                    queue += found.tolist()
                    left = left[~ok]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Trie:
    """Ordered sets of token ranks, common beginnings stored once; nodes of at most NODE tokens, parents first."""

    def __init__(self, sets: list[np.ndarray]):
        rank = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in rank]
        self.rank = rank
        self.size = np.array([len(s) for s in self.sets])
        tokens: list[np.ndarray] = []
        node: list[list[int]] = []  # parent, first token, number, depth at the end, first set, end set, is a leaf
        used = 0

        def grow(parent: int, s: np.ndarray, a: int, b: int, lo: int, hi: int, leaf: int) -> int:
            nonlocal used
            while True:
                c = min(b, a + NODE)
                tokens.append(s[a:c])
                node.append([parent, used, c - a, c, lo, hi, leaf if c == b else 0])
                used += c - a
                parent = len(node) - 1
                if c == b:
                    return parent
                a = c

        work = [(-1, 0, 0, len(sets))]
        while work:
            parent, depth, lo, hi = work.pop()
            if hi - lo == 1:
                grow(parent, self.sets[lo], depth, len(self.sets[lo]), lo, hi, 1)
                continue
            first, last = self.sets[lo], self.sets[hi - 1]
            m = min(len(first), len(last))
            differ = first[depth:m] != last[depth:m]
            common = depth + (int(differ.argmax()) if differ.any() else m - depth)
            if common > depth:
                parent = grow(parent, first, depth, common, lo, hi, 0)
            i = lo
            while i < hi and len(self.sets[i]) == common:
                grow(parent, self.sets[i], common, common, i, i + 1, 1)
                i += 1
            heads = np.array([s[common] for s in self.sets[i:hi]])
            cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), hi - i] if len(heads) else []
            work += [(parent, common, i + x, i + y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.parent, self.first, self.count, self.depth, self.lo, self.hi, self.leaf = np.array(node, dtype=np.int64).reshape(-1, 7).T
        order = np.argsort(self.parent, kind="stable")
        self.child = order
        self.child_end = np.searchsorted(self.parent[order], np.arange(-1, len(node)), "right")  # of parent p at p + 1
        self.least = np.minimum.reduceat(np.append(self.size, 1 << 60), np.stack([self.lo, self.hi], 1).ravel())[::2]
        self.most = np.maximum.reduceat(np.append(self.size, 0), np.stack([self.lo, self.hi], 1).ravel())[::2]

    def walk(self, q: np.ndarray, wanted: np.ndarray, t: Threshold, mark: np.ndarray) -> np.ndarray:
        """Sets (of those ``wanted``) that are linked with the ranks ``q``; ``mark`` is scratch, False everywhere."""
        total = np.concatenate(([0], np.cumsum(wanted)))
        mark[q] = True
        found = []
        nodes = self.child[: self.child_end[0]]
        overlap = np.zeros(len(nodes), np.int64)
        smallest, n = t.smallest(len(q)), len(q)
        while len(nodes):
            ok = (total[self.hi[nodes]] > total[self.lo[nodes]]) & (self.most[nodes] >= smallest) & (t.smallest(self.least[nodes]) <= n)
            nodes, overlap = nodes[ok], overlap[ok]
            count = self.count[nodes]
            where = np.repeat(self.first[nodes] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hits = np.concatenate(([0], np.cumsum(mark[self.tokens[where]])))
            ends = np.cumsum(count)
            overlap = overlap + hits[ends] - hits[ends - count]
            last = np.where(count > 0, self.tokens[np.minimum(self.first[nodes] + np.maximum(count, 1) - 1, max(len(self.tokens) - 1, 0))] if len(self.tokens) else 0, -1)
            rest_q = n - np.searchsorted(q, last, "right")
            rest_q[last < 0] = n
            rest = np.minimum(self.most[nodes] - self.depth[nodes], rest_q)
            ok = overlap + rest >= t.overlap(np.maximum(self.least[nodes], smallest), n)
            nodes, overlap = nodes[ok], overlap[ok]
            leaf = self.leaf[nodes] == 1
            ends_here = self.lo[nodes[leaf]]
            found.append(ends_here[t.linked(overlap[leaf], n, self.size[ends_here])])
            nodes, overlap = nodes[~leaf], overlap[~leaf]
            begin, end = self.child_end[nodes], self.child_end[nodes + 1]
            overlap = np.repeat(overlap, end - begin)
            nodes = self.child[np.repeat(begin, end - begin) + ragged(end - begin)]
        mark[q] = False
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        return out[wanted[out]]


def trie_links(sets: list[np.ndarray], t: Threshold, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between ``sets`` (sorted arrays of ranks) that connect whatever their links connect.

    With ``block``, only pairs of different blocks count.
    """
    trie = Trie(sets)
    root = np.arange(len(sets))  # by the trie's order
    side = block[trie.rank] if block is not None else None
    mark = np.zeros(int(max((s[-1] for s in sets if len(s)), default=0)) + 1, bool)
    out = []
    for i, q in enumerate(trie.sets):
        wanted = root != root[i]
        if side is not None:
            wanted &= side != side[i]
        if not len(q) or not wanted.any():
            continue
        for j in trie.walk(q, wanted, t, mark).tolist():
            if root[j] != root[i]:
                out.append((trie.rank[i], trie.rank[j]))
                root[root == root[j]] = root[i]
    return out


def verified_links(t: Threshold, levels):
    """Links within clusters: rows (cluster, cell, cls, side, tokens) to edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _rows(batches)
        if table is None:
            return
        level = np.frombuffer(levels.value, np.uint8)
        cluster, cell, cls, side = (_col(table, c) for c in ("cluster", "cell", "cls", "side"))
        order = np.lexsort((cls, cell, cluster))
        changes = np.flatnonzero((cluster[order][1:] != cluster[order][:-1]) | (cell[order][1:] != cell[order][:-1])) + 1
        tokens = table.column("tokens")
        a, b = [], []
        for rows in np.split(order, changes):
            _, once = np.unique(cls[rows], return_index=True)
            rows = rows[once]
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(tokens[r].as_py(), np.uint64) for r in rows.tolist()]
            distinct, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            rank = np.empty(len(distinct), np.int64)
            rank[np.lexsort((distinct, level_of(distinct, level)))] = np.arange(len(distinct))
            ranks = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
            sides = side[rows]
            for i, j in trie_links(ranks, t, sides if len(np.unique(sides)) > 1 else None):
                a.append(int(cls[rows[i]]))
                b.append(int(cls[rows[j]]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def grouped_rows(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """One row for each of ``docs`` (``__key``, ``__text`` and strings that are carried): ``n``, its group's ``root`` and ``component_id``, null without words."""
    spark = docs.sparkSession
    t = Threshold(*threshold)
    carried = [c for c in docs.columns if c not in ("__key", "__text")]
    levels = spark.sparkContext.broadcast(sketch_levels(docs, size).tobytes())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            sets = list(shingle_sets(block, size))
            arrays = [block.column("__key"), *map(block.column, carried), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["__key", *carried, "n", "cls", "bits"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.frombuffer(levels.value, np.uint8), set()
        for block in blocks(batches, "__text"):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in shingle_sets(block, size):
                n = len(s)
                if not n or (cls := class_of(s)) in seen:
                    continue
                seen.add(cls)
                s = ordered(s, level)[: t.prefix(n)]
                # A token that may be in very many sets has cells: pairs of blocks of its classes.
                side = np.maximum(1, (1 << level_of(s, level).astype(np.int64)) // GROUP)
                own = (cls & 0x7FFFFFFFFFFFFFFF) % side
                other = ragged(side)
                own, wide = np.repeat(own, side), np.repeat(side, side)
                cell = np.minimum(own, other) * wide + np.maximum(own, other)
                for x, y in zip(out, (np.repeat(s.view(np.int64), side), cell, np.full(len(cell), cls), np.full(len(cell), n), np.repeat(np.arange(len(s)), side)), strict=True):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["token", "cell", "cls", "n", "at"])

    entry = "token long, cell long, cls long, n long, at long"
    described = stored(docs.mapInArrow(describe, ", ".join(["__key long", *(f"{c} string" for c in carried), "n long, cls long, bits binary"])))
    classes = described.filter("cls is not null").groupBy("cls").agg(F.min("__key").alias("rep"), F.first("bits").alias("bits"))
    met = dealt(docs.mapInArrow(prefixes, entry), "token", "cell", source=docs, times=2.0).mapInArrow(meeting(t), entry)
    edges = dealt(met.join(classes.select("cls", "bits"), "cls"), "token", "cell", source=docs).mapInArrow(candidate_edges(t), "a long, b long")
    clusters = components(edges)
    roots = clusters.groupBy("root").agg((F.count("*") + 1).alias("size"))
    members = clusters.unionByName(roots.select(F.col("root").alias("node"), "root")).join(roots, "root").select(F.col("node").alias("cls"), F.col("root").alias("cluster"), "size")
    # One text for each class: that of its smallest key (or all of its texts without a key).
    wanted = stored(members.join(classes.select("cls", "rep"), "cls"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            sets = list(shingle_sets(block, size))
            arrays = [pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), *(block.column(c) for c in ("cls", "cluster", "cell", "side")), pa.array([s.tobytes() for s in sets], pa.binary())]
            same = pa.array([a is not None and a == b for a, b in zip(arrays[0].to_pylist(), arrays[1].to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([x.filter(same) for x in arrays[1:]], names=["cls", "cluster", "cell", "side", "tokens"])

    side = F.ceil(F.col("size") / CLUSTER)
    own = F.pmod(F.col("cls"), side)
    cells = wanted.withColumn("sides", side).withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    cells = cells.select("cls", "rep", "cluster", "side", (F.least("side", "other") * F.col("sides") + F.greatest("side", "other")).alias("cell"))
    some = among(docs, key_bits(wanted.select("rep")))  # the other texts are not shuffled
    texts = some.join(cells, some["__key"].eqNullSafe(cells["rep"])).select("__text", "cls", "cluster", "cell", "side")
    whole = texts.mapInArrow(sets_of, "cls long, cluster long, cell long, side long, tokens binary")
    links = dealt(whole, "cluster", "cell", source=docs).mapInArrow(verified_links(t, levels), "a long, b long")
    linked = components(links)
    # The group of a class: its root; the id of a group: its smallest key.
    grouped = classes.select("cls", "rep").join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = grouped.join(ids, "root").select("cls", "root", "component_id")
    return described.filter("cls is not null").join(by_class, "cls").select("__key", *carried, "n", "root", "component_id").unionByName(
        described.filter("cls is null").select("__key", *carried, "n", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("component_id"))
    )


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles reach the Jaccard ``threshold`` (a fraction), by links.

    Returns one row per document: the key, ``n_shingles`` (long) and ``component_id``, the
    smallest key that links reach, itself included.  All links count; a document without words has
    an empty set and is linked with nothing; null texts are empty.  Rows with equal texts are linked, and
    repeated rows give repeated rows.  A null key stays null and its document counts as a link but is never a
    group's id.  Other columns are ignored.  An empty table gives no rows.
    """
    docs = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    found = grouped_rows(docs, size, threshold)
    return found.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("__key").isNotNull(), F.coalesce("component_id", "__key")).alias("component_id"))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group (see ``near_duplicates``) one row stays, as it is.

    It is that of the smallest key (null keys last; of rows with one key, that of the smallest checksum of the text).
    Rows are told apart by key and text, so another text under the key of one that goes stays; of rows equal in both
    one stays.  Rows without words are linked with nothing: all of them stay, but of equal ones (key and text, a null
    text being no empty one) one does.  Extra columns stay as they are; an empty table gives no rows.
    """
    name = F.concat(F.col(text).isNull().cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    own = [f"__n{i}" for i in range(len(df.columns))]  # names that clash with nothing
    renamed = df.toDF(*own)
    k, t = own[df.columns.index(key)], own[df.columns.index(text)]
    docs = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"), name.alias("__name"))
    grouped = stored(grouped_rows(docs, size, threshold))
    # One row of each group, by key and text, has no other before it.
    first = grouped.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("__key").isNull().alias("no_key"), "__key", "__name")).alias("f"))
    kept = first.select("f.*").select("__key", "__name").unionByName(grouped.filter("root is null").select("__key", "__name").distinct())
    kept = kept.select(F.coalesce("__key", F.lit(0).cast("long")).alias("__k"), F.col("__key").isNull().alias("__no_key"), "__name")
    rows = renamed.withColumn("__k", F.coalesce(F.col(k).cast("long"), F.lit(0).cast("long"))).withColumn("__no_key", F.col(k).cast("long").isNull())
    rows = rows.withColumn("__name", F.concat(F.col(t).isNull().cast("string"), F.md5(F.coalesce(F.col(t), F.lit("")).cast("binary"))))
    by = ["__k", "__no_key", "__name"]
    return rows.join(kept, by, "left_semi").dropDuplicates(by).select(*(F.col(n).alias(c) for n, c in zip(own, df.columns, strict=True)))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=4, threshold=(85, 100))
