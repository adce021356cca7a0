"""Exact Jaccard join of word n-gram sets in prefix trees.

The n-grams of a document are 64-bit hashes in one global order: first by how often their cell of a corpus-wide
count sketch is hit (rare first), then by hash. Sets that reach the threshold share an n-gram among the first
n - ceil(t * n) + 1 of each, so each set enters the first level of the tree under those only. At such a node a set
stays if the lengths that remain behind the shared n-gram allow the overlap with some other set there. The node's
hub is the set in which the n-gram stands earliest; nodes of one hub are one cell, so a set enters a cell once,
however many n-grams lead there, and every pair that can link meets in a cell.

1. The members of each cell are stored in a trie, which is walked with the hub.
2. In cells whose members are then of several components, tries of at most BLOCK members are walked with those
   outside the hub's component, BLOCK at a time. Only links between components are returned, at most one a set and
   block, so groups of copies stay linear, and no link between components is lost.

A walk counts the overlap along a shared path once, and leaves a subtree as soon as overlap and remaining lengths
stay under the overlap needed. Before sets are sent to tries, parity maps of about two bits an n-gram drop those
without a possible partner. In the worst case (very many sets share four fifths of their n-grams but link with
none) step 2 sends the members of a cell times those outside its hub's component, over BLOCK.

Defined cases: null and blank texts have no set and link with nothing; fewer than n words are one n-gram; equal
rows and equal sets link; rows with a null doc_id link like others, and component_id is the least doc_id that is not
null (null if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N, NUM, DEN = 5, 80, 100
#: Members of a trie, n-grams that it holds, and depths that a walk looks ahead.
BLOCK, BLOCK_GRAMS, STEP = 128, 1 << 20, 256
#: Rows of a node that are compared at once, rows that a task holds before it sends them on, and words of maps compared at once.
WHOLE, HELD, MAP_WORDS = 256, 1 << 16, 1 << 20
#: Cells of the count sketch, and slices in which its parts are added up.
CELLS, SLICES = 1 << 20, 16
#: Rows of 8-byte keys that may be broadcast, 8 MB; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = common.mix64(np.arange(1, N + 2, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text in a buffer of UTF-8 texts."""
    docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * docs
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:-1] | np.r_[True, ~word[:-1]]))
    end = np.flatnonzero(word & (edge[1:] | np.r_[~word[1:], True])) + 1
    name = common.window_hash(common.prefix_hash(_LOWER[data]), start, end)
    of = np.searchsorted(start, offsets)  # the first word of each text
    gram = np.zeros(max(0, len(name) - N + 1), np.uint64)
    for k in range(N):
        gram += name[k : k + len(gram)] * _FACTORS[k]
    gram, out = common.mix64(gram), []
    for lo, hi in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if hi - lo >= N:
            out.append(np.unique(gram[lo : hi - N + 1]))
        else:
            few = (name[lo:hi] * _FACTORS[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[N:] * np.uint64(hi - lo)
            out.append(common.mix64(few) if hi > lo else gram[:0])
    return out


def set_key(grams: np.ndarray) -> int:
    """Names a set; 63 bits."""
    total = common.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(common.mix64(total + np.array([len(grams)], np.uint64))[0] >> np.uint64(1))


def prefix_size(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def needed(a, b):
    """The least overlap with which sets of these sizes link."""
    return -(-NUM * (a + b) // (DEN + NUM))


def parity(grams: np.ndarray) -> bytes:
    """Each hash flips a bit of a map of two bits a hash or more: maps of two sets differ in at most as many bits as the sets in hashes."""
    bits = max(64, 2 << (len(grams) - 1).bit_length()) if len(grams) else 64
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps, one a row, folded to so many words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def may_link(a: list[bytes], na: np.ndarray, b: list[bytes], nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of a[i] and b[j]: false only if so many bits differ that the sets cannot link; a longer map is folded."""

    def by_size(maps: list[bytes]):
        size = np.array([len(x) // 8 for x in maps], np.int64)
        at, tables = np.zeros(len(maps), np.int64), {}
        for w in np.unique(size).tolist():
            own = np.flatnonzero(size == w)
            at[own] = np.arange(len(own))
            tables[w] = np.frombuffer(b"".join(maps[k] for k in own), np.uint64).reshape(-1, w)
        return size, at, tables

    (size_a, at_a, tables_a), (size_b, at_b, tables_b) = by_size(a), by_size(b)
    differ = np.zeros(len(i), np.int64)
    for x, left in tables_a.items():
        for y, right in tables_b.items():
            own, w = np.flatnonzero((size_a[i] == x) & (size_b[j] == y)), min(x, y)
            one, two, step = _fold(left, w), _fold(right, w), max(1, MAP_WORDS // w)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                differ[part] = np.bitwise_count(one[at_a[i[part]]] ^ two[at_b[j[part]]]).sum(1, dtype=np.int64)
    return differ <= na[i] + nb[j] - 2 * needed(na[i], nb[j])


_INFO = "doc_id long, row_key long, n long, set_key long, map binary, slice int, cells binary"


def _inform(batches):
    """Size and name of each document's set; at the task's end, its part of the sketch."""
    count = np.zeros(CELLS, np.uint32)
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    names = ["doc_id", "row_key", "n", "set_key", "map", "slice", "cells"]
    for batch in batches:
        sets = shingles(*common.utf8(batch["text"]))
        if len(grams := np.concatenate(sets)) if sets else False:
            np.add.at(count, (grams >> shift).astype(np.int64), np.uint32(1))
        keys = [set_key(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["row_key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
    if count.any():
        part = np.minimum(count, 65535).astype(np.uint16).reshape(SLICES, -1)
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in part], pa.binary())], names)


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up sketch parts of one slice; parts hold 16-bit counts, sums 64-bit ones."""
    total = np.zeros(CELLS // SLICES, np.uint64)
    for batch in batches:
        for wide, x in zip(batch["wide"].to_pylist(), batch["cells"].to_pylist(), strict=True):
            total += np.frombuffer(x, np.uint64 if wide else np.uint16)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([True]), pa.array([total.tobytes()], pa.binary())], ["slice", "wide", "cells"])


def _levels(info: DataFrame) -> np.ndarray:
    """How far each cell's count stands over the mean, in doublings of the deviation that unique n-grams would give.

    So n-grams that occur as often as the root of a cell's load already go last. One byte a cell, CELLS bytes whatever
    the corpus.
    """
    parts = info.filter("slice is not null").select("slice", F.lit(False).alias("wide"), "cells", F.pmod(F.xxhash64("cells"), F.lit(32)).alias("part"))
    form = "slice int, wide boolean, cells binary"
    sums = parts.groupBy("slice", "part").applyInArrow(_add, form).groupBy("slice").applyInArrow(_add, form).collect()
    count = np.zeros(CELLS, np.float64)
    for r in sums:
        count[r["slice"] * (CELLS // SLICES) :][: CELLS // SLICES] = np.frombuffer(bytes(r["cells"]), np.uint64)
    mean = max(1.0, count.sum() / CELLS)
    return np.clip(np.floor(np.log2(np.maximum((count - mean) / np.sqrt(mean), 1.0))), 0, 31).astype(np.uint8)


def ordered(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Sorted ids in the global order: the level in the top bits, then the hash."""
    level = levels[(grams >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (grams >> np.uint64(6)))


def _enter(levels):
    """(n-gram, place, size and name) for the first n-grams of each distinct set of a task."""

    def run(batches):
        seen = set()
        for batch in batches:
            out = []
            for grams in shingles(*common.utf8(batch["text"])):
                if len(grams) and (key := set_key(grams)) not in seen:
                    seen.add(key)
                    first = ordered(grams, levels.value)[: prefix_size(len(grams))]
                    out.append((first.view(np.int64), np.arange(len(first), dtype=np.int32), np.full(len(first), len(grams), np.int32), np.full(len(first), key)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], _ENTRY)

    return run


_ENTRY = ["gram", "at", "n", "set_key"]


def _fits(na, at_a, nb, at_b):
    """If a first shared n-gram at these places leaves enough in both sets."""
    return 1 + np.minimum(na - at_a - 1, nb - at_b - 1) >= needed(na, nb)


def _cells(gram: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, hub: tuple[int, ...] | None) -> pa.RecordBatch:
    """(hub, member, its size, if the two may link) from rows sorted by n-gram, place and name.

    hub: place, size and name of that of a node begun before.
    """
    keep = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
    gram, at, n, key = gram[keep], at[keep].astype(np.int64), n[keep].astype(np.int64), key[keep]
    cuts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    size = np.diff(np.r_[cuts, len(gram)])
    out: list[tuple[np.ndarray, ...]] = []

    def member(head: np.ndarray, rows: np.ndarray, may: np.ndarray) -> None:
        out.append((head, key[rows], n[rows], may))

    for s in np.unique(size).tolist():
        nodes = cuts[size == s]
        if hub is not None and nodes[0] == 0:
            nodes = nodes[1:]
        if s > WHOLE:
            for lo in nodes.tolist():
                rows = np.arange(lo, lo + s)
                member(np.full(s, key[lo]), rows, _fits(n[lo], at[lo], n[rows], at[rows]))
        elif s > 1:
            for lo in range(0, len(nodes), step := max(1, WHOLE**2 // s**2)):
                rows = nodes[lo : lo + step, None] + np.arange(s)
                ok = _fits(n[rows][:, :, None], at[rows][:, :, None], n[rows][:, None], at[rows][:, None])
                ok[:, np.arange(s), np.arange(s)] = False
                stays = ok.any(2)
                head = stays.argmax(1)  # the first that stays
                each, place = np.nonzero(stays)
                member(key[rows[each, head[each]]], rows[each, place], ok[each, head[each], place])
    if hub is not None:
        rows = np.arange(size[0])
        member(np.full(len(rows), hub[2]), rows, _fits(hub[1], hub[0], n[rows], at[rows]))
    a, b, size, may = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (key[:0], key[:0], key[:0], key[:0] > 0)
    order = np.lexsort((~may, b, a))  # of equal rows, one that may link goes first
    order = order[np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)][: len(a)]]
    return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (a, b, size, may)], ["hub", "set_key", "n", "may"])


def _meet(batches):
    """Streams rows sorted by n-gram through _cells(); of a node over HELD rows, only the hub is held."""
    held, hub = None, None
    for batch in batches:
        now = [batch[c].to_numpy(zero_copy_only=False) for c in _ENTRY]
        if not len(now[0]):
            continue
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
        if last:
            yield _cells(*(x[:last] for x in now), hub)
            held, hub = [x[last:] for x in now], None
        else:
            held = now
        if len(held[0]) > HELD:
            hub = hub or tuple(int(x[0]) for x in held[1:])
            yield _cells(*held, hub)
            held = [x[-1:] for x in held]  # a repeated name may go on
    if held is not None:
        yield _cells(*held, hub)


def _sets(levels):
    def run(batches):
        seen = set()
        for batch in batches:
            keys, sets = [], []
            for grams in shingles(*common.utf8(batch["text"])):
                if len(grams) and (key := set_key(grams)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(ordered(grams, levels.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["set_key", "grams"])

    return run


class Trie:
    """Sets in the global order as paths: sorted, each with how long a path it shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets, self.shared = [sets[i] for i in self.order], [0]
        self.size = np.array([len(x) for x in self.sets], np.int64)
        for before, now in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(now), len(before))
            differ = np.flatnonzero(now[:m] != before[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)

    def walk(self, probe: np.ndarray, skip: np.ndarray | None = None) -> list[int]:
        """Which sets link with the probe, depth first, by their place in the list given; skip: those not asked for.

        path[d] is the overlap of the path's first d n-grams with the probe, known up to the depth that the walk
        reached: the part shared with the next set is not counted again, and below a depth where overlap and
        remaining lengths stay under the overlap needed nothing is looked at.
        """
        found, known, path = [], 0, np.zeros(int(self.size.max(initial=0)) + 1, np.int64)
        needs = needed(len(probe), self.size).tolist()
        for i, now, shared, n, need in zip(self.order, self.sets, self.shared, self.size.tolist(), needs, strict=False):
            known = min(known, shared)
            if skip is not None and skip[i]:
                continue
            while known < n:
                have, passed = int(path[known]), int(np.searchsorted(probe, now[known]))
                if have + min(len(probe) - passed, n - known) < need:
                    break
                label = now[known : known + STEP]
                where = np.minimum(np.searchsorted(probe, label), len(probe) - 1)
                path[known + 1 : known + 1 + len(label)] = have + np.cumsum(probe[where] == label)
                known += len(label)
            if known == n and path[n] >= need:
                found.append(i)
        return found


def _verify(batches):
    """Rows (a, grams_a, b, grams_b), sorted by hub a: the pairs that link."""
    for batch in batches:
        a, b, hubs, grams = (batch[c] for c in ("a", "b", "grams_a", "grams_b"))
        ids, keep = a.to_numpy(zero_copy_only=False), []
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]).tolist() if len(ids) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            trie = Trie([np.frombuffer(grams[j].as_py(), np.uint64) for j in range(lo, hi)])
            keep += [lo + j for j in trie.walk(np.frombuffer(hubs[lo].as_py(), np.uint64))]
        at = pa.array(sorted(keep), pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])


def _maybe(batches):
    """The pairs whose parity maps allow a link."""
    for batch in batches:
        (a, b), (na, nb) = (batch[c].to_pylist() for c in ("map_a", "map_b")), (batch[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        each = np.arange(batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(may_link(a, na, b, nb, each, each), pa.bool_()))


_PLACE = ["hub", "i", "j"]


def _blocks(batches):
    """The rows of each block, from batches sorted by _PLACE."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch[c].to_numpy() for c in _PLACE]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in x], axis=0)) + 1).tolist()
        if held and any(held[-1][c][0] != batch[c][0] for c in _PLACE):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _possible(batches):
    """The rows of each block that have a partner of another component on the other side, by size and parity map."""
    for block in _blocks(batches):
        key, n, root, outside, probe = (block[c].to_numpy() for c in ("set_key", "n", "root", "outside", "probe"))
        maps, i, j = block["map"].to_pylist(), np.flatnonzero(probe), np.flatnonzero(~probe)
        may = (root[i][:, None] != root[j]) & (needed(n[i][:, None], n[j]) <= np.minimum(n[i][:, None], n[j]))
        may &= ~outside[j] | (key[i][:, None] < key[j])  # both outside the hub's component: one order will do
        x, y = np.nonzero(may)
        ok = may_link([maps[k] for k in i], n[i], [maps[k] for k in j], n[j], x, y)
        rows = np.union1d(i[x[ok]], j[y[ok]])
        if len(rows):
            yield from block.select([*_PLACE, "probe", "set_key", "n", "root", "outside"]).take(pa.array(rows)).combine_chunks().to_batches()


def _across(batches):
    """Links between components in each block: its members' trie is walked with its probes; what a link joins is one component then."""
    for block in _blocks(batches):
        key, root, outside, probe = (block[c].to_numpy() for c in ("set_key", "root", "outside", "probe"))
        sets, links = [np.frombuffer(x.as_py(), np.uint64) for x in block["grams"].combine_chunks()], []
        members, name = np.flatnonzero(~probe), root.copy()
        trie = Trie([sets[k] for k in members])
        for i in np.flatnonzero(probe).tolist():
            skip = (name[members] == name[i]) | (outside[members] & (key[members] < key[i]))
            if skip.all():
                continue
            for j in members[trie.walk(sets[i], skip)].tolist():
                if name[i] != name[j]:
                    links.append((int(key[i]), int(key[j])))
                    name[name == name[j]] = name[i]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n, set_key, root and least doc_id of the root's component for each document; root names a component of sets."""
    spark = docs.sparkSession
    common.text_batches(spark)
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    info = common.materialize(texts.mapInArrow(_inform, _INFO))
    levels = spark.sparkContext.broadcast(_levels(info))
    info = info.filter("slice is null").select("doc_id", "row_key", "n", "set_key", "map")
    distinct = common.materialize(info.filter("set_key is not null").groupBy("set_key").agg(F.min("n").alias("n"), F.min("map").alias("map"), F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key")))
    nodes = texts.select("text").mapInArrow(_enter(levels), "gram long, at int, n int, set_key long")
    nodes = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram").sortWithinPartitions("gram", "at", "set_key")
    met = nodes.mapInArrow(_meet, "hub long, set_key long, n long, may boolean")
    cells = common.materialize(met.groupBy("hub", "set_key").agg(F.max("n").alias("n"), F.max("may").alias("may")).filter("hub <> set_key"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(set_key, grams) of the sets wanted, made anew from one document each."""
        rows = common.materialize(distinct.join(wanted, "set_key", "left_semi").select("row_key"))
        rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        found = texts.join(rows, "row_key", "left_semi").select("text").mapInArrow(_sets(levels), "set_key long, grams binary")
        return common.materialize(found.dropDuplicates(["set_key"]))  # so that a hub with many members is a join that Spark can split

    # 1. Hubs. Rows of pairs are as many as cells have members.
    pairs = cells.filter("may").select(F.col("hub").alias("a"), F.col("set_key").alias("b"))
    for x in ("a", "b"):
        pairs = pairs.join(distinct.select(F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"map_{x}")), x)
    pairs = common.materialize(pairs.mapInArrow(_maybe, "a long, b long"))
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
    both = pairs.join(sets.toDF("b", "grams_b"), "b").join(sets.toDF("a", "grams_a"), "a")
    links = common.materialize(both.select("a", "grams_a", "b", "grams_b").mapInArrow(_verify, "a long, b long"))
    roots = common.materialize(common.components(links))
    # 2. Cells of several components.
    placed = cells.join(roots.toDF("set_key", "root"), "set_key", "left").join(roots.toDF("hub", "hub_root"), "hub", "left")
    root = F.coalesce("root", "set_key")
    placed = common.materialize(placed.select("hub", "set_key", "n", root.alias("root"), (root != F.coalesce("hub_root", "hub")).alias("outside")))
    blocks = lambda rows, grams: F.ceil(F.greatest(rows / BLOCK, grams / BLOCK_GRAMS))
    mixed = placed.groupBy("hub").agg(blocks(F.count("*"), F.sum("n")).alias("all"), blocks(F.count_if("outside"), F.sum(F.when(F.col("outside"), F.col("n")))).alias("probes"), F.count("*").alias("members"))
    mixed = common.materialize(mixed.filter("probes > 0 and members > 1").drop("members"))
    if not mixed.isEmpty():
        spread = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
        part = lambda x: F.pmod(F.xxhash64("set_key"), F.col(x))
        held = ["set_key", "n", "map", "root", "outside"]
        opened = placed.join(mixed, "hub").join(distinct.select("set_key", "map"), "set_key")
        members = opened.select("hub", part("all").alias("i"), spread("probes").alias("j"), F.lit(False).alias("probe"), *held)
        probes = opened.filter("outside").select("hub", spread("all").alias("i"), part("probes").alias("j"), F.lit(True).alias("probe"), *held)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = members.unionByName(probes).repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE)
        met = common.materialize(met.mapInArrow(_possible, "hub long, i long, j long, probe boolean, set_key long, n long, root long, outside boolean"))
        met = met.join(sets_of(met.select("set_key").distinct()), "set_key").repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE)
        found = common.materialize(met.mapInArrow(_across, "a long, b long"))
        if not found.isEmpty():
            roots = common.materialize(common.components(links.unionByName(found)))
    named = common.materialize(distinct.select("set_key", "doc_id").join(roots.toDF("set_key", "root"), "set_key", "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("root")))
    least = common.materialize(named.groupBy("root").agg(F.min("doc_id").alias("least")))
    named = common.materialize(named.drop("doc_id").join(least, "root"))
    return info.drop("map").join(named, "set_key", "left")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and set_key for each document."""
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return _named(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "set_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their near copies: of each group one row stays, that with the least doc_id, nulls last.

    Of rows with one doc_id the one with the least hash of id and text stays. Documents without words all stay.
    """
    named = common.materialize(_named(docs).filter("set_key is not null").select("root", "doc_id", "row_key"))
    best = common.materialize(named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("best")))
    marked = named.join(best, "root").select("row_key", (F.col("row_key") == F.col("best.row_key")).alias("stays"))
    marked = common.materialize(marked.groupBy("row_key").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1").select(F.col("row_key").alias("_row"), "stays"))
    keys = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    whole = docs.select(F.struct("*").alias("_doc"), F.xxhash64("doc_id", "text").alias("_row"))
    rest, again = whole.join(keys(marked.select("_row")), "_row", "left_anti"), marked.filter("stays").select("_row")
    if not again.isEmpty():  # equal rows of which one stays
        rest = rest.unionByName(whole.join(keys(again), "_row", "left_semi").dropDuplicates(["_row"]))
    return rest.select("_doc.*")
