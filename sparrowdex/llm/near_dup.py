"""Near-duplicate detection: chosen-path set similarity join over word shingles.

Texts with equal sets form a class; only the smallest id of a class goes on. A sketch holds the low bytes of WIDTH minwise
values of a set. In each of some independent trees the root branches on a whole minwise value, and each further node on
sketch coordinates that its own key selects: as many on average as keep a pair at the threshold alive, and EXTRA more.
Nodes of at most LEAF documents are compared exhaustively: sketches first, which drops only pairs LEAST_SIGMAS below the
threshold, then the full sets. There are as many trees as make the expected recall of a pair at the threshold RECALL, even
if its nodes fall below LEAF only at level LEVELS (`expected_recall`, `trees_for`). Only nodes above LEAF branch on,
unless a node holds nearly all of its parent: then its sets agree in most coordinates, and it is solved exactly by what
its sets do not share. So the levels end by themselves.

Let T be a set and f(x) the difference of x and T. As |x ^ y| = |f(x) ^ f(y)|, x and y are linked without a look at T if
their slacks (100 - per_cent) |x| - (100 + per_cent) |f(x)| add up to 0 or more, and otherwise only if f(x) and f(y)
share as many shingles as the slacks fall short of 0, by 2 (100 + per_cent). As f(y) holds what they share, and (100 +
per_cent) |x ^ y| is at most (100 - per_cent) (|x| + |y|), f(x) has no more others than that allows: what no other set
has of it drops a document that has too much of its own. So each document is linked with the one of the most slack where
the slacks allow it, which connects all such pairs, and the others, far from that one, meet in the node's entries: the
documents that have, or lack, a shingle against T. Only entries with a far document count, and only those of a
document's rarest shingles that cannot all be missed by what it has to share. An entry above LEAF is solved as a node of
its own.

This holds for any T; which one it is decides how short the differences are. T is what most of PIVOTS of the node's sets
have, chosen by a hash. One of these has, and one lacks, the shingle of any entry, or has it against T, so that an entry
is smaller than its node, mostly by half. How rare a shingle is is told by a table of counts that may be too high but not
too low (`tally`), so that sets stay in their rows, and only the rarest shingles become rows (`prefixes`).

Nothing depends on one task holding a large node: nodes are counted by partial aggregation, joined as (node, document)
pairs, and gathered only when they have at most LEAF documents. Leaves of the trees overlap; documents that similar
sketches connect, LEAF of them at most, are compared once, not once a leaf. A text that very many documents have is dealt
over all tasks wherever its copies are joined (`workspace.spread`).
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import mix, shingle_sets
from .workspace import discard, give_back, lean, small_batches, spread, stash

WIDTH, LEAF = 128, 256
#: Children of a node beyond the 1 / similarity that keep a pair alive, and the share of its parent from which a node is coherent.
EXTRA, COHERENT = 0.2, 0.7
RECALL, LEVELS = 0.995, 24
#: The coordinates on which roots branch, a tree each.
ROOTS = np.random.default_rng(4).permutation(WIDTH)
LEAST_SIGMAS = 4.5
#: Rows of (id, node) that go to every task at most where sets or sketches are looked up; more are joined by a shuffle. The
#: driver holds them several times over: as collected, as a table and as blocks. BROADCAST_KEYS: the same of ids alone.
BROADCAST_IDS, BROADCAST_KEYS = 250_000, 1_000_000
#: Members of a node whose majority is its T.
PIVOTS = 64
#: Slots to an entry where entries are counted, and the most of them as a power of 2, a byte each; the bit for far sets.
SLOTS, MOST_BITS, FAR = 4, 25, 128


def survival(share: float, kids: float, level: int) -> float:
    """The chance that two sketches of which a share agrees meet in a node at that level of one tree."""
    gone, sure = 0.0, int(kids)
    for _ in range(level - 1):
        apart = 1 - share + share * gone
        gone = apart**sure * (1 - (kids - sure) * (1 - apart))
    return share * (1 - gone)


def expected_recall(similarity: float, trees: int, level: int) -> float:
    """The chance that two sets of this similarity meet in a node at that level of any tree."""
    kids = 1 / similarity + EXTRA
    agree = ((k, comb(WIDTH, k) * similarity**k * (1 - similarity) ** (WIDTH - k)) for k in range(WIDTH + 1))
    return sum(p * (1 - (1 - survival(k / WIDTH, kids, level)) ** trees) for k, p in agree)


def trees_for(similarity: float) -> int:
    return next(t for t in range(1, WIDTH + 1) if expected_recall(similarity, t, LEVELS) >= RECALL)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1), r.integers(0, 1 << 64, WIDTH, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values, a row for each of some non-empty sets."""
    times, flip = _coefficients()
    out = np.zeros((len(sets), WIDTH), np.uint32)
    first = 0
    while first < len(sets):  # as many sets at once as stay in the processor's cache
        last, held = first + 1, len(sets[first])
        while last < len(sets) and held + len(sets[last]) <= 32_768:
            held += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for c in range(WIDTH):
            out[first:last, c] = np.minimum.reduceat(((flat ^ flip[c]) * times[c]) >> np.uint64(32), starts)
        first = last
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, trees: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, and, null for an empty set, its digest, the minwise values of the roots, and the sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("roots", pa.list_(pa.int32())), ("sketch", pa.binary())])
    chosen = ROOTS[:trees]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = list(shingle_sets(part.column(1).cast(pa.binary()).to_pylist()))
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = sketches([sets[i] for i in full]) if full else np.zeros((0, WIDTH), np.uint32)
                roots: list = [None] * len(sets)
                sketch, digest = roots.copy(), roots.copy()
                for i, first, low in zip(full, rows[:, chosen].astype(np.int32), rows.astype(np.uint8), strict=True):
                    roots[i], sketch[i], digest[i] = first, low.tobytes(), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.record_batch([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(roots, pa.list_(pa.int32())), pa.array(sketch, pa.binary())], schema=schema)

    return _texts(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, roots array<int>, sketch binary")


def leaves(reps: DataFrame, first: F.Column, kids: float) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(node, rep): members of leaf nodes with at least two documents; (node, size, lo, rep): members of large nodes
    that do not branch on, lo the smallest, or None; the stashes that both read.

    reps: rep, sketch; first: the nodes of a row at the roots; kids: children of a node on average."""
    rows = reps.select("rep", F.explode(first).alias("node"), F.lit(0).alias("parent"))
    found, whole, used = [], [], []
    alike = (F.col("size") > COHERENT * F.col("parent")) & (F.col("parent") > 0)
    while True:
        nodes = stash(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max("parent").alias("parent"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("size > 1"), "nodes")
        used.append(nodes)
        # nodes of the same documents, of other trees mostly: one of them is enough where they end
        once_each = lambda some: some.groupBy("size", "who").agg(F.min("node").alias("node"), F.min("lo").alias("lo")).select("node", "size", "lo")
        pairs = nodes.where("size = 2").select("lo", "hi").distinct()
        found.append(pairs.select(F.xxhash64("lo", "hi").alias("node"), F.explode(F.array("lo", "hi")).alias("rep")))
        small = once_each(nodes.where((F.col("size") > 2) & (F.col("size") <= LEAF)))
        found.append(rows.select("rep", "node").join(small.select("node"), "node").select("node", "rep"))
        large = nodes.where(F.col("size") > LEAF)
        held = {r.alike: r.rows for r in large.groupBy(alike.alias("alike")).agg(F.sum("size").alias("rows")).collect()}
        if True in held:
            whole.append(rows.select("rep", "node").join(once_each(large.where(alike)), "node").select("node", "size", "lo", "rep"))
        if False not in held:
            return reduce(DataFrame.union, found), reduce(DataFrame.union, whole) if whole else None, used
        paths = rows.select("rep", "node").join(large.where(~alike), "node").select("node", "rep", "size")
        paths = F.broadcast(paths) if held[False] <= BROADCAST_IDS else paths
        sure = int(kids)
        more = F.pmod(F.xxhash64("node", F.lit("more")), F.lit(1000)) < int(1000 * (kids - sure))
        value = lambda j: F.substring("sketch", F.pmod(F.xxhash64("node", F.lit("at"), j), F.lit(WIDTH)).cast("int") + 1, F.lit(1))  # noqa: E731, B023
        child = F.transform(F.sequence(F.lit(1), F.when(more, sure + 1).otherwise(sure)), lambda j: F.xxhash64("node", j, value(j)))
        rows = stash(paths.join(reps.select("rep", "sketch"), "rep").select("rep", F.explode(child).alias("node"), F.col("size").cast("int").alias("parent")), "paths")
        used.append(rows)


def dealt(whole: DataFrame) -> DataFrame:
    """(node, rep): large nodes in blocks that share the node's smallest document."""
    block = F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), F.ceil(F.col("size") / (LEAF / 2))))
    return whole.select(block.alias("node"), F.explode(F.array_distinct(F.array("rep", "lo"))).alias("rep")).distinct()


def majorities(batches):
    """node, common of (node, sets): the shingles that most of the sets have."""
    for b in batches:
        out = []
        for sets in b.column(1):
            known, n = np.unique(sets.values.flatten().to_numpy(), return_counts=True)
            out.append(known[2 * n > len(sets)])
        yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "common"])


def _slots(b: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each entry, number of entries of each row) of a batch with the columns node and diff."""
    lengths = b.column("diff").value_lengths().to_numpy()
    node = np.repeat(mix(b.column("node").to_numpy().view(np.uint64)), lengths)
    return (mix(b.column("diff").flatten().to_numpy().view(np.uint64) ^ node) >> np.uint64(64 - bits)).astype(np.int64), lengths


def _summed(slot: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, at = np.unique(slot, return_inverse=True)
    out = np.zeros(len(known), np.int64)
    np.add.at(out, at, n)
    return known, out


def tally(entries: DataFrame, bits: int) -> np.ndarray:
    """A byte for each of 2 ** bits slots: 0 if no set has an entry there, else how many have, by logarithms above 64, and
    FAR if a far one has. Entries that share a slot are counted together, so that a count is never too low.

    entries: node, far, diff."""
    low = min(bits, 16)
    one_far = 1 << 40

    def rows(slot, n):
        slot, n = _summed(np.concatenate(slot), np.concatenate(n))
        ends = np.flatnonzero(np.diff(slot >> low)) + 1
        parts = np.split(slot, ends)
        return pa.record_batch([pa.array([int(p[0]) >> low for p in parts], pa.int32()), pa.array([p & ((1 << low) - 1) for p in parts], pa.list_(pa.int32())), pa.array(np.split(n, ends), pa.list_(pa.int64()))], names=["part", "slots", "n"])

    def count(batches):
        slots, ns, held = [], [], 0
        for b in batches:
            slot, lengths = _slots(b, bits)
            far = np.repeat(b.column("far").to_numpy(zero_copy_only=False), lengths)
            slots.append(slot)
            ns.append(1 + far * np.int64(one_far))
            held += len(slot)
            if held > 1 << 20:
                yield rows(slots, ns)
                slots, ns, held = [], [], 0
        if held:
            yield rows(slots, ns)

    def merge(batches):
        for b in batches:
            out = []
            for row in b.column(1):
                slot, n = _summed(row.values.field("slots").flatten().to_numpy(), row.values.field("n").flatten().to_numpy())
                far, n = n >= one_far, n % one_far
                scaled = np.where(n <= 64, n, np.minimum(FAR - 1, 64 + 8 * np.log2(np.maximum(n, 64) / 64)))
                table = np.zeros(1 << low, np.uint8)
                table[slot] = scaled.astype(np.uint8) | (far * FAR).astype(np.uint8)
                out.append(table.tobytes())
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["part", "counts"])

    parts = entries.select("node", "far", "diff").mapInArrow(lean(count), "part int, slots array<int>, n array<long>")
    parts = parts.groupBy("part").agg(F.collect_list(F.struct("slots", "n")).alias("p")).mapInArrow(lean(merge), "part int, counts binary")
    table = np.zeros(1 << bits, np.uint8)
    for r in parts.collect():
        table[r.part << low : (r.part + 1) << low] = np.frombuffer(r.counts, np.uint8)
    return table


def prefixes(entries: DataFrame, total: int) -> DataFrame:
    """(node, e, rep, far): of the entries of each set that another set of its node can have, and a far one has, rare ones
    first, so many that one of them is among the `need` that the set has to share.

    entries: node, rep, far, need, diff; total: how many entries they have."""
    bits = min(max(16, (SLOTS * total).bit_length()), MOST_BITS)
    sent = entries.sparkSession.sparkContext.broadcast(tally(entries, bits))

    def run(batches):
        for b in batches:
            slot, lengths = _slots(b, bits)
            counts, flat = sent.value[slot], b.column("diff").flatten().to_numpy()
            ends = np.cumsum(lengths)
            at, kept = [], []
            for a, z, need in zip((ends - lengths).tolist(), ends.tolist(), b.column("need").to_pylist(), strict=True):
                mine = a + np.flatnonzero(counts[a:z] > FAR + 1)
                # the order is one for all sets of a node
                mine = mine[np.lexsort((flat[mine], counts[mine]))][: max(0, len(mine) - need + 1)]
                at.append(mine)
                kept.append(len(mine))
            mine = np.concatenate([np.zeros(0, np.int64), *at])
            row = pa.array(np.repeat(np.arange(b.num_rows), kept))
            yield pa.record_batch([b.column("node").take(row), pa.array(flat[mine], pa.int64()), b.column("rep").take(row), b.column("far").take(row)], names=["node", "e", "rep", "far"])

    out = stash(entries.mapInArrow(lean(run), "node long, e long, rep long, far boolean"), "prefixes")
    sent.destroy()
    return out


def solved(groups: DataFrame, docs: DataFrame, per_cent: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """([(node, rep)], [(a, b)]): leaves and links that hold or connect all pairs that are linked within a group.

    groups: node, rep; docs: doc_id, text."""
    leaf, edges = [], []

    def differences(batches):
        for b in batches:
            columns: tuple[list, list, list] = ([], [], [])
            sets, common = b.column(2), b.column(3)
            for x, t in zip(sets, common, strict=True):
                x, t = x.values.to_numpy(), t.values.to_numpy()
                own, lacked = np.setdiff1d(x, t, assume_unique=True), np.setdiff1d(t, x, assume_unique=True)
                columns[0].append(len(x))
                columns[1].append((100 - per_cent) * len(x) - (100 + per_cent) * (len(own) + len(lacked)))
                columns[2].append(np.concatenate([own, lacked]))  # a shingle is in T or not: no entry mixes the two
            yield pa.record_batch([b.column(0), b.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["node", "rep", "n", "slack", "diff"])

    while not groups.isEmpty():
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "rep")))
        some = groups.withColumn("place", place).where(F.col("place") <= PIVOTS).select("node", "rep")
        common = shingles_of(some, docs).groupBy("node").agg(F.collect_set("set").alias("sets"))
        common = stash(common.mapInArrow(lean(majorities), "node long, common array<long>"), "common")
        few = (common.agg(F.sum(F.greatest(F.lit(1), F.size("common")))).first()[0] or 0) <= BROADCAST_IDS
        meet = lambda rows, found: rows.join(F.broadcast(found), "node") if few else spread(rows, found, "node", "rep", like=groups)  # noqa: E731, B023
        diffs = stash(meet(shingles_of(groups, docs), common).select("node", "rep", "set", "common").mapInArrow(lean(differences), "node long, rep long, n long, slack long, diff array<long>"), "differences")
        best = stash(diffs.groupBy("node").agg(F.max(F.struct("slack", "rep")).alias("best"), F.max("n").alias("largest")).select("node", F.col("best.rep").alias("star"), F.col("best.slack").alias("most"), "largest"), "stars")
        rated = stash(meet(diffs, best), "rated")
        edges.append(rated.where("rep <> star and slack + most >= 0").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct())
        # those that are linked with the star need no link with each other: one of a pair is far from it, of less slack
        far = F.col("slack") + F.col("most") < 0
        # the shingles that a document has to share with another, at least: with one of as much slack as there is, and with
        # one that has no others against T and is as large as a set that is linked with it
        need = F.ceil(-(F.col("slack") + F.when(far, F.col("most")).otherwise(-F.col("most") - 1)) / F.lit(2 * (100 + per_cent)))
        linked_to = F.least("largest", F.floor(100 * F.col("n") / F.lit(per_cent)))
        alone = F.ceil(-(F.col("slack") + (100 - per_cent) * linked_to) / F.lit(100 + per_cent))
        entries = rated.select("node", "rep", far.alias("far"), F.greatest(F.lit(1), need, alone).cast("long").alias("need"), "diff")
        first = prefixes(entries, rated.agg(F.sum(F.size("diff"))).first()[0] or 0)
        met = first.groupBy("node", "e").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("n > 1 and far")
        # entries of the same documents: one of them is enough
        met = stash(met.groupBy("n", "who").agg(F.min(F.struct("node", "e")).alias("at")).select("n", "at.node", "at.e"), "entries")
        held = lambda some: first.join(some.select("node", "e"), ["node", "e"]).select(F.xxhash64("node", "e").alias("node"), "rep").distinct()  # noqa: E731, B023
        leaf.append(held(met.where(F.col("n") <= LEAF)))
        groups = stash(held(met.where(F.col("n") > LEAF)), "groups")
    return leaf, edges


def clusters(members: DataFrame, reps: DataFrame, least: float, ratio: float) -> DataFrame:
    """members (array of ids): in each leaf, those that are connected by sketches of which a share of `least` agrees and
    set sizes of which the smaller is `ratio` of the larger. reps: rep, n, sketch."""

    def run(batches):
        for b in batches:
            col = b.column(0)
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            flat = col.flatten()
            reps_, n = flat.field("rep").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH)
            out = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                s, size = sketch[a:z], n[a:z]
                if z - a == 2:
                    if min(size) >= ratio * max(size) and (s[0] == s[1]).mean() >= least:
                        out.append(np.sort(reps_[a:z]))
                    continue
                near = np.array([(s == x).mean(1) for x in s]) >= least
                near &= np.minimum.outer(size, size) >= ratio * np.maximum.outer(size, size)
                for group in connected(near):
                    if len(group) > 1:
                        out.append(np.sort(reps_[a:z][group]))
            yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], names=["members"])

    # many leaves hold the same documents: one of them is enough, and only its members need their sketches
    same = members.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("m")).select("m").distinct()
    each = same.select(F.xxhash64("m").alias("node"), F.explode("m").alias("rep"))
    rows = each.join(reps.select("rep", "n", "sketch"), "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "n", "sketch")).alias("r"))
    return rows.select("r").mapInArrow(lean(run), "members array<long>").distinct()


def connected(near: np.ndarray) -> list[np.ndarray]:
    """The index groups that a symmetric boolean matrix connects."""
    left, out = np.ones(len(near), bool), []
    while left.any():
        group = np.zeros(len(near), bool)
        group[np.argmax(left)] = True
        while True:
            more = near[group].any(0) & left | group
            if (more == group).all():
                break
            group = more
        out.append(np.flatnonzero(group))
        left &= ~group
    return out


def once(groups: DataFrame) -> DataFrame:
    """(cluster, rep) of groups (members, sorted arrays of ids, LEAF at most): groups that overlap are one cluster, if
    that has at most LEAF ids; the others stay as they are.

    Overlapping groups mostly have the same smallest ids: a group goes by the least of the first ids of all groups that
    its members are in."""
    rows = groups.select("members", F.explode("members").alias("rep"))
    low = rows.groupBy("rep").agg(F.min(F.col("members")[0]).alias("low"))
    keyed = stash(rows.join(low, "rep").groupBy("members").agg(F.min("low").alias("key")), "keyed")
    few = keyed.groupBy("key").agg(F.sum(F.size("members")).alias("rows"))
    # most keys are of so few members that they need not be counted one by one
    sure = few.where(F.col("rows") <= LEAF).select("key")
    rest = keyed.join(few.where(F.col("rows") > LEAF).select("key"), "key")
    sizes = rest.select("key", F.explode("members").alias("rep")).distinct().groupBy("key").count()
    sure = sure.union(sizes.where(F.col("count") <= LEAF).select("key"))
    one = keyed.join(sure.withColumn("sure", F.lit(True)), "key", "left")
    cluster = F.when(F.col("sure"), F.col("key")).otherwise(F.xxhash64("members"))
    return one.select(cluster.alias("cluster"), F.explode("members").alias("rep")).distinct()


def shingles_of(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node, rep, set (array of shingles, never null): the set of each id's text, for each node of the id.

    rows: node, rep; docs: doc_id, text. An id with several texts has several sets, with repeated ones repeated sets."""
    ids = stash(rows.groupBy("rep").agg(F.collect_set("node").alias("nodes")), "ids")
    few = ids.agg(F.sum(F.size("nodes"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    if few <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    elif ids.count() <= BROADCAST_KEYS:  # only texts that are looked up are shuffled
        texts = texts.join(F.broadcast(ids.select("rep")), "rep", "left_semi")

    def sets(batches):
        for b in batches:
            found = [s.view(np.int64) for s in shingle_sets(b.column(2).cast(pa.binary()).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["nodes", "rep", "set"])

    found = texts.join(ids, "rep").select("nodes", "rep", "text")
    return found.mapInArrow(lean(sets), "nodes array<long>, rep long, set array<long>").select(F.explode("nodes").alias("node"), "rep", "set")


def links(groups: DataFrame, docs: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): what full sets link among the documents of each group, a the smallest of a component. docs: doc_id, text."""

    def run(batches):
        for b in batches:
            out: tuple[list, list] = ([], [])
            for row in b.column(0):
                reps = row.values.field("rep").to_numpy(zero_copy_only=False)
                for part in exact([x.values.to_numpy().view(np.uint64) for x in row.values.field("set")], per_cent):
                    ids = np.unique(reps[part]).tolist()
                    out[0].extend(ids[:1] * (len(ids) - 1))
                    out[1].extend(ids[1:])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    full = shingles_of(once(groups).select(F.col("cluster").alias("node"), "rep"), docs)
    gathered = full.groupBy("node").agg(F.collect_set(F.struct("rep", "set")).alias("r"))  # a repeated set counts once
    return gathered.select("r").mapInArrow(lean(run), "a long, b long")


def exact(sets: list[np.ndarray], per_cent: int) -> list[np.ndarray]:
    """The components of more than one set under 100 * intersection >= per_cent * union, as indices."""
    sizes = np.array([len(s) for s in sets])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label = np.arange(len(sets))
    mark = np.zeros(len(known), np.int64)
    for i in range(len(sets) - 1):
        mine = at[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[at], starts)
        mark[mine] = 0
        linked = 100 * both >= per_cent * (sizes + sizes[i] - both)
        for j in np.flatnonzero(linked & (label != label[i])):
            label[label == label[j]] = label[i]
    return [np.flatnonzero(label == k) for k, n in zip(*np.unique(label, return_counts=True), strict=True) if n > 1]


def near_duplicates(docs: DataFrame, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Rows are linked when 100 * intersection >= per_cent * union of their shingle sets. component_id is the smallest
    doc_id that links reach, the row's own included; kept: doc_id = component_id. A text that is null or has no word has
    an empty set and is linked with nothing. Rows that share a doc_id are one document. A row with a null doc_id takes
    no part: its component is null and it is kept. Other columns are dropped, whatever their names.
    """
    spark = docs.sparkSession
    give_back(spark)
    texts = _texts(docs, id_col, text_col)
    share = per_cent / 100
    trees = trees_for(share)
    sig = stash(signatures(docs, trees, id_col, text_col), "signatures")
    known = sig.where("doc_id is not null and n_shingles > 0")
    reps = stash(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")), "sketches")
    least = share - LEAST_SIGMAS * float(np.sqrt(share * (1 - share) / WIDTH))
    first = F.array(*[F.xxhash64(F.lit(t), F.element_at("roots", t + 1)) for t in range(trees)])
    leaf, whole, used = leaves(reps, first, 1 / share + EXTRA)
    edges = []
    if whole is not None:  # nodes of different trees with the same smallest document are mostly one group
        more, edges = solved(stash(whole.select(F.xxhash64("lo").alias("node"), "rep").distinct(), "groups"), texts, per_cent)
        leaf = reduce(DataFrame.union, more, leaf)
    groups = stash(clusters(leaf, reps, least, share), "clusters")
    discard(*used)
    give_back(spark)
    edges = reduce(DataFrame.union, edges, links(groups, texts, per_cent))
    # a row's id and the smallest of its class are one document's, where an id has several sets
    several = known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    shared = known.select("doc_id", "digest").join(several, "doc_id").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    found = components(edges.union(shared))
    of_class = reps.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = sig.select("doc_id", "n_shingles", "digest")
    # a row without a set or an id has no class
    none = F.col("digest").isNull() | F.col("doc_id").isNull()
    out = spread(rows.where(~none), of_class, "digest", "doc_id").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.union(rows.where(none).select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).withColumnRenamed("doc_id", id_col)
