"""Copies of images by local descriptors: crops and edited copies share many of them under one movement.

Images of a batch are stacked, so each step runs over all their pixels at once. At each scale of a pyramid of halves,
corners are local maxima of the Harris response; the centroid of the disc around a corner gives its orientation, across
which BITS pairs of smoothed pixels are compared. Descriptors meet in Hamming tables: a table for each of TABLES parts of
their bits; a part that agrees is an entry. A single meeting within MAX_BITS makes two images candidates, so a copy is
lost only if none of its corners meet: of those of a copy with noise half do, of one turned by 30 degrees a twentieth. An entry of more than LEAF images branches on the same part of the corners around, which are moved and
cropped with it; one that nevertheless keeps nearly all of its images is dealt into leaves that share the images with the
fewest corners and with the smallest id. That finds most links at little cost; after it, the images of each entry of more
than LEAF are compared pair by pair, but for those that are connected already. So an entry's size loses no copy.

Candidates are compared in full: matching descriptors, of any scales and orientations, vote for a movement (turn, zoom by
halves, displacement), and MIN_VOTES for one movement, MIN_SHARE of the smaller image's corners, make a copy.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .near_dup import COHERENT, LEAF, connected, once
from .shingles import mix
from .workspace import discard, lean, spread, stash

SCALES = 3
REACH, DISC = 4, 7
#: Least response of a corner; noise on a plain ground stays below it.
FLOOR = 50
#: BITS binary tests as WORDS 32-bit numbers; a table's key is KEY_BITS of them. With fewer bits corners meet by chance, the
#: more often the more images there are.
BITS, WORDS, TABLES, KEY_BITS = 128, 4, 3, 42
ANGLES = 32
#: A corner is (2 x, 2 y, scale * ANGLES + angle, descriptor words).
STEP = 3 + WORDS
MARGIN = 2
MAX_BITS, MIN_VOTES, MIN_SHARE, SLACK = 14, 4, 0.2, 2.5
#: Movements that are tried for one turn and zoom, and pixels or descriptor pairs that are looked at at once.
TRIALS, AT_ONCE = 300, 4 << 20
WIDTH = 64
#: Rows of (id, node) that go to every task at most where corners are looked up.
BROADCAST_IDS = 1_000_000


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """The pixels of a binary 8-bit PGM image; None for anything else."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", raw or b"")
    if not head or int(head[3]) > 255:
        return None
    width, height = int(head[1]), int(head[2])
    data = raw[head.end() : head.end() + width * height]
    return np.frombuffer(data, np.uint8).reshape(height, width) if width * height and len(data) == width * height else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return f"P5 {pixels.shape[1]} {pixels.shape[0]} 255\n".encode() + np.ascontiguousarray(pixels, np.uint8).tobytes()


#: What a page's picture leaves out: what every page of a site has.
FRAME = re.compile(rb"<(head|nav|footer|aside|script|style|form)\b.*?(?:</\1\s*>|\Z)|<div class=.ad.>.*?(?:</div>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)


def render(html: str | None) -> bytes:
    """A page's blocks of text as an image: a pixel a byte, WIDTH to a row; each block begins a new row
    and is repeated to its end, so no part of the image is blank."""
    rows = [np.full(WIDTH, 32, np.uint8)]
    for block in re.split(rb"(?:<[^>]*>)+", FRAME.sub(b"", (html or "").encode())):
        if block := block.strip():
            rows.append(np.resize(np.frombuffer(block, np.uint8), -(-len(block) // WIDTH) * WIDTH))
    code = np.concatenate(rows).reshape(-1, WIDTH)
    return encode_pgm(((code.astype(np.uint32) * 167 + 61) % 256).astype(np.uint8))


def _shifted(a: np.ndarray, axis: int, start: int, size: int) -> np.ndarray:
    return a[start : start + size] if axis == 0 else a[:, start : start + size]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1."""
    for axis in (0, 1):
        n = a.shape[axis]
        wide = np.pad(a, [(r, r) if x == axis else (0, 0) for x in (0, 1)])
        a = _shifted(wide, axis, 0, n).copy()
        for k in range(1, 2 * r + 1):
            a += _shifted(wide, axis, k, n)
    return a


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of side 2 r + 1, by doubling."""
    for axis in (0, 1):
        m, have = np.pad(a, [(r, r) if x == axis else (0, 0) for x in (0, 1)]), 1
        while have < 2 * r + 1:
            step = min(have, 2 * r + 1 - have)
            n = m.shape[axis] - step
            m = np.maximum(_shifted(m, axis, 0, n), _shifted(m, axis, step, n))
            have += step
        a = m
    return a


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the disc, offsets of the test pairs for each angle), rows before columns."""
    y, x = np.mgrid[-DISC : DISC + 1, -DISC : DISC + 1]
    inside = x**2 + y**2 <= DISC**2
    disc = np.stack([y[inside], x[inside]], 1)
    pairs = np.random.default_rng(7).uniform(-DISC, DISC, (256 * BITS, 2, 2))
    apart = pairs[:, 0] - pairs[:, 1]
    # along the orientation one pixel is the brighter one nearly always, so pairs lie across it
    fit = (np.hypot(pairs[..., 0], pairs[..., 1]) <= DISC).all(1) & (np.hypot(*apart.T) >= 3) & (np.abs(apart[:, 1]) <= 0.6 * np.hypot(*apart.T))
    pairs = pairs[fit][:BITS]
    turned = []
    for k in range(ANGLES):
        c, s = np.cos(2 * np.pi * k / ANGLES), np.sin(2 * np.pi * k / ANGLES)
        turned.append(np.rint(np.stack([pairs[..., 0] * c + pairs[..., 1] * s, pairs[..., 1] * c - pairs[..., 0] * s], -1)).astype(int))
    return disc, np.array(turned)


def features(images: list[np.ndarray]) -> list[np.ndarray]:
    """For each image of one width, a row for each of its corners, as STEP numbers; x and y are of scale 0."""
    align = 1 << (SCALES - 1)
    tops, at = [], MARGIN * align
    for p in images:
        tops.append(at)
        at += -(-(p.shape[0] + MARGIN * align) // align) * align
    tops, heights = np.array(tops), np.array([p.shape[0] for p in images])
    width, left = images[0].shape[1], MARGIN * align
    sheet = np.zeros((at + MARGIN * align, -(-(width + 2 * left) // align) * align), np.float32)
    for p, top in zip(images, tops, strict=True):
        sheet[top : top + p.shape[0], left : left + width] = p
    disc, pairs = _patterns()
    found = []
    for scale in range(SCALES):
        smooth = _box(_box(sheet, 1), 1) / 81
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[1:-1] = smooth[2:] - smooth[:-2]
        gx[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = np.maximum(np.rint((xx * yy - xy * xy - 0.05 * (xx + yy) ** 2) / 1e4), 0)
        y, x = np.nonzero((response > FLOOR) & (response == _highest(response, REACH)))
        edge, rows, cols = (DISC + 2) << scale, y << scale, (x << scale) - left  # what a corner sees lies in its image
        owner = np.maximum(np.searchsorted(tops, rows, side="right") - 1, 0)
        inside = (rows >= tops[owner] + edge) & (rows + (1 << scale) <= tops[owner] + heights[owner] - edge) & (cols >= edge) & (cols + (1 << scale) <= width - edge)
        y, x, owner = y[inside], x[inside], owner[inside]
        around = smooth[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        angle = np.arctan2(around @ disc[:, 0].astype(np.float32), around @ disc[:, 1].astype(np.float32))
        angle = np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        words = np.zeros((len(y), WORDS), np.int64)
        for a in range(0, len(y), 1 << 14):
            z, turn = slice(a, a + (1 << 14)), pairs[angle[a : a + (1 << 14)]]
            first = smooth[y[z, None] + turn[:, :, 0, 0], x[z, None] + turn[:, :, 0, 1]]
            second = smooth[y[z, None] + turn[:, :, 1, 0], x[z, None] + turn[:, :, 1, 1]]
            words[z] = np.packbits(first < second, axis=1).view(">i4")
        centre = lambda v, start: (2 * v + 1 << scale) - 1 - 2 * start  # noqa: E731, B023
        found.append(np.column_stack([owner, centre(x, left), centre(y, tops[owner]), np.full(len(y), scale * ANGLES) + angle, words]))
        if scale + 1 < SCALES:
            sheet = (sheet[::2, ::2] + sheet[1::2, ::2] + sheet[::2, 1::2] + sheet[1::2, 1::2]) / 4
    table = np.concatenate(found)
    table = table[np.argsort(table[:, 0], kind="stable")]
    return np.split(table[:, 1:], np.searchsorted(table[:, 0], np.arange(1, len(images))))


def corners(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, STEP).astype(np.int64)


def describe(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, digest of the image and its corners (null if there is none), n of each row."""
    schema = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("corners", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                raw = part.column(1).to_pylist()
                images = [decode_pgm(r) for r in raw]
                found: list = [None] * len(raw)
                widths: dict[int, list[int]] = {}
                for i, p in enumerate(images):
                    if p is not None:
                        widths.setdefault(p.shape[1], []).append(i)
                for group in widths.values():
                    while group:  # as many images at once as AT_ONCE pixels hold, one at least
                        most = max(1, int(np.searchsorted(np.cumsum([images[i].size for i in group]), AT_ONCE, side="right")))
                        for i, f in zip(group[:most], features([images[i] for i in group[:most]]), strict=True):
                            found[i] = f
                        group = group[most:]
                digest = [None if f is None else hashlib.blake2b(r, digest_size=16).digest() for f, r in zip(found, raw, strict=True)]
                flat = [None if f is None else f.astype("<i4").tobytes() for f in found]
                yield pa.record_batch([part.column(0), pa.array(digest, pa.binary()), pa.array(flat, pa.binary()), pa.array([0 if f is None else len(f) for f in found], pa.int64())], schema=schema)

    columns = rows.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return columns.mapInArrow(lean(run), "id long, digest binary, corners binary, n long")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each descriptor of a differs from each of b; rows of WORDS numbers."""
    bits = np.zeros((len(a), len(b)), np.uint8)
    for c in range(WORDS):
        bits += np.bitwise_count((a[:, c, None] ^ b[:, c]).astype(np.uint32))
    return bits


def _blocks(a: np.ndarray, b: np.ndarray):
    """(first row, distances of some rows of a to all of b), AT_ONCE pairs at once."""
    some = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), some):
        yield at, _distances(a[at : at + some, 3:], b[:, 3:])


def needed(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.ceil(max(MIN_VOTES, MIN_SHARE * min(len(a), len(b)))))


def is_copy(a: np.ndarray, b: np.ndarray) -> bool:
    return min(len(a), len(b)) >= MIN_VOTES and votes(a, b, needed(a, b)) >= needed(a, b)


def votes(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """The most corners of two images that match under one movement; `enough` of them end the search.

    A match says by how much its corner is turned and zoomed. Two matches that agree in this fix a movement, on which
    TRIALS pairs are tried for each turn and zoom; those that it takes to their place, but for SLACK pixels, vote.
    """
    met = [(i + at, j) for at, near in _blocks(a, b) for i, j in [np.nonzero(near <= MAX_BITS)]]
    i, j = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, int),) * 2
    p, q = (a[i, 0] + 1j * a[i, 1]) / 2, (b[j, 0] + 1j * b[j, 1]) / 2
    zoom = b[j, 2] // ANGLES - a[i, 2] // ANGLES
    turn = (b[j, 2] - a[i, 2]) % ANGLES
    enough, most = enough or len(i) + 1, 0
    for z in sorted(set(zoom.tolist()), key=abs):
        for t in sorted(range(0, ANGLES, 2), key=lambda k: min(k, ANGLES - k)):
            own = np.flatnonzero((zoom == z) & ((turn - t + 1) % ANGLES < 4))
            if len(own) < max(MIN_VOTES, most + 1):
                continue
            slack = SLACK * (1 << b[j[own], 2] // ANGLES)
            for moved in _movements(p[own], q[own], 2.0**z, 2 * np.pi * (t + 0.5) / ANGLES):
                for k in np.flatnonzero((fit := np.abs(moved - q[own]) <= slack).sum(1) > most):
                    most = max(most, min(len(np.unique(i[own][fit[k]])), len(np.unique(j[own][fit[k]]))))
                if most >= enough:
                    return most
    return most


def _movements(p: np.ndarray, q: np.ndarray, zoom: float, turn: float):
    """The points p under movements that two pairs (p, q) fix, near a zoom and a turn; a row for each movement."""
    one, two = np.random.default_rng(len(p)).integers(len(p), size=(2, TRIALS))
    far = np.abs(p[one] - p[two]) > 2 * SLACK
    one, two = one[far], two[far]
    by = (q[one] - q[two]) / (p[one] - p[two])
    near = (np.abs(np.abs(by) / zoom - 1) < 0.2) & (np.abs(np.angle(by * np.exp(-1j * turn))) < 2 * np.pi * 3 / ANGLES)
    one, by = one[near], by[near]
    some = max(1, AT_ONCE // 8 // len(p))
    for at in range(0, len(one), some):
        m = slice(at, at + some)
        yield by[m, None] * (p - p[one[m], None]) + q[one[m], None]


def keys(words: np.ndarray) -> np.ndarray:
    """The key of each descriptor in each table, a column a table; words: rows of WORDS numbers."""
    bits = np.unpackbits(words.astype(">u4").view(np.uint8).reshape(len(words), -1), axis=1)
    parts = [np.packbits(bits[:, t * KEY_BITS : (t + 1) * KEY_BITS], axis=1) for t in range(TABLES)]
    wide = [np.pad(p, ((0, 0), (0, 8 - p.shape[1]))).view(np.uint64)[:, 0] + np.uint64(t) for t, p in enumerate(parts)]
    return np.stack([mix(w) for w in wide], 1).view(np.int64)


def entries(images: DataFrame) -> DataFrame:
    """node, rep, corner, seen: each entry of each image in each table, with one of its corners. images: rep, corners."""

    def run(batches):
        for b in batches:
            out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []]
            for rep, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = corners(raw)
                node, first = np.unique(keys(f[:, 3:]).T.ravel(), return_index=True)  # table by table
                out[0].append(node)
                out[1].append(np.full(len(node), rep))
                out[2].append(first)
                out[3] += map(bytes, f[first % len(f), 3:].astype("<i4"))
            yield pa.record_batch([*(pa.array(np.concatenate(x)) for x in out[:3]), pa.array(out[3], pa.binary())], names=["node", "rep", "corner", "seen"])

    return images.select("rep", "corners").mapInArrow(lean(run), "node long, rep long, corner long, seen binary")


def _around(paths: DataFrame, images: DataFrame, level: int, few: bool) -> DataFrame:
    """The entries of large nodes one level deeper: those that agree in the same table for the corner that is next around,
    or for the second next. An image without further corners shares a node with its like."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for rep, raw, rows in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                f = corners(raw)
                own = keys(f[:, 3:]).view(np.uint64)
                near: dict[int, list] = {}
                for r in rows:
                    table, at = divmod(r["corner"], len(f))
                    if at not in near:
                        away = (f[:, 0] - f[at, 0]) ** 2 + (f[:, 1] - f[at, 1]) ** 2
                        near[at] = np.argsort(away, kind="stable")[2 * level - 1 : 2 * level + 1].tolist() or [None]
                    for k in near[at]:
                        part = np.uint64(0) if k is None else own[k, table]
                        out[0].append(mix(np.array([r["node"]], np.int64).view(np.uint64) + mix(np.array([part ^ np.uint64(level)]))).view(np.int64)[0])
                        out[1].append(rep)
                        out[2].append(r["corner"])
                        out[3].append(f[at, 3:].astype("<i4").tobytes())
                        out[4].append(r["size"])
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["node", "rep", "corner", "seen", "parent"])

    own = paths.groupBy("rep").agg(F.collect_list(F.struct("node", "corner", "size")).alias("rows"))
    own = F.broadcast(own) if few else own
    return images.select("rep", "corners").join(own, "rep").select("rep", "corners", "rows").mapInArrow(lean(run), "node long, rep long, corner long, seen binary, parent long")


def candidates(images: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """members (sorted arrays of ids): images that corners of one entry connect; (node, rep): images of which any two that
    share an entry of more than LEAF images share a node, or None. images: rep, n, corners."""
    rows = entries(images).withColumn("parent", F.lit(0).cast("long"))
    held, used = [], []
    alike = (F.col("size") > COHERENT * F.col("parent")) & (F.col("parent") > 0)
    level, crowd = 0, None
    while True:
        level += 1
        nodes = stash(rows.groupBy("node").agg(F.count("*").alias("size"), F.max("parent").alias("parent")).where("size > 1"), "nodes")
        used.append(nodes)
        held.append(rows.join(nodes.where(F.col("size") <= LEAF).select("node"), "node").select("node", "rep", "seen"))
        large = nodes.where(F.col("size") > LEAF)
        sizes = {r.alike: r.rows for r in large.groupBy(alike.alias("alike")).agg(F.sum("size").alias("rows")).collect()}
        if level == 1 and sizes:  # what branches off from an entry has none but its images
            shared = stash(rows.join(large.select("node"), "node").select("node", "rep"), "crowds")
            used.append(shared)
            # entries with the same smallest image are mostly of the same ones
            low = shared.groupBy("node").agg(F.min("rep").alias("lo"))
            crowd = stash(shared.join(low, "node").select(F.col("lo").alias("node"), "rep").distinct(), "crowds")
        if True in sizes:
            whole = rows.join(large.where(alike).select("node", "size"), "node").join(images.select("rep", "n"), "rep").select("node", "size", "rep", "n", "seen")
            stars = whole.groupBy("node").agg(F.min(F.struct("n", "rep", "seen")).alias("few"), F.min(F.struct("rep", "seen")).alias("low"))
            block = F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), F.ceil(F.col("size") / (LEAF / 2))))
            each = F.explode(F.array(F.struct("rep", "seen"), F.struct("few.rep", "few.seen"), F.col("low")))
            held.append(whole.join(stars, "node").select(block.alias("node"), each.alias("x")).select("node", "x.rep", "x.seen").distinct())
        if False not in sizes:
            break
        paths = rows.join(large.where(~alike).select("node", "size"), "node").select("rep", "node", "corner", "size")
        rows = stash(_around(paths, images, level, sizes[False] <= BROADCAST_IDS), "entries")
        used.append(rows)

    def run(batches):
        for b in batches:
            out = []
            for row in b.column(0):
                reps = row.values.field("rep").to_numpy(zero_copy_only=False)
                seen = np.frombuffer(b"".join(row.values.field("seen").to_pylist()), "<i4").reshape(-1, WORDS)
                for group in connected(_distances(seen, seen) <= MAX_BITS):
                    members = np.unique(reps[group])
                    if len(members) > 1:
                        out.append(members)
            yield pa.record_batch([pa.array(out, pa.list_(pa.int64()))], names=["members"])

    gathered = reduce(DataFrame.union, held).groupBy("node").agg(F.collect_list(F.struct("rep", "seen")).alias("r"))
    found = stash(gathered.select("r").mapInArrow(lean(run), "members array<long>").distinct(), "candidates")
    discard(*used)
    return found, crowd


def apart(crowd: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links between images of one node that are in different components, by all such pairs.

    A node is cut into blocks, and each two blocks, or one with itself, are compared in a group of their own.
    crowd: node, rep; images: rep, corners; found: node, component of the links so far."""

    def run(batches):
        for b in batches:
            out: tuple[list, list] = ([], [])
            for row in b.column(0):
                ids, block, component = (row.values.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "block", "component"))
                order = np.argsort(block, kind="stable")
                raw = row.values.field("corners").to_pylist()
                first = int((block == block.min()).sum())
                label = np.unique(component[order], return_inverse=True)[1]
                # a group of two blocks compares across them only; one whose other block is empty has nothing to compare
                if first == len(ids) and not row.values.field("own")[0].as_py():
                    continue
                for i, j in linked([corners(raw[k]) for k in order], label, first if first < len(ids) else None):
                    out[0].append(ids[order[i]])
                    out[1].append(ids[order[j]])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    at = found.select(F.col("node").alias("rep"), "component")
    rows = crowd.join(at, "rep", "left").select("node", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    blocks = F.ceil(F.col("size") / (LEAF / 2)).cast("int")
    rows = rows.join(open_.select("node", "size"), "node").select("node", "rep", "component", F.pmod(F.xxhash64("node", "rep"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.withColumn("other", other).select("node", "rep", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    each = pairs.join(images.select("rep", "corners"), "rep")
    own = (F.col("x") == F.col("y")).alias("own")
    gathered = each.groupBy("node", "x", "y").agg(F.collect_list(F.struct("rep", "block", "component", "corners", own)).alias("r"))
    return gathered.select("r").mapInArrow(lean(run), "a long, b long")


def copies(rows: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, n_features, component_id, copied of each row of rows.

    component_id is the smallest id that copies reach, the row's own included; copied: another row is in the component.
    Equal images are copies of each other, also those without corners. A media value that is null or no 8-bit PGM image
    has 0 features and no copies. Rows that share an id are one image; rows with a null id take no part.
    """
    found = stash(describe(rows, id_col, media_col), "features")
    known = found.where("id is not null and digest is not null")
    classes = stash(known.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "media-classes")
    own = stash(spread(known.select("id", "digest", F.col("n").alias("n_features")), classes.select("digest", "rep"), "digest", "id"), "media-own")
    others = own.where("id <> rep").select("id", "digest").distinct()
    images = known.where(F.col("n") >= MIN_VOTES).join(others, ["id", "digest"], "left_anti")
    if not own.where("id = rep").groupBy("digest").count().where("count > 1").isEmpty():  # rows that repeat id and image
        images = images.dropDuplicates(["digest"])
    images = images.select(F.col("id").alias("rep"), "n", "corners")

    def run(batches):
        for b in batches:
            out: tuple[list, list] = ([], [])
            for row in b.column(0):
                ids = row.values.field("rep").to_pylist()
                for i, j in linked([corners(x) for x in row.values.field("corners").to_pylist()]):
                    out[0].append(ids[i])
                    out[1].append(ids[j])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    met, crowd = candidates(images)
    gathered = images.join(once(met), "rep").groupBy("cluster").agg(F.collect_list(F.struct("rep", "corners")).alias("r"))
    several = own.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("id")
    shared = own.join(several, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    edges = gathered.select("r").mapInArrow(lean(run), "a long, b long").union(shared)
    if crowd is not None:
        edges = stash(edges, "links")
    links = components(edges)
    if crowd is not None:
        links = components(edges.union(apart(crowd, images, links)))
    of_class = stash(classes.join(links, F.col("rep") == F.col("node"), "left").select("digest", "last", F.coalesce("component", "rep").alias("component_id")), "media-found")
    last = of_class.groupBy("component_id").agg(F.max("last").alias("end"))
    of_class = spread(of_class, last, "component_id", "digest").select("digest", "component_id", (F.col("end") > F.col("component_id")).alias("copied"))
    none = F.col("digest").isNull() | F.col("id").isNull()
    out = spread(own.select("id", "n_features", "digest"), of_class, "digest", "id").select("id", "n_features", "component_id", "copied")
    out = out.union(found.where(none).select("id", "n", "id", F.lit(False)))
    return out.withColumnRenamed("id", id_col)


def linked(images: list[np.ndarray], label: np.ndarray | None = None, first: int | None = None):
    """Pairs that span what copies connect among some images, by their corners. Images of one label are connected already;
    first: only pairs of the first images, as many, with the others."""
    start = first or 0
    everything, sizes = np.concatenate(images[start:]), np.array([len(x) for x in images])
    starts = np.cumsum(sizes[start:]) - sizes[start:]
    label = np.arange(len(images)) if label is None else label.copy()
    for i in range(len(images) - 1 if first is None else first):
        if (label[start:] == label[i]).all():
            continue
        met = np.zeros((len(images) - start, len(images[i])), bool)  # which corners of i match some corner of each other image
        for at, near in _blocks(images[i], everything):
            met[:, at : at + len(near)] = np.logical_or.reduceat(near <= MAX_BITS, starts, axis=1).T
        for j in start + np.flatnonzero((met.sum(1) >= np.maximum(MIN_VOTES, MIN_SHARE * np.minimum(sizes[start:], sizes[i]))) & (label[start:] != label[i])):
            if j > i and label[j] != label[i] and is_copy(images[i], images[j]):
                yield i, int(j)
                label[label == label[j]] = label[i]
