"""N-gram Jaccard join: an index of rarest-first prefixes in skippable blocks, and answers derived from similar sets.

Sets are the distinct shingle hashes of documents; documents with the same
set are one set. A set is indexed under its rarest shingles only, so many
that two sets which link must share one. The lists of the index are cut into
blocks by size and position, so whole blocks that cannot reach the needed
overlap are skipped. Every set of a list is first compared with one pivot;
sets that link to the same pivot are one component and are not compared with
each other, and for sets that do not link the known overlaps with a pivot
bound the overlap with each of the pivot's other sets. Sets meet as short sets,
a byte or so a shingle; whole sets only where these leave the answer open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import components
from .shared import BROADCAST_ROWS, HOT_LEAST, discard, split_join, stored
from .words import shingle_sets, small_batches

WIDTH = 4
#: Sets link if NUM / DEN of their union, at least, is shared.
NUM, DEN = 85, 100
#: The heavy shingles are those in at least a millionth of all postings, so there are a million at most.
HEAVY_PARTS = 1_000_000
HEAVY_LEAST = 16
#: Bytes of text whose shingles a task makes at once.
TEXT_BYTES = 1 << 20
#: Shingles that a task counts together, and how often one must be met there to be reported.
COUNTED = 1_000_000
MET = 2
#: Sets in one part of a heavy shingle's list, and in one block.
LIST_PART = 1000
#: Sets outside the main component that one task compares with one part of a list.
PROBES = 4000
BLOCK = 256
#: Stars are tried again while one in so many links; what they leave is matched list by list either way.
STAR_YIELD = 10
#: How many times as many pairs of each component the next round tries.
TRY_MORE = 4
#: Bits of a set's sketch.
SKETCH_BITS = 512
#: Cells a shingle, at least, into which a short set divides all hashes.
CELLS = 32
LISTS = ["token", "part", "sid", "size", "place", "pivot", "pivot_size", "pivot_place"]
NO_ID = -(2**63)


def set_ids(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit identity of each set; two of n different sets share one with probability n * n / 2**65."""
    return np.array([xxhash.xxh3_64_intdigest(runs[a:b]) for a, b in zip(at[:-1], at[1:])], np.uint64).view(np.int64)


def describe(width: int):
    """Pass 1 over (id, text): rows of kind 0 with id, set and size; of kind 1 with shingles met often."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        tokens.sort()
        edges = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
        n = np.diff(edges)
        often = n >= MET
        token = tokens[edges[:-1][often]].view(np.int64)
        return batch(np.ones(len(token), np.int32), token, token, n[often])

    def batch(kind, doc, sid, n) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in (kind, doc, sid, n)], ["kind", "id", "sid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        for rows in small_batches(batches, "text", TEXT_BYTES):
            runs, at = shingle_sets(rows.column("text"), width)
            sizes = np.diff(at)
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            yield batch(np.zeros(len(ids), np.int32), ids, set_ids(runs, at), sizes)
            parts.append(runs)
            held += len(runs)
            if held >= COUNTED:
                yield counted(parts)
                held, parts = 0, []
        if held:
            yield counted(parts)

    return run


class Heavy:
    """The heavy shingles with their counts."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.tokens >> np.uint64(44)).astype(np.int64)] = True

    def find(self, runs: np.ndarray) -> np.ndarray:
        """The count of each shingle if it is heavy, else 0."""
        out = np.zeros(len(runs), np.int64)
        maybe = np.flatnonzero(self.marks[(runs >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, runs[maybe]), len(self.tokens) - 1)
            out[maybe] = np.where(self.tokens[at] == runs[maybe], self.counts[at], 0)
        return out


def post(width: int, num: int, den: int, sent):
    """Pass 2 over texts: (token, part, sid, size, place) for the prefix of each set, rare shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(*sent.value)
        seen: set[int] = set()
        for rows in small_batches(batches, "text", TEXT_BYTES):
            runs, at = shingle_sets(rows.column("text"), width)
            sids, counts = set_ids(runs, at), heavy.find(runs)
            keep, lengths, own = [], [], []
            for i, sid in enumerate(sids.tolist()):
                a, b = int(at[i]), int(at[i + 1])
                if a == b or sid in seen:
                    continue
                seen.add(sid)
                take = (b - a) + (-num * (b - a) // den) + 1  # size - ceil(size * num / den) + 1
                chosen = np.arange(a, b)
                part = counts[a:b]
                if part.any():
                    chosen = chosen[np.argsort(part, kind="stable")]  # light ones stay in hash order
                keep.append(chosen[:take])
                lengths.append(take)
                own.append(i)
            if not keep:
                continue
            at_token, n = np.concatenate(keep), np.array(lengths)
            of = np.repeat(np.array(own), n)
            place = np.arange(len(at_token)) - np.repeat(np.cumsum(n) - n, n)
            sid = sids[of]
            parts = -(-counts[at_token] // LIST_PART)
            part = np.where(parts > 1, (sid.view(np.uint64) >> np.uint64(20)).astype(np.int64) % np.maximum(parts, 1), 0)
            part = np.where(counts[at_token] > 0, part + 1, 0)  # 0: a light shingle, whose list is whole
            yield pa.record_batch(
                [
                    pa.array(runs[at_token].view(np.int64)),
                    pa.array(part.astype(np.int32)),
                    pa.array(sid),
                    pa.array(np.diff(at)[of].astype(np.int32)),
                    pa.array(place.astype(np.int32)),
                ],
                ["token", "part", "sid", "size", "place"],
            )

    return run


def possible(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes a and b may link whose first common shingle is at places i and j."""
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & ((den + num) * np.minimum(a - i, b - j) >= num * (a + b))


def shared_lists(num: int, den: int):
    """Postings sorted by (token, part, sid) to those with a possible partner in their list, and the list's first set as pivot.

    Lists of heavy shingles come in parts and stay whole. A list may go on in
    the next batch, so the last one of a batch waits.
    """
    names = LISTS[:5]

    def lists(columns: list[np.ndarray]) -> pa.RecordBatch:
        head = _breaks(columns[0], columns[1])
        fresh = np.concatenate(([True], head | (columns[2][1:] != columns[2][:-1])))
        token, part, sid, size, place = columns = [x[fresh] for x in columns]
        starts = np.flatnonzero(np.concatenate(([True], _breaks(token, part))))
        n = np.diff(np.append(starts, len(token)))
        stay = part > 0
        wide = size.astype(np.int64), place.astype(np.int64)
        two = starts[(n == 2) & (part[starts] == 0)]
        two = two[possible(wide[0][two], wide[1][two], wide[0][two + 1], wide[1][two + 1], num, den)]
        stay[two] = stay[two + 1] = True
        many = (n > 2) & (part[starts] == 0)
        for a, b in zip(starts[many].tolist(), (starts + n)[many].tolist()):
            own = wide[0][a:b], wide[1][a:b]
            for low in range(0, b - a, BLOCK):
                cut = slice(low, low + BLOCK)
                ok = possible(own[0][cut, None], own[1][cut, None], own[0][None], own[1][None], num, den)
                ok[np.arange(ok.shape[0]), low + np.arange(ok.shape[0])] = False
                stay[a + low : a + low + ok.shape[0]] = ok.any(axis=1)
        columns = [x[stay] for x in columns]
        starts = np.concatenate(([True], _breaks(columns[0], columns[1])))[: len(columns[0])]
        first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
        return pa.record_batch([pa.array(x) for x in [*columns, *[x[first] for x in columns[2:]]]], LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None
        for rows in batches:
            now = [rows.column(x).to_numpy(zero_copy_only=False) for x in names]
            if waiting is not None:
                now = [np.concatenate(x) for x in zip(waiting, now)]
            new = np.flatnonzero(_breaks(now[0], now[1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            waiting = [x[cut:] for x in now]
            if cut:
                yield lists([x[:cut] for x in now])
        if waiting is not None and len(waiting[0]):
            yield lists(waiting)

    return run


def sketch(tokens: np.ndarray) -> bytes:
    """For each of SKETCH_BITS classes of shingles, whether the set has an odd number of them.

    Where two sketches differ the sets differ, so the number of such bits is
    no larger than the sets' symmetric difference.
    """
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sketch_words(column: pa.Array) -> np.ndarray:
    """A column of sketches as rows of 64-bit words."""
    column = column.cast(pa.binary(SKETCH_BITS // 8))
    raw = np.frombuffer(column.buffers()[1], np.uint8)
    start = column.offset * (SKETCH_BITS // 8)
    return raw[start : start + len(column) * (SKETCH_BITS // 8)].view(np.uint64).reshape(len(column), -1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of differing bits of sketches."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the difference that the sketches prove still allows a link; ``sizes`` are the sums of both sizes."""
    return allows(difference(a, b), sizes, num, den)


def allows(apart: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets whose sizes add up to ``sizes`` may link if they differ in ``apart`` shingles at least."""
    return apart * (den + num) <= sizes * (den - num)


def cell_bits(size: int) -> int:
    """The leading bits of a hash that name its cell in a short set of this size."""
    return (size * CELLS).bit_length()


def short_set(tokens: np.ndarray) -> bytes:
    """The cells of ascending shingle hashes, as gaps: a gap is a byte 255 for each 255 in it, then a byte for the rest."""
    cells = (tokens >> np.uint64(64 - cell_bits(len(tokens)))).astype(np.int64)
    gaps = np.diff(cells, prepend=0)
    more = gaps // 255
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def cells_of(packed) -> np.ndarray:
    """The cells that ``short_set`` packed."""
    gaps = np.frombuffer(packed, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def shared_bounds(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The most and the least that two sets share, from their cells.

    Shared shingles share a cell, so the most is certain. Others that meet in
    a cell by chance are of a Poisson number of known mean; more than eight
    times the mean and 20 have a probability below 2**-64.
    """
    bits = [cell_bits(len(x)) for x in (a, b)]
    a, b = (x >> (k - min(bits)) for x, k in zip((a, b), bits))
    (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    most = int(np.minimum(n[i], m[j]).sum())
    mean = (len(a) - most) * (len(b) - most) / 2 ** min(bits)
    return most, max(most - 20 - int(np.ceil(8 * mean)), 0)


def set_rows(width: int, whole: bool = False):
    """Texts to (sid, size, sketch, cells), or to (sid, tokens): the packed shingle hashes of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in small_batches(batches, "text", TEXT_BYTES):
            runs, at = shingle_sets(rows.column("text"), width)
            sids = pa.array(set_ids(runs, at))
            each = [runs[a:b] for a, b in zip(at[:-1], at[1:])]
            if whole:
                yield pa.record_batch([sids, pa.array([v.tobytes() for v in each], pa.binary())], ["sid", "tokens"])
                continue
            packed = [pa.array([f(v) for v in each], pa.binary()) for f in (sketch, short_set)]
            yield pa.record_batch([sids, pa.array(np.diff(at)), *packed], ["sid", "size", "sketch", "cells"])

    return run


OVERLAPS = "x long, y long, x_size long, y_size long, shared long, least long"


def _compared(kind: str, count):
    """(x, y, x_<kind>, y_<kind>) to OVERLAPS; ``count`` gives both sizes, the most and the least that is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [count(a.as_buffer(), b.as_buffer()) for a, b in zip(rows.column(f"x_{kind}"), rows.column(f"y_{kind}"))]
            found = np.array(found, np.int64).reshape(-1, 4)
            yield pa.record_batch(
                [rows.column("x"), rows.column("y"), *[pa.array(v) for v in found.T]], ["x", "y", "x_size", "y_size", "shared", "least"]
            )

    return run


def _by_cells(a, b) -> tuple[int, int, int, int]:
    a, b = cells_of(a), cells_of(b)
    return len(a), len(b), *shared_bounds(a, b)


def _by_tokens(a, b) -> tuple[int, int, int, int]:
    a, b = (np.frombuffer(v, np.uint64) for v in (a, b))
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return len(a), len(b), shared, shared


near_overlaps, overlaps = _compared("cells", _by_cells), _compared("tokens", _by_tokens)


def linked(shared: Column, x_size: Column, y_size: Column, num: int, den: int) -> Column:
    return den * shared >= num * (x_size + y_size - shared)


def reaches(shared: Column, x_size: Column, y_size: Column, num: int, den: int) -> Column:
    """Whether an overlap of at most ``shared`` may be enough."""
    return (den + num) * shared.cast("bigint") >= num * (x_size + y_size)


def room(x_size: Column, x_place: Column, y_size: Column, y_place: Column) -> Column:
    """The most that two sets share if their first common shingle is at these places."""
    return F.least(x_size - x_place, y_size - y_place)


def match_lists(num: int, den: int):
    """Rows sorted by (token, chunk, probe, size, place) to the pairs (x, y, x_size, y_size, apart) of one list that may link.

    Entries are cut into blocks of BLOCK in the order of size and place. A
    probe skips a block whose sizes and first place rule out the needed
    overlap; in the other blocks each entry is tried by size, place and sketch.
    """

    def group(columns: dict[str, np.ndarray], a: int, m: int, b: int) -> list[np.ndarray]:
        sid, comp, size, place, marks = (columns[k] for k in ("sid", "comp", "size", "place", "sketch"))
        out = []
        p_size, p_place = size[m:b, None], place[m:b, None]
        for low in range(a, m, BLOCK):
            high = min(low + BLOCK, m)
            most, least, first = size[high - 1], size[low], place[low:high].min()
            fits = (den * np.minimum(size[m:b], most) >= num * np.maximum(size[m:b], least)) & (
                (den + num) * np.minimum(size[m:b] - place[m:b], most - first) >= num * (size[m:b] + least)
            )
            p = np.flatnonzero(fits)
            if not len(p):
                continue
            x_size, y_size = p_size[p], size[None, low:high]
            ok = possible(x_size, p_place[p], y_size, place[None, low:high], num, den)
            ok &= comp[m + p][:, None] != comp[None, low:high]
            i, j = np.nonzero(ok)
            i, j = m + p[i], low + j
            apart = difference(marks[i], marks[j])
            stay = allows(apart, size[i] + size[j], num, den)
            out.append(np.stack([sid[i[stay]], sid[j[stay]], size[i[stay]], size[j[stay]], apart[stay]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "chunk", "probe", "sid", "comp", "size", "place", "sketch")
        waiting: dict[str, np.ndarray] | None = None

        def matched(now: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
            head = np.flatnonzero(np.concatenate(([True], _breaks(now["token"][:n], now["chunk"][:n]))))
            ends = np.append(head[1:], n)
            probes = np.concatenate(([0], np.cumsum(now["probe"][:n])))
            middle = ends - (probes[ends] - probes[head])
            useful = np.flatnonzero((middle > head) & (ends > middle))
            found = [x for k in useful for x in group(now, int(head[k]), int(middle[k]), int(ends[k]))]
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((5, 0), np.int64)
            return pa.record_batch([pa.array(x) for x in pairs], ["x", "y", "x_size", "y_size", "apart"])

        for rows in batches:
            now = {k: rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in names[:-1]}
            now["sketch"] = sketch_words(rows.column("sketch"))
            if waiting is not None:
                now = {k: np.concatenate((waiting[k], now[k])) for k in names}
            cut = np.flatnonzero(_breaks(now["token"], now["chunk"]))
            n = int(cut[-1]) + 1 if len(cut) else 0
            if n:
                yield matched(now, n)
            waiting = {k: now[k][n:] for k in names}
        if waiting is not None and len(waiting["token"]):
            yield matched(waiting, len(waiting["token"]))

    return run


def _breaks(token: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    return (token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])


class Join:
    """The state of one join: the sets, the pairs that were tried, the verified overlaps."""

    def __init__(self, sets: DataFrame, whole, num: int, den: int):
        self.sets, self.whole, self.num, self.den = sets, whole, num, den
        self.answers: DataFrame | None = None
        self.tried: DataFrame | None = None

    def with_sets(self, pairs: DataFrame, n: int, sets: DataFrame, field: str) -> DataFrame:
        """``n`` pairs (x, y) with this field of both sets; a set in very many pairs is split."""
        for side in "xy":
            ids = pairs.select(F.col(side).alias("sid"))
            own = sets.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "sid", "left_semi")
            own = own.select(F.col("sid").alias(side), F.col(field).alias(f"{side}_{field}"))
            counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")) if n >= HOT_LEAST else None
            pairs = split_join(pairs, own, side, counts, F.struct("x", "y"), "inner")
        return pairs.select("x", "y", f"x_{field}", f"y_{field}")

    def verify(self, pairs: DataFrame, n: int) -> int:
        """Try ``n`` new pairs (x, y): by short sets, then by whole sets where these leave it open. The number of those that link."""
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        near = stored(self.with_sets(pairs, n, self.sets, "cells").mapInArrow(near_overlaps, OVERLAPS))
        may = linked(F.col("shared"), F.col("x_size"), F.col("y_size"), self.num, self.den)
        seen = near.agg(F.count_if(self.links()).alias("sure"), F.count_if(may).alias("may")).first()
        new, found, n = near, seen["sure"], seen["may"] - seen["sure"]
        if n:
            left = stored(near.where(may & ~self.links()).select("x", "y"))
            whole = stored(self.whole(left.select(F.explode(F.array("x", "y")).alias("sid")).distinct(), 2 * n))
            exact = stored(self.with_sets(left, n, whole, "tokens").mapInArrow(overlaps, OVERLAPS))
            discard(left, whole)
            new = near.where(~may | self.links()).union(exact)
            found += exact.where(self.links()).count()
        self.answers = new if self.answers is None else self.answers.union(new)
        return found

    def links(self) -> Column:
        return linked(F.col("least"), F.col("x_size"), F.col("y_size"), self.num, self.den)

    def components(self) -> DataFrame:
        return stored(components(self.answers.where(self.links()).select("x", "y")))

    def untried(self, pairs: DataFrame) -> DataFrame:
        known = self.tried.union(self.tried.select("y", "x"))
        return pairs.join(known, ["x", "y"], "left_anti")

    def underived(self, pairs: DataFrame) -> DataFrame:
        """Pairs (x, y, x_size, y_size) whose answer does not follow from a pivot that x and y were both compared with.

        With |x & p| and |y & p| known, |x & y| is at most |x & p| + |y - p|.
        """
        near = self.answers.select(F.col("x").alias("y"), F.col("y").alias("p"), (F.col("x_size") - F.col("least")).alias("y_rest"))
        mine = self.answers.select("x", F.col("y").alias("p"), F.col("shared").alias("x_shared"))
        none = (
            pairs.join(near, "y")
            .join(mine, ["x", "p"])
            .where(~reaches(F.col("x_shared") + F.col("y_rest"), F.col("x_size"), F.col("y_size"), self.num, self.den))
            .select("x", "y")
            .distinct()
        )
        return pairs.join(none, ["x", "y"], "left_anti")

    def possible(self, x: str, y: str) -> Column:
        """Whether sets that meet in a list as <x>_size, <x>_place and <y>_size, <y>_place may link."""
        a, b, i, j = (F.col(k) for k in (f"{x}_size", f"{y}_size", f"{x}_place", f"{y}_place"))
        return (self.den * F.least(a, b) >= self.num * F.greatest(a, b)) & reaches(room(a, i, b, j), a, b, self.num, self.den)


def labelled(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The lists that still hold more than one component, with each set's component."""
    comps = comps.select(F.col("node").alias("sid"), "comp")
    rows = lists.join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    live = rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    return rows.join(live, "token", "left_semi")


def favourite(met: DataFrame) -> DataFrame:
    """For each x of (x, y, n), the y that it meets in most lists."""
    return met.groupBy("x").agg(F.min(F.struct(-F.col("n"), "y")).getField("y").alias("y"))


def meetings(pairs: DataFrame) -> DataFrame:
    """(x, y, n): in how many lists the pairs (x, y) meet."""
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def link_lists(lists: DataFrame, sets: DataFrame, whole, num: int, den: int) -> DataFrame:
    """(node, comp) of all sets that link with another; ``lists`` as from ``shared_lists``.

    ``whole`` gives (sid, tokens) for a table of at most so many sid.
    """
    state = Join(sets, whole, num, den)
    stars = lists.where("sid <> pivot").select(
        F.col("sid").alias("x"), F.col("pivot").alias("y"), F.col("size").alias("x_size"), F.col("place").alias("x_place"),
        F.col("pivot_size").alias("y_size"), F.col("pivot_place").alias("y_place"),
    )
    pairs = stored(favourite(meetings(stars.where(state.possible("x", "y")))))
    state.verify(pairs, pairs.count())
    comps = state.components()
    lists, was = lists.select("token", "sid", "size", "place"), lists
    while True:
        now = stored(labelled(lists, comps))
        discard(was)
        lists = was = now
        # The largest component of each list, and its set of least place.
        main = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = main.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), "comp")).alias("main"))
        main = main.select("token", "n", (-F.col("main.col1")).alias("most"), F.col("main.comp").alias("main"))
        main = stored(main)
        rows = split_join(lists, main.select("token", "main"), "token", main.select("token", "n"), F.col("sid"), "inner")
        strays, inner = stored(rows.where("comp <> main")), rows.where("comp = main")
        best = inner.groupBy("token").agg(F.min(F.col("place").cast("bigint") * 2**31 + F.col("size")).alias("key"))
        pivots = inner.join(best, "token").where(F.col("place").cast("bigint") * 2**31 + F.col("size") == F.col("key"))
        pivots = pivots.groupBy("token").agg(F.min("sid").alias("y"), F.min("size").alias("y_size"), F.min("place").alias("y_place"))
        stars = strays.select("token", F.col("sid").alias("x"), F.col("size").alias("x_size"), F.col("place").alias("x_place"))
        stars = split_join(stars, pivots, "token", main.select("token", "n"), F.col("x"), "inner").where(state.possible("x", "y"))
        pairs = stored(favourite(state.untried(meetings(stars))))
        lists = lists.drop("comp")
        tried = pairs.count()
        found = state.verify(pairs, tried) if tried else 0
        if found:
            comps, old = state.components(), comps
            discard(old)
        if found * STAR_YIELD < tried or not tried:
            break
        discard(main, strays)

    # What is left: sets outside their list's main component against all sets of the list.
    marks = sets.select("sid", "sketch").dropDuplicates(["sid"])
    marked = stored(rows.join(marks, "sid"))
    # A long list is a grid of parts of its entries by parts of its probes.
    pieces = {"across": F.col("n") / LIST_PART, "down": (F.col("n") - F.col("most")) / PROBES}
    rows = marked.join(main.select("token", *[F.ceil(x).cast("int").alias(k) for k, x in pieces.items()]), "token")
    part = lambda k: F.pmod(F.xxhash64("sid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    entries = rows.select("*", F.lit(0).alias("probe"), part("across").alias("i"), every("down").alias("j"))
    probes = rows.where("comp <> main").select("*", F.lit(1).alias("probe"), every("across").alias("i"), part("down").alias("j"))
    chunk = (F.col("i") * F.col("down") + F.col("j")).alias("chunk")
    both = [x.select("token", chunk, "probe", "sid", "comp", "size", "place", "sketch") for x in (entries, probes)]
    both = both[0].union(both[1]).repartition("token", "chunk").sortWithinPartitions("token", "chunk", "probe", "size", "place")
    met = both.mapInArrow(match_lists(num, den), "x long, y long, x_size long, y_size long, apart long").distinct()
    # A pair is an answer's or open by what is known of it and a pivot, before it is written.
    found = stored(state.untried(met))
    discard(marked, main, was, strays)
    x, y = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    left = stored(state.underived(found).select(x, y, "apart").distinct())
    discard(found)
    # One link joins a component to another, so each one's closest pair is tried first, then more and more of them.
    take, held = 1, left
    while True:
        between = left
        for side, name in (("x", "a"), ("y", "b")):
            own = comps.select(F.col("node").alias(side), F.col("comp").alias(name))
            between = between.join(own, side, "left").withColumn(name, F.coalesce(name, side))
        between = stored(state.untried(between.where("a <> b")))
        both = between.select("x", "y", "apart", F.explode(F.array("a", "b")).alias("comp"))
        closest = Window.partitionBy("comp").orderBy("apart", "x", "y")
        both = both.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= take)
        pairs = stored(both.select("x", "y").distinct())
        n = pairs.count()
        if not n:
            return comps
        if state.verify(pairs, n):
            comps, old = state.components(), comps
            discard(old)
        # What one round has tried or joined needs no other look.
        discard(held)
        left, held = between.drop("a", "b"), between
        take *= TRY_MORE


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, width: int = WIDTH
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Texts are lower-cased (A-Z) and cut at ASCII white space. Two documents
    link when den * |intersection| >= num * |union| of their sets of distinct
    ``width``-word shingles; a text with fewer words has its whole sequence as
    its one shingle. Null and empty texts have no shingles and link with
    nothing. ``component_id`` is the smallest id that links reach. Null ids
    come last: they never give a component its id unless all its ids are null.
    Repeated rows are equal sets. Other columns are not read.

    The order of shingles in an index decides what is compared, never what
    links. Heavy shingles come last in it; a task reports what it meets MET
    times among COUNTED shingles.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    found = stored(texts.mapInArrow(describe(width), "kind int, id long, sid long, n long"), "kind")
    described = found.where("kind = 0").select("id", "sid", F.col("n").alias("size"))
    total = described.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    heavy = found.where("kind = 1").groupBy(F.col("sid").alias("token")).agg(F.sum("n").alias("n"))
    heavy = heavy.where(F.col("n") >= max(HEAVY_LEAST, -(-total // HEAVY_PARTS))).toPandas()
    sent = spark.sparkContext.broadcast((heavy["token"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)))

    postings = texts.select("text").mapInArrow(
        post(width, num, den, sent), "token long, part int, sid long, size int, place int"
    )
    postings = postings.repartition("token", "part").sortWithinPartitions("token", "part", "sid")
    lists = stored(
        postings.mapInArrow(shared_lists(num, den), "token long, part int, sid long, size int, place int, pivot long, pivot_size int, pivot_place int")
    )

    classes = stored(described.where("size > 0").groupBy("sid").agg(F.min(F.when(F.col("id") > NO_ID, F.col("id"))).alias("first"), F.count(F.lit(1)).alias("n")))
    wanted = lists.select("sid").distinct().join(classes, "sid").select(F.coalesce("first", F.lit(NO_ID)).alias("id"))
    wanted = stored(wanted.distinct())
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = stored(texts.join(wanted, "id", "left_semi").select("text").mapInArrow(set_rows(width), "sid long, size long, sketch binary, cells binary"))

    def whole(sids: DataFrame, n: int) -> DataFrame:
        ids = classes.join(sids, "sid", "left_semi").select(F.coalesce("first", F.lit(NO_ID)).alias("id"))
        own = texts.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "id", "left_semi").select("text")
        return own.mapInArrow(set_rows(width, whole=True), "sid long, tokens binary")

    comps = link_lists(lists, sets, whole, num, den).select(F.col("node").alias("sid"), "comp")
    grouped = stored(classes.join(comps, "sid"))
    ids = stored(grouped.groupBy("comp").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of_set = split_join(grouped.select("sid", "comp"), ids.select("comp", "component_id"), "comp", ids.select("comp", "n"), F.col("sid"), "inner")
    alone = classes.join(comps, "sid", "left_anti").select("sid", F.col("first").alias("component_id"))
    of_set = of_set.select("sid", "component_id").union(alone)
    named = split_join(described.where("size > 0"), of_set, "sid", classes.select("sid", "n"), F.col("id"), "inner")
    ident = F.when(F.col("id") > NO_ID, F.col("id"))
    rows = named.select(ident.alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
    return rows.union(described.where("size = 0").select(ident, "size", ident))
