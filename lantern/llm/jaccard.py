"""N-gram Jaccard join: an exact metric-space join of shingle sets.

Two metrics on finite sets serve: the size of the symmetric difference, and Jaccard distance. Documents that share
nothing are all at Jaccard distance 1, so document pivots alone would leave one region of everything. Hence:

1. The empty set is the first pivot. A set's distance from it is its size, so its Voronoi rings are bands of size; a set
   enters a lower ring as a guest if the triangle inequality lets it link with a set there.
2. In a ring whose links are T shingles apart at most, the universe of shingles is cut into more than T parts by hash.
   Differences spoil one part each, so linked sets are equal in some part: its content is a pivot, and the sets at
   distance 0 from it in that part are a region. How many such pivots a set must share with others, if it has a
   link at all, follows from its size; sets that share fewer leave before any set is moved.
3. Inside a region documents are pivots, as many as its size asks for: members are measured against them exactly. Those
   that share the most with others come first, so that a text with many near copies is their pivot although the copies are
   too far from each other. The nearest of all pivots that a member has met, in whichever region, is its home; a cell has
   those at home with a pivot, and as guests all who share a region with one of them, where the triangle inequality does not
   rule out a link. So the many regions that a group of near copies shares become a cell or two. A region whose members
   are at home in more than HOMES cells is a cell itself, so that a member never enters more than so many from a region.
4. Cells are regions again, with pivots anew, until they are known to be one component, or fit a task: there members
   are pivots in turn, each for all members of other components. A cell that pivots don't split any more goes to tasks in
   blocks, each with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.llm.common import caches_of, components, discard, free_names, fresh_dir, partitions, release, small_batches, written

#: ASCII white space to spaces, A-Z to a-z; other bytes of UTF-8 stay.
FOLDED = np.array([32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes that are hashed at once, about; a text goes whole, so a longer one takes more.
CHUNK = 1 << 18
#: The factor between the bounds of rings, and the spare parts of a ring as a share of the differences it allows.
RING, SPARE = 1.6, 6
#: Postings that a task sorts at once, and how many of one pivot it passes on in one piece.
RUN, HOT = 1 << 19, 32
#: Groups of pivots for each shuffle partition, and pieces that hot pivots are spread over.
GROUPS, SALTS = 4, 4096
#: Rounds of cells, and what a task holds of a cell, and a pivot of a region is there for: members, and their shingles.
ROUNDS, BLOCK, BLOCK_SHINGLES = 3, 2048, 1 << 21
#: Homes that the members of a region may have for it to be dealt to their cells; with more it stays whole, as a cell.
HOMES = 4
#: Bits of the screen for documents whose sets are wanted again.
SCREEN = 1 << 22
#: Two hashes of all columns of a row, which tell rows apart that share an id or have none.
ROW = ("_row_a", "_row_b")

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct 64-bit shingle hashes, sorted, of a column of texts.

    Words are hashed all at once: a polynomial in the bytes' random numbers, summed along the column; a word's value is
    the difference of two sums, times the inverse of the power at its start.
    """

    BYTE = _mix(np.arange(1, 257, dtype=U) * ODD)[FOLDED]

    def __init__(self, size: int):
        self.size = size
        self._grow(CHUNK)

    def _grow(self, n: int) -> None:
        inverse = U(pow(int(ODD), -1, 1 << 64))
        self.up, self.down = (np.cumprod(np.append(U(1), np.full(n, f)), dtype=U) for f in (ODD, inverse))

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The sets of texts that lie in data between the offsets at."""
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        inside = FOLDED[data] != 32
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin, end = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
        first[begin], last[end] = inside[begin], inside[end]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.BYTE[data] * self.up[: len(data)], out=sums[1:])
        words = _mix((sums[stop] - sums[start]) * self.down[start] + (stop - start).astype(U))
        k, n = self.size, len(words) - self.size + 1
        hashes = np.full(max(n, 0), k, U)
        for i in range(k):
            hashes = _mix(hashes * ODD + words[i : max(n, 0) + i])
        bound, out = np.searchsorted(start, at), []
        for a, z in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if z - a >= k:
                x = np.sort(hashes[a : z - k + 1])
                x = x[np.append(True, x[1:] != x[:-1])]
            else:
                x = np.full(int(z > a), z - a, U)
                for j in range(a, z):
                    x = _mix(x * ODD + words[j])
            out.append(x)
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
            out += self._chunk(data[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j
        return out


class Rings:
    """The rings around the empty set, and the parts of each, for links of percent or more."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> list[int]:
        """The ring that n shingles are at home in, then those that they enter as guests."""
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * RING)))
        home = int(np.searchsorted(self.low, n, side="right")) - 1
        out, r = [home], home - 1
        while r >= 0 and self.percent * n <= 100 * (self.low[r + 1] - 1):
            out.append(r)
            r -= 1
        return [r for r in out if self.apart(r)]

    def apart(self, ring: int) -> int:
        """How many shingles the sets of a link are apart at most, if the smaller is at home in the ring."""
        return (100 - self.percent) * (self.low[ring + 1] - 1) // self.percent

    def parts(self, ring: int) -> int:
        t = self.apart(ring)
        return t + 2 + t // SPARE

    def apart_from(self, ring: int, n: int) -> int:
        """The same for links of a set of n shingles in this ring."""
        most = self.low[ring + 1] - 1
        return (100 - self.percent) * (n + (100 * n // self.percent if n <= most else most)) // (100 + self.percent)


def postings(sets: list[np.ndarray], keys: list[bytes | None], percent: int, rings: Rings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pivot, guest) postings, and for each guest, a set in a ring: its number, its set's place, the pivots to share.

    Sets with so many empty parts that a link might share empty ones alone post their least shingles too: two such
    sets that link share one of those.
    """
    guests = [(i, r) for i, x in enumerate(sets) if len(x) for r in rings.of(len(x))]
    zero = np.zeros(0, U)
    if not guests:
        return zero, zero, zero, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.array([g[0] for g in guests])
    ring, size = np.array([g[1] for g in guests], U), np.array([len(sets[g[0]]) for g in guests])
    parts = np.array([rings.parts(r) for _, r in guests])
    number = _mix(np.array([int.from_bytes(keys[i][:8], "little") for i, _ in guests], U) + ring * ODD)
    flat, of = np.concatenate([sets[i] for i, _ in guests]), np.repeat(np.arange(len(guests)), size)
    # Sets are sorted and parts are ranges of hashes, so each part is one stretch.
    part = ((flat >> U(32)) * parts.astype(U)[of]) >> U(32)
    slot = (np.cumsum(parts) - parts)[of] + part.astype(np.int64)
    at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    owner = of[at]
    pivot = _mix(np.add.reduceat(_mix(flat + ring[of] * ODD), at) + part[at] * U(0xD6E8FEB86659FD93))
    empty = parts - np.bincount(owner, minlength=len(guests))
    share = parts - np.array([rings.apart_from(r, len(sets[i])) for i, r in guests]) - empty
    pivots, owners = [pivot], [owner]
    for g in np.flatnonzero(share <= 0):
        x = sets[place[g]]
        least = x[: len(x) - -(-percent * len(x) // 100) + 1]
        pivots.append(_mix(least + ring[g : g + 1] * ODD + U(1)))
        owners.append(np.full(len(least), g))
    return np.concatenate(pivots), number[np.concatenate(owners)], number, place, np.maximum(share, 1)


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *more)


def _lists(sets: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    values = np.concatenate([*sets, np.zeros(0, sets[0].dtype if sets else np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values.view(np.int64), kind))


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]


def _facts(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, key (128-bit hash of the set; null for an empty one), guests and the pivots each has to share, and ROW if texts has it."""
    more = [c for c in ROW if c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("jaccard")
        make, rings = Shingler(size), Rings(percent)
        for batch in batches:
            sets = make(batch.column(1))
            keys = _keys(sets)
            _, _, number, place, share = postings(sets, keys, percent, rings)
            bound = np.searchsorted(place, np.arange(len(sets) + 1))
            lists = [_lists([x[a:z] for a, z in zip(bound[:-1], bound[1:], strict=True)]) for x in (number, share)]
            cols = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), *lists, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "key", "guests", "shares", *more])

    schema = ["doc_id long, n long, key binary, guests array<long>, shares array<long>", *(f"{c} long" for c in more)]
    return texts.select("doc_id", "text", *more).mapInArrow(run, ", ".join(schema))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal values of a sorted array."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _shared(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(pivot, guest) for all pivots of two guests at least.

    Postings are shuffled once, packed: a task sorts RUN of them and sends each group of pivots one piece. A pivot
    of more than HOT guests in a run needs no company to be kept: its postings go to pieces of their own, and a mark
    tells its group. So a group gets HOT postings of a pivot from a run at most, however common it is.
    """
    groups = partitions(texts.sparkSession) * GROUPS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("jaccard")
        make, rings, task = Shingler(size), Rings(percent), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sent = 0

        def flush() -> pa.RecordBatch:
            nonlocal sent
            pivot, guest = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            order = np.argsort(pivot)
            pivot, guest = pivot[order], guest[order]
            at, n = _runs(pivot)
            plain, marks, rows = np.ones(len(pivot), bool), [], []
            for a, k in zip(at[n > HOT].tolist(), n[n > HOT].tolist(), strict=True):
                own = np.unique(guest[a : a + k])
                plain[a + 1 : a + k] = False  # one posting stays, in case that copies are all there is
                if len(own) > 1:
                    plain[a] = False
                    marks.append(a)
                    rows.append((-1 - (task * 64 + sent) % SALTS, np.full(len(own), pivot[a]), own, b""))
                    sent += 1
            hot, pivot, guest = pivot[np.array(marks, int)], pivot[plain], guest[plain]
            number = lambda x: (((x >> U(32)) * U(groups)) >> U(32)).astype(np.int64)
            bound, marked = (np.searchsorted(number(x), np.arange(groups + 1)) for x in (pivot, hot))
            for g in np.flatnonzero((bound[1:] > bound[:-1]) | (marked[1:] > marked[:-1])).tolist():
                rows.append((g, pivot[bound[g] : bound[g + 1]], guest[bound[g] : bound[g + 1]], hot[marked[g] : marked[g + 1]].tobytes()))
            cols = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (1, 2)), pa.array([r[3] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["piece", "pivots", "guests", "hot"])

        for batch in batches:
            sets = make(batch.column(0))
            held.append(postings(sets, _keys(sets), percent, rings)[:2])
            if sum(len(x[0]) for x in held) >= RUN:
                yield flush()
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        pivot, guest, hot = (np.frombuffer(b"".join(group.column(c).to_pylist()), U) for c in ("pivots", "guests", "hot"))
        order = np.argsort(pivot)
        pivot, guest = pivot[order], guest[order]
        if group.column("piece")[0].as_py() >= 0:
            at, n = _runs(pivot)
            keep = np.repeat((n > 1) | np.isin(pivot[at], hot), n)
            pivot, guest = pivot[keep], guest[keep]
        order = np.lexsort((guest, pivot))
        pivot, guest = pivot[order], guest[order]
        new = np.append(True, (pivot[1:] != pivot[:-1]) | (guest[1:] != guest[:-1])) if len(pivot) else np.zeros(0, bool)
        pivot, guest = pivot[new], guest[new]
        if group.column("piece")[0].as_py() >= 0:
            at, n = _runs(pivot)
            keep = np.repeat((n > 1) | np.isin(pivot[at], hot), n)
            pivot, guest = pivot[keep], guest[keep]
        return pa.table({"region": pa.array(pivot.view(np.int64)), "guest": pa.array(guest.view(np.int64))})

    sent = texts.select("text").mapInArrow(send, "piece int, pivots binary, guests binary, hot binary")
    return sent.groupBy("piece").applyInArrow(meet, "region long, guest long")


def _members(texts: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """rep, n, shingles (sorted, packed) of the wanted representatives (rep, key, least), from their texts.

    A bitmap of SCREEN bits of their ids, put together in the tasks, spares most other documents; the join is exact.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SCREEN))
    at = wanted.select(bit("least").alias("bit"))
    rows = at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()  # SCREEN bits
    screen = bytearray(SCREEN // 8 + 8192)
    step = 4096  # bytes of Spark's bitmaps; buckets begin with 1 and a bucket's first number is a multiple of its bits plus 1
    for r in rows:
        screen[r.bucket * step : (r.bucket + 1) * step] = r.bits
    shared = texts.sparkSession.sparkContext.broadcast(bytes(screen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("jaccard")
        bits, make = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little"), Shingler(size)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(1).to_numpy() * step * 8 + batch.column(2).to_numpy()] == 1))
            sets = make(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets], pa.int64()), pa.array(_keys(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["n", "key", "shingles"])

    known = texts.withColumn("bit", bit("doc_id"))
    known = known.select("text", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    screened = known.mapInArrow(run, "n long, key binary, shingles binary")
    return screened.join(wanted.select("rep", "key"), "key").dropDuplicates(["key"]).select("rep", "n", "shingles")


def _regions(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """region, rep, n, weight: the members of the regions with two members at least; of equal regions, one.

    A member's weight is the members, added up, of all regions that its guest shares. Guests that share fewer pivots than a link would make them share are left out, and the others enter the smallest regions
    only: as many as it takes to meet the other side of any link in one. Should two sets have a guest's number
    in common, both are members: regions may be too large, never too small.
    """
    guests = reps.select("rep", "n", F.explode(F.arrays_zip("guests", "shares")).alias("g")).select("rep", "n", F.col("g.guests").alias("guest"), F.col("g.shares").alias("share"))
    met = shared.groupBy("guest").agg(F.count(F.lit(1)).alias("met"))
    alive = written(guests.join(met, "guest").filter("met >= share"), "jaccard-alive")
    posted = written(shared.join(alive, "guest").select("region", "guest", "rep", "n", "share").distinct(), "jaccard-posted")
    discard(alive)
    # Of the pivots that a link shares, the one of the smallest region is among the first so many of either side's, by size.
    sizes = posted.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    own = W.partitionBy("guest", "rep")
    ranked = posted.join(sizes, "region").withColumn("place", F.row_number().over(own.orderBy("size", "region")))
    first = ranked.withColumn("all", F.count(F.lit(1)).over(own)).withColumn("weight", F.sum("size").over(own)).filter("place <= all - share + 1")
    out = written(first.select("region", "rep", "n", "weight"), "jaccard-first")
    discard(posted)
    posted, out = out, written(_once(out), "jaccard-regions")
    discard(posted)
    return out


def _once(members: DataFrame) -> DataFrame:
    """The rows of regions of two members at least; of regions with the same members, one."""
    facts = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.expr("bit_xor(xxhash64(7, rep))").alias("y"))
    once = facts.filter("n > 1").groupBy("n", "x", "y").agg(F.min("region").alias("region")).select("region")
    return members.join(once, "region").select(*members.columns)


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, d, linked of distinct pairs of representatives, from their whole sets."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("jaccard")
        for batch in batches:
            i, u = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                i[k] = len(np.intersect1d(x, y, assume_unique=True))
                u[k] = len(x) + len(y) - i[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(1 - i / u), pa.array(100 * i >= percent * u)], names=["a", "b", "d", "linked"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, d double, linked boolean")


def _distances(pairs: DataFrame, sets: DataFrame, stored: int, percent: int) -> DataFrame:
    """All of _measured(), written, in pieces of about four times as many pairs as there are stored sets.

    A pair moves a whole set, so the pairs of one exchange are bounded by the sets on disk, and each piece's exchange is
    released before the next begins.
    """
    spark = pairs.sparkSession
    pairs = written(pairs, "jaccard-pairs")
    pieces = max(1, -(-pairs.count() // max(1, 4 * stored)))
    if pieces == 1:
        out = written(_measured(pairs, sets, percent), "jaccard-distances")
    else:
        root = fresh_dir(spark, "jaccard-distances")
        for k in range(pieces):
            found = _measured(pairs.filter(F.pmod(F.xxhash64("b", "a"), F.lit(pieces)) == k), sets, percent)
            found.write.mode("append").parquet(root)
            release(spark)
        out = spark.read.schema(found.schema).parquet(root)
    discard(pairs)
    return out


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Documents link when 100 * |x & y| >= percent * |x | y| for their sets of size-word shingles; component_id is the
    smallest doc_id that links reach. Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A text of fewer words is one shingle; null, empty and blank texts have none and link with nothing. Rows that
    share an id share its component; a null id gets links but is nobody's component id unless alone (then null).
    Equal sets are joined once, by a representative, so copies cost a row each.
    """
    first, named = _parts(_texts(docs, id_col, text_col), size, percent)
    out = first.select("doc_id", "n", "key").join(named.select("key", "component"), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _pivots(region: DataFrame) -> DataFrame:
    """region, pivot: a pivot, and one more for each BLOCK members, so that cells may fit a task; without ordering a region.

    A region's members are dealt to as many slots, and each slot's member of the most weight is a pivot.
    """
    sizes = region.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    slots = 1 + F.floor(F.col("members") / BLOCK)
    dealt = region.join(sizes, "region").withColumn("slot", F.pmod(F.xxhash64(F.lit(3), "rep"), slots))
    return dealt.groupBy("region", "slot").agg(F.max_by("rep", F.struct("weight", "rep")).alias("pivot")).select("region", "pivot")


def _parts(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written rows of _facts(), and key, part, component for each set that is not empty.

    part is the component itself: of several components without ids, or of one repeated id, each has its own.
    """
    facts = written(_facts(texts, size, percent), "jaccard-docs")
    # A null id must not hide that a set has a document: it stands behind all others.
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")
    reps = facts.filter("n > 0").groupBy("key").agg(F.min(order)["doc_id"].alias("least"), F.first("n").alias("n"), F.first("guests").alias("guests"), F.first("shares").alias("shares"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "jaccard-reps")
    shared = written(_shared(texts, size, percent), "jaccard-shared")
    region = _regions(shared, reps)
    discard(shared)
    wanted = written(reps.select("rep", "key", "least").join(region.select("rep").distinct(), "rep", "left_semi"), "jaccard-wanted")
    members = written(_members(texts, size, wanted), "jaccard-members")
    stored = members.count()
    links, label, region = _split(region, members, stored, percent, None)
    for _ in range(ROUNDS - 1):
        # Only cells that no task holds are split further, and only as long as pivots do split them.
        sizes = region.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
        large = written(region.join(sizes.filter(F.col("members") > BLOCK).select("region"), "region"), "jaccard-large")
        n = large.count()
        if not n:
            break
        links, label, cells = _split(large, members, stored, percent, links)
        if cells.count() > 2 * n:
            break
        rest = region.join(large.select("region").distinct(), "region", "left_anti").select("region", "rep", "n", "weight")
        old, region = region, written(rest.union(cells.select(F.xxhash64(F.lit(n), "region").alias("region"), "rep", "n", "weight")), "jaccard-regions")
        for used in (old, large, cells):
            discard(used)
    links = written(links.union(_in_tasks(region, members, label, percent)), "jaccard-links")
    discard(members)
    part = components(links)
    least = reps.select("rep", "key", "least").join(part.withColumnRenamed("id", "rep"), "rep", "left")
    smallest = least.groupBy(F.coalesce("component_id", "rep").alias("part")).agg(F.min("least").alias("component"))
    return facts, least.withColumn("part", F.coalesce("component_id", "rep")).join(smallest, "part").select("key", "part", "component")


def _split(region: DataFrame, members: DataFrame, stored: int, percent: int, links: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measures the members of regions against their pivots: all links so far, the components they make, and the cells."""
    chosen = written(_pivots(region), "jaccard-pivots")
    met = region.join(chosen, "region").select("region", "rep", "pivot").filter("rep <> pivot")
    pairs = met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    dist = _distances(pairs, members, stored, percent)
    new = dist.filter("linked").select("a", "b")
    links = written(new if links is None else links.union(new), "jaccard-links")
    label = written(components(links), "jaccard-labels")
    cells = _cells(region, chosen, met, dist, 1 - percent / 100, label)
    for used in (chosen, dist):
        discard(used)
    return links, label, cells


def _cells(region: DataFrame, chosen: DataFrame, met: DataFrame, dist: DataFrame, radius: float, label: DataFrame) -> DataFrame:
    """The cells of the pivots: who is at home there, and guests, but for pairs that were measured.

    Two members of a region that are no pivots of it meet in the home of either. A guest of a pivot it was measured
    against comes in if its distance is within the radius of the distances that members at home have: else
    none of them can be within the radius of it. Where all at home are of its component, it does not come in. Regions and
    cells of one component need no further work. In a region of more than HOMES homes all meet in the region itself.
    """
    ends = [F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")]
    near = met.select("rep", "pivot", *ends).distinct().join(dist, ["a", "b"]).select("rep", "pivot", "d")
    near = written(near, "jaccard-near")
    home = near.groupBy("rep").agg(F.min(F.struct("d", "pivot")).alias("x")).select("rep", F.col("x.pivot").alias("cell"), F.col("x.d").alias("d"))
    home = written(home, "jaccard-homes")
    reach = home.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    inside = region.join(chosen.select("region", F.col("pivot").alias("rep")), ["region", "rep"], "left_anti")
    inside = inside.join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left").withColumn("label", F.coalesce("component_id", "rep"))
    inside = inside.join(home.select("rep", F.col("cell").alias("own")), "rep", "left").select("region", "rep", "n", "weight", "label", "own")
    inside = written(inside, "jaccard-inside")
    homes = inside.groupBy("region", F.col("own").alias("cell")).agg(F.min("label").alias("least"), F.max("label").alias("most"))
    homes_of = written(homes, "jaccard-inside-homes")
    mixed = homes_of.groupBy("region").agg(F.min("least").alias("x"), F.max("most").alias("y"), F.count(F.lit(1)).alias("homes")).filter("x <> y")
    whole = inside.join(mixed.filter(F.col("homes") > HOMES).select("region"), "region").select(F.xxhash64(F.lit(11), "region").alias("region"), "rep", "n", "label", "weight")
    homes = homes_of.join(mixed.filter(F.col("homes") <= HOMES).select("region"), "region").withColumnRenamed("region", "at")
    # A guest has nothing to find where all who are at home are of its own component.
    news = (F.col("own") == F.col("cell")) | (F.col("least") != F.col("label")) | (F.col("most") != F.col("label"))
    enter = inside.join(homes, (F.col("region") == F.col("at")) & (F.col("rep") != F.col("cell")) & news)
    enter = enter.groupBy("rep", "n", "cell", "label").agg(F.max("weight").alias("weight"))
    enter = enter.join(near.select("rep", F.col("pivot").alias("cell"), "d"), ["rep", "cell"], "left").join(reach, "cell")
    eps = 1e-9
    stays = enter.filter(F.col("d").isNull() | F.col("d").between(F.col("lo") - radius - eps, F.col("hi") + radius + eps))
    stays = written(stays.select(F.col("cell").alias("region"), "rep", "n", "label", "weight").union(whole), "jaccard-cells")
    mixed = stays.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("region")
    out = written(_once(stays.join(mixed, "region").select("region", "rep", "n", "weight")), "jaccard-regions")
    for used in (near, home, inside, homes_of, stays):
        discard(used)
    return out


def _links_in(percent: int):
    """Links between the members of side 0 and those of side 1, or among side 0 where there is no side 1: enough to join
    what they join, one after another as pivot for all members of other components."""

    def links(group: pa.Table) -> pa.Table:
        rep, label, side = (group.column(c).to_numpy() for c in ("rep", "label", "side"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("shingles")]
        n = np.array([len(x) for x in sets])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.cumsum(n) - n
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        label, seen, found = label.copy(), np.zeros(len(known), bool), []
        for k, i in enumerate(left.tolist()):
            rest = right if right is not left else right[k + 1 :]
            rest = rest[(label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            if not len(rest):
                continue
            seen[flat[at[i] : at[i] + n[i]]] = True
            size = n[rest]
            begin = np.cumsum(size) - size
            both = np.add.reduceat(seen[flat[np.repeat(at[rest] - begin, size) + np.arange(size.sum())]].astype(np.int64), begin)
            seen[flat[at[i] : at[i] + n[i]]] = False
            for j in rest[100 * both >= percent * (size + n[i] - both)].tolist():
                if label[j] != label[i]:
                    found.append((rep[i], rep[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return links


def _in_tasks(region: DataFrame, members: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """a, b: links that are left in regions, each joined in one task, or in blocks of bounded size, each block with each."""
    own = label.select(F.col("id").alias("rep"), "component_id")
    held = region.join(own, "rep", "left").select("region", "rep", "n", F.coalesce("component_id", "rep").alias("label"))
    sizes = held.groupBy("region").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = held.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side")
    held = held.select("rep", "label", "region", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), side)
    return held.join(members.select("rep", "shingles"), "rep").groupBy("region", "b0", "b1").applyInArrow(_links_in(percent), "a long, b long")


def _row_hashes(docs: DataFrame, names: list[str] | tuple[str, ...] = ROW) -> list[Column]:
    # Hashes pass over nulls, so which columns are null is hashed too.
    cols = [c for name in docs.columns for c in (docs[name].isNull(), docs[name])]
    return [F.xxhash64(F.lit(k), *cols).alias(name) for k, name in enumerate(names)]


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns: of the smallest id, null ids behind all others, then of the least row hash.

    Rows of null, empty and blank texts are copies of nothing and all stay. Repeated ids count as rows of their own, so
    copies under one id go too, and different texts under one id each have a component. Of rows equal in all columns,
    one stays. Texts are read whole; columns may have any names; an empty table gives an empty one.
    """
    own = free_names(docs, *ROW)
    marked = docs.select("*", *_row_hashes(docs, own))
    texts = _texts(docs, "doc_id", "text", *_row_hashes(docs))
    first, named = _parts(texts, size, percent)
    no_id = F.col("doc_id").isNull().alias("no")
    rows = first.filter("n > 0").groupBy("key", "doc_id", *ROW).agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("key").agg(F.min(F.struct(no_id, "doc_id", *ROW, "rows")).alias("x"))
    best = best.join(named, "key").groupBy("part").agg(F.min("x").alias("x"))
    kept = best.select(*(f"x.{c}" for c in ROW), (F.col("x.rows") > 1).alias("tied"))
    kept = written(kept.union(first.filter("n = 0").select(*ROW, F.lit(False)).distinct()), "jaccard-kept")
    named = [F.col(c).alias(n) for c, n in zip(ROW, own, strict=True)]
    out = marked.join(kept.filter("not tied").select(*named), own, "left_semi")
    tied = kept.filter("tied").select(*named)
    if not tied.isEmpty():
        out = out.unionByName(marked.join(tied, own, "left_semi").dropDuplicates(own))
    return out.select(*docs.columns)
