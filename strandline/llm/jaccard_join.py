"""Exact Jaccard join of shingle sets in metric space.

The distance 1 - |x & y| / |x | y| is a metric.  Texts with equal sets are one
point.  Points are dealt into regions such that any two within the radius share one:

* by size (the distance to the empty set in the metric of symmetric
  differences): sizes fall into shells, and a point whose partners can lie in later shells is
  replicated there, as the triangle inequality | |x| - |y| | <= |x ^ y| bounds them;
* within a shell two points of a link differ in at most h shingles, so of more than h
  parts of the shingle space that a point occupies one is untouched by the
  differences.  A region is a part together with its exact content.

In a region the pivot is the member that lies in most regions; the distance of every member
to it is computed.  Members within the radius are linked to the pivot and never
compared with each other: they are one component already.  The others stay open.
Regions with the same pivot are joined as one.  Where one has open members it is cut into rings of one radius around its pivot; a member
is replicated to the next ring, as two linked members differ by at most a
radius in their distance to the pivot.  Each ring is joined recursively:
farthest-first pivots make Voronoi regions, a member is replicated to every
region whose pivot is at most two radii farther than its nearest, and a region that
is small, or that its pivots can't cut, is compared pair by pair behind the windows of all pivots.

Document pivots alone can't cut a corpus, as unrelated texts all lie at a distance
near 1 from every pivot and each window would hold all of them; hence the divided space at the top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import byte_slices, checkpointed, connected_components, digest_of, id_of, parts, text_of, tidy, without_rows
from .words import mix, shingle_sets

#: Ratio of the sizes at the ends of a shell.
SHELL = 1.4
#: Voronoi regions with at most so many members are compared pair by pair.
LEAF = 24
#: Pivots of a Voronoi cut.
PIVOTS = 6
#: Members of a ring that a task takes at once; larger rings are joined block against block.
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seeded(g: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(g ^ (np.uint64(seed + 1) * _ODD))


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of the values of each text."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[off[1:]] - total[off[:-1]]


def set_keys(g: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    n = np.diff(off).astype(np.uint64)
    one, two = (_per_text(_seeded(g, 1000 + 2 * seed + k), off) for k in (0, 1))
    return mix(one + n * _ODD), mix(two ^ n)


class Division:
    """Shells and parts for links of `percent` or more."""

    def __init__(self, percent: int):
        self.percent = percent
        edges, top = [1], 1.0
        while edges[-1] < 1 << 40:
            top *= SHELL
            edges.append(max(edges[-1] + 1, int(np.ceil(top))))
        self.edges = np.array(edges, np.int64)  # shell k holds sizes edges[k] <= n < edges[k + 1]

    def parts_of(self, shell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most differing shingles of a link in the shell, and how many parts its space has."""
        most = (100 - self.percent) * 2 * (self.edges[shell + 1] - 1) // (100 + self.percent)
        return most, most + 3 + most // 8

    def signatures(self, g: np.ndarray, off: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the set, region, least) for every region that a set belongs to.  least holds the shell (above 20
        bits) and how many of its regions in the shell the set shares at least with each of its links."""
        n = np.diff(off)
        some = np.flatnonzero(n)
        own = np.searchsorted(self.edges, n[some], side="right") - 1
        reach = np.searchsorted(self.edges, n[some] * 100 // self.percent, side="right") - own
        place = np.repeat(some, reach)
        shell = np.repeat(own, reach) + np.arange(len(place)) - np.repeat(np.cumsum(reach) - reach, reach)
        out_place, out_region, out_least = [], [], []
        h = _seeded(g, 77 + seed)
        word = mix(h + _ODD)
        step = 4096
        for a in range(0, len(place), step):
            p, s = place[a : a + step], shell[a : a + step]
            most, many = self.parts_of(s)
            base = np.concatenate([[0], np.cumsum(many)])
            size = n[p]
            row = np.repeat(np.arange(len(p)), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + off[p][row]
            part = ((h[at] >> np.uint64(32)) * many[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[row]
            content = np.zeros(base[-1], np.uint64)
            np.add.at(content, part, word[at])
            held = np.bincount(part, minlength=base[-1]) > 0
            owner = np.repeat(np.arange(len(p)), many)
            occupied = np.add.reduceat(held, base[:-1])
            give = held | (occupied <= most)[owner]  # too few occupied parts: an empty one may be all that two sets share
            number = np.arange(base[-1]) - base[owner]
            region = mix(content + mix((s[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + _ODD))
            out_place.append(p[owner[give]])
            out_region.append(region[give])
            least = np.where(occupied > most, occupied - most, 1)  # a partner with enough occupied parts gives no empty one
            out_least.append(((s.astype(np.int32) << 20) | np.minimum(least, (1 << 20) - 1).astype(np.int32))[owner[give]])
        if not out_place:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        return np.concatenate(out_place), np.concatenate(out_region), np.concatenate(out_least)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sizes(shingle: int, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            g, off = shingle_sets(batch.column("text"), shingle)
            one, two = set_keys(g, off, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.diff(off).astype(np.int64)), _long(one), _long(two)], [*(c for c in batch.schema.names if c != "text"), "n", "key", "check"])

    return run


def _regions(shingle: int, percent: int, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        division = Division(percent)
        for batch in byte_slices(batches):
            g, off = shingle_sets(batch.column("text"), shingle)
            key = set_keys(g, off, seed)[0]
            place, region, least = division.signatures(g, off, 0)
            first = np.unique(key, return_index=True)[1]  # copies within the batch are one point
            keep = np.isin(place, first)
            yield pa.RecordBatch.from_arrays([_long(region[keep]), _long(key[place[keep]]), pa.array(least[keep])], ["region", "key", "least"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by region and key, the distinct members of regions that have at least two.

    A region streams through, whatever its size.
    """
    region, last, least, told = None, None, 0, False
    for batch in batches:
        r, k = batch.column("region").to_numpy(), batch.column("key").to_numpy()
        m = batch.column("least").to_numpy()
        if not len(r):
            continue
        if region is None:
            region, last, least, told = r[0], k[0], m[0], False
        m = np.concatenate([[least], m]).astype(np.int32)
        r, k = np.concatenate([[region], r]), np.concatenate([[last], k])  # the row before, once more
        change = (r[1:] == r[:-1]) & (k[1:] != k[:-1])  # another member than the row before
        give = np.concatenate([[False], change])
        # the first member of a region is told once its second is seen
        new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        many = np.add.reduceat(give, new) > 0
        many[0] &= not told
        give[new] |= many
        yield pa.RecordBatch.from_arrays([pa.array(r[give]), pa.array(k[give]), pa.array(m[give])], ["region", "key", "least"])
        told = bool(np.flatnonzero(give[new[-1] :]).size) or (len(new) == 1 and told)
        region, last, least = r[-1], k[-1], m[-1]


def _texts(shingle: int, seed: int):
    """Key and compressed text of each distinct set of a batch; a text is smaller than its shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in byte_slices(batches):
            g, off = shingle_sets(batch.column("text"), shingle)
            key = set_keys(g, off, seed)[0].view(np.int64)
            first = np.sort(np.unique(key, return_index=True)[1])
            first = first[np.diff(off)[first] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array([small.compress(batch.column("text")[i].as_py().encode()) for i in first.tolist()], pa.binary())], ["key", "packed"])

    return run


def _unpacked(packed: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of compressed texts, as of shingle_sets."""
    large = zstandard.ZstdDecompressor()
    return shingle_sets(pa.array([large.decompress(x.as_py()).decode() for x in packed], pa.large_string()), shingle)


def _compare(shingle: int, percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1 << 20, 500, "x"):
            gx, ox = _unpacked(batch.column("x"), shingle)
            gy, oy = _unpacked(batch.column("y"), shingle)
            # equal shingles of a pair stand side by side once both sets are sorted together
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(ox)), np.repeat(np.arange(batch.num_rows), np.diff(oy))])
            g = np.concatenate([gx, gy])
            order = np.lexsort((g, row))
            g, row = g[order], row[order]
            i = np.bincount(row[1:][(g[1:] == g[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
            u = np.diff(ox) + np.diff(oy) - i
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(1.0 - i / np.maximum(u, 1)), pa.array(100 * i >= percent * u)], ["a", "b", "distance", "linked"])

    return run


def _distances(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b, distance, linked of the distinct pairs (a, b)."""
    x = texts.select(F.col("key").alias("a"), F.col("packed").alias("x"))
    y = texts.select(F.col("key").alias("b"), F.col("packed").alias("y"))
    return checkpointed(pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_compare(shingle, percent), "a long, b long, distance double, linked boolean"))


class Ring:
    """Sets of a ring's members in a common numbering of shingles, and the links found among them."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, percent: int):
        self.off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.size = np.diff(self.off)
        self.percent, self.radius = percent, 1.0 - percent / 100.0
        self.mark = np.zeros(int(self.flat.max()) + 1, bool)
        self.comp = component.copy()
        self.links: list[tuple[int, int]] = []

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Shingles that x shares with each of the others."""
        if not len(others):
            return np.zeros(0, np.int64)
        own = self.flat[self.off[x] : self.off[x + 1]]
        self.mark[own] = True
        size = self.size[others]
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(start, size) + np.repeat(self.off[others], size)
        out = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), start)
        self.mark[own] = False
        return out

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.common(x, others)
        return 1.0 - both / (self.size[x] + self.size[others] - both)

    def check(self, x: int, others: np.ndarray) -> None:
        """Links x with the others where the exact condition holds; one component is not searched twice."""
        others = others[self.comp[others] != self.comp[x]]
        both = self.common(x, others)
        good = others[100 * both >= self.percent * (self.size[x] + self.size[others] - both)]
        for y in good.tolist():
            if self.comp[y] != self.comp[x]:
                self.links.append((x, y))
                self.comp[self.comp == self.comp[y]] = self.comp[x]

    def pairs(self, ids: np.ndarray, to_pivots: np.ndarray) -> None:
        """All pairs of ids that every pivot's window leaves."""
        for i in range(1, len(ids)):
            before = np.ones(i, bool)
            for d in to_pivots:
                before &= np.abs(d[:i] - d[i]) <= self.radius + 1e-9
            self.check(ids[i], ids[:i][before])

    def join(self, ids: np.ndarray) -> None:
        if len(np.unique(self.comp[ids])) < 2:
            return
        if len(ids) <= LEAF:
            self.pairs(ids, np.zeros((0, len(ids))))
            return
        d = [self.distance(ids[0], ids)]
        while len(d) < PIVOTS:
            far = int(np.min(d, axis=0).argmax())
            if np.min(d, axis=0)[far] <= 0:
                break
            d.append(self.distance(ids[far], ids))
        table = np.array(d)
        near = table.min(axis=0)
        inside = table <= near + 2 * self.radius + 1e-9
        inside &= (inside & (table == near)).any(axis=1)[:, None]  # a region without members of its own is not searched
        if inside.sum(axis=1).max() > 0.7 * len(ids):
            self.pairs(ids, table)
            return
        for row in inside:
            self.join(ids[row])


def _join_ring(shingle: int, percent: int):
    @tidy
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("key")
        key = rows.column("key").to_numpy()
        keep = np.concatenate([[True], key[1:] != key[:-1]])
        g, off = _unpacked(rows.column("packed").filter(pa.array(keep)), shingle)
        sets = [g[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        key = key[keep]
        ring = Ring(sets, np.unique(rows.column("component").to_numpy()[keep], return_inverse=True)[1], percent)
        ring.join(np.arange(len(key)))
        return pa.table({"a": pa.array([key[x] for x, _ in ring.links], pa.int64()), "b": pa.array([key[y] for _, y in ring.links], pa.int64())})

    return run


def jaccard_groups(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row.

    Two rows link when 100 times the intersection of their shingle sets is at
    least `percent` times the union.  A text with fewer words than a shingle
    is one shingle; null, empty and blank texts have none and link with nothing.
    class_id is the smallest identifier with the same set.  Rows that repeat an identifier give a row each; rows without
    one never link.  An empty table gives no rows.
    """
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    return _grouped(rows, shingle, percent, "").select("doc_id", "n_shingles", "component_id", "class_id")


def _grouped(rows: DataFrame, shingle: int, percent: int, more: str) -> DataFrame:
    """jaccard_groups of rows (doc_id, text and what `more` declares, which is handed on)."""
    spark = rows.sparkSession
    carried = [f.split()[0] for f in more.split(",") if f]
    seed = 0
    while True:
        base = checkpointed(rows.mapInArrow(_sizes(shingle, seed), f"doc_id long, {more + ', ' if more else ''}n long, key long, check long"))
        known = base.where("n > 0 and doc_id is not null")
        reps = checkpointed(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1")))
        if reps.where("c0 <> c1").isEmpty():  # else two sets share a digest: take another
            break
        seed += 1
    dealt = rows.where("doc_id is not null").select("text").mapInArrow(_regions(shingle, percent, seed), "region long, key long, least int")
    members = dealt.repartition(parts(spark), "region").sortWithinPartitions("region", "key").mapInArrow(_members, "region long, key long, least int")
    members = checkpointed(members)
    for _ in range(2):  # a set that shares fewer regions than a link would has none; then regions may be left with one member
        enough = members.groupBy("key", "least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("least").bitwiseAND((1 << 20) - 1))
        members = members.join(enough.select("key", "least"), ["key", "least"], "left_semi")
        members = checkpointed(members.join(members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region"), "region", "left_semi"))
    members = members.select("region", "key")
    texts = rows.where("doc_id is not null").select("text").mapInArrow(_texts(shingle, seed), "key long, packed binary")
    texts = checkpointed(texts.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    # first round: everyone against the pivot of its region
    often = members.groupBy("key").agg(F.count(F.lit(1)).alias("regions"))
    pivot = members.join(often, "key").groupBy("region").agg(F.max(F.struct("regions", "key"))["key"].alias("pivot"))
    pointed = checkpointed(members.join(pivot, "region"))
    found = _distances(pointed.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")), texts, shingle, percent)
    links = found.where("linked").select("a", "b")
    # a member in the pivot's component needs no more links within it; the others are open
    grouped = connected_components(links).select(F.col("id").alias("key"), F.col("component_id").alias("component"))
    grouped = checkpointed(texts.select("key").join(grouped, "key", "left").select("key", F.coalesce("component", "key").alias("component")))
    of_pivot = grouped.select(F.col("key").alias("pivot"), F.col("component").alias("main"))
    # regions with the same pivot go on as one, so that a member is sent once for a pivot and not once for a region
    told = pointed.select("key", "pivot").distinct().join(grouped, "key").join(of_pivot, "pivot").join(found.select(F.col("a").alias("key"), F.col("b").alias("pivot"), "distance"), ["key", "pivot"], "left")
    told = told.select(F.col("pivot").alias("region"), "key", "component", (F.col("component") != F.col("main")).alias("open"), F.coalesce("distance", F.lit(0.0)).alias("distance"))
    live = told.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("n_open")).where("n_open > 0 and n > 2").select("region")
    radius = 1.0 - percent / 100.0
    ring = F.floor(F.col("distance") / radius).cast("long")
    rings = told.join(live, "region").select("key", "component", "open", F.explode(F.array(F.struct(ring.alias("ring"), F.lit(True).alias("home")), F.struct((ring + 1).alias("ring"), F.lit(False).alias("home")))).alias("at"), "region")
    rings = checkpointed(rings.select("region", "at.ring", "at.home", "key", "component", "open"))
    sizes = rings.groupBy("region", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("n_open"), F.max("home").alias("any_home"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    sizes = sizes.where("n > 1 and n_open > 0 and any_home and c0 <> c1").select("region", "ring", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    work = rings.join(sizes, ["region", "ring"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # block i meets every block j: a member of block i goes to (i, j) and (j, i), the smaller first
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("region", "ring", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "component").join(texts, "key")
    rest = work.groupBy("region", "ring", "i", "j").applyInArrow(_join_ring(shingle, percent), "a long, b long")
    links = links.unionByName(checkpointed(rest))
    a, b = (reps.select(F.col("key").alias(s), F.col("rep").alias(f"rep_{s}")) for s in "ab")
    ends = links.distinct().join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    component = connected_components(ends).withColumnRenamed("id", "rep")
    answer = checkpointed(reps.select("key", "rep").join(component, "rep", "left").select("key", F.col("rep").alias("class_id"), F.coalesce("component_id", "rep").alias("component_id")))
    full = known.drop("check").join(answer, "key").select("doc_id", *carried, F.col("n").alias("n_shingles"), "component_id", "class_id")
    none = base.where("n = 0 or doc_id is null").select("doc_id", *carried, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return full.unionByName(none)


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group one with the smallest identifier.

    Rows are told apart by identifier and text: of several rows of a group with its smallest identifier the one with the smallest digest
    stays, and one of those that are equal.  Rows without words, or without an identifier, have no group and stay.  Columns
    stay as they are, whatever their names; an empty table gives no rows.
    """
    text = text_of(docs, text_col)
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), digest_of(text).alias("digest"), text.alias("text"))
    groups = checkpointed(_grouped(rows, shingle, percent, "digest binary").where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest", "component_id"))
    each = groups.groupBy("component_id", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = each.where("doc_id = component_id").groupBy("component_id").agg(F.min("digest").alias("least"))
    each = each.join(first, "component_id").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("least")))
    each = checkpointed(each.where("not stays or n > 1").select("doc_id", "digest", "stays"))
    return without_rows(docs, text, id_col, each.where("not stays").select("doc_id", "digest"), each.where("stays").select("doc_id", "digest"))
