"""N-gram Jaccard join: every pair of texts whose shingle sets are similar enough, exactly.

Two sets that are similar enough differ in few shingles, and their sizes lie close together. Sizes
are cut into bands. In the tile of a band, the range of shingle hashes is cut into more segments
than two linked sets can differ by shingles, so at least one segment is the same in both: its
content, hashed, is the key that brings the sets together. A shared passage does not make a key
unless nearly all of the text is shared, and no key needs shingle counts.

Sets that share keys are checked inside tiles: parity bitmaps of the hashed shingles bound the
overlap from above by one bit count, and what passes is intersected exactly as sorted arrays. A large
corpus shares many keys by chance, so until then a set is moved as its bitmap only, which is some
hundredth of the set's size; the sets of pairs that pass are made from their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainspark.llm.components import components
from chainspark.llm.text import LOWER, Ranges, bit_table, chunks, group_sum, in_bits, map_arrow, mix, released, shingles, sorted_sets
from chainspark.session import cut_lineage

#: Pairs of a set and a component that are checked before all others.
BEST = 4
#: Sets a side in one tile.
TILE = 256
#: A band holds sizes from RATIO times its largest size.
RATIO = 0.7
_SEG, _TILE_SALT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Bands:
    """Size bands and segments for links with 100 * intersection >= percent * union."""

    percent: int

    def overlap(self, a, b):
        """Smallest intersection that links sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def tables(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest size of each band, number of its segments, empty segments it allows for.

        A tile holds the sets of its band and those of the next one up to the size that can still
        link. With ``diff`` shingles that a linked pair can differ by, diff + 1 + spare segments
        leave spare + 1 equal ones, of which a set with at most ``spare`` empty segments has one
        that is not empty.
        """
        tops, top = [], 1
        while not tops or tops[-1] < largest:
            tops.append(top)
            # a partner lies in the same band or the next
            top = max(top + 1, int(top / RATIO), 100 * top // self.percent)
        tops = np.array(tops, np.int64)
        partner = 100 * tops // self.percent
        sums = tops + partner
        diff = np.maximum(sums - 2 * self.overlap(tops, partner),
                          ((100 - self.percent) * sums) // (100 + self.percent))
        smallest = np.concatenate([[1], tops[:-1] + 1])
        lam = diff * np.exp(-smallest / np.maximum(diff + 1, 1))
        spare = np.where(diff > 0, np.ceil(lam + 4 * np.sqrt(lam) + 1), 0).astype(np.int64)
        return tops, diff + 1 + spare, spare


def _sets(chunk, k: int):
    """Sorted shingle sets of a chunk's lower-cased words, with fingerprints (two sums) and sizes."""
    starts, ends, bounds = chunk.words()
    words = Ranges(LOWER[chunk.data]).hash(starts, ends)
    values, first = sorted_sets(*shingles(words, bounds, k))
    n = np.diff(first)
    fp1 = mix(group_sum(mix(values ^ _SEG), first) + n.astype(np.uint64))
    fp2 = mix(group_sum(mix(values ^ _TILE_SALT), first) + n.astype(np.uint64))
    return values, first, n, fp1.view(np.int64), fp2.view(np.int64)


def segment_keys(values, first, n, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets of a chunk and the set of each key."""
    tops, segments, spare = bands.tables(int(n.max(initial=1)))
    own = np.searchsorted(tops, n)
    keys, owners = [], []
    for shift in (0, 1):  # the tile of the own band, and that of the band below
        tile = own - shift
        member = (n > 0) & (tile >= 0)
        if shift:
            # equal sets meet anyway; others must be small enough for the band below
            member &= bands.percent * n <= 100 * tops[np.maximum(tile, 0)]
        member &= segments[np.maximum(tile, 0)] > 1
        sets = np.flatnonzero(member)
        if not len(sets):
            continue
        count = segments[tile[sets]]
        take = np.repeat(member, n)
        doc = np.repeat(np.arange(len(n)), n)[take]
        v = values[take]
        slot_of = np.zeros(len(n), np.int64)
        slot_of[sets] = np.concatenate([[0], np.cumsum(count)[:-1]])
        per = np.zeros(len(n), np.uint64)
        per[sets] = count
        seg = ((v >> np.uint64(32)) * per[doc]) >> np.uint64(32)
        slot = slot_of[doc] + seg.astype(np.int64)
        total = int(count.sum())
        edges = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=total))])
        content = group_sum(mix(v), edges)
        owner = np.repeat(sets, count)
        index = np.arange(total) - np.repeat(slot_of[sets], count)
        key = mix(content + index.astype(np.uint64) * _SEG + (tile[owner] + 1).astype(np.uint64) * _TILE_SALT)
        empty = edges[1:] == edges[:-1]
        n_empty = np.bincount(owner[empty], minlength=len(n))
        use = ~empty | (n_empty > spare[np.maximum(tile, 0)])[owner]
        keys.append(key[use])
        owners.append(owner[use])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def bitmaps(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parity bitmaps: bit i tells whether an odd number of shingles hash to i; 2 bits a shingle or more.

    Unrelated sets then differ in nearly a bit for each shingle, and linked ones in far fewer.
    """
    out = []
    for a, b in zip(first[:-1], first[1:]):
        size = max(64, 1 << (2 * int(b - a) - 1).bit_length()) if b > a else 64
        bits = np.bincount((values[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        out.append(np.packbits(bits.astype(np.uint8)).tobytes())
    return out


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, bits) of every document (doc_id: bigint, text)."""
    def run(batch):
        for chunk in chunks(batch.column("text")):
            values, first, n, fp1, fp2 = _sets(chunk, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), pa.array(n.astype(np.int64)),
                 pa.array(fp1), pa.array(fp2), pa.array(bitmaps(values, first), pa.binary())], ["doc_id", "n", "fp1", "fp2", "bits"])
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, bits binary")


def _keys(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """(key, node) of all sets; node: fp1. Copies that a task has seen send nothing again."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, first, n, fp1, _ = _sets(chunk, k)
                fresh = np.zeros(chunk.n, bool)
                for i, f in enumerate(fp1.tolist()):
                    if n[i] and f not in seen:
                        seen.add(f)
                        fresh[i] = True
                size = np.where(fresh, n, 0)
                kept = values[np.repeat(fresh, n)]
                bounds = np.concatenate([[0], np.cumsum(size)])
                key, owner = segment_keys(kept, bounds, size, bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp1[owner])],
                                                 ["key", "node"])
    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(released(run), "key bigint, node bigint")


def _likely(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key may be among ``ids`` (a column of the key's name): all of those, and a few more, which a join drops.

    Ids go to the tasks as a filter of 2^FILTER_BITS bits, whatever their number, so that only the texts or sets
    it lets pass are dealt. The fuller it is, the more pass; it never holds back a row of ``ids``.
    """
    bits = bit_table(ids.select(F.xxhash64(key).alias("spot")), "spot")
    names = rows.columns

    def run(batch):
        yield batch.select(names).filter(pa.array(in_bits(bits, batch.column("spot").to_numpy())))
    return map_arrow(rows.select("*", F.xxhash64(key).alias("spot")), run, rows.schema)


def _set_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, items) of every document: its set as a sorted array."""
    def run(batch):
        for chunk in chunks(batch.column("text")):
            values, first, n, fp1, fp2 = _sets(chunk, k)
            raw = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(chunk.first_row, chunk.n), pa.array(n.astype(np.int64)),
                 pa.array(fp1), pa.array(fp2), pa.array(raw, pa.binary())], ["doc_id", "n", "fp1", "fp2", "items"])
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, items binary")


def _linked(a: np.ndarray, b: np.ndarray, bands: Bands) -> bool:
    """Exact test of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    inter = int((b[at] == a).sum())
    return 100 * inter >= bands.percent * (len(a) + len(b) - inter)


def _parts(batch: pa.RecordBatch, rows: int = 1000):
    """A batch in parts, so that what Python makes of it stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _apart(x: bytes, y: bytes) -> int:
    """Shingles by which two sets differ, at least: unequal bits of their parity bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())


def _bounded_pairs(pairs: DataFrame, table: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (left, right: fp1) as (a, b: smallest documents) if the bit counts leave enough overlap."""
    def side(s: str, at: str) -> DataFrame:
        return table.select(F.col("fp1").alias(at), F.col("rep").alias(s), F.col("n").alias(f"n_{s}"),
                            F.col("bits").alias(f"bits_{s}"))

    def run(whole):
        for batch in _parts(whole):
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            need = bands.overlap(n_a, n_b)
            bits = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            good = [i for i, (x, y) in enumerate(bits) if need[i] <= min(n_a[i], n_b[i])
                    and (n_a[i] + n_b[i] - _apart(x, y)) // 2 >= need[i]]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
    rows = pairs.join(side("a", "left").hint("merge"), "left").join(side("b", "right").hint("merge"), "right")
    return map_arrow(rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a bigint, b bigint")


def _items(docs: DataFrame, table: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(rep, items) of the sets that pairs (a, b) name.

    Only their texts are dealt: a join with the names would deal all texts first. Rows that repeat an id and text are one.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = table.join(named.select(F.col("doc_id").alias("rep")), "rep", "left_semi")
    texts = _likely(docs, "doc_id", named).hint("merge").join(named, "doc_id", "left_semi")
    texts = texts.withColumn("_print", F.xxhash64("text")).dropDuplicates(["doc_id", "_print"])
    return (_set_table(texts, k).join(sets.select(*[F.col(c).alias(f"_{c}") for c in ("fp1", "fp2", "n")], "rep").hint("merge"),
                                      (F.col("doc_id") == F.col("rep")) & (F.col("fp1") == F.col("_fp1"))
                                      & (F.col("fp2") == F.col("_fp2")) & (F.col("n") == F.col("_n")))
            .select("rep", "items"))


def _verified_pairs(pairs: DataFrame, items: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b; a written table) that are links, by intersecting their sorted arrays (rep, items)."""
    def run(whole):
        for batch in _parts(whole):
            both = zip(batch.column("items_a"), batch.column("items_b"))
            good = [i for i, (x, y) in enumerate(both) if _linked(
                np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), bands)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
    rows = (pairs.join(items.select(F.col("rep").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a")
            .join(items.select(F.col("rep").alias("b"), F.col("items").alias("items_b")).hint("merge"), "b"))
    return map_arrow(rows.select("a", "b", "items_a", "items_b"), run, "a bigint, b bigint")


def _tile(bits: list[bytes], n: np.ndarray, comp: np.ndarray, rep: np.ndarray, side: np.ndarray, bands: Bands,
          most: int | None) -> tuple[np.ndarray, bool]:
    """Pairs of one tile, and whether ``most`` has left any out."""
    size = min(map(len, bits))
    flat = np.stack([_fold(np.frombuffer(b, np.uint8), size) for b in bits]).view(np.uint64)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out, cut = [], False
    for i in left:
        other = right[comp[right] != comp[i]]
        apart = np.bitwise_count(flat[other] ^ flat[i]).sum(axis=1).astype(np.int64)
        bound = (n[other] + n[i] - apart) // 2
        ok = bound >= bands.overlap(n[other], n[i])
        other, bound = other[ok], bound[ok]
        if most is not None and len(other) > most:
            order = np.lexsort((-bound, comp[other]))
            other = other[order]
            first = np.flatnonzero(np.append(True, comp[other][1:] != comp[other][:-1]))
            place = np.arange(len(other)) - np.repeat(first, np.diff(np.append(first, len(other))))
            cut |= bool((place >= most).any())
            other = other[place < most]
        if len(other):
            out.append(np.stack([np.full(len(other), rep[i]), rep[other]]))
    return (np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)), cut


def _tile_pairs(rows: DataFrame, bands: Bands, most: int | None) -> DataFrame:
    """Pairs across components that the bit counts leave, in tiles of queries (side 0) and members.

    With ``most``, only the pairs of highest bound of each query and component; if that leaves any
    out, there is a row of nulls. Rows of a tile, 2 * TILE at most, follow each other in their
    partition; a task holds one batch and the tile that its end cuts.
    """
    names = ["key", "tile_q", "tile_m", "n", "comp", "rep", "side"]

    def run(batches):
        rest = None
        cut = False

        def tiles(table, last):
            nonlocal cut
            col = {c: table.column(c).to_numpy() for c in names}
            bits = table.column("bits").to_pylist()
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([col[c][1:] != col[c][:-1] for c in names[:3]], axis=0)
            first = np.append(np.flatnonzero(new), table.num_rows)
            done = len(first) - 1 if last else len(first) - 2
            found = []
            for a, b in zip(first[:done], first[1:done + 1]):
                if b - a > 1:
                    pairs, more = _tile(bits[a:b], *(col[c][a:b] for c in names[3:]), bands, most)
                    cut |= more
                    found.append(pairs)
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            both = np.unique(np.sort(both, axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"]), first[done]

        for batch in (part for whole in batches for part in _parts(whole)):
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            out, at = tiles(table, False)
            rest = table.slice(int(at))
            yield out
        if rest is not None and rest.num_rows:
            yield tiles(rest.combine_chunks(), True)[0]
        if cut:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2, ["a", "b"])
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = names[:3]
    return (rows.select(*names, "bits").repartition(slots, *tile).sortWithinPartitions(*tile)
            .mapInArrow(released(run), "a bigint, b bigint").distinct())


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents (doc_id: bigint, text) linked by similar sets of k-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased, of the whole text. Two documents
    link when 100 * intersection >= percent * union (percent from 50 to 100) of their distinct
    k-word shingles; a text of fewer words, but not none, has its whole sequence as its one shingle.
    Returns per row doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Equal sets are one node and are never paired. Every other set first meets the smallest node of
    each of its keys; groups of near copies then are one component, at a cost that grows with their
    members and not with their pairs. Keys whose sets are still in several components are cut into
    tiles, in which all pairs across components are checked, so no link is lost.

    Null and empty texts have an empty set and link with nothing (component_id is their doc_id).
    A row with a null doc_id is no node; it takes the component of the rows with the same set, or
    null. Repeated rows are equal sets. An empty table gives an empty table; other columns are not
    read. Sets are compared as 64-bit shingle hashes; nodes by 128 bits and their size.
    """
    bands = Bands(percent)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = cut_lineage(signatures(docs, k))
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("key").orderBy("node")
    members = cut_lineage(
        _keys(docs, k, bands).repartition(slots, "key")
        .select("key", "node", F.first("node").over(order).alias("leader"), F.lag("node").over(order).alias("prev"))
        .where("prev IS NOT NULL AND prev <> node").drop("prev"))
    nodes = members.select("node").unionAll(members.select(F.col("leader").alias("node"))).distinct()
    # the nodes that share a key: their smallest document and the bitmap of their set.
    # here and where sets meet always a merge join: a plan that changes with the number of copies
    # would change what is shuffled, and how much of it, from one corpus to the next
    table = cut_lineage(sig.where("n > 0 AND doc_id IS NOT NULL").hint("merge").join(nodes, F.col("fp1") == F.col("node"), "left_semi")
                        .groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified_pairs(pairs, _items(docs, table, pairs, k), bands)

    pairs = members.select(F.col("node").alias("left"), F.col("leader").alias("right")).distinct()
    checked = cut_lineage(_bounded_pairs(pairs, table, bands))
    named = _place(table.select("rep", F.col("rep").alias("comp")), verified(checked))
    rows = _open_sets(members, table, named)
    # the best pairs across components join nearly all that are linked; then those left out, if any
    for most in (BEST, None):
        if rows.isEmpty():
            break
        found = cut_lineage(_tile_pairs(_tiles(rows, table), bands, most))
        # a pair is intersected once: one that is no link stays none
        new = cut_lineage(found.where("a IS NOT NULL").join(_ordered(checked), ["a", "b"], "left_anti"))
        named = _place(named, verified(new))
        if found.where("a IS NULL").isEmpty():
            break
        # components only grow: a key that was not open is not open now
        checked, rows = checked.unionAll(new), _still_open(rows, named)
    # every class of equal sets that has more than one document, or links
    classes = (sig.where("n > 0").groupBy("fp1", "fp2", "n")
               .agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    labels = (classes.join(named, F.col("first") == F.col("rep"), "left")
              .where("rows > 1 OR comp IS NOT NULL")
              .select(*[F.col(c).alias(f"_{c}") for c in ("fp1", "fp2", "n")],
                      F.coalesce("comp", "first").alias("_label")))
    return (sig.join(labels, (F.col("fp1") == F.col("_fp1")) & (F.col("fp2") == F.col("_fp2"))
                     & (F.col("n") == F.col("_n")), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_label", "doc_id").alias("component_id")))


def _place(named: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp) after more links (a, b: rep)."""
    at = named.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
    to = named.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    joined = components(links.join(at, "a").join(to, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return cut_lineage(named.join(joined, F.col("comp") == F.col("node"), "left")
                       .select("rep", F.coalesce("component", "comp").alias("comp")))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the smaller document first, as tiles give them."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open_sets(members: DataFrame, table: DataFrame, named: DataFrame) -> DataFrame:
    """(key, rep, comp) of the sets of keys that several components still share."""
    where = table.select(F.col("fp1").alias("node"), "rep").join(named, "rep")
    of_leader = where.select(F.col("node").alias("leader"), F.col("comp").alias("comp_leader"))
    # a key of two sets has been decided; one of three or more is open while components differ
    differ = F.max((F.col("comp") != F.col("comp_leader")).cast("int"))
    open_keys = (members.join(where, "node").join(of_leader, "leader").groupBy("key")
                 .agg(F.count("*").alias("others"), differ.alias("open")).where("open = 1 AND others > 1").select("key"))
    kept = (members.join(open_keys, "key", "left_semi")
            .select("key", F.explode(F.array("node", "leader")).alias("node")).distinct())
    rows = kept.join(where, "node").select("key", "rep", "comp")
    # keys of the same sets ask the same: one of them is enough
    prints = [F.sum(F.xxhash64(F.lit(s), "rep").cast("decimal(38,0)")) for s in (1, 2)]
    single = rows.groupBy("key").agg(F.struct(F.count("*"), *prints).alias("sets")).groupBy("sets").agg(F.min("key").alias("key"))
    return cut_lineage(rows.join(single.select("key"), "key", "left_semi"))


def _still_open(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Open sets (key, rep, comp) after more links."""
    rows = rows.select("key", "rep").join(named, "rep").select("key", "rep", "comp")
    differ = rows.groupBy("key").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("key")
    return cut_lineage(rows.join(differ, "key", "left_semi"))


def _tiles(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Tiles of open sets (key, rep, comp).

    Of each key, the rows outside its largest component are its queries: any pair across
    components has one of them. Queries and all rows are cut into blocks of TILE.
    """
    largest = (rows.groupBy("key", "comp").count().groupBy("key")
               .agg(F.max_by("comp", F.struct("count", "comp")).alias("main")))
    rows = rows.join(largest, "key").withColumn("query", F.col("comp") != F.col("main")).drop("main")
    by_key = Window.partitionBy("key").orderBy("query", "comp", "rep")
    by_query = Window.partitionBy("key", "query").orderBy("comp", "rep")
    rows = cut_lineage(rows.withColumn("tile_m", F.floor((F.row_number().over(by_key) - 1) / TILE))
                       .withColumn("tile_q", F.floor((F.row_number().over(by_query) - 1) / TILE)))
    last = rows.groupBy("key").agg(F.max("tile_m").alias("last_m"),
                                   F.max(F.when(F.col("query"), F.col("tile_q"))).alias("last_q"))
    rows = rows.join(last, "key")
    zero = F.lit(0).cast("bigint")
    asked = rows.where("query").select("key", "rep", "comp", "tile_q", F.explode(F.sequence(zero, "last_m")).alias("tile_m"),
                                       F.lit(0).alias("side"))
    met = rows.select("key", "rep", "comp", F.explode(F.sequence(zero, "last_q")).alias("tile_q"), "tile_m",
                      F.lit(1).alias("side"))
    return asked.unionByName(met).join(table.select("rep", "n", "bits"), "rep")
