"""Exact n-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Every shingle is XORed into one segment of a
sketch, so the segments (and the bits) in which two sketches differ are at most the symmetric
difference of the sets. Sets whose sizes can reach the threshold lie in one size band or in two
adjoining ones. A band has more segments than the largest symmetric difference D that it allows, so a
linked pair agrees in a segment (pigeonhole): equal segments are joined by hash, and pairs are
verified on the whole shingle sets.

* Equal sets are joined first, by a 128-bit digest that is grouped with map-side combination; one
  text of each stands for all.
* A band has `surplus` segments more than D + 1, so a linked pair agrees in surplus + 1 of them. Segments
  without a shingle are no keys; a document with more of them than the surplus uses them too. What
  its empty segments leave of the surplus, a document takes off its commonest keys: of the keys that
  a linked pair shares, the rarest is never among them. So passages that many documents share join
  nobody, and no link is lost.
* Of each key's documents, the one whose keys are shared most leads. Every document is verified
  against the leader with which it shares most keys: one pair a document.
* Of the keys that the same documents share, one is looked at. Where it leaves documents unconnected,
  they are compared in blocks by parity sketches, whose Hamming distance must not exceed the difference
  that the threshold allows. Emitted are spanning trees of
  what may link, at most a row for each row read. Their components, with each whole text sent once to
  each pair of blocks, are verified where they lie, giving spanning trees of the links. A component's
  commonest part meets only the documents outside it.

So rows grow with the documents, not with the square of a group; only texts that may link and are not
yet connected are compared, and none of these is left out.

Defined cases: null, empty and blank texts have an empty set, n_shingles 0, and are their own
component; a text of fewer words than a shingle is one shingle; rows that repeat an id are rows of
their own, linked by their own texts; null ids are kept and linked with nothing; an empty table gives
an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, discarded, hashed_ngrams, hashed_words, mix, stored, table, utf8
from .components import components

#: Sizes at which a band begins grow by this factor; at least 1 / similarity, so that partners adjoin.
BAND_RATIO = 1.3
#: Bits of the sketches: the power of two above the size, within these.
LEAST_BITS, MOST_BITS = 256, 8192
#: Documents, and their shingles, in a block where documents are compared pair by pair.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000


def shingle_sets(data, offsets, n: int):
    """Sorted distinct shingle hashes of every row."""
    for i, j in chunks(offsets):
        words, first = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold=True)
        grams = hashed_ngrams(words, n)
        for k in range(j - i):
            w = first[k + 1] - first[k]
            if w >= n:
                yield np.unique(grams[first[k] : first[k + 1] - n + 1])
            elif w:
                yield hashed_ngrams(words[first[k] : first[k + 1]], int(w))[:1]
            else:
                yield np.zeros(0, np.uint64)


def digest(shingles: np.ndarray, salt: int) -> int:
    return int(mix(shingles, salt).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0


class Bands:
    """Size bands and their numbers of segments for similarity percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = max(BAND_RATIO, 100 / percent)
        self.starts = [1]
        while self.starts[-1] < 1 << 31:
            self.starts.append(max(self.starts[-1] + 1, int(np.ceil(self.starts[-1] * self.ratio))))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def allowed(self, band: int) -> int:
        """Largest symmetric difference of a linked pair whose smaller set lies in the band."""
        return (100 - self.percent) * (self.starts[band + 1] - 1) // self.percent

    def surplus(self, band: int) -> int:
        return max(4, self.allowed(band) // 8)

    def joined(self, size: int) -> list[int]:
        """Its own band, and the one below if a smaller partner may lie there."""
        band = self.of(size)
        below = -(-self.percent * size // 100) < self.starts[band]
        return [b for b in ([band, band - 1] if below else [band]) if b >= 0 and self.allowed(b)]

    def segments(self, mixed: np.ndarray, band: int) -> np.ndarray:
        return (mixed >> np.uint64(32)) % np.uint64(self.allowed(band) + 1 + self.surplus(band))

    def spare(self, shingles: np.ndarray) -> list[int]:
        """How many keys may go in bands of even and of odd number."""
        out, mixed = [0, 0], mix(shingles, 3)
        for band in self.joined(len(shingles)):
            count = self.allowed(band) + 1 + self.surplus(band)
            empty = count - np.count_nonzero(np.bincount(self.segments(mixed, band).astype(np.int64), minlength=count))
            out[band & 1] = max(0, self.surplus(band) - int(empty))
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Hashes of the segments; the lowest bit tells bands of even and odd number apart."""
        out, mixed, values = [], mix(shingles, 3), mix(shingles, 5)
        for band in self.joined(len(shingles)):
            segment = self.segments(mixed, band)
            order = np.argsort(segment, kind="stable")
            segment = segment[order]
            at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            which, value = segment[at], np.bitwise_xor.reduceat(values[order], at)
            count = self.allowed(band) + 1 + self.surplus(band)
            if count - len(which) > self.surplus(band):  # too many empty segments: they are keys as well
                empty = np.setdiff1d(np.arange(count, dtype=np.uint64), which)
                which, value = np.concatenate([which, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
            key = mix(mix(value + which * np.uint64(0xA24BAED4963EE407)), 11 + band)
            out.append(key & ~np.uint64(1) | np.uint64(band & 1))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray, bits: int = 0) -> bytes:
    """Parity of the shingles at each bit. A sketch of half the bits is the XOR of the halves."""
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (max(len(shingles), 1) - 1).bit_length()))
    odd = np.bincount((mix(shingles, 7) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int = 0) -> np.ndarray:
    """The sketches as rows of equal length, that of the shortest if none is given."""
    width = width or min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for k, s in enumerate(sketches):
        words = np.frombuffer(s, np.uint64)
        out[k] = words if len(words) == width else np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)
    return out


def difference(percent: int, a, b):
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def _matches(percent: int, bits: np.ndarray, size: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of the others may link with one, by their sizes and sketches."""
    a, b = size[one], size[others]
    others = others[np.minimum(a, b) * 100 >= percent * np.maximum(a, b)]
    apart = np.bitwise_count(bits[others] ^ bits[one]).sum(axis=1)
    return others[apart <= difference(percent, a, size[others])]


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, text_hash, size, d1, d2, spare, sketch) of every row."""
    bands = Bands(percent)
    kind = "id long, text_hash long, size long, d1 long, d2 long, spare array<int>, sketch binary"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = [(len(s), digest(s, 1), digest(s, 2), bands.spare(s) if len(s) else [0, 0], sketch(s)) for s in shingle_sets(*utf8(part.column(1)), n)]
                size, d1, d2, spare, bits = zip(*rows, strict=True)
                columns = [part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(spare, pa.list_(pa.int32())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "size", "d1", "d2", "spare", "sketch"])

    return docs.select("id", "text", F.xxhash64("text")).mapInArrow(run, kind)


def segment_keys(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, node) for every segment; texts: node, d1, text, of which only those with the digest count."""
    bands = Bands(percent)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                wanted = part.column(1).to_pylist()
                keys = [bands.keys(s) if digest(s, 1) == d else s[:0] for s, d in zip(shingle_sets(*utf8(part.column(2)), n), wanted, strict=True)]
                nodes = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return texts.mapInArrow(run, "key long, node long")


def _shared_keys(batches):
    """Distinct rows of keys that more than one node has, of batches sorted by key and node; a key may fill any number of batches."""
    last_key, last_node, given = None, None, True
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.concatenate([[last_key is None or key[0] != last_key or node[0] != last_node], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        key, node = key[fresh], node[fresh]
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        goes_on = last_key is not None and key[0] == last_key
        keep = np.concatenate([[goes_on], same]) | np.concatenate([same, [False]])
        out_key, out_node = key[keep], node[keep]
        if goes_on and not given:
            out_key, out_node = np.concatenate([[last_key], out_key]), np.concatenate([[last_node], out_node])
        yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_node)], ["key", "node"])
        last_key, last_node, given = key[-1], node[-1], bool(keep[-1])


def _may_link(percent: int):
    """Pairs whose sizes and sketches allow a link."""

    def run(batches):
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
            ok = np.minimum(*sizes) * 100 >= percent * np.maximum(*sizes)
            most = difference(percent, *sizes)
            both = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b")]
            lengths = np.array([[len(x) for x in side] for side in both]).min(axis=0) if batch.num_rows else np.zeros(0)
            for length in np.unique(lengths):
                at = np.flatnonzero(ok & (lengths == length))
                x, y = (folded([side[k] for k in at], length // 8) for side in both)
                ok[at] = np.bitwise_count(x ^ y).sum(axis=1) <= most[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n")], ["a", "b", "n"]).filter(pa.array(ok))

    return run


def _linked(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.count_nonzero(y[at] == x))
    return common * 100 >= (len(x) + len(y) - common) * percent


def _verified_pairs(n: int, percent: int):
    """Linked pairs of (a, b, text_a, text_b); the texts of an a that comes again and again are read once."""

    def run(batches):
        last, mine = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("a").to_numpy()
            ok = np.zeros(len(a), bool)
            theirs = shingle_sets(*utf8(batch.column("text_b")), n)
            for k, other in enumerate(theirs):
                if last != a[k]:
                    last, mine = a[k], next(shingle_sets(*utf8(batch.column("text_a").slice(k, 1)), n))
                ok[k] = _linked(percent, mine, other)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _groups(batches, keys: list[str]):
    """Tables of the rows that agree in all keys, of batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not held.num_rows:
            continue
        new = np.zeros(held.num_rows, bool)
        new[0] = True
        for name in keys:
            column = held.column(name).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            yield held.slice(lo, hi - lo)
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _possible_trees(percent: int):
    """Spanning trees of what may link between different components, in the documents of a key and a pair of blocks."""

    def trees(rows):
        node, comp, size, block, lower, upper = (rows.column(c).to_numpy() for c in ("node", "comp", "size", "block", "lower", "upper"))
        bits = folded(rows.column("sketch").to_pylist())
        apart = lower[0] != upper[0]
        free = np.ones(len(node), bool)
        for root in range(len(node)):
            if not free[root]:
                continue
            free[root] = False
            queue = [root]
            while queue:
                one = queue.pop()
                others = np.flatnonzero(free & (comp != comp[one]) & ((block != block[one]) if apart else True))
                near = _matches(percent, bits, size, one, others)
                free[near] = False
                queue += near.tolist()
                for other in near:
                    yield node[root], node[other]

    def run(batches):
        for rows in _groups(batches, ["key", "lower", "upper"]):
            found = list(trees(rows))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _link_trees(n: int, percent: int):
    """Spanning trees of the links between different components, in a pair of blocks of texts that may link."""

    def run(key, rows):
        lower, upper = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks()
        node, comp, block, minor = (rows.column(c).to_numpy() for c in ("node", "comp", "block", "minor"))
        sets = list(shingle_sets(*utf8(rows.column("text")), n))
        size = np.array([len(s) for s in sets])
        widest = 1 << min(14, max(8, int(2 * size.max() - 1).bit_length()))
        bits = folded([sketch(s, widest) for s in sets])
        names, comp = np.unique(comp, return_inverse=True)
        parent = list(range(len(names)))

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        apart, near = lower != upper, []
        for one in np.flatnonzero(minor):
            others = (block != block[one]) if apart else np.arange(len(node)) != one
            near.append((one, _matches(percent, bits, size, one, np.flatnonzero(others & (comp != comp[one])))))
        a, b = [], []
        for one, others in sorted(near, key=lambda x: -len(x[1])):  # those near most others first: what they connect need not be compared
            for other in others.tolist():
                x, y = top(comp[one]), top(comp[other])
                if x != y and _linked(percent, sets[one], sets[other]):
                    parent[x] = y
                    a.append(node[one])
                    b.append(node[other])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _led(kept: DataFrame) -> DataFrame:
    """(key, node, a, n, w): nodes of a key, their leader a and their number n. Of the w keys with the same nodes one stands for all."""
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    groups = kept.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(one).alias("s1"), F.bit_xor(two).alias("s2"), F.max(F.struct("hub", (-F.col("node")).alias("node"))).alias("m")).where("n > 1")
    groups = groups.groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("w"), F.first("m.node").alias("m"))
    return kept.select("key", "node").join(groups.select("key", (-F.col("m")).alias("a"), "n", "w"), "key")


def _possible_pairs(led: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): nodes that may link with a leader, and how many keys they share."""
    pairs = led.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.sum("w").alias("n"))
    side = lambda x: about.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_may_link(percent), "a long, b long, n long")


def _leader_links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): each node with the leader it shares most keys with, if they link."""
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return best.join(of("b"), "b").join(of("a"), "a").mapInArrow(_verified_pairs(n, percent), "a long, b long")


def _parted(rows: DataFrame, parts: DataFrame, node: str = "node", comp: str = "comp") -> DataFrame:
    return rows.join(parts.select(F.col("node").alias(node), F.col("component").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))


def _possible_links(led: DataFrame, pairs: DataFrame, parts: DataFrame, about: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): trees over the nodes that may link and are not connected: leaders with theirs, then the others of each key."""
    with_leaders = _parted(_parted(pairs, parts, "a", "x"), parts, "b", "y").where("x <> y").select("a", "b")
    placed = _parted(led.where("n > 2 and node <> a").select("key", "node"), parts)
    groups = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"))
    open_groups = groups.where("low < high").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = placed.join(open_groups, "key").join(about.select("node", "size", "sketch"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "node", "comp", "size", "sketch", "block")
    dealt = rows.repartition("key", "lower", "upper").sortWithinPartitions("key", "lower", "upper")
    return with_leaders.unionByName(dealt.mapInArrow(_possible_trees(percent), "a long, b long")).distinct()


def _cluster_links(clusters: DataFrame, parts: DataFrame, about: DataFrame, texts: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(a, b): trees of the links inside clusters of nodes that may link; clusters: node, cluster."""
    placed = _parted(clusters, parts).join(about.select("node", "size"), "node")
    main = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    blocks = lambda rows, weight: F.ceil(F.greatest(rows / block, weight / BLOCK_SHINGLES)).cast("int")
    total = main.groupBy("cluster").agg(F.max(F.struct("n", "weight", (-F.col("comp")).alias("comp"))).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    total = total.select("cluster", (-F.col("main.comp")).alias("main"), blocks(F.col("main.n"), F.col("main.weight")).alias("majors"), blocks(F.col("n") - F.col("main.n"), F.col("weight") - F.col("main.weight")).alias("minors"))
    rows = placed.join(total.where("minors > 0"), "cluster").withColumn("minor", F.col("comp") != F.col("main"))
    # blocks of minor documents come first and meet all blocks, the others meet those only
    rows = rows.withColumn("block", F.when(F.col("minor"), F.pmod(F.xxhash64("node"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("minors") - 1 + F.when(F.col("minor"), F.col("majors")).otherwise(0))))
    rows = rows.select("cluster", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "node", "comp", "block", "minor")
    return rows.join(texts, "node").groupBy("cluster", "lower", "upper").applyInArrow(_link_trees(n, percent), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, part, text_hash) of every row; linked where 100 * intersection >= percent * union.

    part tells components apart even where an id stands at several texts; null without words or id.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    every = stored(described(texts, n, percent), "sets")
    # one node for each distinct set: its least id, or a hash where that stands at several sets
    sets = every.where("size > 0 and id is not null").groupBy("size", "d1", "d2").agg(F.min(F.struct("id", "text_hash", "spare", "sketch")).alias("of")).select("size", "d1", "d2", "of.*")
    again = F.row_number().over(Window.partitionBy("id").orderBy("d1", "d2", "size")) > 1
    classes = stored(sets.withColumn("node", F.when(again, F.xxhash64("id", "d1", "d2")).otherwise(F.col("id"))), "classes")
    about = classes.select("node", "size", "sketch")

    # segments that nodes share, without the commonest that each can spare
    # a class has the text of one row, so an id that other texts repeat meets none of those
    own = hashed.join(classes.select("id", "text_hash", "node", "d1"), ["id", "text_hash"]).select("node", "d1", "text")
    entries = segment_keys(own, n, percent).repartition("key").sortWithinPartitions("key", "node")
    shared = stored(entries.mapInArrow(_shared_keys, "key long, node long"), "shared", free=True)
    counted = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    odd = F.col("key").bitwiseAND(1)
    rank = F.row_number().over(Window.partitionBy("node", odd).orderBy(F.desc("n"), "key"))
    rare = counted.join(classes.select("node", "spare"), "node").withColumn("rank", rank).where(F.col("rank") > F.col("spare")[odd.cast("int")])
    kept = stored(rare.select("key", "node", F.sum("n").over(Window.partitionBy("node")).alias("hub")), "kept", free=True)
    led = stored(_led(kept), "led", free=True)
    discarded(shared, kept)

    pairs = stored(_possible_pairs(led, about, percent), "pairs", free=True)
    wanted = classes.select("id", "text_hash", "node", "d1").join(led.select("node").distinct(), "node", "left_semi")
    once = hashed.join(wanted, ["id", "text_hash"]).dropDuplicates(["id", "text_hash", "node"])  # dealt by these already
    near = stored(_of_digest(once.select("node", "d1", "text"), n), "texts", free=True)
    links = stored(_leader_links(pairs, near, n, percent), "links", free=True)
    parts = stored(components(links), "parts")
    possible = stored(_possible_links(led, pairs, parts, about, percent, block), "possible", free=True)
    clusters = stored(components(possible).withColumnRenamed("component", "cluster"), "clusters")
    more = stored(_cluster_links(clusters, parts, about, near, n, percent, block), "links", free=True)
    ties = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = stored(components(ties.unionByName(more)), "found")
    discarded(led, pairs, near, links, parts, possible, clusters, more)

    # a component's name is the least id in it
    placed = classes.select("size", "d1", "d2", "id", "node").join(found, "node", "left")
    names = placed.where("component is not null").groupBy("component").agg(F.min("id").alias("name"))
    of_class = placed.join(names, "component", "left").select("size", "d1", "d2", F.coalesce("name", "id").alias("name"), F.coalesce("component", "node").alias("part"))
    out = every.select("id", "text_hash", "size", "d1", "d2").join(of_class, ["size", "d1", "d2"], "left")
    filled = (F.col("size") > 0) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(filled, F.col("name")).otherwise(F.col("id")).alias("component_id"), F.when(filled, F.col("part")).alias("part"), "text_hash")


def _of_digest(texts: DataFrame, n: int) -> DataFrame:
    """(node, text) of the rows whose text has the digest d1; rows of other texts of the same id go."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(*utf8(batch.column(2)), n)
            ok = [digest(s, 1) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["node", "text"]).filter(pa.array(ok, pa.bool_()))

    return texts.mapInArrow(run, "node long, text string")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).drop("part", "text_hash")
