"""Operator 3: n-gram Jaccard join by parity sketches.

A document's sketch is k blocks of 2^64 parity bits, one bit flipped by each shingle, so that the Hamming distance of
two sketches is at most the size d of their sets' symmetric difference. The bits are too sparse to be written out: a
block is held as the XOR of the mixed positions of its set bits, which is equal for equal blocks and else by a chance
of 2^-64. (Written-out blocks of 64 bits made one pair in a hundred of unrelated long texts meet.) At most d blocks
differ. For the sizes that meet in a size band, d is bounded by the wanted similarity; with k > d blocks at least one
is equal, and equal blocks are joined. Second, a folded sketch of 512 written-out bits tests pairs before verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import blocks
from emberlog.llm.common import drop_scratch, map_arrow, materialize, table
from emberlog.llm.words import U64, WORD_BASE, Words, mix, run_hashes

#: Of a set's buckets, how many of the least are known where it meets others, to skip a pair that met before.
FIRST = 16
#: Most pairs (16 bytes each) that are broadcast to the table of hashes.
BROADCAST_PAIRS = 1_000_000
#: 64-bit words of the fixed sketch that pairs are tested with before verification.
FOLD = 8
SETS = "doc_id long, block long, n_shingles long, low long, high long"


class Shingles:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, size: int):
        words = Words(texts, lower=True)
        hashes, of_doc, counts = words.hashes(), words.of_doc, words.counts
        doc = words.docs()
        n = max(0, len(doc) - size + 1)
        starts = np.flatnonzero(doc[:n] == doc[size - 1 :]) if n else np.zeros(0, np.int64)
        ends = starts + size
        short = np.flatnonzero((counts > 0) & (counts < size))  # the whole sequence is its one shingle
        starts, ends = np.concatenate([starts, of_doc[short]]), np.concatenate([ends, of_doc[short + 1]])
        owner = doc[starts] if len(starts) else np.zeros(0, np.int64)
        h = run_hashes(hashes, starts, ends, WORD_BASE)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.h, self.owner = h[new], owner[new]
        self.begins = np.searchsorted(self.owner, np.arange(len(counts) + 1))
        self.sizes = np.diff(self.begins)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums over each set: equal for equal sets."""
        out = []
        for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
            sums = np.concatenate([[U64(0)], np.cumsum(mix(self.h ^ U64(salt)), dtype=np.uint64)])
            out.append(mix(sums[self.begins[1:]] - sums[self.begins[:-1]] + self.sizes.astype(np.uint64)))
        return out[0], out[1]


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Edges of the size bands up to largest, and (blocks, empty blocks allowed) of each band's sketch.

    Two sets of the wanted similarity lie in one band or in neighbours; a band's sketch serves its own pairs and those
    with the next band. They differ in at most (a + b) * (100 - percent) / (100 + percent) shingles. A sketch has as
    many blocks more as empty ones, which say nothing, may be left out.
    """
    edges, plans = [1], []
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    edges += [max(edges[-1] + 1, -(-edges[-1] * 100 // percent)), max(edges[-1] + 1, -(-edges[-1] * 100 // percent)) * 2]
    for a, b in zip(edges[1:], edges[2:], strict=False):
        most = min(b - 1, (a - 1) * 100 // percent)
        differ = (a - 1 + most) * (100 - percent) // (100 + percent)
        light = differ * 15 // 100 + 1
        plans.append((differ + 1 + light, light) if differ else (0, 0))
    return np.array(edges), plans


def sketch_keys(sets: Shingles, chosen: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) for every sketch block that the chosen texts send, in their own band and in the one before.

    Blocks with a shingle are always sent. If a text has more empty blocks than its sketch allows for, it sends those
    too: of two similar texts either one stays within the allowance, and then a block with shingles is equal, or both
    send everything.
    """
    edges, plans = bands(percent, int(sets.sizes.max(initial=1)))
    own = np.searchsorted(edges, sets.sizes, "right") - 1
    words_of = np.array([k for k, _ in plans])
    light_of = np.array([z for _, z in plans])
    keys, owners = [], []
    for shift in (0, -1):
        band = own + shift
        use = chosen & (sets.sizes > 0) & (band >= 0)
        use[use] = words_of[band[use]] > 0
        k = np.where(use, words_of[np.clip(band, 0, len(plans) - 1)], 0)
        mine = use[sets.owner]
        h, owner = sets.h[mine], sets.owner[mine]
        if not len(h):
            continue
        place = ((h >> U64(32)) * k[owner].astype(np.uint64)) >> U64(32)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
        word = np.bitwise_xor.reduceat(mix(h), new)
        place, owner = place[new].astype(np.int64), owner[new]
        light = k - np.bincount(owner, minlength=len(k))
        all_too = np.flatnonzero(use & (light > light_of[np.clip(band, 0, len(plans) - 1)]))
        if len(all_too):
            # The empty blocks of these texts count too, as zero.
            base = np.concatenate([[0], np.cumsum(k[all_too])])
            o2 = np.repeat(all_too, k[all_too])
            p2 = np.arange(base[-1]) - np.repeat(base[:-1], k[all_too])
            w2 = np.zeros(base[-1], np.uint64)
            row = np.full(len(k), -1)
            row[all_too] = np.arange(len(all_too))
            inside = row[owner] >= 0
            w2[base[row[owner[inside]]] + place[inside]] = word[inside]
            word, place, owner = np.concatenate([word[~inside], w2]), np.concatenate([place[~inside], p2]), np.concatenate([owner[~inside], o2])
        salt = mix((band[owner].astype(np.uint64) << U64(32)) + place.astype(np.uint64))
        keys.append(mix(word ^ salt))
        owners.append(owner)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def fold_sketches(sets: Shingles) -> np.ndarray:
    """A parity sketch of FOLD words for each set: their Hamming distance never exceeds the symmetric difference."""
    bits = 64 * FOLD
    place = sets.owner * bits + ((sets.h >> U64(7)) & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sets.sizes) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(-1, FOLD)


def candidate_rows(docs: DataFrame, reps: DataFrame, size: int, percent: int, text_col: str, id_col: str, count: int) -> DataFrame:
    """Two kinds of rows: with part >= 0 packed (key, set) entries of sketch words that more than one set has, and with
    part -1 the shingle hashes of a set that has such a word. reps: block and doc_id of the set's representative."""
    rows = blocks.with_blocks(docs, text_col, {"doc_id": id_col}, count).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = blocks.parts(docs, count)
    # Representatives travel as masks of level -1: their ids, packed.
    ids = reps.select("block", F.lit(-1).alias("level"), F.lit(0).alias("part"), "doc_id")

    def pack_ids(key: tuple, x: pa.Table) -> pa.Table:
        return pa.table({"block": [key[0].as_py()], "level": pa.array([-1], pa.int32()), "part": pa.array([0], pa.int32()), "mask": [x.column("doc_id").to_numpy().astype(np.int64).tobytes()]})

    chosen = ids.groupBy("block").applyInArrow(pack_ids, blocks.MASKS)

    def prepare(texts: pa.Table, back: pa.Table) -> tuple[pa.Table, Shingles, np.ndarray, np.ndarray, np.ndarray]:
        levels = back.column("level").to_pylist()
        own = [np.frombuffer(m, np.int64) for lv, m in zip(levels, back.column("mask").to_pylist(), strict=True) if lv == -1]
        own = np.concatenate([*own, np.zeros(0, np.int64)])
        keep = np.isin(texts.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(), own)
        texts = texts.filter(pa.array(keep, pa.bool_()))
        sets = Shingles(texts.column("text"), size)
        keys, owner = sketch_keys(sets, np.ones(texts.num_rows, bool), percent)
        low, _ = sets.signatures()
        return texts, sets, keys, owner, low

    def level0(texts: pa.Table, back: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        _, _, keys, _, _ = prepare(texts, back)
        return blocks.distinct_keys(keys)

    masks = blocks.find_repeats(blocks.send(rows, level0, 0, n, chosen)).unionByName(chosen)

    def finish(key: tuple, texts: pa.Table, back: pa.Table) -> pa.Table:
        _, sets, keys, owner, low = prepare(texts, back)
        distinct, _ = blocks.distinct_keys(keys)
        repeated = distinct[blocks.unmask(distinct, back, 0, n)]
        hit = np.isin(keys, repeated, kind="sort")
        keys, owner = keys[hit], owner[hit]
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        some, edges = blocks.cuts(keys, n)
        with_word = np.unique(owner)
        blob = lambda x: [x[edges[p] : edges[p + 1]].tobytes() for p in some]
        sizes = sets.sizes.astype(np.uint32)
        return pa.table({
            "part": pa.array([*some, *[-1] * len(with_word)], pa.int32()),
            "keys": pa.array([*blob(keys), *[None] * len(with_word)], pa.binary()),
            "sets": pa.array([*blob(low[owner]), *[None] * len(with_word)], pa.binary()),
            "sizes": pa.array([*blob(sizes[owner]), *[None] * len(with_word)], pa.binary()),
            "node": pa.array([*[None] * len(some), *low[with_word].view(np.int64)], pa.int64()),
            "sketch": pa.array([*[None] * len(some), *fold_sketches(sets)[with_word].tolist()], pa.list_(pa.int64())),
            "hashes": pa.array([*[None] * len(some), *(sets.h[sets.begins[i] : sets.begins[i + 1]].tobytes() for i in with_word)], pa.binary()),
        })

    out = rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(finish, "part int, keys binary, sets binary, sizes binary, node long, sketch array<long>, hashes binary")
    return materialize(out)


def buckets(entries: DataFrame, n: int) -> DataFrame:
    """bucket, node, n: the sets that share a sketch word, once for each distinct company of sets.

    Two packed steps: entries meet by key; what meets is named by a hash of its members, so that the many words that
    the same sets share collapse to one bucket."""

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        keys, sets, sizes = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("sets", np.uint64), ("sizes", np.uint32)))
        order = np.lexsort((sets, keys))
        keys, sets, sizes = keys[order], sets[order], sizes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])
        keys, sets, sizes = keys[new], sets[new], sizes[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.concatenate([starts[1:], [len(keys)]])
        sums = np.concatenate([[U64(0)], np.cumsum(mix(sets.copy()), dtype=np.uint64)])
        names = mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
        many = ends - starts > 1
        starts, ends, names = starts[many], ends[many], names[many]
        _, first = np.unique(names, return_index=True)
        starts, ends, names = starts[first], ends[first], names[first]
        return by_name(names, [sets[a:b] for a, b in zip(starts, ends, strict=True)], [sizes[a:b] for a, b in zip(starts, ends, strict=True)])

    def by_name(names: np.ndarray, sets: list, sizes: list) -> pa.Table:
        """Packed by part of the name space: names, lengths and members."""
        some, edges = blocks.cuts(names, n)
        cat = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t).tobytes()
        slices = [slice(edges[p], edges[p + 1]) for p in some]
        return pa.table({"part": pa.array(some, pa.int32()), "names": pa.array([names[s].tobytes() for s in slices], pa.binary()), "lengths": pa.array([cat([[len(x)] for x in sets[s]], np.int64) for s in slices], pa.binary()), "sets": pa.array([cat(sets[s], np.uint64) for s in slices], pa.binary()), "sizes": pa.array([cat(sizes[s], np.uint32) for s in slices], pa.binary())})

    def once(key: tuple, rows: pa.Table) -> pa.Table:
        names, lengths, sets, sizes = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("names", np.uint64), ("lengths", np.int64), ("sets", np.uint64), ("sizes", np.uint32)))
        _, first = np.unique(names, return_index=True)
        keep = np.zeros(len(names), bool)
        keep[first] = True
        member = np.repeat(keep, lengths)
        return pa.table({"bucket": np.repeat(names, lengths)[member].view(np.int64), "node": sets[member].view(np.int64), "n": sizes[member].astype(np.int64)})

    packed = entries.groupBy("part").applyInArrow(meet, "part int, names binary, lengths binary, sets binary, sizes binary")
    return materialize(packed.groupBy("part").applyInArrow(once, "bucket long, node long, n long"))


def verify(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """member, center and linked for distinct pairs of nodes: the intersection of the two sets, counted.

    Only the members' sets travel, once a pair, to where their centre's set is; the ids of the pairs go to the table of
    hashes, broadcast up to a checked number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"member": batch.column("member"), "center": batch.column("center"), "linked": pa.array(linked, pa.bool_())})

    few = pairs.count() <= BROADCAST_PAIRS
    centers = pairs.select("center").distinct()
    x = hashes.select(F.col("node").alias("center"), F.col("hashes").alias("x")).join(F.broadcast(centers) if few else centers, "center", "left_semi")
    y = hashes.select(F.col("node").alias("member"), F.col("hashes").alias("y")).join(F.broadcast(pairs) if few else pairs, "member")
    return y.join(x.hint("merge"), "center").select("member", "center", "x", "y").mapInArrow(run, "member long, center long, linked boolean")


#: Most links that are joined in one task; more are dealt into so many parts that each has about as many.
PART_LINKS = 100_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a, b, sorted, and for each the least node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node reachable) for every node with a link to another.

    Links are dealt evenly into parts of about PART_LINKS, and each part is joined in one task. Where there is more than
    one part, what the parts make of them goes on by alternating large and small stars: each half step hooks neighbours
    to the least of their neighbourhood; it ends when a full step changes nothing.
    """

    def join(key: tuple, x: pa.Table) -> pa.Table:
        nodes, least = least_reachable(x.column("a").to_numpy(), x.column("b").to_numpy())
        return pa.table({"node": nodes, "comp": least})

    links = links.where("a <> b")
    parts = -(-links.count() // PART_LINKS)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(max(1, parts))).alias("part")
    joined = materialize(links.select("a", "b", part).groupBy("part").applyInArrow(join, "node long, comp long"))
    if parts <= 1:
        return joined
    edges = materialize(joined.select(F.col("node").alias("u"), F.col("comp").alias("v")).where("u <> v").distinct())
    drop_scratch(links.sparkSession, joined)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, materialize(small)
        drop_scratch(links.sparkSession, last)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
        if now == before:
            break
        before = now
    out = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
    drop_scratch(links.sparkSession, edges)
    return out


#: Rounds in which each set is compared with one centre, before the rest is compared pair by pair.
STAR_ROUNDS = 3


def linked_components(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and comp for all nodes that have a link, given who met in which bucket (bucket, node, n) and the sets of the
    nodes (node, sketch, hashes).

    Pairs inside a bucket count only as far as they can join different components, and only those are verified whose
    sizes and whose sketches' Hamming distance allow the wanted similarity. In
    a star round every bucket with more than one component picks a centre (another one each round), and every set of
    another component is compared with one centre of its buckets; copies of one text are soon all in one component.
    Then the remaining pairs across components are compared, all of them: no link between components is lost. At least
    one of such a pair lies outside the bucket's commonest component, so only those meet the whole bucket. Two sets
    that share many words share many buckets; they are paired in the least of those they both know of (each knows its
    FIRST least), and never skipped in the least that they have in common at all.
    """
    checked, comps, left_over = None, None, []
    sizes_fit = f"comp <> ccomp and least(n, cn) * 100 >= {percent} * greatest(n, cn)"
    hamming = " + ".join(f"bit_count(sketch[{k}] ^ csketch[{k}])" for k in range(FOLD))
    sketches_fit = f"({hamming}) * {100 + percent} <= (n + cn) * {100 - percent}"
    sketches = sets.select("node", "sketch")
    members = met
    for turn in range(STAR_ROUNDS + 1):
        written = comps is not None
        labelled = members.withColumn("comp", F.col("node")) if not written else materialize(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        for old in left_over:
            drop_scratch(met.sparkSession, old)
        left_over = []
        center = F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit(turn)))
        open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("most"), center.alias("c")).where("lo <> hi")
        met_here = F.col("h.bucket") == F.col("o.bucket")
        if turn < STAR_ROUNDS:
            # Ids and sizes only: a set meets the same centre in many buckets, so sketches are added to distinct pairs.
            other = open_.select("bucket", F.col("c.node").alias("cnode"), F.col("c.n").alias("cn"), F.col("c.comp").alias("ccomp"))
            near = labelled.alias("h").join(other.alias("o"), met_here & F.expr(sizes_fit)).select("node", "n", "cnode", "cn").distinct()
            near = near.join(sketches, "node").join(sketches.select(F.col("node").alias("cnode"), F.col("sketch").alias("csketch")), "cnode").where(sketches_fit)
        else:
            still = materialize(labelled.join(open_.select("bucket", "most"), "bucket"))
            firsts = still.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("bucket")), 1, FIRST).alias("firsts"))
            here = materialize(still.join(firsts, "node").join(sketches, "node"))
            other = here.where("comp <> most").select("bucket", F.col("node").alias("cnode"), F.col("n").alias("cn"), F.col("sketch").alias("csketch"), F.col("comp").alias("ccomp"), F.col("firsts").alias("cfirsts"))
            once = (F.col("comp") == F.col("most")) | (F.col("node") < F.col("cnode"))
            unmet = "coalesce(array_min(array_intersect(firsts, cfirsts)) >= h.bucket, true)"
            near = here.alias("h").join(other.alias("o"), met_here & once & F.expr(f"{sizes_fit} and {sketches_fit} and {unmet}")).select("node", "cnode").distinct()
        pairs = near.select(F.col("node").alias("member"), F.col("cnode").alias("center"))
        if checked is not None:
            pairs = pairs.join(checked, (F.least("member", "center") == F.col("a")) & (F.greatest("member", "center") == F.col("b")), "left_anti")
        if turn < STAR_ROUNDS:
            pairs = pairs.groupBy("member").agg(F.min_by("center", F.xxhash64("center", F.lit(turn))).alias("center"))
        pairs = materialize(pairs)
        got = materialize(verify(pairs, sets, percent))
        left_over.append(pairs)
        seen = got.select(F.least("member", "center").alias("a"), F.greatest("member", "center").alias("b"))
        checked = seen if checked is None else checked.unionByName(seen)
        new = got.where("linked").select(F.col("member").alias("a"), F.col("center").alias("b"))
        if new.head(1):
            # The stars of earlier components and the new links say all that is needed.
            links = new if comps is None else new.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a <> b"))
            comps = components(links)
        if turn < STAR_ROUNDS:
            left_over += [labelled] if written else []
            members = labelled.join(open_.select("bucket"), "bucket", "left_semi").drop("comp")
    for old in (*left_over, *([labelled] if written else []), still, here):
        drop_scratch(met.sparkSession, old)
    if comps is None:
        return met.sparkSession.createDataFrame([], "node long, comp long")
    return comps


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leaders: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    A document's set: the distinct word shingles of its whole text (A-Z lower-cased), or its whole word sequence if it
    has fewer words than size. Two documents link when 100 * intersection >= percent * union; component_id is the
    least doc_id reachable by links. Null, empty and wordless texts have an empty set and link with nothing: their
    component is their own id. Null ids are kept and never lend their id to a component that has another. Repeated
    rows are equal sets. An empty table gives an empty result; other columns are not read.

    leaders adds text_hash (xxhash64 of the text) and leads: whether the row's id and text are those of the one chosen
    member of its component (the least id, null ids last; rows that repeat both are told alike). A text with an empty
    set leads itself.

    Equal sets are found by signature first, so copies of one text are one node from there on.
    """
    count = blocks.block_count(docs, text_col)
    rows = blocks.with_blocks(docs, text_col, {"doc_id": id_col}, count).withColumn("doc_id", F.col("doc_id").cast("long"))

    def sets(batch: pa.RecordBatch) -> dict:
        s = Shingles(batch.column("text"), size)
        low, high = s.signatures()
        return {"doc_id": batch.column("doc_id"), "block": batch.column("block"), "n_shingles": pa.array(s.sizes, pa.int64()), "low": low.view(np.int64), "high": high.view(np.int64)}

    if leaders:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    keep = ["text_hash"] if leaders else []
    found = materialize(map_arrow(rows, lambda batch: sets(batch) | {c: batch.column(c) for c in keep}, SETS + "".join(f", {c} long" for c in keep)))
    real = found.where("n_shingles > 0")
    # Nodes are named by the first half of the signature; the second must agree too.
    least = real.groupBy("low", "high").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("id"), "block", *keep)).alias("r"))
    least = materialize(least.select("low", "high", F.col("r.id").alias("id"), F.col("r.block").alias("block"), *[F.col(f"r.{c}").alias(f"first_{c}") for c in keep]))
    parts = candidate_rows(docs, least.select("block", F.col("id").alias("doc_id")), size, percent, text_col, id_col, count)
    met = buckets(parts.where("part >= 0"), blocks.parts(docs, count))
    comps = linked_components(met, parts.where("part = -1").select("node", "sketch", "hashes"), percent)
    for old in (parts, met):  # the dear ones; components are written down
        drop_scratch(docs.sparkSession, old)
    named = least.join(comps.withColumnRenamed("node", "low"), "low", "left").withColumn("comp", F.coalesce("comp", "low"))
    firsts = [F.min(F.struct("id", "block", *[f"first_{c}" for c in keep])).alias("first")] if leaders else []
    ids = named.groupBy("comp").agg(F.min("id").alias("component_id"), *firsts)
    classes = named.join(ids, "comp").select("low", "high", "component_id", *(["first"] if leaders else []))
    out = found.join(classes, ["low", "high"], "left")
    own = F.when((F.col("n_shingles") > 0) & (F.col("component_id") < np.iinfo(np.int64).max), F.col("component_id")).otherwise(F.col("doc_id"))
    if not leaders:
        return out.select("doc_id", "n_shingles", own.alias("component_id"))
    first = (F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)) == F.col("first.id")) & (F.col("text_hash") == F.col("first.first_text_hash"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash", ((F.col("n_shingles") == 0) | first).alias("leads"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as jaccard_components has them."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES: dict[str, str] = {}
