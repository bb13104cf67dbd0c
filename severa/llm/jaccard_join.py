"""N-gram Jaccard join: a MinHash LSH forest, followed by exact verification.

Every text becomes the set of its hashed word n-grams. A tree's signature of a set is a run of `longest` min-hashes; the
trees' sorted signatures are prefix tries, whose nodes at depth d hold the sets with the same first d min-hashes. Two sets
of similarity J share such a node of one tree with probability J**d, and of some tree with `recall(J, d, trees)`.

The join begins with the longest prefixes and shortens them in rounds. A set takes part in a round while the recall of the
rounds before, for the least similarity at or above the threshold that a set of its size can have with another, is below
the target; it goes on no further once the target is reached, and a node whose sets are already known to be of one class is
not looked at again. So:

1. Every set is compared with the smallest set that it meets at the longest prefix. Links that hold join sets to classes;
   only verified links do, so sets of weak similarity make no chains.
2. The sets of a class are compared, all pairs, in blocks of at most 2 * BLOCK sets: pairs are counted inside a task and
   never written as rows.
3. In each round, the sets of a trie node that belong to different classes are compared, again in blocks. A pair is
   verified in the first tree where it meets and not again at shorter prefixes.

Copies are one set with a number of copies. Verification is exact on 64-bit hashes of the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.operators.graph import connected_components
from severa.staging import drop_staged, stage

from . import hashing
from .common import has_repeats, keyed, small_batches, text_of, without

U64 = np.uint64
#: Sets are verified in blocks of about so many against each other.
BLOCK = 256
#: Columns of the membership matrix that are multiplied at once.
COLUMNS = 4096


def recall(similarity: float, depth: int, trees: int) -> float:
    """The probability that two sets of this similarity share a node at this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float, trees: int, longest: int, target: float) -> int:
    """The longest matched prefix whose forest finds a pair at the threshold with the target probability."""
    for depth in range(longest, 0, -1):
        if recall(threshold, depth, trees) >= target:
            return depth
    raise ValueError("more trees are needed for this recall")


def least_similarity(size: int, threshold: float) -> float:
    """The least Jaccard similarity at or above the threshold that a set of so many elements has with any other set; 1 if
    there is none."""
    part = Fraction(str(threshold))
    best = Fraction(1)
    for other in range(max(1, -(-size * part.numerator // part.denominator)), size * part.denominator // part.numerator + 1):
        common = min(size, other)
        if size == other:
            common -= 1
        shared = -(-part * (size + other) // (1 + part))
        if 0 < shared <= common:
            best = min(best, Fraction(int(shared), int(size + other - shared)))
    return float(best)


def depths(threshold: float, trees: int, longest: int, target: float) -> list[int]:
    """Prefix lengths of the rounds: the longest, and the one that a pair exactly at the threshold needs."""
    last = prefix_length(threshold, trees, longest, target)
    return [longest, last] if last < longest else [longest]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and where each text's begin. A text of fewer
    words than n, but not none, is one n-gram."""
    words, first = hashing.words_of(data, offsets)
    counts = np.diff(first)
    grams, at = hashing.windows_of(words, first, n)
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        sums = hashing.prefix(words)
        whole = (sums[first[short] + counts[short]] - sums[first[short]]) * hashing.powers(len(words))[0][first[short]]
        grams, doc = np.concatenate([grams, hashing.mix(whole + counts[short].astype(U64))]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(counts) + 1))


def _sign(n: int, trees: int, rounds: list[int]):
    """Rows (text, any others) -> the others, size and hash of the n-gram set, and its node in each tree at the depth of
    each round: d0 of the first, and so on."""
    factors = hashing.mix(np.arange(1, trees * rounds[0] + 1, dtype=U64)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in hashing.texts_of(batch.column(0)):
                grams, begin = _sets(data, offsets, n)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                ids, nodes = np.zeros(hi - lo, U64), np.zeros((len(rounds), len(full), trees), U64)
                if len(full):
                    ids[full] = hashing.mix(np.add.reduceat(hashing.mix(grams ^ U64(0xA5A5A5A5A5A5A5A5)), begin[full]) + size[full].astype(U64))
                    for t in range(trees):
                        node = np.full(len(full), t + 1, U64)
                        for j in range(rounds[0]):
                            least = np.minimum.reduceat((grams * factors[t * rounds[0] + j]) >> U64(32), begin[full])
                            node = hashing.mix(node * U64(hashing.BASE) + least)
                            if j + 1 in rounds:
                                nodes[rounds.index(j + 1), :, t] = node
                ends = pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, trees, 0))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).view(np.int64))) for x in nodes]
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns[1:], pa.array(size, pa.int32()), pa.array(ids.view(np.int64)), *lists], names=[*batch.schema.names[1:], "n", "id", *(f"d{i}" for i in range(len(rounds)))])

    return run


def _shingled(n: int):
    """Rows (text, ...) -> (..., grams): the sorted distinct n-gram hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in hashing.texts_of(batch.column(0)):
                grams, begin = _sets(data, offsets, n)
                own = batch.slice(lo, hi - lo)
                sets = pa.array([grams[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[1:], sets], names=[*batch.schema.names[1:], "grams"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    every, of = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    sides = np.bincount(of[owner < len(left)], minlength=len(every)), np.bincount(of[owner >= len(left)], minlength=len(every))
    shared = (sides[0] > 0) & (sides[1] > 0)
    place = np.cumsum(shared) - 1
    use = shared[of]
    of, owner = place[of[use]], owner[use]
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(of, (c, c + COLUMNS))
        cells = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        cells[owner[a:b], of[a:b] - c] = 1
        out += (cells[: len(left)] @ cells[len(left) :].T).astype(np.int64)
    return out


def _linked(part: Fraction, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    both = _common(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])
    return part.denominator * both >= part.numerator * (sizes - both)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches ordered by their first columns -> tables of whole groups, and where the groups begin, with the end last.
    Only the group that goes on in the next batch is held."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)])
        return table, np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0), [True]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        other = np.flatnonzero((keys != keys[:, -1:]).any(0))
        last = int(other[-1]) + 1 if len(other) else 0
        same = held and all(held[-1].column(i)[-1].as_py() == keys[i, 0] for i in range(n_keys))
        if held and not (same and last == 0):  # the group that was held ends in this batch, or ended before it
            yield whole([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield whole([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def _of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _stars(threshold: float):
    """Rows (hub, salt, id, own, grams), ordered by the first two, `own` marking the hub's -> (id, hub) of the sets that are
    linked with their hub."""
    part = Fraction(str(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _runs(batches, 2):
            hubs, own, ids = _of(table, "hub"), _of(table, "own"), _of(table, "id")
            grams = [np.frombuffer(g, U64) for g in table.column("grams").to_pylist()]
            found: list[np.ndarray] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rest = np.flatnonzero(~own[a:b]) + a
                hub = int(np.flatnonzero(own[a:b])[0]) + a
                if len(rest):
                    found.append(rest[_linked(part, [grams[hub]], [grams[i] for i in rest])[0]])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(hubs[at], pa.int64())], names=["id", "hub"])

    return run


_FOUND = "id long, links long, peer long"


def _verify(threshold: float, before: list[str], now: str | None):
    """Rows (key, lo, hi, block, id, class, copies, nodes ..., grams), ordered by the first three -> for each set of a
    group that has links there the copies of the sets that it is linked with, and the smallest set that they lead to.

    Without `now` a group is of one class and all its pairs count. With it, key is a node of the column `now`, and pairs of
    one class, pairs that meet in an earlier tree or met in a round `before` are left out."""
    part = Fraction(str(threshold))

    def open_pairs(table: pa.Table, key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        of_class = _of(table, "class")
        out = of_class[left][:, None] != of_class[right]
        nodes = {c: table.column(c).combine_chunks().flatten().to_numpy().reshape(len(table), -1) for c in [*before, now]}
        tree = int(np.flatnonzero(nodes[now][left[0]] == key)[0])
        for name, trees in [(now, tree), *((c, nodes[c].shape[1]) for c in before)]:
            for t in range(trees):
                out &= nodes[name][left, t][:, None] != nodes[name][right, t]
        return out

    def group(table: pa.Table, key: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, block, copies = (_of(table, c) for c in ("id", "block", "copies"))
        sets = [np.frombuffer(g, U64) for g in table.column("grams").to_pylist()]
        left = right = np.arange(len(ids))
        if lo != hi:
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block != lo)
        linked = np.zeros((len(ids), len(ids)), bool)
        if len(left) and len(right):
            asked = open_pairs(table, key, left, right) if now else np.ones((len(left), len(right)), bool)
            if asked.any():
                l_use, r_use = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
                left, right, asked = left[l_use], right[r_use], asked[np.ix_(l_use, r_use)]
                linked[np.ix_(left, right)] = asked & _linked(part, [sets[i] for i in left], [sets[i] for i in right])
        linked |= linked.T
        np.fill_diagonal(linked, False)
        label = np.empty(len(ids), np.int64)
        ranks = np.argsort(ids, kind="stable")
        label[ranks] = np.arange(len(ids))
        near = linked | np.eye(len(ids), dtype=bool)
        while linked.any():
            new = np.where(near, label, len(ids)).min(1)
            if (new == label).all():
                break
            label = new
        use = np.flatnonzero(linked.any(1))
        return ids[use], (linked[use] * copies).sum(1), ids[ranks[label]][use]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _runs(batches, 3):
            keys, lo, hi = (_of(table, c) for c in ("key", "lo", "hi"))
            found = [group(table.slice(a, b - a), keys[a], lo[a], hi[a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in range(3)], names=["id", "links", "peer"])

    return run


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def _in_blocks(members: DataFrame, verify) -> DataFrame:
    """members (key, own, upto, id, ...), each in block `own` of its key and to meet the blocks below `upto` -> what `verify`
    finds in every pair of blocks."""
    rest = [c for c in members.columns if c not in ("key", "own", "upto")]
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)))
    spread = spread.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("block"), *rest)
    return spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(verify, _FOUND)


def _mixed(of_class: DataFrame) -> DataFrame:
    """(node, id, class) -> the members of nodes of several classes, dealt into blocks: node, id, class, own, upto. The sets
    of a node's largest class have blocks of their own, which need not meet one another; a small node is one block."""
    per = of_class.groupBy("node", "class").agg(F.count("*").alias("n"))
    nodes = per.groupBy("node").agg(F.count("*").alias("classes"), F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("every")).where("classes > 1")
    nodes = nodes.select("node", "every", F.col("top.class").alias("main"), _blocks(F.col("top.n")).alias("large"), _blocks(F.col("every") - F.col("top.n")).alias("rest"))
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    of_main, one = F.col("class") == F.col("main"), F.col("every") <= BLOCK
    own = F.when(one, 0).when(of_main, F.col("rest") + deal("large")).otherwise(deal("rest"))
    upto = F.when(one, 1).when(of_main, F.col("rest")).otherwise(F.col("rest") + F.col("large"))
    return of_class.join(nodes, "node").select("node", "id", "class", own.alias("own"), upto.alias("upto"))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, longest: int = 8, target: float = 0.9999) -> DataFrame:
    """documents (doc_id, text, any others) -> a row for each: k, occ (its key), doc_id, class_id, n_links, first.

    Words are split at ASCII white space and not changed. n_links counts the other documents whose n-gram sets have a
    Jaccard similarity of at least the threshold; class_id is the smallest doc_id that such links lead to; `first` marks
    the one document of each class with the smallest key. Documents without words have no links and are classes of
    their own. Null doc_ids come last and have a null class_id if alone; doc_ids may have any type (`keyed` has their
    order). A row repeated with its doc_id and text is the same document. An empty table gives no rows; other columns are
    not read."""
    small_batches(docs.sparkSession)
    rounds = depths(threshold, trees, longest, target)
    nodes = [f"d{i}" for i in range(len(rounds))]
    rows = keyed(docs, text_of().alias("text"), F.col("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = rows.select("text", "k", "occ", "doc_id").mapInArrow(_sign(n, trees, rounds), f"k long, occ long, doc_id {kind}, n int, id long, {', '.join(f'{c} array<long>' for c in nodes)}")
    signed = stage(signed, "signed")
    one = signed.where("n > 0")
    repeats = has_repeats(docs)
    one = one.dropDuplicates(["k", "occ"]) if repeats else one
    sets = one.groupBy("id").agg(F.min(F.struct("k", "occ", "doc_id")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in nodes])
    sets = stage(sets, "sets")
    # A set takes part in the rounds from the first on, until its recall is reached.
    going = {0: F.lit(True)}
    for i in range(1, len(rounds)):
        done = [s for s in range(1, 64) if recall(least_similarity(s, threshold), rounds[i - 1], trees) >= target]
        going[i] = ~F.col("n").isin(done) if done else F.lit(True)

    def meeting(i: int) -> DataFrame:
        """(node, id) of the trie nodes of round i that hold two sets or more."""
        every = sets.where(going[i]).select("id", F.explode(nodes[i]).alias("node"))
        return every.join(every.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1"), "node")

    met = [stage(meeting(i), f"nodes-{rounds[i]}") for i in range(len(rounds))]
    # Only sets that meet another need their n-grams. A longer prefix's companions are also the shorter one's.
    some = reduce(DataFrame.union, [m.select("id") for m in met]).distinct()
    texts = rows.dropDuplicates(["k", "occ"]) if repeats else rows
    wanted = some.join(sets, "id").select("rep.k", "rep.occ", "id", "copies", *nodes)
    columns = f"id long, copies long, {', '.join(f'{c} array<long>' for c in nodes)}"
    shingled = texts.select("k", "occ", "text").join(wanted, ["k", "occ"]).select("text", "id", "copies", *nodes).mapInArrow(_shingled(n), f"{columns}, grams binary")
    grams = stage(shingled, "shingles")

    # 1. Each set with the smallest that it meets at the longest prefix.
    pairs = stage(met[0].groupBy("id").agg(F.min("least").alias("hub")).where("id <> hub"), "stars")
    salts = pairs.groupBy("hub").agg(_blocks(F.count("*")).alias("salts"))
    members = pairs.join(salts, "hub").join(grams.select("id", "grams"), "id").select("hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", F.lit(False).alias("own"), "grams")
    hubs = salts.join(grams.select(F.col("id").alias("hub"), "grams"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("id"), F.lit(True).alias("own"), "grams")
    starred = stage(members.union(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt").mapInArrow(_stars(threshold), "id long, hub long"), "links")
    classes = stage(connected_components(starred, "id", "hub").select(F.col("node").alias("id"), F.col("root").alias("class")), "classes")

    # 2. All pairs of a class.
    sizes = classes.groupBy("class").agg(_blocks(F.count("*")).alias("upto"))
    own = F.pmod(F.xxhash64("id"), F.col("upto")).cast("int").alias("own")
    inside = classes.join(sizes, "class").join(grams.select("id", "copies", "grams"), "id").select(F.col("class").alias("key"), own, "upto", "id", "class", "copies", "grams")
    found = [stage(_in_blocks(inside, _verify(threshold, [], None)), "links")]

    # 3. Pairs of different classes, with ever shorter prefixes.
    for i, at in enumerate(met):
        of_class = at.select("node", "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
        carried = grams.select("id", "copies", *nodes[: i + 1], "grams")
        across = _mixed(of_class).join(carried, "id").select(F.col("node").alias("key"), "own", "upto", "id", "class", "copies", *nodes[: i + 1], "grams")
        found.append(stage(_in_blocks(across, _verify(threshold, nodes[:i], nodes[i])), "links"))

    drop_staged(grams, pairs, classes, *met)
    every = reduce(DataFrame.union, found)
    links = every.groupBy("id").agg(F.sum("links").alias("links"))
    edges = starred.select("id", F.col("hub").alias("peer")).union(reduce(DataFrame.union, found[1:]).select("id", "peer"))
    roots = connected_components(edges, "id", "peer").select(F.col("node").alias("id"), "root")
    of_set = sets.select("id", "rep", "copies").join(links, "id", "left").join(roots, "id", "left").select("id", "rep", F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    heads = of_set.groupBy("root").agg(F.min("rep").alias("head"))
    known = of_set.join(heads, "root").select("id", "head", "n_links", F.lit(True).alias("words"))
    out = signed.select("k", "occ", "doc_id", "n", "id").join(known, "id", "left")
    alone = F.struct("k", "occ", "doc_id")
    head = F.when((F.col("n") > 0) & F.col("words"), F.col("head")).otherwise(alone)
    n_links = F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select("k", "occ", "doc_id", head["doc_id"].alias("class_id"), n_links.alias("n_links"), ((head["k"] == F.col("k")) & (head["occ"] == F.col("occ"))).alias("first"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents without all but one (the smallest doc_id) of each class of `jaccard_join`. A row repeated with its
    doc_id and text stays once."""
    gone = jaccard_join(docs, **options).where("not first").select("k", "occ")
    kept = without(docs, gone)
    if not has_repeats(docs):
        return kept
    rest = [F.col(f"`{c}`") for c in docs.columns]
    return keyed(kept, F.struct(*rest).alias("doc")).dropDuplicates(["k", "occ"]).select("doc.*")
