"""Near-duplicates by minhash with tensored banding; every link is confirmed on full shingle sets.

A table's key is made of two halves, each a hash of `half` minhashes. A tensor takes `side` halves from
either of two small collections and forms side * side keys from them, so `tensors` of them give
tensors * side**2 tables from only 2 * tensors * side * half minhashes. Two sets of Jaccard similarity s
share no key of a tensor with probability 1 - (1 - q)**2, q = (1 - s**half)**side. With the defaults (2,
3, 6: 54 tables from 72 minhashes) and s = 0.8 all six tensors fail for 6 pairs in ten million.

Equal sets are one node from the start, so copies never meet as pairs. Each node is first tested against
the leaders of its buckets (a few for each group of near copies, as buckets share them), which links most
of a large group at the cost of a few tests for each member. Nodes that are then still in another component
than their leader are tested against all that share the leader, block by block. A pair of a bucket shares its
leader, so none stays unresolved; blocks have a fixed size, and only links leave them.

Joins are asked to merge: all sides grow with the corpus, and on a small one the many rounds would otherwise have the
driver collect and keep a table for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, fresh, slices, text_key, texts_of, written

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)


#: Words, and sketches of sets, that a worker remembers; what it forgets is computed again.
WORDS_KEPT, SKETCHES_KEPT = 50_000, 5_000


class WordHashes(dict):
    """64-bit hashes of words; forgets all of them at a bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words; of all words where they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    if not n:
        return h
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * _MUL + h[j : len(h) - n + 1 + j]
    out ^= out >> np.uint64(29)
    out *= _MUL2
    return np.unique(out + np.uint64(n))


class Sketcher:
    def __init__(self, half: int, side: int, tensors: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half, self.n = half, 2 * side * tensors
        self.xor = rng.integers(0, 2**63, self.n * half, dtype=np.uint64)
        self.mul = rng.integers(0, 2**63, self.n * half, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def halves(self, s: np.ndarray) -> np.ndarray:
        """One number for each half key: a hash of `half` minhashes of the set."""
        low = np.full(len(self.xor), np.iinfo(np.uint64).max, dtype=np.uint64)
        for a in range(0, len(s), 4096):
            x = (s[None, a : a + 4096] ^ self.xor[:, None]) * self.mul[:, None]
            x ^= x >> np.uint64(32)
            x *= _MUL
            np.minimum(low, x.min(axis=1), out=low)
        out = np.zeros(self.n, dtype=np.uint64)
        for j in range(self.half):
            out = (out ^ low[j :: self.half]) * _MUL2
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


_SETS = "doc_id long, text_key string, n_shingles long, node binary, halves array<long>"
_FULL = "node binary, n long, shingles array<long>"


def _sketch(docs: DataFrame, size: int, half: int, side: int, tensors: int) -> DataFrame:
    schema = arrow_schema(_SETS)

    def run(batches):
        memo, sketcher, same = WordHashes(), Sketcher(half, side, tensors), {}
        for batch in slices(batches):
            n, nodes, halves = [], [], []
            for text in texts_of(batch):
                s = shingles(text, size, memo)
                n.append(len(s))
                node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                nodes.append(node)
                if node is not None and node not in same:
                    if len(same) >= SKETCHES_KEPT:
                        same.clear()
                    same[node] = sketcher.halves(s)
                halves.append(same.get(node))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, _SETS)


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    schema = arrow_schema(_FULL)

    def run(batches):
        memo = WordHashes()
        for batch in slices(batches):
            found = {}
            for text in texts_of(batch):
                s = shingles(text, size, memo)
                if len(s):
                    found[hashlib.blake2b(s.tobytes(), digest_size=16).digest()] = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([len(s) for s in found.values()], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, _FULL)


def _buckets(nodes: DataFrame, side: int, tensors: int) -> DataFrame:
    """(bucket, node, n) of the buckets that hold two nodes or more."""
    tables = [(t, i, j) for t in range(tensors) for i in range(side) for j in range(side)]
    keys = [F.xxhash64(F.lit(k), F.col("halves")[(2 * t) * side + i], F.col("halves")[(2 * t + 1) * side + j]) for k, (t, i, j) in enumerate(tables)]
    rows = nodes.select("node", "n", F.explode(F.array(*keys)).alias("bucket"))
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("bucket"))).where("members > 1").drop("members")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(a, b): comp is the least node that can be reached.

    Each round all nodes of a label follow the least label that any of them meets, then that label's new
    label twice over, so chains of labels shrink fast; each round's labels are a written table, and the loop
    ends when none changed."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = ends.withColumn("comp", F.col("node"))
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("comp").alias("other"))
        near = both.join(of.hint("merge"), "b").groupBy("a").agg(F.min("other").alias("near")).withColumnRenamed("a", "node")
        low = labels.join(near.hint("merge"), "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        # the whole component follows its least label
        moved = low.groupBy("comp").agg(F.min("low").alias("to"))
        for _ in range(2):
            further = moved.select(F.col("comp").alias("to"), F.col("to").alias("then"))
            moved = moved.join(further.hint("merge"), "to").select("comp", F.col("then").alias("to"))
        after = written(low.join(moved.hint("merge"), "comp").select("node", F.col("to").alias("comp"), (F.col("to") != F.col("comp")).alias("changed")), "labels")
        labels = after.select("node", "comp")
        if not after.where("changed").take(1):
            return labels


#: Shingles on either side of a block, about: what bounds a task's memory (a single larger set is a block of its own).
BLOCK = 600_000
_LINKS = "a binary, b binary"
#: Into how many parts the nodes of a leader are dealt where they meet facts about it.
SALTS = 16


def _compare(percent: int):
    """Links between the nodes of role 1 and those of role 2 of a block, where their components differ."""
    schema = arrow_schema(_LINKS)

    def run(block: pa.Table) -> pa.Table:
        role, comp = block.column("role").to_numpy(), np.asarray(block.column("comp").to_pylist(), dtype=object)
        nodes, n = block.column("node").to_pylist(), block.column("n").to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in block.column("shingles")]
        left, right = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
        if not len(left) or not len(right):  # nodes are dealt by hash, so few large ones may leave a side empty
            return schema.empty_table()
        values = np.concatenate([sets[k] for k in right])
        owner = np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for k in left:
            low, high = np.searchsorted(values, sets[k], side="left"), np.searchsorted(values, sets[k], side="right")
            size = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            shared = np.bincount(owner[at], minlength=len(right))
            near = (100 * shared >= percent * (n[k] + n[right] - shared)) & (comp[right] != comp[k])
            a += [nodes[k]] * int(near.sum())
            b += [nodes[j] for j in right[near]]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    return run


def link(docs: DataFrame, size: int = 5, percent: int = 80, half: int = 2, side: int = 3, tensors: int = 6, classes: int = 8) -> DataFrame:
    """Connected near-duplicates of docs(doc_id, text): a row for each row of docs.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of `size`-word
    shingles (words of lower-cased text between white space; fewer words than size are one shingle).
    component_id is the smallest doc_id that can be reached, kept whether it is the document's own.
    A null or empty text, or one of white space, has no shingle and no link. A null doc_id is linked like
    any other but never names a component that has an id; alone, its component_id is null. A text of any
    length is compared by its full set; an empty table gives no rows. Rows that share a doc_id are nodes of their own, each with its row. Other columns are not read.
    """
    out = _labelled(docs, size, percent, half, side, tensors, classes, F.lit(None).cast("string"))
    found = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def one_of_each(docs: DataFrame, salts: int = 16, **how) -> DataFrame:
    """docs, all columns, with one row of each group that link() joins: that with the smallest doc_id, null
    ids last, then by a digest of the text. Of rows equal in both any one stays. Rows are known by id and
    text, so rows that only share an id with a linked row stay, and so do those without a shingle."""
    defaults = {"size": 5, "percent": 80, "half": 2, "side": 3, "tensors": 6, "classes": 8}
    rows = _labelled(docs, **(defaults | how), key=text_key(F.col("text"))).where("node is not null")
    rows = written(rows.groupBy("comp", "doc_id", "text_key").agg(F.count("*").alias("copies")), "linked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("least")
    # groups of one row need no choice; a large group is dealt over `salts` tasks
    groups = rows.groupBy("comp").agg(least, F.sum("copies").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    told = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int")).join(groups, ["comp", "salt"])
    told = told.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    told = written(told.where("not stays or copies > 1").select(F.col("doc_id").alias("told_id"), F.col("text_key").alias("told_key"), "stays"), "told")
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))

    def among(some: DataFrame) -> Column:
        return keyed["doc_id"].cast("long").eqNullSafe(some["told_id"]) & (keyed[key] == some["told_key"])

    out = keyed.join(told, among(told), "left_anti").drop(key)
    again = told.where("stays")
    if again.take(1):  # the row that stays is there several times
        out = out.unionByName(keyed.join(again, among(again), "left_semi").dropDuplicates(["doc_id", key]).drop(key))
    return out


def _labelled(docs: DataFrame, size: int, percent: int, half: int, side: int, tensors: int, classes: int, key: Column) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, n_shingles, node, comp (a node of the component) and component (its least doc_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("text_key"))
    sets = written(_sketch(docs, size, half, side, tensors), "sketches")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.max("n_shingles").alias("n"), F.first("halves").alias("halves"))
    rank = F.xxhash64("node", F.pmod("bucket", F.lit(classes)))
    crowd = _buckets(nodes, side, tensors).withColumn("lead", F.min(F.struct(rank, "node", "n")).over(Window.partitionBy("bucket")))
    crowd = written(crowd.select("node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")).distinct(), "leaders")

    members = crowd.select("node").distinct()
    chosen = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(members.hint("merge"), "node").select("low").distinct()
    wanted = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["low"]), "left_semi")
    full = written(_full_sets(wanted, size).join(members.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "shingles")

    # every node against its leaders
    near = crowd.where((F.col("node") != F.col("lead")) & (100 * F.col("n") >= percent * F.col("lead_n")) & (100 * F.col("lead_n") >= percent * F.col("n")))
    one = full.select(F.col("node").alias("lead"), F.col("shingles").alias("lead_set"))
    tested = near.join(full.select("node", "shingles").hint("merge"), "node").join(one.hint("merge"), "lead").withColumn("i", F.size(F.array_intersect("shingles", "lead_set")))
    linked = tested.where(100 * F.col("i") >= percent * (F.col("n") + F.col("lead_n") - F.col("i"))).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    labels = components(linked)

    # nodes apart from their leader against all that share the leader, in blocks
    def named(c: str) -> DataFrame:
        return labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))

    # a leader that very many nodes share is dealt over the salts; what is copied is its label, and later its sizes
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    leads = crowd.select("lead").distinct().join(named("lead").hint("merge"), "lead").withColumn("salt", salts)
    own = crowd.select("lead", "node", "n", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    own = own.join(named("node").hint("merge"), "node", "left").join(leads.hint("merge"), ["lead", "salt"], "left")
    own = own.select("lead", "salt", "node", "n", F.coalesce("node_comp", "node").alias("comp"), (F.coalesce("node_comp", "node") != F.coalesce("lead_comp", "lead")).alias("stray"))
    sizes = own.groupBy("lead").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("s")).where("s > 0")
    sizes = sizes.select("lead", F.ceil(F.col("m") / BLOCK).cast("int").alias("nj"), F.ceil(F.col("s") / BLOCK).cast("int").alias("ni"))
    dealt = own.join(sizes.withColumn("salt", salts).hint("merge"), ["lead", "salt"]).withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = dealt.where("stray").select("lead", "node", "comp", F.lit(1).alias("role"), F.pmod("h", "ni").cast("int").alias("i"), every("nj").alias("j"))
    others = dealt.select("lead", "node", "comp", F.lit(2).alias("role"), F.pmod("h", "nj").cast("int").alias("j"), every("ni").alias("i"))
    blocks = strays.unionByName(others).join(full.hint("merge"), "node").select("lead", "i", "j", "role", "node", "comp", "n", "shingles")
    more = written(blocks.groupBy("lead", "i", "j").applyInArrow(_compare(percent), _LINKS).distinct(), "links")
    if more.take(1):  # the links join whole components
        to = more.join(named("a").hint("merge"), "a", "left").join(named("b").hint("merge"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).distinct()
        merged = components(to).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        singles = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.hint("merge"), "node", "left_anti").withColumn("comp", F.col("node"))
        labels = labels.unionByName(singles).join(merged.hint("merge"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))

    named_sets = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lows = named_sets.groupBy("comp").agg(F.min("low").alias("component"))
    component = named_sets.join(lows.hint("merge"), "comp").select("node", "comp", "component")
    return sets.select("doc_id", "text_key", "n_shingles", "node").join(component.hint("merge"), "node", "left")
