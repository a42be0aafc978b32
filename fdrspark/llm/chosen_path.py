"""Jaccard join of word n-grams by chosen paths."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import WordNames, hot_keys, join_split, left_join_present, mix, pair_name, slices, stored, table, text_digest, texts, trimmed, words_of
from fdrspark.llm.components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Tokens of the embedding: one least hash for each of so many functions.
TOKENS = 64
#: Tokens that a set is expected to choose at each node of each run.
CHOICES = 2.5
#: Nodes of up to LEAF sets are compared all by all, those of more than TASK sets in pairs of blocks, so that no task has more; larger nodes are split, at most DEPTH times, then dealt in blocks as well.
LEAF, DEPTH, TASK = 4000, 5, 1000
#: Sets of a node above TASK that differ from its pivot in NEAR tokens at the most are taken out of it, and again while a round takes SHARE of the rows. A pivot has the most frequent tokens of some PIVOT_SETS sets, which no result depends on.
NEAR, SHARE, PIVOT_SETS = 16, 0.25, 64
#: Distinct sets of a candidate class, and bytes of them, that make a block; larger classes are dealt in pairs of blocks, so that a set is sent once for each block of its class.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_FACTORS = mix(np.arange(TOKENS, dtype=np.uint64), 11) | np.uint64(1)


def shingle_sets(ws: list[list[bytes]], names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of documents end to end, as sorted 64-bit names, and how many each has.

    A text of fewer than n words, but some, has one n-gram: all its words.
    """
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    h = names
    for k in range(1, n):
        h = pair_name(h[:-1] if len(h) else h, names[k:], 20 + k)
    first = np.cumsum(sizes) - sizes
    sets = []
    for a, size in zip(first.tolist(), sizes.tolist(), strict=True):
        if size >= n:
            sets.append(np.unique(h[a : a + size - n + 1]))
        elif size:
            g = names[a : a + 1]
            for k in range(1, size):
                g = pair_name(g, names[a + k : a + k + 1], 20 + k)
            sets.append(mix(g, 40 + size))
        else:
            sets.append(names[:0])
    return np.concatenate([*sets, names[:0]]), np.fromiter(map(len, sets), np.int64, len(sets))


def embed(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, TOKENS) 32-bit: of each set the least value under each hash; empty sets have zeros."""
    out = np.zeros((len(sizes), TOKENS), np.uint32)
    some = sizes > 0
    if some.any():
        first = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            for i in range(TOKENS):
                v = flat * _FACTORS[i]
                out[some, i] = np.minimum.reduceat(v, first) >> np.uint64(32)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("h"), F.col(text_col).alias("text"))


def _sets(keyed: DataFrame, n: int) -> DataFrame:
    """(id, h, fp, size, tokens): each document's set by its 128-bit fingerprint; null for documents without words."""
    id_type = keyed.schema["id"].dataType.simpleString()

    def run(batches):
        memo = WordNames()
        for batch in batches:
            for part in slices(batch, 2):
                ws = [words_of(t) for t in texts(part, 2)]
                flat, sizes = shingle_sets(ws, memo.of([w for x in ws for w in x]), n)
                tokens = embed(flat, sizes)
                edge = np.cumsum(sizes) - sizes
                fps = [hashlib.blake2b(flat[a : a + k].tobytes(), digest_size=16).digest() if k else None for a, k in zip(edge.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.binary()), pa.array(sizes), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["id", "h", "fp", "size", "tokens"])

    return keyed.mapInArrow(trimmed(run), f"id {id_type}, h binary, fp binary, size long, tokens binary")


def runs_for(recall: float, choices: float = CHOICES, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is met with the target recall.

    Of the tokens that such a pair shares, each side of a node's choice picks the
    same ones: a Poisson number of mean choices * threshold. The chance s that a
    line of such choices goes on without end solves 1 - s = exp(-mean * s).
    """
    mean, s = choices * threshold, 0.5
    for _ in range(200):
        s = 1 - math.exp(-mean * s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def _chosen(tokens: np.ndarray, node: np.ndarray, choices: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of the tokens that each row chooses at its node: the hash of node, place and token decides."""
    at = mix(np.arange(TOKENS, dtype=np.uint64), 31)
    h = mix(mix(node, 32)[:, None] ^ pair_name(tokens.astype(np.uint64), np.broadcast_to(at, tokens.shape), 33), 34)
    row, col = np.nonzero(h < np.uint64(int(2**64 * choices / TOKENS)))
    return row, mix(h[row, col], 35)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _paths(rows: DataFrame, choices: float, runs: int) -> DataFrame:
    """(node, fp): the nodes that each set goes to, from (fp, tokens) by runs roots, or from (node, fp, tokens)."""
    at = rows.columns.index("tokens")
    inner = "node" in rows.columns

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                tokens = _tokens(part.column(at))
                fp = part.column(rows_fp)
                if inner:
                    starts = [part.column(0).to_numpy().view(np.uint64)]
                else:
                    starts = [np.full(len(tokens), 1 + r, np.uint64) for r in range(runs)]
                for s in starts:
                    row, node = _chosen(tokens, s, choices)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), fp.take(pa.array(row))], names=["node", "fp"])

    rows_fp = rows.columns.index("fp")
    return rows.mapInArrow(trimmed(run), "node long, fp binary")


def _linked_rows(m: int, rows: int, linked) -> np.ndarray:
    """For each of m sets the least set of its component, where linked(lo, hi) has the links of sets lo to hi with all, as booleans.

    Links are asked for so many rows at a time and only once; a union of sets by
    least member takes them in.
    """
    root = np.arange(m)
    for lo in range(0, m, rows):
        part = linked(lo, min(lo + rows, m))
        i, j = np.nonzero(part)
        if not len(i):
            continue
        a, b = root[i + lo], root[j]
        while (a != b).any():
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
    return root


def _alike(tokens: np.ndarray, sizes: np.ndarray, sides: np.ndarray, least: int, ratio: float) -> np.ndarray:
    """For each set the least set of its component; links join sets that share ``least`` tokens, differ in size by no more than the ratio, and stand on different sides if there are two."""
    m = len(tokens)
    order = np.argsort(sizes, kind="stable")
    t, n, side = tokens[order], sizes[order], sides[order]
    two = sides.any()

    def linked(lo: int, hi: int) -> np.ndarray:
        # Sizes are sorted, so that partners further on end where they are too large.
        end = int(np.searchsorted(n, n[hi - 1] / ratio, side="right"))
        same = np.zeros((hi - lo, end - lo), np.uint8)
        for i in range(TOKENS):
            same += t[lo:hi, i, None] == t[None, lo:end, i]
        ok = (same >= least) & (n[lo:hi, None] >= ratio * n[None, lo:end]) & (n[None, lo:end] >= ratio * n[lo:hi, None])
        if two:
            ok &= side[lo:hi, None] != side[None, lo:end]
        out = np.zeros((hi - lo, m), bool)
        out[:, lo:end] = ok
        return out

    root = np.empty(m, np.int64)
    root[order] = order[_linked_rows(m, 256, linked)]
    least_of = np.full(m, m)
    np.minimum.at(least_of, root, np.arange(m))
    return least_of[root]


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    return _linked_rows(len(linked), 256, lambda lo, hi: linked[lo:hi])


def _grouped(batches, columns: int):
    """(key, [columns]) of rows that come sorted by column 0, across batches."""
    key, held = None, []
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and k[lo] != key:
                yield key, [pa.concat_arrays(c) for c in zip(*held, strict=True)]
                held = []
            key = k[lo]
            held.append([batch.column(c).slice(lo, hi - lo) for c in range(1, columns)])
    if held:
        yield key, [pa.concat_arrays(c) for c in zip(*held, strict=True)]


def _near_pairs(leaves: DataFrame, least: int, ratio: float) -> DataFrame:
    """(a, b): links that hold the similar sets of each node together; leaves are (node, side, fp, size, tokens).

    A node's sets are compared all by all; where both sides 0 and 1 are there,
    only those of different sides.
    """

    def run(batches):
        a, b = [], []
        for _, (side, fp, size, tokens) in _grouped(batches, 5):
            if len(fp) > 1:
                # In the order of names, so that all nodes with the same sets choose the same root.
                by = pa.compute.sort_indices(fp)
                side, fp, size, tokens = (c.take(by) for c in (side, fp, size, tokens))
                root = _alike(_tokens(tokens), size.to_numpy(zero_copy_only=False), side.to_numpy(zero_copy_only=False), least, ratio)
                at = np.flatnonzero(root != np.arange(len(root)))
                if len(at):
                    a.append(fp.take(pa.array(at)))
                    b.append(fp.take(pa.array(root[at])))
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])

    parts = leaves.repartition("node").sortWithinPartitions("node")
    return parts.select("node", "side", "fp", "size", "tokens").mapInArrow(trimmed(run), "a binary, b binary")


def _block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """rows dealt to pairs of the so many blocks of their group: (pair, side) besides the columns.

    Two rows of a group meet in one pair: that of their blocks, or if these are
    the same, that of the block with itself, where all have side 0.
    """
    own = F.pmod(F.xxhash64("fp"), F.col("_n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    d = rows.withColumn("_n", blocks.cast("long")).withColumn("_own", own).withColumn("_other", other)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return d.withColumn("pair", F.xxhash64(group, low, high)).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_n", "_own", "_other")


def _pivots(met: DataFrame) -> DataFrame:
    """(node2, n2, tokens2): at each place the token that most of some PIVOT_SETS sets of a node have; rows are (node, n, fp, size, tokens)."""
    some = met.filter(F.pmod(F.xxhash64("fp"), F.col("n")) < PIVOT_SETS)

    def run(batches):
        for batch in batches:
            out = []
            for sets in batch.column(2).to_pylist():
                t = np.sort(np.frombuffer(b"".join(sets), np.uint32).reshape(-1, TOKENS), axis=0)
                # How often each token stands before it in its sorted column.
                run_of = np.zeros(t.shape, np.int64)
                for i in range(1, len(t)):
                    run_of[i] = np.where(t[i] == t[i - 1], run_of[i - 1] + 1, 0)
                out.append(t[run_of.argmax(0), np.arange(TOKENS)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["node2", "n2", "tokens2"])

    held = some.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("tokens").alias("sets"))
    return stored(held.mapInArrow(trimmed(run), "node2 long, n2 long, tokens2 binary"), "pivots")


def _around_pivots(met: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between sets of nodes (node, n, fp, size, tokens), and the nodes' rows that are left, with n anew.

    Sets that differ from their node's pivot in NEAR tokens at the most are taken
    out of the node, if they are half of those that get linked. What shares ``least`` tokens with one of these differs from the
    pivot in TOKENS - least more at the most, whatever the pivot is; all such sets
    are linked together, so those taken out need no further comparison. A row is
    read once a round.
    """
    far = least - NEAR
    pivots = _pivots(met)
    both = join_split(met, pivots, "node", "node2", hot_keys(pivots, "node2", "n2"), ["fp"], "left").select("node", "fp", "size", "tokens", "tokens2")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                same, known = np.zeros(part.num_rows, np.int64), part.column(4).is_valid()
                at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
                same[at] = (_tokens(part.column(3).filter(known)) == _tokens(part.column(4).filter(known))).sum(1)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array(same)], names=["node", "fp", "size", "tokens", "same"])

    held = stored(both.mapInArrow(trimmed(run), "node long, fp binary, size long, tokens binary, same long"), "around")
    # Sets that are only near what is taken join the candidate class, so a node where these are the most stays whole.
    ones = held.filter(F.col("same") >= far).groupBy(F.col("node").alias("node2")).agg(F.min("fp").alias("b"), F.count("*").alias("n2"), F.count_if(F.col("same") >= TOKENS - NEAR).alias("taken"))
    ones = stored(ones.filter(F.col("taken") * 2 >= F.col("n2")).drop("taken"), "ones")
    joined = stored(join_split(held, ones, "node", "node2", hot_keys(ones, "node2", "n2"), ["fp"], "left").select("node", "fp", "size", "tokens", "same", "b"), "joined")
    links = stored(joined.filter((F.col("same") >= far) & (F.col("fp") != F.col("b"))).select(F.col("fp").alias("a"), "b").distinct(), "links")
    rest = joined.filter((F.col("same") < TOKENS - NEAR) | F.col("b").isNull()).select("node", "fp", "size", "tokens")
    counts = stored(rest.groupBy(F.col("node").alias("node2")).agg(F.count("*").alias("n")), "rest")
    return links, stored(join_split(rest, counts, "node", "node2", hot_keys(counts, "node2", "n"), ["fp"]).select("node", "n", "fp", "size", "tokens"), "left")


def candidates(nodes: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, choices: float = CHOICES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(a, b): links that hold together all sets whose Jaccard similarity reaches the threshold, and maybe others.

    nodes are (fp, size, tokens). In each of the runs a set goes from the root to
    the children named by tokens that it chooses, and from a node of more than
    ``leaf`` sets on to that node's children. Sets of a small node are compared by
    their embeddings with a margin of five deviations. Nodes that are still
    larger after ``depth`` splits are compared in pairs of blocks. Before that, what
    lies around a pivot is taken out of nodes above TASK, so that a large group of
    near copies is neither split nor dealt.
    """
    least = math.floor(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold)))
    paths = _paths(nodes.select("fp", "tokens"), choices, runs_for(recall, choices, threshold))
    found = []
    for level in range(depth + 1):
        paths = stored(paths, f"paths{level}")
        many = stored(paths.groupBy(F.col("node").alias("node2")).agg(F.count("*").alias("n")).filter("n > 1"), f"many{level}")
        met = join_split(paths, many, "node", "node2", hot_keys(many, "node2", "n"), ["fp"]).select("node", "n", "fp").dropDuplicates(["node", "fp"])
        met = stored(met.join(nodes, "fp").select("node", "n", "fp", "size", "tokens"), f"met{level}")
        task = min(TASK, leaf)
        few, met = met.filter(F.col("n") <= task), met.filter(F.col("n") > task)
        rows = met.count()
        while rows:
            links, left = _around_pivots(met, least)
            found.append(links)
            few, met = few.unionByName(left.filter(F.col("n") <= task)), left.filter(F.col("n") > task)
            if left.count() > (1 - SHARE) * rows:
                break
            rows = met.count()
        small = few.withColumn("side", F.lit(0)).select("node", "side", "fp", "size", "tokens")
        dealt = _block_pairs(met.filter(F.lit(level == depth) | (F.col("n") <= leaf)), "node", F.ceil(F.col("n") / F.lit(max(1, task // 2))))
        dealt = dealt.drop("node").withColumnRenamed("pair", "node").select("node", "side", "fp", "size", "tokens")
        found.append(stored(_near_pairs(small.unionByName(dealt), least, threshold), f"near{level}"))
        large = met.filter(F.col("n") > leaf)
        if level == depth or large.isEmpty():
            break
        paths = _paths(large.select("node", "fp", "tokens"), choices, 1)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    m = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    token = np.cumsum(fresh) - 1
    held = np.bincount(token)
    often = held[token] > 1
    token, who = token[often], who[often]
    if not len(token):
        return np.zeros((m, m), np.int64)
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[1:] != token[:-1]
    token = np.cumsum(fresh) - 1
    out = np.zeros((m, m), np.float64)
    width = max(64, 4_000_000 // m)
    for lo in range(0, token[-1] + 1, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        x = np.zeros((m, int(token[b - 1]) - lo + 1), np.float32)
        x[who[a:b], token[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(fp, links, root) of the sets that have a partner in their task; members are (pair, side, fp, copies, elements)."""
    t = Fraction(threshold).limit_denominator(10_000)

    def run(batches):
        for _, (side, fp, copies, elements) in _grouped(batches, 5):
            names, at = np.unique(np.array(fp.to_pylist(), object), return_index=True)
            if len(at) < 2:
                continue
            take = pa.array(at)
            sets = [np.frombuffer(x, np.uint64) for x in elements.take(take).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            sides = side.to_numpy(zero_copy_only=False)[at]
            shared = _intersections(sets)
            linked = shared * (t.numerator + t.denominator) >= t.numerator * (sizes[:, None] + sizes[None, :])
            np.fill_diagonal(linked, False)
            if sides.any():
                linked &= sides[:, None] != sides[None, :]
            links = linked @ copies.to_numpy(zero_copy_only=False)[at].astype(np.int64)
            some = np.flatnonzero(links)
            if len(some):
                root = _forest(linked)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.binary()), pa.array(links[some]), pa.array([names[root[i]] for i in some], pa.binary())], names=["fp", "links", "root"])

    parts = members.repartition("pair").sortWithinPartitions("pair")
    return parts.select("pair", "side", "fp", "copies", "elements").mapInArrow(trimmed(run), "fp binary, links long, root binary")


def _elements(rows: DataFrame, n: int) -> DataFrame:
    """rows with the set's elements in place of the text."""
    at, fields = rows.columns.index("text"), [f for f in rows.schema if f.name != "text"]

    def run(batches):
        memo = WordNames()
        for batch in batches:
            for part in slices(batch, at):
                ws = [words_of(t) for t in texts(part, at)]
                flat, sizes = shingle_sets(ws, memo.of([w for x in ws for w in x]), n)
                edge = np.cumsum(sizes)
                data = [flat[b - k : b].tobytes() for b, k in zip(edge.tolist(), sizes.tolist(), strict=True)]
                keep = [i for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(data, pa.binary())], names=[*[part.schema.field(i).name for i in keep], "elements"])

    return rows.mapInArrow(trimmed(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", elements binary")


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, leaf: int, depth: int, block: int) -> DataFrame:
    """(id, h, size, label, class_id, n_links) of each row; label is null for rows without words."""
    keyed = _keyed(docs, id_col, text_col)
    every = stored(_sets(keyed, n), "sets")
    sets = every.filter("fp IS NOT NULL")
    place = F.struct("id", "h")
    # min of a struct would take a null id first; least ids come from a column of their own.
    nodes = stored(sets.groupBy("fp").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.max(place).alias("one"), F.min("size").alias("size"), F.min("tokens").alias("tokens")), "nodes")
    near = components(candidates(nodes.select("fp", "size", "tokens"), threshold=threshold, recall=recall, leaf=leaf, depth=depth))
    near = stored(near.join(nodes.withColumnRenamed("fp", "node"), "node").select(F.col("node").alias("fp"), "label", "copies", "size", F.col("one.id").alias("id2"), F.col("one.h").alias("h2")), "near")
    counts = near.groupBy(F.col("label").alias("label2")).agg(F.count("*").alias("members"), F.sum("size").alias("elements"))
    counts = stored(counts.withColumn("blocks", F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") * 8 / BLOCK_BYTES))), "counts")
    members = join_split(near, counts, "label", "label2", hot_keys(counts, "label2", "members"), ["fp"]).select("fp", "label", "blocks", "copies", "id2", "h2")
    held = keyed.join(members.hint("shuffle_hash"), keyed["id"].eqNullSafe(members["id2"]) & (keyed["h"] == members["h2"])).select("fp", "label", "blocks", "copies", "text")
    dealt = _block_pairs(_elements(held, n), "label", F.col("blocks"))
    verified = stored(_verify(dealt, threshold), "verified")
    classes = components(verified.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("fp").agg(F.sum("links").alias("links"))
    named = nodes.select("fp", "copies", "least").join(links, "fp", "left").join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", F.coalesce("label", "fp").alias("label"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(named, "named")
    ids = named.groupBy(F.col("label").alias("label2")).agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    result = join_split(named, ids, "label", "label2", hot_keys(ids, "label2", "n"), ["fp"]).select(F.col("fp").alias("fp2"), "label", "class_id", "n_links")
    # Copies of one set lie together under its fingerprint, and may be very many.
    out = left_join_present(every.select("id", "h", "fp", "size"), result, "fp", "fp2", hot_keys(nodes, "fp", "copies"), ["id", "h"])
    alone = F.col("fp").isNull()
    return out.select("id", "h", "size", "label", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """id, class_id, n_links and n_shingles, one row per row of docs.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least the threshold. A class is what links hold together; its
    class_id is its least id. n_links counts a document's links, exact copies
    included. Documents with equal sets are one set from the start. Chosen paths
    find candidate classes; within these all pairs are verified on the whole
    sets, by blocks, so that links and classes are exact but for pairs that the
    paths miss, whose share the target recall bounds. Pairs never leave a task.

    A text of fewer than n words, but some, is one n-gram. Null, empty and
    wordless texts are classes of their own without links. Rows that repeat id
    and text are copies of each other; null ids are never a class_id unless the
    class has no other, in which case class_id is null. Rows with equal or null ids
    are told apart by a digest of their texts. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    c = _classes(docs, id_col, text_col, n, threshold, recall, leaf, depth, block)
    return c.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("size").alias("n_shingles"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, of which one of each class stays: that of the least id (null last).

    Rows without words all stay; see jaccard_classes.
    """
    c = _classes(docs, id_col, text_col, n, threshold, recall, leaf, depth, block)
    rows = c.filter("label IS NOT NULL").groupBy("label", "id", "h").agg(F.count("*").alias("n"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "h", "n")).alias("one")).select("one.id", "one.h", "one.n")
    bare = c.filter("label IS NULL").select("id", "h", F.lit(1).cast("long").alias("n")).distinct()
    kept = stored(first.unionByName(bare).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("n").alias("_n")), "kept")
    got = docs.join(kept.hint("shuffle_hash"), docs[id_col].eqNullSafe(kept["_id"]) & (text_digest(docs[text_col]) == kept["_h"]))
    whole = got.filter("_n = 1").select(*[docs[x] for x in docs.columns])
    if kept.filter("_n > 1").isEmpty():
        return whole
    return whole.unionByName(got.filter("_n > 1").select(*[docs[x] for x in docs.columns]).dropDuplicates([id_col, text_col]))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: All pairs that share an n-gram, and the closure of the links, which tables of the sample sizes allow. THRESHOLD is 4 / 5.
OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + {N - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {N - 2})) AS i FROM d WHERE len(w) >= {N})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {N - 1})),
c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 5 * m >= 4 * (x.k + y.k - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a)
SELECT d.doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(k, 0)::BIGINT AS n_shingles
FROM d JOIN (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a) USING (doc_id) LEFT JOIN c USING (doc_id)
"""
