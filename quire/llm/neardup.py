"""Near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets are one vertex. In each of
several independent trees a node branches on a few minwise tokens that its path
chooses, so documents that share much take the same branches. Before a large
node branches, its members meet a leader, and those that can have no candidate
beyond the leader's cluster are done. Small nodes, and chunks of nodes that stay
large at the last level, are compared exhaustively by signature; what a node's
largest cluster has not taken in then meets all chunks of the node. What the comparisons connect is a cluster. Clusters
too large for one task are parted first, by the rarest tokens of their sets, one of which two linked sets always share. The full sets of each
cluster meet once, in blocks, and only links confirmed on them count. Blocks of
one cluster are then held against whatever its largest component has not taken
in, so no pair of a node or a cluster goes unseen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import text as T

U64 = np.uint64
SHINGLE = 5
PERCENT = 80
#: Minwise tokens of a signature.
SIGNATURE = 64
#: A pair with fewer equal tokens is no candidate; at a similarity of 0.8 that loses about one in a million.
AGREE = 36
#: Tokens in which two candidates differ at most.
REACH = SIGNATURE - AGREE
TREES = 6
BRANCHES = 2
LEVELS = 4
#: Nodes of so many documents are compared, larger ones branch.
SMALL = 48
CHUNK = 768
PIVOTS = 24
#: Documents of a cluster whose sets meet in one task, and bytes of their texts unless a single one has more.
MEET = 1024
MEET_BYTES = 4 << 20
#: Links that a task contracts at once.
LINKS = 1 << 17
#: Tokens of a batch that a task hands on.
TOKENS = 1 << 16

_STEP = T.mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_FLIP = T.mix(np.arange(101, 165, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and where each text's begin. Fewer than k words are one shingle."""
    data = T.LOWER[data]
    starts, ends, at = T.word_spans(data, offsets)
    words = T.span_hashes(data, starts, ends) if len(starts) else np.empty(0, U64)
    n = np.diff(at)
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    first = T.ranges(at[:-1], sizes)
    size = np.repeat(np.minimum(n, k), sizes)
    total = T.mix(size.astype(U64))
    for j in range(k):
        inside = size > j
        total[inside] += words[first[inside] + j] * _STEP[j]
    return T.mix(total), out_at


def minwise(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signatures of texts, none of them empty: texts x SIGNATURE, the upper half of the least hash."""
    out = np.empty((len(at) - 1, SIGNATURE), np.int32)
    for j in range(SIGNATURE):
        out[:, j] = (np.minimum.reduceat((tokens ^ _FLIP[j]) * _STEP[j], at[:-1]) >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, t, nb, n_shingles, key, sig) of rows (doc_id, t, nb, text): key is the digest of the set, null if it is empty. The text itself is not kept."""
    C.ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def sign(batches):
        for batch in batches:
            for rows in T.steps(batch, "text"):
                tokens, at = shingles(*T.buffer_of(rows.column(3)), k)
                full = np.flatnonzero(np.diff(at))
                sets = [np.unique(tokens[at[i] : at[i + 1]]) for i in range(rows.num_rows)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs: list = [None] * rows.num_rows
                if len(full):
                    for i, s in zip(full.tolist(), minwise(tokens, np.append(at[full], len(tokens))), strict=True):
                        sigs[i] = s
                more = [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), *more], ["doc_id", "t", "nb", "n_shingles", "key", "sig"])

    return docs.select("doc_id", "t", "nb", "text").mapInArrow(sign, f"doc_id {kinds['doc_id']}, t long, nb int, n_shingles long, key binary, sig array<int>")


def _children(node: Column, sig: Column) -> Column:
    """Nodes that a document goes to from a node: one for each coordinate that the node chooses, by the token there."""
    base = F.pmod(node, F.lit(SIGNATURE)).cast("int")
    turn = F.pmod(F.shiftright(node, 20), F.lit(SIGNATURE // BRANCHES)).cast("int") * 2 + 1
    spots = [F.pmod(base + j * turn, F.lit(SIGNATURE)).cast("int") for j in range(BRANCHES)]
    return F.array(*[F.xxhash64(node, s, F.get(sig, s)) for s in spots])


def cut(differ: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Of a node, by how many members differ in how many tokens from its leader: (join, done).

    Members that differ in at most join tokens are put into the leader's
    cluster; those in at most done need no more comparison in this node, since
    whoever could be a candidate of theirs is in the cluster: tokens that differ
    are a metric, and two candidates differ in at most REACH. join grows past
    REACH only where that finishes more members than it adds.
    """
    best, out = None, (REACH, 0)
    for join in [REACH, *differ[differ > REACH].tolist()]:
        beyond = differ[differ > join]
        done = min(join, int(beyond[0]) - REACH - 1) if len(beyond) else join
        gain = int(n[differ <= done].sum()) - int(n[(differ > REACH) & (differ <= join)].sum())
        if best is None or gain > best:
            best, out = gain, (join, done)
    return out


def _cuts(histograms: DataFrame) -> DataFrame:
    """Rows (node, size, join, done) from rows (node, size, bars array of (differ, n)), at most 65 bars each."""

    def solve(batches):
        for batch in batches:
            found = [cut(np.array([b["differ"] for b in bars]), np.array([b["n"] for b in bars])) for bars in batch.column(2).to_pylist()]
            if found:
                join, done = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(join, pa.int32()), pa.array(done, pa.int32())], ["node", "size", "join", "done"])

    return histograms.mapInArrow(solve, "node long, size long, join int, done int")


def nodes(vertices: DataFrame, trees: int = TREES) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Rows (node, key, size) of the nodes to compare, pairs (a, b) of leaders and those they took in, and the steps both are read from.

    Before a large node branches, its members meet its leader, the one with the
    least hash. Who is so near that none of its candidates can be outside the
    leader's cluster goes no further, so a large group of near copies does not
    branch on as a whole. Large nodes are dealt by node and salt.
    """
    roots = F.flatten(F.array(*[_children(F.xxhash64(F.lit(f"tree {t}")), F.col("sig")) for t in range(trees)]))
    rows = vertices.select("key", F.explode(roots).alias("node"))
    signed_keys = vertices.select(F.col("key").alias("_key"), F.col("sig").alias("_sig"))
    found, taken, steps = None, None, []
    for level in range(LEVELS):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.xxhash64("key")).alias("lead")).where("size > 1").withColumnRenamed("node", "_node")
        held = C.materialize(rows.join(sizes, rows["node"] == sizes["_node"]).select("node", "key", "size", "lead"), f"nodes-{level}")
        steps.append(held)
        last = level == LEVELS - 1
        small = held.where(F.col("size") <= SMALL).select("node", "key", "size")
        found = small if found is None else found.unionByName(small)
        large = held.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        # One leader's signature for each salt of a node; the size says how many salts there are, on both sides.
        salts = F.ceil(F.col("size") / MEET).cast("int")
        salt = F.pmod(F.xxhash64("key"), salts).cast("int")
        each = F.explode(F.sequence(F.lit(0), salts - 1))
        leaders = large.where(F.xxhash64("key") == F.col("lead"))
        leaders = leaders.join(signed_keys, leaders["key"] == signed_keys["_key"]).select(F.col("node").alias("_node"), F.col("key").alias("leader"), F.col("_sig").alias("_lead_sig"), each.alias("_salt"))
        met = large.join(signed_keys, large["key"] == signed_keys["_key"]).withColumn("salt", salt)
        met = met.join(leaders, (met["node"] == leaders["_node"]) & (met["salt"] == leaders["_salt"]))
        differ = F.size(F.filter(F.zip_with("_sig", "_lead_sig", lambda x, y: x != y), lambda x: x))
        met = C.materialize(met.select("node", "key", "size", "salt", "leader", "_sig", differ.alias("differ")), f"met-{level}")
        steps.append(met)
        bars = met.groupBy("node", "size", "differ").agg(F.count("*").alias("n")).groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("differ", "n"))).alias("bars"))
        cuts = _cuts(bars.select("node", "size", "bars")).select(F.col("node").alias("_node"), "join", "done", each.alias("_salt"))
        judged = C.materialize(met.join(cuts, (met["node"] == cuts["_node"]) & (met["salt"] == cuts["_salt"])).select("node", "key", "size", "leader", "_sig", "differ", "join", "done"), f"judged-{level}")
        steps.append(judged)
        pairs = judged.where((F.col("differ") <= F.col("join")) & (F.col("key") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("key").alias("b"))
        taken = pairs if taken is None else taken.unionByName(pairs)
        rest = judged.where(F.col("differ") > F.col("done"))
        if last:
            found = found.unionByName(rest.select("node", "key", "size"))
        elif rest.isEmpty():
            break
        else:
            rows = rest.select("key", F.explode(_children(F.col("node"), F.col("_sig"))).alias("node"))
    return found, taken, steps


def _by_group(batches, solve):
    """Run solve on slices of rows that hold whole groups (first column, sorted), with the places where they begin and end."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        group = rows.column(0).to_numpy()
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        if len(cut):
            yield from solve(rows.slice(0, int(cut[-1])), np.concatenate([[0], cut]))
        rest = rows.slice(int(cut[-1]) if len(cut) else 0)
    if rest is not None and rest.num_rows:
        yield from solve(rest, np.array([0, rest.num_rows]))


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _star(first: dict[bytes, int], parent: list[int], a: list[bytes], b: list[bytes]) -> None:
    """Add to a and b the least of what is connected and each of the others; first: their places in parent."""
    least: dict[int, bytes] = {}
    for name, i in first.items():
        x = _root(parent, i)
        least[x] = min(least.get(x, name), name)
    for name, i in first.items():
        if (x := least[_root(parent, i)]) != name:
            a.append(x)
            b.append(name)


def _edges(a: list[bytes], b: list[bytes]):
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _clustered(members: DataFrame, vertices: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that connect, within each node, all whose signatures agree enough: not all pairs, but as many as connect them. taken: pairs known already."""
    near = _within_chunks(members, vertices)
    near = C.materialize(near if taken is None else near.unionByName(taken), "pairs")
    large = members.where(F.col("size") > CHUNK)
    if large.isEmpty():
        return near
    labels = components(near)
    blocks = F.ceil(F.col("size") / CHUNK).cast("int")
    blocked = large.select(F.col("node").alias("cluster"), "key", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"))
    more = C.materialize(_across_chunks(_left_over(blocked, labels).join(vertices.select("key", "sig"), "key")), "pairs")
    return labels.where("key != comp").select(F.col("comp").alias("a"), F.col("key").alias("b")).unionByName(more)


def _within_chunks(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs (a, b) from the chunks of each node: each member to the least of those it is connected with."""
    rows = members.join(vertices.select("key", "sig"), "key")
    large = F.col("size") > SMALL
    chunks = F.when(large, F.ceil(F.col("size") / CHUNK)).otherwise(1).cast("int")
    # About PIVOTS members of a large node, chosen by a hash, go to all its chunks and connect them.
    common = large & (F.pmod(F.xxhash64("node", "key", F.lit(1)), F.col("size")) < PIVOTS)
    chunk = F.explode(F.when(common, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), chunks).cast("int"))))
    dealt = rows.select("node", "key", "sig", chunk.alias("chunk")).select(F.xxhash64("node", "chunk").alias("group"), "key", "sig")

    def compare(rows, cuts):
        keys, sigs = rows.column(1).to_pylist(), rows.column(2).flatten().to_numpy().reshape(-1, SIGNATURE)
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, parent = sigs[lo:hi], list(range(hi - lo))
            for i in range(1, hi - lo):
                for j in np.flatnonzero((own[:i] == own[i]).sum(axis=1) >= AGREE).tolist():
                    x, y = _root(parent, i), _root(parent, j)
                    parent[max(x, y)] = min(x, y)
            for i in range(hi - lo):  # rows are sorted by key, so a root is the least: nodes that share members share edges
                if (x := _root(parent, i)) != i:
                    a.append(keys[lo + x])
                    b.append(keys[lo + i])
        return _edges(a, b)

    sorted_rows = dealt.repartition(F.col("group")).sortWithinPartitions("group", "key")
    return sorted_rows.mapInArrow(lambda batches: _by_group(batches, compare), "a binary, b binary")


def _across_chunks(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters within groups of rows (group, key, comp, asks, sig): rows that ask against all rows of other clusters, as _confirmed does on sets."""

    def meet(rows, cuts):
        comps, asks = rows.column(2).to_pylist(), rows.column(3).to_pylist()
        sigs = rows.column(4).flatten().to_numpy().reshape(-1, SIGNATURE)
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, first = sigs[lo:hi], {}
            parent = [first.setdefault(comps[lo + i], i) for i in range(hi - lo)]
            parts = len(first)
            for i in range(hi - lo):
                if parts == 1:
                    break
                if not asks[lo + i]:
                    continue
                for j in np.flatnonzero((own == own[i]).sum(axis=1) >= AGREE).tolist():
                    x, y = _root(parent, i), _root(parent, j)
                    if x != y:
                        parent[x] = y
                        parts -= 1
            _star(first, parent, a, b)
        return _edges(a, b)

    dealt = groups.select("group", "key", "comp", "asks", "sig").repartition(F.col("group")).sortWithinPartitions("group", "key")
    return dealt.mapInArrow(lambda batches: _by_group(batches, meet), "a binary, b binary")


def _confirmed(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Components (a, b) within groups of rows (group, key, comp, asks, text) that are one, by links of full sets: 100 * intersection >= percent * union.

    Each row that asks is held against all rows that do not, or against all rows
    where all ask, at once by a lookup of its tokens. b is any but the least of those that a group's
    links make one, a is the least; each b comes once from a group.
    """

    def meet(rows, cuts):
        comps, asks = rows.column(2).to_pylist(), rows.column(3).to_pylist()
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            m = hi - lo
            sets = []
            for some in T.steps(rows.slice(lo, m), "text"):
                tokens, at = shingles(*T.buffer_of(some.column(4)), k)
                sets += [np.unique(tokens[at[i] : at[i + 1]]) for i in range(some.num_rows)]
            sizes = np.array([len(s) for s in sets])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            names, ids = np.unique(np.concatenate(sets), return_inverse=True)
            seen = np.zeros(len(names), np.int32)
            # Who asks of others is among the others of its own block, too.
            others = np.flatnonzero(~np.array(asks[lo:hi], bool))
            others = others if len(others) else np.arange(m)
            theirs, begins, held = ids[T.ranges(begin[others], sizes[others])], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), sizes[others]
            first: dict = {}
            parent = [first.setdefault(comps[lo + i], i) for i in range(m)]
            parts = len(first)
            for i in range(m):
                if parts == 1:
                    break
                if not asks[lo + i]:
                    continue
                own = ids[begin[i] : begin[i] + sizes[i]]
                seen[own] = 1
                both = np.add.reduceat(seen[theirs], begins)
                seen[own] = 0
                for j in others[100 * both >= percent * (held + sizes[i] - both)].tolist():
                    x, y = _root(parent, i), _root(parent, j)
                    if x != y:
                        parent[x] = y
                        parts -= 1
            _star(first, parent, a, b)
        return _edges(a, b)

    dealt = groups.select("group", "key", "comp", "asks", "text").repartition(F.col("group")).sortWithinPartitions("group", "key")
    return dealt.mapInArrow(lambda batches: _by_group(batches, meet), "a binary, b binary")


def _blocks(clusters: DataFrame) -> DataFrame:
    """Rows (cluster, key, nb, blocks, block) of rows (cluster, key, nb): each member of a cluster of several once, in a block of its cluster of about MEET members and MEET_BYTES of text."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("nb").alias("bytes")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / MEET), F.ceil(F.col("bytes") / MEET_BYTES)).cast("int")
    total = clusters.count()
    sizes = sizes.select(F.col("cluster").alias("_c"), "size", blocks.alias("blocks"))
    rows = C.salted_join(clusters, sizes, "cluster", "_c", C.heavy_keys(sizes, "_c", "size", total), ["key"])
    return rows.select("cluster", "key", "nb", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))


def _tokens(members: DataFrame, k: int) -> DataFrame:
    """Rows (key, size, token) of rows (cluster, key, text): each token of a set once, under a name that other clusters do not have, with the size of the set."""

    def spell(batches):
        for batch in batches:
            for rows in T.steps(batch, "text"):
                tokens, at = shingles(*T.buffer_of(rows.column(2)), k)
                clusters = rows.column(0).to_numpy().view(U64).tolist()
                sets = [np.unique(tokens[at[i] : at[i + 1]]) ^ U64(c) for i, c in enumerate(clusters)]
                sizes = np.array([len(s) for s in sets])
                names, place = T.mix(np.concatenate(sets)).view(np.int64), np.repeat(np.arange(len(sets)), sizes)
                for lo in range(0, len(names), TOKENS):
                    of = place[lo : lo + TOKENS]
                    yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(of)), pa.array(sizes[of]), pa.array(names[lo : lo + TOKENS])], ["key", "size", "token"])

    return members.select(F.xxhash64("cluster"), "key", "text").mapInArrow(spell, "key binary, size long, token long")


def _parted(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (key, cluster) of rows (cluster, key, text): clusters parted so that two members that a link can join stay together.

    Tokens of a cluster are ordered by how many of its sets have them. Two linked
    sets share percent of either's tokens, so the rarest one that they share is
    among the tokens of both of which at most so many come after it. Members
    that share one of these stay together; who has none with another member has no row.
    A token has a row of a few bytes for each set of its cluster that has it, so at most as many as the cluster has members.
    """
    rows = _tokens(members, k).withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1")
    from_last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), F.col("token").desc()))
    rare = rows.withColumn("_place", from_last).where(F.col("_place") * 100 >= F.col("size") * percent)
    # A token is a vertex beside the sets; its name is shorter than theirs.
    links = C.materialize(rare.select(F.col("key").alias("a"), F.unhex(F.hex("token")).alias("b")), "rare")
    return components(links).withColumnRenamed("comp", "cluster")


def _left_over(blocked: DataFrame, comps: DataFrame) -> DataFrame:
    """Of clusters (or nodes) of several blocks, rows (group, key, comp, asks): blocks of members beyond the largest component against all blocks."""
    rows = blocked.where("blocks > 1").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    by_comp = rows.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    most = by_comp.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).where("all > most.n")
    most = most.select(F.col("cluster").alias("_c"), F.col("most.comp").alias("_most"), F.ceil((F.col("all") - F.col("most.n")) / MEET).cast("int").alias("parts"))
    rows = rows.join(most, rows["cluster"] == most["_c"])
    asking = rows.where("comp != _most").withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")).cast("int"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    others = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
    both = asking.select("cluster", "block", "part", "key", "comp", "asks").unionByName(others.select("cluster", "block", "part", "key", "comp", "asks"))
    return both.select(F.xxhash64("cluster", "block", "part").alias("group"), "key", "comp", "asks")


def _contracted(links: DataFrame, loops: bool = False) -> DataFrame:
    """Links (a, b) that connect what the given ones do: each task makes stars around the least vertex of what it has read, LINKS links at a time. loops: with a link of each least vertex to itself."""

    def forest(held):
        ends = pa.chunked_array([batch.column(i) for i in (0, 1) for batch in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names, place = ends.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        a, b = place[ends.indices.to_numpy()].reshape(2, -1).tolist()
        parent = list(range(len(names)))
        for x, y in zip(a, b, strict=True):
            x, y = _root(parent, x), _root(parent, y)
            parent[max(x, y)] = min(x, y)
        if b := [i for i, x in enumerate(parent) if loops or x != i]:
            a = [_root(parent, i) for i in b]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    def contract(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= LINKS:
                yield from forest(held)
                held, n = [], 0
        if held:
            yield from forest(held)

    return links.select("a", "b").mapInArrow(contract, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """Least vertex of each linked vertex's component: rows (key, comp).

    Tasks contract the links they read. As soon as LINKS links or fewer are left,
    one task contracts them all, which ends it. Until then, in each round, every vertex goes to
    the least of itself and its neighbours, and the links go with their ends: who
    was linked is linked still or the same vertex, and the least one of a
    component stays. What has gone where is written, and rounds are chained from
    the last to the first. Keys are digests, so their order is random and long
    falling paths do not occur. Vertices of very many links are heavy keys of the
    joins and dealt over many tasks.
    """
    step = C.materialize(_contracted(links), "links")
    rounds = []
    while (n := step.count()) > LINKS:
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        gone = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("parent"), F.count("*").alias("n")).withColumn("parent", F.least("key", "parent"))
        gone = C.materialize(gone, "parents")
        rounds.append(gone)
        hubs = C.heavy_keys(gone, "key", "n", 2 * n)
        ends = gone.select(F.col("key").alias("_key"), F.col("parent").alias("_parent"))
        left = C.salted_join(step, ends, "a", "_key", hubs, ["b"]).select(F.col("_parent").alias("a"), "b", F.col("a").alias("_was"))
        # a is another vertex now, so the links of one b are dealt by what a was.
        moved = C.salted_join(left, ends, "b", "_key", hubs, ["_was"]).select("a", F.col("_parent").alias("b")).where("a != b")
        # Written before it is contracted: a task reads many small files, so it contracts more than the parts of a join would.
        moved, before = C.materialize(moved, "moved"), step
        if moved.count() > LINKS:
            step = C.materialize(_contracted(moved), "links")
            C.release(moved)
        else:
            step = moved
        C.release(before)
    out = _contracted(step.coalesce(1), loops=True).select(F.col("b").alias("key"), F.col("a").alias("comp"))
    if not rounds:
        out = C.materialize(out, "components")
    for gone in reversed(rounds):
        out = C.materialize(_followed(gone.select("key", F.col("parent").alias("comp")), out), "components")
    C.release(step)
    return out


def _followed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (key, comp) of first whose comp is where second takes it to."""
    above = second.where("key != comp").select(F.col("key").alias("_key"), F.col("comp").alias("_comp"))
    common = C.heavy_keys(first.groupBy("comp").agg(F.count("*").alias("n")), "comp", "n", first.count())
    return C.salted_join(first, above, "comp", "_key", common, ["key"], "left").select("key", F.coalesce("_comp", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All rows with their component: doc_id, text, n_shingles, key, component_key, component_id, kept, and the columns named in keep.

    component_key: the component itself (ids may be null or shared by several);
    component_id: the smallest doc_id reachable over links; kept: whether this
    row stands for its component (of rows that share the smallest id, each).
    Null texts and texts without words have no shingles, are linked with
    nothing and kept. Rows with a null id stand for their component only if
    it has no id. Equal sets are one vertex however many rows have them.
    """
    if percent != PERCENT and percent < PERCENT:
        raise ValueError("signatures are sized for a similarity of 0.8 and more")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # What tells texts apart; steps are written with it, and without texts.
    base = base.withColumns({"t": F.xxhash64("text"), "nb": F.coalesce(F.octet_length("text"), F.lit(-1))})
    rows = C.materialize(signed(base, shingle), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("rep")
    vertices = rows.where("key is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.count("*").alias("copies"), F.max("nb").alias("nb"), least)
    vertices = C.materialize(vertices, "vertices")
    kinds = rows.groupBy(F.col("t").alias("_t"), F.col("nb").alias("_nb")).agg(F.first("n_shingles").alias("n_shingles"), F.first("key").alias("key"), F.count("*").alias("copies"))
    kinds = C.materialize(kinds, "texts")
    C.release(rows)
    members, taken, steps = nodes(vertices)
    clusters = components(_clustered(members, vertices, taken)).withColumnRenamed("comp", "cluster")
    for x in steps:
        C.release(x)
    chosen = C.materialize(clusters.join(vertices.select("key", "nb", "rep"), "key").select("cluster", "key", "nb", "rep"), "clustered")
    needed = chosen.select("key", F.col("rep.doc_id").alias("_id"), F.col("rep.t").alias("_t"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    # Always by a shuffle, since needed grows with the corpus; of texts, those that pass a mask of the needed ones.
    some = C.masked(base.select("doc_id", "t", "text"), "t", needed, "_t")
    texts = C.materialize(some.join(needed.hint("merge"), same).select("key", "text").dropDuplicates(["key"]), "candidates")
    blocked = C.materialize(_blocks(chosen.select("cluster", "key", "nb")), "blocks")
    large = blocked.where("blocks > 1")
    if not large.isEmpty():
        parts = _parted(large.select("cluster", "key").join(texts, "key"), shingle, percent)
        blocked = blocked.where("blocks = 1").unionByName(C.materialize(_blocks(large.select("key", "nb").join(parts, "key")), "blocks"))
    groups = blocked.select(F.xxhash64("cluster", "block").alias("group"), "key", F.col("key").alias("comp"), F.lit(True).alias("asks"))
    # A key is in one block, so what a block's sets connect are components as they are; the least of each has no row.
    comps = C.materialize(_confirmed(groups.join(texts, "key"), shingle, percent), "confirmed").select(F.col("b").alias("key"), F.col("a").alias("comp"))
    if not blocked.where("blocks > 1").isEmpty():
        joined = components(C.materialize(_confirmed(_left_over(blocked, comps).join(texts, "key"), shingle, percent), "confirmed"))
        if not joined.isEmpty():
            comps = _followed(comps, joined).unionByName(joined)
    C.release(texts)
    # The least id of a component, from one row for each vertex; sets that are linked with no other name themselves.
    linked = C.materialize(vertices.select("key", F.col("rep.doc_id").alias("_least"), "copies").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")), "linked")
    C.release(vertices)
    facts = linked.agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).first()
    least = linked.groupBy(F.col("comp").alias("_comp")).agg(F.min("_least").alias("_component"), F.count("*").alias("n"))
    of_key = C.salted_join(linked, least, "comp", "_comp", C.heavy_keys(least, "_comp", "n", facts["n"]), ["key"])
    of_key = of_key.select(F.col("key").alias("_key"), F.col("comp").alias("component_key"), "_component")
    # One row for each different text; sets without words have no component but their own row.
    worded = kinds.where("key is not null")
    copied = C.heavy_keys(linked, "key", "copies", facts["rows"] or 0)
    of_text = C.salted_join(worded, of_key, "key", "_key", copied, ["_t"]).drop("_key")
    of_text = of_text.unionByName(kinds.where("key is null").withColumns({"component_key": F.lit(None).cast("binary"), "_component": F.lit(None).cast(base.schema["doc_id"].dataType)}))
    of_text = C.materialize(of_text, "of-texts")
    C.release(kinds)
    common = C.heavy_keys(of_text.groupBy("_t").agg(F.sum("copies").alias("n")), "_t", "n", of_text.agg(F.sum("copies")).first()[0] or 0)
    out = C.salted_join(base, of_text, "t", "_t", common, ["doc_id", *[f"_keep_{c}" for c in keep]], also=("nb", "_nb"))
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("_component")))
    kept = F.col("key").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "text", "n_shingles", "key", "component_key", "component_id", kept.alias("kept"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
