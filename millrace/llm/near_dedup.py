"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

Each text's set of word shingles is hashed once; its RETAINED smallest hashes
are its sketch. The INDEXED smallest of them are keys of inverted lists. Within
a list, sketch overlaps give union-sketch estimates, estimates far from the
threshold decide nothing more, and what remains is verified by exact Jaccard on
the full texts. Verified links make components by label propagation.

Why no link is lost: a pair with similarity s misses every list with
probability about (1 - s) ** INDEXED (6e-8 at 0.75), and the estimate's cut lies six standard
deviations below the threshold. Texts with equal shingle sets are one node, so
copies are never paired. A pair is looked at in one list only, that of its smallest common value. No pairs leave a
list for verification: its members that may have a link go on, each once, with their full shingle sets, all
intersections among them are counted exactly, and a spanning forest of the links is what a list gives.
Lists are cut into blocks where they have many rows or many shingles, and each pair of blocks is a group of its own; between two blocks one
pair of each two parts that are surely linked within their blocks goes on.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel
from millrace.llm.shared import BROADCAST_ROWS, attach, discard, rows_of, settle, text_keys

RETAINED = 192
INDEXED = 12
BLOCK = 1024
#: Longer lists are dealt by size class.
LONG = 48
SIGMAS = 6
#: Shingles of a set beyond which a block has fewer rows.
WIDE = 8192
#: Children of a node in a spanning forest, as far as the links allow: no node is a hot key of the joins that follow.
FAN = 8
#: Values that so many members share at most are counted pair by pair, others as matrix products.
RARE = 16
#: Values of all sets that are counted together.
RANGE = 1 << 20


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Rows are linked if 100 * |intersection| >= percent * |union| of their shingle
    sets. component_id is the smallest id that links reach, kept says that a row's id
    is it. A row without words (or a null text) has the component of its own id.
    Repeated rows are one node; of rows that share the kept id, all are kept. Ids that are
    null come last: a component has a null id only if all its ids are null.
    Columns besides id and text are not read. An empty table gives an empty result.
    """
    return grouped(docs, id_col, text_col, percent, k).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays (then by text hash, nulls last).

    Rows without words stay. Of repeated rows (same id and text) one stays. Columns are those of docs.
    """
    found = grouped(docs, id_col, text_col, percent, k).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")
    found = settle(found.select("component", "doc_id", "t1", "t2"), "found")
    first = found.groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("id"), F.col("p.t1").alias("f1"), F.col("p.t2").alias("f2"))
    alike = found.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "t1", "t2").alias("k")
    judged = settle(alike.join(first, same, "left").where("f1 is null or rows > 1").select(name, F.col("f1").isNull().alias("goes"), "rows"), "judged")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner))
    row_key = F.concat_ws(":", F.coalesce(F.col(own[id_col]).cast("long").cast("string"), F.lit("-")), *text_keys(own[text_col]).values())
    if rows_of(judged) <= BROADCAST_ROWS:
        marked = docs.toDF(*inner).withColumn("k", row_key).join(F.broadcast(judged.drop("rows")), "k", "left")
    else:
        marked = attach(docs.toDF(*inner).withColumn("k", row_key), F.col("k"), judged, "k", "rows", judged.agg(F.sum("rows")).first()[0], F.struct("k", own[id_col]))
    named = lambda df: df.select(*[F.col(c).alias(name) for c, name in zip(inner, docs.columns)])
    once = named(marked.where(F.col("goes").isNull()))
    repeated = named(marked.where(~F.col("goes")).dropDuplicates(["k"]))
    return once.unionByName(repeated) if judged.where("not goes").limit(1).count() else once


def grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> DataFrame:
    """near_duplicates with the text's hashes t1 and t2, and the component's name."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.withColumns(text_keys())
    sketches = settle(keyed.mapInArrow(lambda batches: sketch(batches, k), "doc_id long, t1 long, t2 long, n long, node string, low array<long>, sketch binary"), "sketches")
    edges = settle(verified(candidates(sketches, percent), sketches, keyed, percent, k).distinct(), "edges")
    return components(sketches, edges)


def sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, node, low, kept = [], [], [], []
        for _, data, offsets in kernel.slices(batch.column("text")):
            for s in kernel.shingle_sets(data, offsets, k):
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                low.append(s[:INDEXED].view(np.int64))
                kept.append((s[:RETAINED] >> np.uint64(32)).astype(np.uint32).tobytes())
        sizes = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*low, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(n, pa.int64()), pa.array(node, pa.string()), lists, pa.array(kept, pa.binary())], ["doc_id", "t1", "t2", "n", "node", "low", "sketch"])


def candidates(sketches: DataFrame, percent: int) -> DataFrame:
    """v, g, i, j, node: for each list and pair of its blocks the nodes that the estimates leave.

    A long list is dealt by size class: sizes of similar sets differ by less than a class,
    so group c holds classes c and c + 1 and answers for pairs with a member of class c.
    """
    postings = sketches.where("n > 0").select(F.explode("low").alias("v"), "node", "n").groupBy("v", "node").agg(F.min("n").alias("n"))
    shared = postings.groupBy("v").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = settle(shared, "lists")
    total = sketches.sparkSession.read.schema(shared.schema).parquet(shared.settled_at).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    size_class = F.when(F.col("members") <= LONG, F.lit(0)).otherwise(1 + F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent + 1e-9)))).cast("int")
    listed = attach(postings, F.col("v"), shared.withColumn("weight", F.col("members")), "v", "weight", total, F.col("node"), "inner")
    listed = settle(listed.withColumn("c", size_class).select("v", "node", "n", "c"), "postings")
    groups = listed.select("v", "node", "n", "c", F.explode(F.when(F.col("c") > 0, F.array(F.col("c") - 1, F.col("c"))).otherwise(F.array("c"))).alias("g"))
    heavy = F.sum(F.greatest(F.lit(1.0), F.col("n") / WIDE))
    # short lists are cut for the bytes of their sets alone, so only large sets count there
    weighed = groups.where((F.col("c") > 0) | (F.col("n") > WIDE))
    long_groups = weighed.groupBy("v", "g").agg(heavy.alias("size")).where(f"size > {BLOCK} - {LONG}")
    # few: each has more than BLOCK members; the join still doesn't rely on that
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    sized = groups.join(long_groups, ["v", "g"], "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block pair (i, j), i <= j: a member of block m belongs to (0, m) .. (m, m), (m, m + 1) .. (m, blocks - 1)
    dealt = sized.select("v", "g", "node", "own", (F.col("c") > F.col("g")).alias("upper"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    needed = listed.select("node").distinct()
    bodies = sketches.where("n > 0").select("node", "n", "sketch").join(needed, "node", "left_semi").dropDuplicates(["node"])
    full = dealt.join(bodies, "node").repartition("v", "g", "i", "j").sortWithinPartitions("v", "g", "i", "j", "node")
    full = full.select("v", "g", "i", "j", "own", "upper", "node", "n", "sketch")
    return full.mapInArrow(lambda batches: by_group(batches, lambda t, lo, hi: in_list(t, lo, hi, percent / 100)), "v long, g int, i int, j int, node string")


GROUP = ("v", "g", "i", "j")


def by_group(batches: Iterator[pa.RecordBatch], look: Callable[[pa.Table, int, int], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """look(table, lo, hi) for each group of the rows, which come sorted by list and block pair; a group may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)  # not copied, as a group's sets may be large
        keys = [t.column(c).to_numpy() for c in GROUP]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        out = [look(t, lo, hi) for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows]) if hi - lo > 1]
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in GROUP]
        new = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        at = int(new[-1]) + 1 if len(new) else 0
        if at:
            yield from emit([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        elif held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in GROUP):
            yield from emit(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from emit(held)


def in_list(t: pa.Table, lo: int, hi: int, least: float) -> pa.RecordBatch:
    """The members of one group that are to be looked at exactly."""
    part = t.slice(lo, hi - lo).combine_chunks()
    v, i, j = (part.column(c)[0].as_py() for c in ("v", "i", "j"))
    bodies = [np.frombuffer(b, np.uint32) for b in part.column("sketch").to_pylist()]
    keep = in_group(np.uint32(v % (1 << 64) >> 32), i == j, part.column("own").to_numpy(), part.column("upper").to_numpy(), part.column("n").to_numpy(), bodies, least)
    kept = part.select([*GROUP, "node"]).take(pa.array(keep, pa.int64())).combine_chunks()
    return kept.to_batches()[0] if len(keep) else pa.RecordBatch.from_pylist([], schema=kept.schema)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of numbers, exactly; looked at in ranges of values, so that beside the sets only one range is held."""
    g = len(sets)
    common = np.zeros((g, g), np.float32)
    total = sum(map(len, sets))
    parts = -(-total // RANGE)
    if parts < 2:
        return common + in_range(sets)
    # every part-th value of the largest sets cuts all sets alike
    largest = max(sets, key=len)
    cuts = largest[np.linspace(0, len(largest), parts, endpoint=False, dtype=np.int64)[1:]]
    bounds = [np.concatenate(([0], np.searchsorted(s, cuts), [len(s)])) for s in sets]
    for k in range(len(cuts) + 1):
        pieces = [s[b[k] : b[k + 1]] for s, b in zip(sets, bounds)]
        common += intersections(pieces) if 1 < sum(map(len, pieces)) // RANGE < parts - 1 else in_range(pieces)
    return common


def in_range(sets: list[np.ndarray]) -> np.ndarray:
    """intersections of sets that are held together."""
    g = len(sets)
    code = np.concatenate(sets)
    order = np.argsort(code, kind="stable")
    row, ranked = np.repeat(np.arange(g, dtype=np.int32), [len(s) for s in sets])[order], code[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    held = np.diff(np.append(begin, len(ranked)))
    each = np.repeat(held, held)
    few = np.flatnonzero((each > 1) & (each <= RARE))
    rare, rows = ranked[few], row[few]
    counts = np.zeros(g * g, np.int64)
    for step in range(1, RARE):
        same = np.flatnonzero(rare[step:] == rare[:-step])
        if not len(same):
            break
        counts += np.bincount(rows[same].astype(np.int64) * g + rows[same + step], minlength=g * g)
    common = counts.astype(np.float32).reshape(g, g)
    common = common + common.T
    often = held > RARE
    number, rows = np.repeat(np.cumsum(often) - 1, held)[each > RARE], row[each > RARE]
    at = np.searchsorted(number, np.arange(0, int(often.sum()) + 2048, 2048))
    for k in range(len(at) - 1):
        x = np.zeros((g, 2048), np.float32)
        x[rows[at[k] : at[k + 1]], number[at[k] : at[k + 1]] - 2048 * k] = 1
        common += x @ x.T
    return common


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, in which a node has few children where the links allow it."""
    unseen, out = np.ones(len(linked), bool), []
    for root in np.argsort(-linked.sum(1), kind="stable").tolist():
        if not unseen[root]:
            continue
        unseen[root] = False
        queue, waiting = collections.deque([root]), []
        while queue or waiting:
            at = queue.popleft() if queue else waiting.pop()
            near = np.flatnonzero(linked[at] & unseen)
            if len(near) > FAN:
                waiting.append(at)
                near = near[:FAN]
            unseen[near] = False
            out += [(at, z) for z in near.tolist()]
            queue.extend(near.tolist())
    return out


def in_group(head: np.uint32, whole: bool, own: np.ndarray, upper: np.ndarray, n: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Positions of the members that may have a link here: those with sure links, and of open pairs that these do not join."""
    g = len(sets)
    most = SIGMAS * np.sqrt(least * (1 - least) / RETAINED)
    # a pair that has a smaller common value is looked at in that one's list
    ours = np.triu(intersections([s[: np.searchsorted(s, head)] for s in sets]) == 0, 1)
    across = own[:, None] != own[None, :]
    if not (ours if whole else ours & across).any():
        return np.zeros(0, np.int64)
    common = intersections(sets)
    n = n.astype(np.float64)
    # below this no pair is a link, so all further work is on the pairs that are left
    floor = ((least - most) * np.minimum(least * n, RETAINED)).astype(np.float32)
    x, y = np.nonzero(ours & (common >= floor[:, None]))
    fair = ~(upper[x] & upper[y])
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    fair &= small >= least * large - 1e-9
    x, y, small, large = x[fair], y[fair], small[fair], large[fair]
    across, c = across[x, y], common[x, y].astype(np.float64)
    here = across | whole
    exact = large <= RETAINED
    # the union's bottom-k sample is drawn without replacement from at most small / least values
    band = most * np.sqrt(np.clip(1 - RETAINED * least / np.maximum(small, 1), 0, 1))
    # of two sketches with c common values c / (2 * RETAINED - c) estimates the Jaccard at most, less if the sizes differ
    sure = np.where(exact, c >= least * (n[x] + n[y] - c) - 1e-3, c >= np.minimum(least + band, 1) * (2 * RETAINED - c))
    needed = np.zeros(g, bool)
    label = np.arange(g)
    # parts that sure links join: in a list of one block those of this list, between two blocks those within each block
    joined = sure if whole else sure & ~across
    linked = np.zeros((g, g), bool)
    linked[x[joined], y[joined]] = linked[y[joined], x[joined]] = True
    for a, b in forest(linked):  # parents come before their children
        label[b] = label[a]
        if whole:
            needed[[a, b]] = True
    if not whole:  # one sure pair of each two parts
        at = np.flatnonzero(sure & here)
        a, b = np.minimum(label[x[at]], label[y[at]]), np.maximum(label[x[at]], label[y[at]])
        _, first = np.unique(a * g + b, return_index=True)
        needed[x[at[first]]] = needed[y[at[first]]] = True
        told = np.zeros((g, g), bool)
        told[a, b] = True
        apart = ~told[np.minimum(label[x], label[y]), np.maximum(label[x], label[y])]
    else:
        apart = label[x] != label[y]
    left = here & ~sure & ~exact & apart & (c >= (least - band) * np.minimum(small, RETAINED))
    for a, b, width in zip(x[left].tolist(), y[left].tolist(), band[left].tolist()):
        if needed[a] and needed[b]:
            continue
        both = np.intersect1d(sets[a], sets[b], assume_unique=True)
        union = np.union1d(sets[a], sets[b])[:RETAINED]
        if np.isin(union, both).sum() >= (least - width) * len(union):
            needed[a] = needed[b] = True
    return np.flatnonzero(needed)


def verified(members: DataFrame, sketches: DataFrame, keyed: DataFrame, percent: int, k: int) -> DataFrame:
    """a, b: a spanning forest of the links of each group's members, from the full shingle sets."""
    members = settle(members, "members")
    nodes = members.select("node").distinct()
    # one row has the text of a node: only rows alike in id and text are gathered, and they are one after partial aggregation
    one = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t1", "t2")).alias("t")
    names = sketches.where("n > 0").groupBy("node").agg(one).join(nodes, "node", "left_semi").select("node", "t.doc_id", "t.t1", "t.t2")
    names = settle(names, "names")
    wanted = F.broadcast(names) if rows_of(names) <= BROADCAST_ROWS else names
    mine = keyed.select(F.col("doc_id").alias("d"), "t1", "t2", "text").join(wanted, ["t1", "t2"]).where(F.col("d").eqNullSafe(F.col("doc_id")))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, d, o in kernel.slices(batch.column("text")) for s in kernel.shingle_sets(d, o, k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "full"])

    full = settle(mine.dropDuplicates(["node"]).select("node", "text").mapInArrow(whole, "node string, full binary"), "full")

    def links(t: pa.Table, lo: int, hi: int) -> pa.RecordBatch:
        part = t.slice(lo, hi - lo)
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in part.column("full")]
        n, common = np.array([len(s) for s in sets], np.int64), intersections(sets).astype(np.int64)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(linked, False)
        node = part.column("node").to_pylist()
        tree = [sorted((node[a], node[b])) for a, b in forest(linked)]
        return pa.RecordBatch.from_arrays([pa.array([p[s] for p in tree], pa.string()) for s in (0, 1)], ["a", "b"])

    gathered = members.join(full, "node").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    return gathered.select(*GROUP, "node", "full").mapInArrow(lambda batches: by_group(batches, links), "a string, b string")


def components(sketches: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest id reachable, by label propagation with pointer jumping between nodes that have links."""
    smallest = settle(sketches.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("weight")), "classes")
    total = sketches.count()
    both = edges.union(edges.select("b", "a")).toDF("x", "y").distinct()
    both = settle(both, "links")
    # a label is a node: the one with the smallest (id, node) so far, null ids last
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id").alias("id"), F.col("node").alias("node"))
    state = settle(smallest.join(both.select(F.col("x").alias("node")).distinct(), "node", "left_semi").select("node", order.alias("label")), "labels")
    few = rows_of(state) <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda df: df)
    while True:
        # a node has few links (FAN for each group that it is in), so none is a hot key here
        near = both.join(side(state.select(F.col("node").alias("y"), "label")), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        moved = state.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        moved = settle(moved, "labels")
        hop = moved.select(F.col("node").alias("to"), F.col("label").alias("further"))
        ahead = moved.withColumn("to", F.col("label.node"))
        if few:
            ahead = ahead.join(F.broadcast(hop), "to", "left")
        else:  # all nodes of a component may look to one
            ahead = attach(ahead, F.col("to"), settle(ahead.groupBy("to").agg(F.count(F.lit(1)).alias("looking")).join(hop, "to"), "ahead"), "to", "looking", rows_of(moved), F.col("node"))
        jumped = ahead.select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        jumped = settle(jumped, "labels")
        changed = jumped.where(~F.col("label").eqNullSafe(F.col("was"))).limit(1).count()
        discard(state, moved)
        state = jumped.select("node", "label")
        state.settled_at = jumped.settled_at
        if not changed:
            break
    found = settle(smallest.join(state, "node", "left").select("node", F.when(F.col("label").isNotNull(), F.col("label.id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("label.node", "node").alias("component"), "weight"), "components")
    out = attach(sketches.select("doc_id", F.col("n").alias("n_shingles"), "node", "t1", "t2"), F.col("node"), found, "node", "weight", total, F.struct("doc_id", "t1"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "component", "t1", "t2")
