"""Near-duplicate classes by a chosen-path similarity join.

A document's set holds its distinct 5-word shingles. Documents with equal sets are one class
before anything else. The others are spread over independent trees: a document enters, in each
tree, the node of its minwise shingle under that tree's hash function, so that two documents of
similarity s meet in a tree with probability s. A node of at most LEAF members is compared
exhaustively; a larger one is worked on in two steps:

- if all but half of LEAF of its members are known to be connected, the others are compared with all:
  the node is cut into chunks, and they are put into every chunk;
- else its members are compared within chunks, together with a few pivots that are put into
  every chunk, and then branch into two children each, by the minwise shingles under two further
  functions. A node that is still large after DEEPEST levels is compared in all pairs of chunks.

Trees come in batches. Connected documents get one label after each batch and level, and only
documents of different labels are ever compared, so a group of near copies is worked out once
and not again in every tree and node. Comparing has two steps. Members of a node are kept if
they have a candidate, a member of another label with which LEAST_ALIKE of their minwise shingles
agree (a pair at the threshold misses that once in 10**9). The full sets of those that are kept
join them, and a group's members outside its largest label are held against all others until
nothing is left to compare; links leave the group as edges of a star. So what leaves a node is
at most a row for each member, whatever the number of its pairs. With TREES trees two
documents at the threshold never meet with probability 0.25**TREES, about 2e-10, before what
deeper levels add; pairs that are more alike miss more rarely still.

Defined results: a null text or one without words has an empty set and is linked with nothing;
a text of fewer words than a shingle has its whole sequence as its one shingle; rows with equal
doc_id are one document in the components; a row with a null doc_id is its own, with a null
component, and kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bloom import Filter, filter_of
from millrace.llm.scratch import stored
from millrace.llm.words import mix, slices, words_of

WORDS = 5
#: A link: intersection / union at least so much, in percent.
PERCENT = 75
TREES = 16
#: Hash functions for the levels below the first.
DEEPER = 16
#: Minwise shingles of all functions that candidates must share, at least.
LEAST_ALIKE = 9
#: Trees that are worked on together; documents linked by then are not compared again.
BATCHES = (range(4), range(4, TREES))
#: Members of a node that are compared at once, at most; chunks of a larger node have half of that.
LEAF = 3072
#: Members of a large node that are put into each of its chunks.
PIVOTS = 16
#: Levels below the first before a large node is compared in all pairs of its chunks.
DEEPEST = 6
#: Texts that go to Python at once; only memory depends on this.
BATCH_ROWS = 500


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, each text's in order, and their bounds."""
    words = words_of(column, lower=True)
    owner, sizes = words.owner, np.diff(words.first)
    place, value = words.windows(WORDS)
    texts = [owner[place]]
    values = [value]
    for size in range(1, WORDS):
        at, whole = words.windows(size, salt=10 + size)
        only = sizes[owner[at]] == size
        texts.append(owner[at[only]])
        values.append(whole[only])
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, two keys of the whole set, the minwise shingle of each function and a byte
    of each."""
    steps = np.random.default_rng(20).integers(1, 1 << 62, TREES + DEEPER, dtype=np.uint64)
    for batch in (part for whole in batches for part in slices(whole, "text")):
        value, bounds = shingles(batch.column("text"))
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        first = bounds[:-1][some]
        mins = np.zeros((batch.num_rows, TREES + DEEPER), dtype=np.uint64)
        keys = np.zeros((batch.num_rows, 2), dtype=np.uint64)
        if len(some):
            for k, step in enumerate(steps):
                mins[some, k] = np.minimum.reduceat(value * (step * np.uint64(2) + np.uint64(1)), first)
            for k in range(2):
                salted = value * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                salted ^= salted >> np.uint64(29 + k)
                keys[some, k] = np.add.reduceat(salted * np.uint64(0xD6E8FEB86659FD93), first)
        width = TREES + DEEPER
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()),
             pa.array(np.ascontiguousarray(keys[:, 0]).view(np.int64)),
             pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)),
             pa.ListArray.from_arrays(
                 pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()),
                 pa.array(mins.ravel().view(np.int64))),
             pa.array([row.tobytes() for row in mix(mins, 9).astype(np.uint8)], pa.binary())],
            ["doc_id", "n_shingles", "k1", "k2", "mins", "signature"],
        )


#: Bytes of a shingle's hash that a full set keeps for comparing two sets.
KEPT_BYTES = 5


def _sets_of(wanted: Filter):
    """The full sets of the documents that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            known = whole.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keys = whole.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
            for batch in slices(whole.filter(pa.array(known & wanted.holds(keys))), "text"):
                value, bounds = shingles(batch.column("text"))
                raw = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"),
                     pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                         None, pa.py_buffer((bounds * KEPT_BYTES).astype(np.int32)), pa.py_buffer(raw)])],
                    ["doc", "members"],
                )

    return run


def groups_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in order of `node`."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        node = table.column("node").to_numpy()
        start = int(np.searchsorted(node, node[-1]))
        if start:
            yield table.slice(0, start)
        rest = table.slice(start)
    if rest is not None:
        yield rest


def agreeing(signatures: np.ndarray) -> np.ndarray:
    """signatures (..., n, functions): how many of two members' minwise shingles agree (..., n, n)."""
    out = np.zeros((*signatures.shape[:-1], signatures.shape[-2]), dtype=np.uint8)
    for k in range(signatures.shape[-1]):
        own = signatures[..., k]
        out += own[..., :, None] == own[..., None, :]
    return out


def _signature_matrix(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, TREES + DEEPER)


#: Pairs of members that are held in memory at once.
PAIRS_AT_ONCE = 1 << 21


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of nodes that have a candidate of another label in their node."""
    for table in groups_in(batches):
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        signature = _signature_matrix(table.column("signature"))
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(heads, len(node)))
        kept = np.zeros(len(node), dtype=bool)
        for size in np.unique(sizes[sizes > 1]).tolist():
            own = heads[sizes == size]
            step = max(PAIRS_AT_ONCE // size**2, 1)
            for some in (own[k : k + step] for k in range(0, len(own), step)):
                rows = some[:, None] + np.arange(size)
                other = label[rows][:, :, None] != label[rows][:, None, :]
                if other.any():
                    kept[rows] |= ((agreeing(signature[rows]) >= LEAST_ALIKE) & other).any(axis=2)
        if kept.any():
            for batch in table.filter(pa.array(kept)).to_batches():
                yield batch


def linked_labels(
    labels: np.ndarray, signature: np.ndarray, sets: list[np.ndarray]
) -> tuple[list[tuple[int, int]], int]:
    """Edges that connect the labels of members that are linked, directly or through others, and
    how many members were held against all others for that.

    Members of the largest label wait; any other is held against all, those with most candidates
    first, until every member outside the largest label is done or has no candidate left.
    """
    names, label = np.unique(labels, return_inverse=True)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    likely = agreeing(signature) >= LEAST_ALIKE
    done = np.zeros(len(sets), dtype=bool)
    largest = np.bincount(label).argmax()
    edges = []
    while True:
        waiting = np.flatnonzero(~done & (label != largest))
        chances = (likely[waiting] & (label[waiting][:, None] != label) & ~done).sum(axis=1)
        waiting = waiting[np.argsort(-chances, kind="stable")][: np.count_nonzero(chances)]
        if not len(waiting):
            return edges, int(done.sum())
        for one in waiting.tolist():
            if label[one] == largest or not (likely[one] & (label != label[one]) & ~done).any():
                continue
            marked = np.zeros(int(token.max(initial=-1)) + 1, dtype=bool)
            marked[token[first[one] : first[one + 1]]] = True
            sums = np.concatenate([[0], np.cumsum(marked[token])])
            common = sums[first[1:]] - sums[first[:-1]]
            linked = (100 * common >= PERCENT * (sizes + sizes[one] - common)) & (sizes > 0)
            met = np.unique(label[linked])
            edges += [(int(names[met[0]]), int(names[k])) for k in met[1:]]
            label[np.isin(label, met)] = met[0]
            largest = np.bincount(label).argmax()
            done[one] = True


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between labels, from groups of members with their full sets."""
    for table in groups_in(batches):
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        signature = _signature_matrix(table.column("signature"))
        raw = table.column("members").to_pylist()
        heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        edges = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(node)], strict=True):
            sets = []
            for one in raw[a:b]:
                wide = np.zeros((len(one) // KEPT_BYTES, 8), dtype=np.uint8)
                wide[:, 8 - KEPT_BYTES :] = np.frombuffer(one, dtype=np.uint8).reshape(-1, KEPT_BYTES)
                sets.append(wide.view(np.uint64).ravel())
            edges += linked_labels(label[a:b], signature[a:b], sets)[0]
        if edges:
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"]
            )


MEMBER = "node long, doc long, label long, tree int, signature binary"
COLUMNS = [part.split()[0] for part in MEMBER.split(", ")]


def by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows(doc, ...) with the label of their document, which is the document itself at first."""
    if labels is None:
        return rows.withColumn("label", F.col("doc"))
    return rows.drop("label").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels(doc, label) after edges(a, b) between labels: each becomes its smallest neighbour.

    Two documents of one label are connected; of those that are, not all need have one label.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("now"))
    new = least.select(F.col("a").alias("doc"), F.col("now").alias("label"))
    if labels is None:
        return stored(new, "near-labels")
    moved = labels.join(least, F.col("label") == F.col("a"), "left").select(
        "doc", F.coalesce("now", "label").alias("label")
    )
    return stored(moved.unionByName(new.join(labels, "doc", "left_anti")), "near-labels")


class Comparison:
    """Compares groups of documents and keeps what is known: labels, edges, full sets."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.labels: DataFrame | None = None
        self.edges: list[DataFrame] = []
        self.sets: DataFrame | None = None

    def candidates(self, groups: DataFrame) -> DataFrame:
        """The rows of groups(node, doc, tree, signature) that have a candidate of another label."""
        rows = by_node(labelled(groups, self.labels).select(*COLUMNS))
        kept = stored(rows.mapInArrow(_candidates, MEMBER), "near-kept")
        self.add_sets(kept.select("doc").distinct())
        return kept

    def add_sets(self, ids: DataFrame) -> None:
        if self.sets is not None:
            ids = ids.join(self.sets, "doc", "left_anti")
        ids = stored(ids, "near-ids")
        if ids.isEmpty():
            return
        wanted = filter_of(ids.select(F.col("doc").alias("key")))
        texts = self.docs.mapInArrow(_sets_of(wanted), "doc long, members binary")
        new = stored(texts.join(ids, "doc", "left_semi"), "near-sets", BATCH_ROWS)
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def link(self, kept: DataFrame) -> None:
        """Compares rows of MEMBER, by node, on full sets."""
        if kept.isEmpty():
            return
        full = kept.join(self.sets, "doc").select("node", "label", "signature", "members")
        found = stored(by_node(full).mapInArrow(_links, "a long, b long"), "near-edges")
        self.edges.append(found)
        self.labels = relabelled(self.labels, found)


def large_groups(large: DataFrame, half: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """Groups of the members of large nodes(node, doc, label, tree, signature), and those members
    whose nodes have to branch."""
    counts = large.groupBy("node", "label").agg(F.count("*").alias("n"))
    nodes = counts.groupBy("node").agg(
        F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")
    ).where("most < size")
    nodes = stored(nodes.withColumn("chunks", F.ceil(F.col("size") / half)), "near-nodes")
    rows = large.join(nodes, "node").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(5)), "chunks"))
    few = F.col("size") - F.col("most") <= half
    outside = F.col("label") != F.col("main")
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    # Outsiders of a node that has few of them go into every chunk, else PIVOTS or so of all do.
    chosen = F.pmod(F.xxhash64("doc", "node"), "size") < PIVOTS
    places = F.when(F.when(few, outside).otherwise(chosen), everywhere).otherwise(F.array("chunk"))
    if last:
        pairs = F.expr("transform(sequence(0L, chunks - 1), c -> xxhash64(least(c, chunk), greatest(c, chunk)))")
        places = F.when(few, places).otherwise(pairs)
    groups = rows.withColumn("place", F.explode(places)).withColumn("node", F.xxhash64("node", "place"))
    return groups, rows.where(~few).select("node", "doc", "tree", "signature")


def links_of(signatures: DataFrame, docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b) of edges that connect all linked documents. signatures(doc_id, mins, signature) of
    one document per distinct set."""
    work = Comparison(docs)
    nodes = signatures.select(
        F.col("doc_id").alias("doc"), "signature", F.posexplode(F.slice("mins", 1, TREES)).alias("tree", "least")
    ).select(F.xxhash64("tree", "least").alias("node"), "doc", "tree", "signature")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of nodes of at most `leaf`, and of larger ones."""
        sizes = rows.groupBy("node").agg((F.count("*") > leaf).alias("large")).where("large")
        marked = rows.join(stored(sizes, "near-large"), "node", "left")
        return marked.where("large IS NULL").drop("large"), marked.where("large").drop("large")

    small, large = parted(nodes)
    kept = work.candidates(small)
    for k, trees in enumerate(BATCHES):
        own = kept.where(F.col("tree").between(trees[0], trees[-1]))
        work.link(own if k == 0 else work.candidates(own))
    for level in range(DEEPEST + 1):
        large = stored(large, "near-members")
        if large.isEmpty():
            break
        groups, branching = large_groups(labelled(large, work.labels), leaf // 2, level == DEEPEST)
        work.link(work.candidates(groups))
        if level == DEEPEST:
            break
        child = [
            F.xxhash64("node", F.lit(branch),
                       F.element_at("mins", F.pmod(F.col("tree") * 3 + 2 * level + branch, F.lit(DEEPER)) + TREES + 1))
            for branch in (0, 1)
        ]
        rest = branching.join(signatures.select(F.col("doc_id").alias("doc"), "mins"), "doc").select(
            F.explode(F.array(*child)).alias("node"), "doc", "tree", "signature"
        )
        small, large = parted(stored(rest, "near-rest"))
        work.link(work.candidates(small))
    none = signatures.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    return reduce(DataFrame.unionByName, work.edges, none)


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every document in links(a, b) that is connected with a smaller one:
    the smallest of those.

    In each round a document joins that one of its neighbours and itself which comes first in an
    order, and the links between joined documents remain. The order is that of ids for two rounds,
    enough for stars around their smallest document, which most classes are. After that it is
    drawn anew each time: a drawn order takes a share of any graph's documents away in each round,
    so that rounds grow with the logarithm of their number.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(edges.distinct(), "near-edges")
    labels = None
    turn = 0
    while not edges.isEmpty():
        def drawn(c: str, turn: int = turn):
            rank = F.lit(0) if turn < 2 else F.xxhash64(c, F.lit(turn))
            return F.struct(rank.alias("rank"), F.col(c).alias("doc"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(
            both.groupBy("a").agg(F.min(drawn("b")).alias("m"))
            .select(F.col("a").alias("doc"), F.least("m", drawn("a"))["doc"].alias("now")),
            "near-step",
        )
        for side in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("doc", side), side).drop(side).withColumnRenamed("now", side)
        edges = stored(
            edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "near-edges",
        )
        if labels is None:
            labels = step.withColumnRenamed("now", "label")
        else:
            moved = step.withColumnRenamed("doc", "label")
            labels = labels.join(moved, "label", "left").select("doc", F.coalesce("now", "label").alias("label"))
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("doc"), F.col("a").alias("component")).limit(0)
    least = labels.groupBy("label").agg(F.min("doc").alias("component"))
    return labels.join(least, "label").where("doc <> component").select("doc", "component")


def near_duplicates(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(
        docs.mapInArrow(
            _signatures, "doc_id long, n_shingles long, k1 long, k2 long, mins array<long>, signature binary"
        ),
        "near-signed",
        BATCH_ROWS,
    )
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(
        known.groupBy("n_shingles", "k1", "k2").agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
            F.min_by(F.struct("mins", "signature"), "doc_id").alias("own"),
        ),
        "near-classes",
    )
    signatures = classes.select(F.col("first").alias("doc_id"), "own.mins", "own.signature")
    links = links_of(signatures, docs, leaf)
    copies = known.join(
        classes.where("first < last").drop("last", "own"), ["n_shingles", "k1", "k2"]
    ).where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    joined = components(links.unionByName(copies))
    component = F.coalesce("component", "doc_id")
    return (
        signed.select("doc_id", "n_shingles")
        .join(joined.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )
