"""The trie of all conversations' prefixes, from sorted range shards.

A turn's id is the MD5 of its role and text (with the role's length, so that no two pairs mix),
a conversation's path the ids of its turns end to end. Paths are cut into ranges, ties by
conv_id, so that a first turn or a whole conversation that a third of all share spreads over as
many shards as its size asks for. A shard holds its paths as matrices of turn ids, COLUMNS
turns wide and padded, sorts them (lexsort), and compares each row with the one before: the
running OR of the columns' changes marks where a node of each depth starts, and reduceat over
the starts sums every depth, deepest first. Longer conversations go on in further matrices that
hold them alone, so that one long conversation pads no other.

Only nodes on the paths of a shard's first and last row can go on in another shard. Those leave
their sums open and are recombined, FAN neighbouring shards at a time, until one group closes
them; there are at most two such paths a shard, whatever its size. The ids of conversations
that end at an open node leave the shard as text and are digested in order of the shards, as a
stream that holds one shard's text at a time.

Defined results: a null role or text is empty; null turns come first, equal turns are ordered
by their ids, repeated rows are repeated turns; rows with a null conv_id belong to no
conversation and are left out; other columns are ignored; an empty table has no nodes. One
conversation's turns are one row, as one document's text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stored

#: Turns in a row of a matrix; only memory and time depend on it.
COLUMNS = 8
#: Turns of a range shard, about.
TURNS_PER_SHARD = 1 << 19
#: Neighbouring shards whose open nodes are recombined at once.
FAN = 256

NOTHING = hashlib.sha256(b"").hexdigest()
NODE = (
    "open boolean, first boolean, last boolean, shard long, depth long, key binary, parent_key binary,"
    " conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " last_chars long, ends_sha256 string, ends string"
)
COLUMNS_OF_NODE = [part.split() for part in NODE.split(", ")]
_TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
#: `ends` is text and as long as a shard's conversations; the others are a few bytes.
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in COLUMNS_OF_NODE])


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of conversations(conv_id, turn, role, text): the ids of its turns in
    order, end to end, and their texts' code points."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    turn = F.struct(
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.length(text).alias("chars"),
    )
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.col("t.id").alias("ids"), F.col("t.chars").alias("chars"))
    )


def grafted(paths: DataFrame, most: int, of: int) -> DataFrame:
    """paths(conv_id, ids, chars) with the first turns replaced by those of conversation
    conv_id - conv_id % of; how many, below `most`, comes from the CRC-32 of conv_id."""
    base = F.col("conv_id") - F.col("conv_id") % of
    bases = paths.where(F.col("conv_id") % of == 0).select(
        F.col("conv_id").alias("base"),
        *[F.slice(c, 1, most - 1).alias(f"base_{c}") for c in ("ids", "chars")],
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = paths.withColumns({"base": base, "h": h}).join(bases, "base", "left")
    return joined.select(
        "conv_id",
        *[
            F.expr(
                f"concat(coalesce(slice(base_{c}, 1, h), slice({c}, 1, 0)),"
                f" slice({c}, h + 1, greatest(size({c}) - h, 0)))"
            ).alias(c)
            for c in ("ids", "chars")
        ],
    )


def batch_of(nodes: dict[str, list | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes[f.name], f.type) for f in _ARROW], schema=_ARROW)


def sorted_marks(ids: np.ndarray, first: np.ndarray, conv: np.ndarray):
    """The order of paths (ties by conv), and for each run of COLUMNS depths the places, in that
    order, of the rows that are long enough, and their masks of changes."""
    n = len(conv)
    length = np.diff(first)
    order = np.arange(n)
    group = np.zeros(n, dtype=np.int64)
    places = np.arange(n)
    masks = []
    begin = 0
    while len(places):
        rows = order[places]
        column = begin + np.arange(COLUMNS)
        held = column < length[rows][:, None]
        at = np.minimum(first[rows][:, None] + column, len(ids) - 1)
        matrix = np.where(held[:, :, None], ids[at], 0) if len(ids) else np.zeros((len(rows), COLUMNS, 2), np.uint64)
        # Of equal rows those that end here stand before those that go on.
        more = length[rows] > begin + COLUMNS
        keys = [conv[rows], more, *(matrix[:, k, part] for k in range(COLUMNS - 1, -1, -1) for part in (1, 0)), group]
        by = np.lexsort(keys)
        order[places] = rows[by]
        matrix, held, group = matrix[by], held[by], group[by]
        change = np.ones((len(by), COLUMNS), dtype=bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(axis=2) | (held[1:] != held[:-1])
        change[1:, 0] |= group[1:] != group[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        masks.append((places, change))
        longer = np.flatnonzero(length[order[places]] > begin + COLUMNS)
        group = np.cumsum(change[:, -1])[longer]
        places = places[longer]
        begin += COLUMNS
    return order, masks


def shard_nodes(shard: int, ids: np.ndarray, first: np.ndarray, chars: np.ndarray, conv: np.ndarray):
    """The nodes of one shard's paths. ids: two unsigned words of every turn, first: each path's
    first turn (one more at the end)."""
    order, masks = sorted_marks(ids, first, conv)
    conv, begins, length = conv[order], first[:-1][order], np.diff(first)[order]
    n, depth = len(conv), int(length.max())
    keys = {row: prefix_keys(ids, begins[row], length[row]) for row in {0, n - 1}}
    leaf, saved = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    child_rows = np.zeros(0, dtype=np.int64)
    below = None
    for d in range(depth, -1, -1):
        if d:
            places, change = masks[(d - 1) // COLUMNS]
            deep = length[places] >= d
            rows, starts = places[deep], np.flatnonzero(change[deep, (d - 1) % COLUMNS])
        else:
            rows, starts = np.arange(n), np.zeros(1, dtype=np.int64)
        heads = rows[starts]
        count = np.diff(np.append(starts, len(rows)))
        # Open nodes: on the path of the first or of the last row.
        on_first, on_last = np.zeros(len(heads), dtype=bool), np.zeros(len(heads), dtype=bool)
        on_first[0], on_last[-1] = length[0] >= d, length[n - 1] >= d
        is_open = on_first | on_last
        children = np.bincount(np.searchsorted(heads, child_rows, side="right") - 1, minlength=len(heads))
        ended = np.add.reduceat((length[rows] == d).astype(np.int64), starts)
        last_chars = chars[begins[heads] + d - 1] if d else np.zeros(1, dtype=np.int64)
        leaf[heads] += ~is_open & (ended == count)
        saved[heads] += np.where(is_open, 0, (count - 1) * last_chars)
        smallest = np.minimum.reduceat(conv[rows], starts)
        ends = [",".join(map(str, conv[a : a + m].tolist())) for a, m in zip(heads.tolist(), ended.tolist(), strict=True)]
        key = [
            keys[0][d] if f else keys[n - 1][d] if b else None
            for f, b in zip(on_first.tolist(), on_last.tolist(), strict=True)
        ]
        if below is not None:
            parent = np.searchsorted(heads, below["heads"], side="right") - 1
            under_open = is_open[parent]
            below["parent_key"] = [key[p] if u else None for p, u in zip(parent.tolist(), under_open.tolist(), strict=True)]
            below["parent_conv_id"] = pa.array(smallest[parent], mask=under_open)
            yield batch_of(below)
        below = {
            "heads": heads, "open": is_open, "first": on_first, "last": on_last,
            "shard": np.full(len(heads), shard), "depth": np.full(len(heads), d), "key": key,
            "conv_id": smallest, "n_convs": count, "n_children": children,
            "n_leaves": np.add.reduceat(leaf[rows], starts), "saved_tokens": np.add.reduceat(saved[rows], starts),
            "last_chars": last_chars,
            "ends_sha256": [
                None if o else hashlib.sha256(e.encode()).hexdigest() if e else NOTHING
                for o, e in zip(is_open.tolist(), ends, strict=True)
            ],
            "ends": [e if o and e else None for o, e in zip(is_open.tolist(), ends, strict=True)],
        }
        child_rows = heads[~is_open]
    below["parent_key"], below["parent_conv_id"] = [None], [None]
    yield batch_of(below)


def prefix_keys(ids: np.ndarray, begin: int, length: int) -> list[bytes]:
    """The MD5 of every prefix of a path, the empty one first."""
    running = hashlib.md5(b"")
    keys = [running.digest()]
    for turn in ids[begin : begin + length]:
        running.update(turn.astype(">u8").tobytes())
        keys.append(running.digest())
    return keys


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    paths = [path for batch in parts for path in batch.column("path").to_pylist()]
    ids = np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    turns = np.fromiter((len(path) // 16 for path in paths), dtype=np.int64, count=len(paths))
    first = np.concatenate([[0], np.cumsum(turns)])
    chars = np.concatenate([batch.column("chars").flatten().to_numpy() for batch in parts]).astype(np.int64)
    conv = np.concatenate([batch.column("conv_id").to_numpy() for batch in parts])
    yield from shard_nodes(TaskContext.get().partitionId(), ids, first, chars, conv)


def recombined(rows: pa.Table, final: bool, fan: int) -> pa.Table:
    """Open nodes of neighbouring shards as one: closed, but for those on the outer paths."""
    r = {name: rows.column(name).to_pylist() for name in rows.column_names}
    lowest, highest = min(r["shard"]), max(r["shard"])
    nodes: dict[tuple[int, bytes], dict] = {}
    for k in range(rows.num_rows):
        node = nodes.setdefault(
            (r["depth"][k], r["key"][k]),
            dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved_tokens"), 0)
            | {"first": False, "last": False, "conv_id": r["conv_id"][k], "key": r["key"][k],
               "parent_key": r["parent_key"][k], "last_chars": r["last_chars"][k], "depth": r["depth"][k]},
        )
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += r[name][k]
        node["conv_id"] = min(node["conv_id"], r["conv_id"][k])
        node["first"] |= r["first"][k] and r["shard"][k] == lowest
        node["last"] |= r["last"][k] and r["shard"][k] == highest
    found, added = [], {}
    for (depth, _), node in sorted(nodes.items(), key=lambda x: -x[0][0]):
        node["open"] = not final and (node["first"] or node["last"])
        parent = nodes.get((depth - 1, node["parent_key"]))
        # What a node adds when it closes counts for every node above it, which all are here.
        more = added.get((depth, node["key"]), np.zeros(2, dtype=np.int64))
        if not node["open"]:
            more = more + [not node["n_children"], (node["n_convs"] - 1) * node["last_chars"]]
            if parent:
                parent["n_children"] += 1
        node["n_leaves"] += int(more[0])
        node["saved_tokens"] += int(more[1])
        above = (depth - 1, node["parent_key"])
        added[above] = added.get(above, np.zeros(2, dtype=np.int64)) + more
        found.append(node | {"shard": lowest // fan, "ends": None, "ends_sha256": None, "parent_conv_id": None})
    return pa.Table.from_pylist(found, schema=_ARROW)


def _recombine(final: bool, fan: int):
    def run(rows: pa.Table) -> pa.Table:
        return recombined(rows, final, fan)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with the same key; their texts are joined by commas."""
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"]
        )

    current, running = None, None
    for batch in batches:
        for key, ends in zip(batch.column("key"), batch.column("ends"), strict=True):
            key, ends = key.as_py(), ends.as_py().encode()
            if key == current:
                running.update(b"," + ends)
                continue
            if running:
                yield row()
            current, running = key, hashlib.sha256(ends)
    if running:
        yield row()


RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def prefix_trie(paths: DataFrame, shards: int | None = None, fan: int = FAN) -> DataFrame:
    """A row for each node of the trie of paths(conv_id, ids, chars): RESULT."""
    spark = paths.sparkSession
    rows = stored(
        paths.select("conv_id", F.unhex(F.array_join("ids", "")).alias("path"), F.col("chars").cast("array<int>").alias("chars")),
        "trie-paths",
    )
    if shards is None:
        turns = rows.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // TURNS_PER_SHARD + 1)
    nodes = stored(
        rows.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shard, NODE), "trie-nodes"
    )
    shards = (nodes.agg(F.max("shard")).first()[0] or 0) + 1
    once_open = []
    level = nodes.where("open").drop("ends")
    while True:
        final = shards <= fan
        groups = level.withColumn("ends", F.lit(None).cast("string")).withColumn(
            "group", F.floor(F.col("shard") / fan)
        )
        merged = stored(
            groups.groupBy("group").applyInArrow(_recombine(final, fan), NODE), "trie-merged"
        )
        once_open.append(merged.where("NOT open"))
        if final:
            break
        level, shards = merged.where("open").drop("ends"), -(-shards // fan)
    # Digests of the conversations that end at nodes of several shards, shard by shard.
    texts = nodes.where("open AND ends IS NOT NULL").select("key", "shard", "ends")
    digests = (
        texts.repartition("key").sortWithinPartitions("key", "shard")
        .mapInArrow(_digests, "key binary, ends_sha256 string")
    )
    joined = reduce(DataFrame.unionByName, once_open)
    joined = joined.drop("ends_sha256").join(digests, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    )
    known = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_now"))
    wanted = [*RESULT, "parent_key"]
    every = nodes.where("NOT open").select(wanted).unionByName(joined.select(wanted))
    under_open = every.where("parent_key IS NOT NULL").join(known, "parent_key", "left")
    return (
        every.where("parent_key IS NULL").select(*RESULT)
        .unionByName(under_open.withColumn("parent_conv_id", F.col("parent_now")).select(*RESULT))
    )
