"""Phrases of up to four words that occur often, by Toivonen's sampling and their collocation scores.

A sample of the documents proposes phrases: level by level, those that reach a lowered
threshold in it. They are known by a Bloom filter. A full pass counts, exactly and in all
documents, every phrase whose shorter parts the filter all takes for proposed: the proposed
phrases themselves, and the negative border, which is what would have to be looked at next
(every word at the first level). Words outside the filter that turn out frequent, and longer
phrases of the border that do, are *failures*: phrases around them were not counted. Then a
further pass counts what contains a failure and was not counted yet. A frequent phrase that was
not counted in the first full pass has a shortest part outside the filter; that part is in the
border, and frequent as its whole is, so it is a failure. So two passes at most close the
search, whatever the sample and the filter's false hits; those only change how much is counted.

The filter has a bounded number of bits, so what is broadcast is bounded. Every task counts a
block of texts and sends each distinct phrase once with its count to the phrase's bucket, in one
row for each bucket; the number of buckets is fixed, so that rows follow the blocks. A bucket is
read as a stream: only its distinct phrases are held. Languages are part of a phrase's identity.

Defined results: a null text has no words, a null language is `und`; repeated rows count each;
other columns are ignored; an empty table has no phrases. Phrases are told apart by 64-bit
hashes within a block of texts, by their bytes everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bloom import Filter, filter_of
from millrace.llm.scratch import stored
from millrace.llm.words import mix, slices, span_hashes, text_bytes

LONGEST = 4
#: Occurrences of a phrase, at least.
FREQUENT = 30
#: The sample: one document in so many, and the threshold in it.
SHARE, PROPOSED = 8, 2
#: Bytes of text, and rows, that are counted together at most; only memory and traffic depend on
#: them.
BLOCK, BATCH_ROWS = 4 << 20, 300
#: Buckets of a full pass, whatever the input's size; a pass over the sample has its share of them.
BUCKETS = 1024
#: Bytes of a bucket's rows that wait at least until they are added up.
WAITING = 8 << 20

#: No UTF-8 text holds these bytes: the end of a language, and of a phrase.
LANGUAGE_ENDS, PHRASE_ENDS = 0xFF, 0xFE

_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Grams:
    """The words of some texts: byte spans, and for each length the key of the phrase that starts
    at a word and whether it lies within one piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    keys: list[np.ndarray]
    whole: list[np.ndarray]


def language_keys(languages: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(languages), dtype=np.uint8)
    ends = np.cumsum([len(x) for x in languages]).astype(np.int64)
    return span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, 1)


def grams_of(texts: pa.Array, languages: list[bytes]) -> Grams:
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    n = len(data)
    cut = _CUT[data]
    apart = cut | _BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(n, dtype=bool)
    before[1:] = apart[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = apart[1:]
    start = np.flatnonzero(~apart & (before | edge[:n]))
    end = np.flatnonzero(~apart & (after | edge[1:])) + 1
    piece = np.cumsum(cut | edge[:n], dtype=np.int32)[start]
    owner = np.searchsorted(offsets, start, side="right") - 1
    word = mix(span_hashes(data, start, end, 0) ^ language_keys(languages)[owner], 3)
    keys, whole = [word], [np.ones(len(word), dtype=bool)]
    for k in range(1, LONGEST):
        shorter = keys[-1][:-1] if len(keys[-1]) else keys[-1]
        keys.append(mix(shorter * np.uint64(31) + word[k:], 3 + k) if len(shorter) else shorter)
        whole.append(piece[: len(keys[-1])] == piece[k:] if len(keys[-1]) else np.zeros(0, dtype=bool))
    return Grams(data, start, end, owner, keys, whole)


def both(flags: np.ndarray) -> np.ndarray:
    """Whether a phrase's part without its last and without its first word are flagged."""
    return flags[:-1] & flags[1:] if len(flags) else flags


def counted_first(g: Grams, proposed: Filter) -> list[np.ndarray]:
    """For each length, which phrases the first full pass counts: all their parts are proposed."""
    out = [g.whole[0]]
    inside = g.whole[0] & proposed.holds(g.keys[0])
    for k in range(1, LONGEST):
        out.append(both(inside) & g.whole[k])
        inside = out[-1].copy()
        inside[out[-1]] = proposed.holds(g.keys[k][out[-1]])
    return out


def counted_again(g: Grams, proposed: Filter, failed: Filter, words: Filter) -> list[np.ndarray]:
    """For each length, which phrases contain a failure, have frequent words only, and were not
    counted in the first full pass."""
    before = counted_first(g, proposed)
    frequent = words.holds(g.keys[0])
    out = [np.zeros(len(g.start), dtype=bool)]
    around = frequent & failed.holds(g.keys[0])
    for k in range(1, LONGEST):
        frequent = both(frequent)
        around = around[:-1] | around[1:] if len(around) else around
        wanted = around & frequent & g.whole[k]
        out.append(wanted & ~before[k])
        own = np.zeros(len(wanted), dtype=bool)
        may = frequent & g.whole[k] & ~wanted
        own[may] = failed.holds(g.keys[k][may])
        around = wanted | own
    return out


def entries(g: Grams, words: pa.Array, languages: pa.Array, at: np.ndarray, size: int) -> pa.Array:
    """The phrases of `size` words at these words, each after its language, both ended by their
    mark. words: the bytes of all words of g; languages: those of its texts."""
    own = [words.take(pa.array(at + k)) for k in range(size)]
    phrase = pc.binary_join_element_wise(*own, b" ") if size > 1 else own[0]
    language = languages.take(pa.array(g.owner[at]))
    marked = pc.binary_join_element_wise(language, phrase, bytes([LANGUAGE_ENDS]))
    return pc.binary_join_element_wise(marked, b"", bytes([PHRASE_ENDS]))


def words_in(g: Grams) -> pa.Array:
    """The bytes of every word."""
    inside = np.zeros(len(g.data) + 1, dtype=np.int8)
    inside[g.start] += 1
    inside[g.end] -= 1
    held = g.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(g.end - g.start)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(g.start), [None, pa.py_buffer(ends), pa.py_buffer(held)])


def bytes_of(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a fresh binary column end to end, and its bounds."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[: len(column) + 1]
    return column.buffers()[2], bounds


COUNTS = "bucket long, phrases binary, counts binary, languages array<string>, totals array<long>"


def _counts(pick, size_of: range, buckets: int, block: int):
    """A row for each block and bucket: its phrases and their counts, and with the first of them
    the block's number of words by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", block)):
            languages = [x.encode() for x in batch.column("lang").to_pylist()]
            g = grams_of(batch.column("text"), languages)
            flags = pick(g)
            words = words_in(g)
            names = pa.array(languages, pa.binary())
            phrases, bucket, counts = [], [], []
            for size in size_of:
                at = np.flatnonzero(flags[size - 1])
                keys, first, n = np.unique(g.keys[size - 1][at], return_index=True, return_counts=True)
                phrases.append(entries(g, words, names, at[first], size))
                counts.append(n)
                bucket.append(((keys >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64))
            counts, bucket = map(np.concatenate, (counts, bucket))
            if not len(counts):
                continue
            order = np.argsort(bucket, kind="stable")
            data, ends = bytes_of(pa.concat_arrays(phrases).take(pa.array(order)))
            bucket, counts = bucket[order], counts[order].astype("<u4")
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            bounds = ends[np.append(heads, len(bucket))].astype(np.int32)
            n_words = np.bincount(g.owner, minlength=len(languages))
            totals: dict[str, int] = {}
            for language, n in zip(batch.column("lang").to_pylist(), n_words.tolist(), strict=True):
                if n:
                    totals[language] = totals.get(language, 0) + n
            none = [[]] * (len(heads) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[heads]),
                 pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds), data]),
                 pa.Array.from_buffers(
                     pa.binary(), len(heads),
                     [None, pa.py_buffer((np.append(heads, len(bucket)) * 4).astype(np.int32)), pa.py_buffer(counts)]),
                 pa.array([list(totals), *none], pa.list_(pa.string())),
                 pa.array([list(totals.values()), *none], pa.list_(pa.int64()))],
                ["bucket", "phrases", "counts", "languages", "totals"],
            )

    return run


#: size 0: the number of words of a language, as f.
SUMS = "lang string, size long, phrase string, f long, key long"


def _sums(threshold: int, waiting: int = WAITING):
    """The exact counts of one bucket's phrases that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = added([_NO_ENTRIES])
        parts, size = [], 0
        totals: dict[str, int] = {}
        for rows in batches:
            for names, values in zip(rows.column("languages").to_pylist(), rows.column("totals").to_pylist(), strict=True):
                for name, value in zip(names, values, strict=True):
                    totals[name] = totals.get(name, 0) + value
            parts.append(entries_in(rows))
            size += parts[-1].nbytes
            # As much waits as is held, so that an entry is added up a few times only.
            if size >= max(waiting, sums.nbytes):
                sums = added([sums, *parts])
                parts, size = [], 0
        if parts:
            sums = added([sums, *parts])
        sums = sums.filter(pc.greater_equal(sums.column("f"), threshold))
        out: dict[str, list] = {name: [] for name in ("lang", "size", "phrase", "f")}
        for entry, f in zip(sums.column("entry").to_pylist(), sums.column("f").to_pylist(), strict=True):
            language, phrase = entry[:-1].split(b"\xff")
            for name, value in zip(out, (language.decode(), phrase.count(b" ") + 1, phrase.decode(), f), strict=True):
                out[name].append(value)
        keys = keys_of(out["phrase"], out["lang"], out["size"])
        n = len(totals)
        columns = [[*totals, *out["lang"]], [0] * n + out["size"], [""] * n + out["phrase"], [*totals.values(), *out["f"]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            + [pa.array(np.concatenate([np.zeros(n, dtype=np.uint64), keys]).view(np.int64))],
            names=["lang", "size", "phrase", "f", "key"],
        )

    return run


_NO_ENTRIES = pa.table({"entry": pa.array([], pa.large_binary()), "f": pa.array([], pa.int64())})


def entries_in(rows: pa.RecordBatch) -> pa.Table:
    """The phrases and counts of COUNTS rows, one by one."""
    data = np.frombuffer(b"".join(rows.column("phrases").to_pylist()), dtype=np.uint8)
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype="<u4")
    stops = np.flatnonzero(data == PHRASE_ENDS) + 1
    bounds = np.concatenate([[0], stops]).astype(np.int64)
    found = pa.Array.from_buffers(
        pa.large_binary(), len(stops), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    )
    return pa.table({"entry": found, "f": pa.array(counts.astype(np.int64))})


def added(parts: list[pa.Table]) -> pa.Table:
    """Each entry once, with the sum of its counts."""
    sums = pa.concat_tables(parts).group_by("entry", use_threads=False).aggregate([("f", "sum")])
    return sums.select(["entry", "f_sum"]).rename_columns(["entry", "f"])


def keys_of(phrases: list[str], languages: list[str], sizes: list[int]) -> np.ndarray:
    """The keys that grams_of gives these phrases."""
    if not phrases:
        return np.zeros(0, dtype=np.uint64)
    g = grams_of(pa.array(phrases), [x.encode() for x in languages])
    first = np.searchsorted(g.owner, np.arange(len(phrases)))
    out = np.zeros(len(phrases), dtype=np.uint64)
    for size in range(1, LONGEST + 1):
        own = np.flatnonzero(np.array(sizes) == size)
        out[own] = g.keys[size - 1][first[own]] if len(own) else 0
    return out


def counted(texts: DataFrame, pick, sizes: range, threshold: int, buckets: int, block: int, label: str) -> DataFrame:
    """SUMS of the picked phrases of texts(lang, text) that reach the threshold."""
    found = texts.mapInArrow(_counts(pick, sizes, buckets, block), COUNTS)
    return stored(found.groupBy("bucket").applyInArrow(_sums(threshold), SUMS), label, BATCH_ROWS)


def frequent_phrases(
    docs: DataFrame, frequent: int = FREQUENT, share: int = SHARE, proposed: int = PROPOSED,
    block: int = BLOCK, buckets: int | None = None,
) -> DataFrame:
    """(lang, size, phrase, f) of every phrase of docs(doc_id, text, lang) with f >= frequent, and
    with size 0 the number of words of each language."""
    if buckets is None:
        buckets = BUCKETS
    given = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(share)) == 0).alias("sampled"),
    )
    texts, sample = given.drop("sampled"), given.where("sampled").drop("sampled")
    found: DataFrame | None = None
    known = filter_of(texts.sparkSession.createDataFrame([], SUMS))
    for size in range(1, LONGEST + 1):
        flags = _first_of(known)
        level = counted(
            sample, flags, range(size, size + 1), proposed, max(buckets // share, 1), block, "phrases-sample"
        ).where("size > 0")
        found = level if found is None else found.unionByName(level)
        known = filter_of(found)
        if level.isEmpty():
            break
    first = counted(texts, _first_of(known), range(1, LONGEST + 1), frequent, buckets, block, "phrases-counted")
    # Words of all lengths are failures if the filter lacks them; the longest have nothing around.
    failures = first.where(f"size BETWEEN 1 AND {LONGEST - 1}").mapInArrow(_outside(known), SUMS)
    failed, words = filter_of(failures), filter_of(first.where("size = 1"))
    every = first
    if len(failed.bits):
        again = counted(
            texts, _again_of(known, failed, words), range(2, LONGEST + 1), frequent, buckets, block, "phrases-again"
        )
        every = first.unionByName(again.where("size > 0"))
    # Totals come in parts, one of each bucket that was first in a block.
    totals = every.where("size = 0").groupBy("lang", "size").agg(F.lit("").alias("phrase"), F.sum("f").alias("f"))
    return every.where("size > 0").select("lang", "size", "phrase", "f").unionByName(totals)


def _first_of(proposed: Filter):
    def pick(g: Grams) -> list[np.ndarray]:
        return counted_first(g, proposed)

    return pick


def _again_of(proposed: Filter, failed: Filter, words: Filter):
    def pick(g: Grams) -> list[np.ndarray]:
        return counted_again(g, proposed, failed, words)

    return pick


def _outside(known: Filter):
    """The rows whose key the filter does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = known.holds(batch.column("key").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(~held))

    return run


def collocations(
    counts: DataFrame, most: int, within: int, scale: int
) -> DataFrame:
    """The first `most` phrases of each language by score, from counts(lang, size, phrase, f).

    A phrase of two or more words is cut into two parts; the cut that scores lowest,
    floor(scale * a / (l + r)), counts. Phrases inside a longer one that has at least `within`
    percent of their occurrences are left out.
    """
    exact = "CAST({} AS DECIMAL(20, 0))"
    candidates = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    inner = (
        candidates.where("size >= 3")
        .select(
            "lang", "f",
            F.explode(F.expr(
                "flatten(transform(sequence(2, CAST(size AS INT) - 1), n -> transform("
                "sequence(1, CAST(size AS INT) - n + 1), i -> array_join(slice(words, i, n), ' '))))"
            )).alias("phrase"),
        )
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR {exact.format('longer')} * 100 < {exact.format('f')} * {within}"
    )
    parts = counts.where("size > 0")
    cuts = kept.select(
        "lang", "phrase", F.col("f").alias("a"),
        F.explode(F.expr(
            "transform(sequence(1, CAST(size AS INT) - 1), k -> struct(k AS k,"
            " array_join(slice(words, 1, k), ' ') AS head,"
            " array_join(slice(words, k + 1, CAST(size AS INT) - k), ' ') AS tail))"
        )).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    for part, name in (("head", "l"), ("tail", "r")):
        own = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = cuts.join(own, ["lang", part])
    scored = cuts.withColumn(
        "score", F.expr(f"({exact.format('a')} * {scale}) div ({exact.format('l')} + {exact.format('r')})")
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # Two steps, so that no task meets all phrases of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = lowest.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "share"], ["lang"]):
        window = Window.partitionBy(*keys).orderBy(*order)
        shares = shares.withColumn("rank", F.row_number().over(window).cast("long")).where(F.col("rank") <= most)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return shares.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
