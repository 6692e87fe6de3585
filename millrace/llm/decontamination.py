"""Benchmark passages in training texts, by spaced-seed hashing, in built-in functions only.

A seed is a fixed mask over a span of tokens; the tokens at its ignored places may differ. Every
place of every training text is hashed under each mask and looked up among the benchmark's
hashes under the same mask. Around a hit the two token sequences are laid side by side, up to
AROUND tokens on either side of the hit's first, and the overlap counts if enough of the tokens
are equal, so passages with a few substituted words are found. Items of WHOLE_BELOW to SPAN tokens
have three masks as long as they are, each ignoring another third of the places, so that any one
token may be substituted. Items of fewer tokens are looked up whole and exactly.

Tokens are words, lower case, without other characters than letters and digits; in scripts that
put no spaces between words each letter is a token.

The benchmark is the query side: its hashes, each with the tokens around, are dealt into blocks
of a bounded number of rows; each block is broadcast and meets all training rows, so that a
larger benchmark takes more passes and no more memory. Texts are never shuffled: tokens, hashes,
look-up and verification of a text happen in one stage, and only its hits leave it, summed by
text and item. A text is compared per place, so a passage in a third of all texts gives rows for
each hit and no pairs of texts.

Defined results: null or empty texts and items without tokens match nothing, nor does an item of
one token with fewer than LONG_TOKEN letters; of repeated rows
each is judged the same; a null doc_id or item_id is carried along; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the token at this place counts, 0: it is ignored. Fixed values of this library: spans of
#: twelve tokens of which eight count, no two alike and none ignoring the ends.
MASKS = ("111101010011", "110010111101", "101111001011")
SPAN = 12
#: Tokens on each side of a hit's first token that are compared.
AROUND = 30
#: An overlap stands with so many equal tokens, or with this share of a shorter item's.
LEAST_EQUAL, LEAST_SHARE = 13, 0.6
#: Items with fewer tokens are looked up whole and exactly.
WHOLE_BELOW = 6
#: Letters that the token of an item of one token has, at least; others are too common.
LONG_TOKEN = 10
#: Fixed value: letters of scripts without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Rows of the benchmark that one block holds, about; a block is broadcast.
BLOCK_ROWS = 50_000
#: Places of a text that go on together.
STRETCH = 512


def tokens(text: str = "text") -> Column:
    low = f"lower(coalesce(`{text}`, ''))"
    apart = f"if({low} rlike r'{UNSPACED}', regexp_replace({low}, r'({UNSPACED})', ' $1 '), {low})"
    return F.expr(f"filter(split({apart}, r'[^\\p{{L}}\\p{{N}}]+'), w -> w != '')")


def masked_hash(mask: str, array: str, place: str) -> Column:
    words = ", ".join(f"{array}[{place} + {k}]" for k, bit in enumerate(mask) if bit == "1")
    return F.expr(f"xxhash64({int(mask, 2)}, {len(mask)}, {words})")


def whole_masks(n: int) -> list[str]:
    """The masks of items of n tokens that cover them whole."""
    if n < WHOLE_BELOW:
        return ["1" * n]
    return ["".join("01"[(k + skipped) % 3 > 0] for k in range(n)) for skipped in range(3)]


def benchmark_rows(benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """(mask, hash, item_id, item_tokens, item_place, around), and the masks in use."""
    items = (
        benchmark.select("item_id", tokens().alias("item"))
        .withColumn("n", F.size("item"))
        .where(f"n > 1 OR (n = 1 AND length(item[0]) >= {LONG_TOKEN})")
        .distinct()
    )
    short = [r[0] for r in items.where(F.col("n") <= SPAN).select("n").distinct().collect()]
    whole = [mask for n in sorted(short) for mask in whole_masks(n)]
    masks = [*MASKS, *whole]
    placed = items.select(
        "item_id", "item", "n", F.posexplode(F.expr("sequence(0, n - 1)")).alias("_", "place")
    )
    rows = [
        placed.where(
            f"place + {SPAN} <= n" if mask in MASKS else f"n = {len(mask)} AND place = 0"
        ).select(
            masked_hash(mask, "item", "place").alias("hash"),
            "item_id",
            F.col("n").alias("item_tokens"),
            F.expr(f"least(place, {AROUND})").alias("item_place"),
            F.expr(f"slice(item, greatest(place - {AROUND}, 0) + 1, {2 * AROUND})").alias("around"),
        )
        for mask in masks
    ]
    return reduce(DataFrame.unionAll, rows), masks


def overlaps(docs: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item_tokens) of every text that holds a benchmark passage.

    docs(doc_id, text), benchmark(item_id, text). n_equal: equal tokens of the best overlap.
    """
    sought, masks = benchmark_rows(benchmark)
    sought = sought.withColumn("deal", F.xxhash64("hash", "item_id", "item_place", "around")).checkpoint()
    blocks = max(1, -(-sought.count() // block_rows))
    shortest = min(len(mask) for mask in masks)
    # Long texts go on in stretches, so that no row carries a whole one along.
    stretches = (
        docs.select("doc_id", tokens().alias("all"))
        .withColumn("n_all", F.size("all"))
        .where(F.col("n_all") >= shortest)
        .select("doc_id", "n_all", F.explode(F.expr(
            f"transform(sequence(0, (n_all - 1) div {STRETCH}), c -> struct("
            f" c * {STRETCH} AS begin, greatest(c * {STRETCH} - {AROUND}, 0) AS base,"
            f" slice(all, greatest(c * {STRETCH} - {AROUND}, 0) + 1,"
            f" least(c * {STRETCH}, {AROUND}) + {STRETCH} + {SPAN + 2 * AROUND}) AS words))"
        )).alias("s"))
        .select("doc_id", "s.words", F.expr("s.begin - s.base").alias("low"),
                F.expr(f"least(n_all - {shortest}, s.begin + {STRETCH} - 1) - s.base").alias("high"))
        .where("low <= high")
        .withColumn("n", F.size("words"))
    )
    placed = stretches.select(
        "doc_id", "words", "n", F.explode(F.sequence("low", "high")).alias("place")
    )
    hashed = placed.select(
        "doc_id", "words", "n", "place",
        F.explode(F.array(*[
            F.when(F.col("place") + len(mask) <= F.col("n"), masked_hash(mask, "words", "place"))
            for mask in masks
        ])).alias("hash"),
    )
    # Laid side by side: the benchmark's tokens around, and the text's from `shift` on.
    equal = F.expr(
        "size(filter(sequence(greatest(-shift, 0), size(around) - 1),"
        " k -> shift + k < n AND around[k] = get(words, shift + k)))"
    )
    found = []
    for block in range(blocks):
        own = sought.where(F.pmod("deal", F.lit(blocks)) == block).drop("deal")
        found.append(
            hashed.join(F.broadcast(own), "hash")
            .withColumn("shift", F.col("place") - F.col("item_place"))
            .select("doc_id", "item_id", "item_tokens", equal.alias("n_equal"))
        )
    enough = F.least(F.lit(LEAST_EQUAL), F.ceil(LEAST_SHARE * F.col("n_item_tokens")))
    # Judged after the grouping, so that the look-up stays within compiled code.
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_equal").alias("n_equal"), F.max("item_tokens").alias("n_item_tokens"))
        .where(F.col("n_equal") >= enough)
    )
