"""Mixing sources to target weights along a time-varying curriculum.

Sizes are tokens of a public tokenizer. Each source has a weight schedule over training time t in [0, 1] whose integral
is its share; the cumulative token demand of the schedule is inverted in closed form, so that every document occurrence
gets the training position at which its source has demanded the tokens before it. Occurrences are then sorted by range.

The total is the largest at which every source that has documents holds its target share within its repeats, or a given
number of tokens; then sources that run out are held at their cap and the rest is filled by the others in proportion.

Defined results: null and empty texts have no tokens and don't occur; documents of null or unlisted sources don't occur;
the share of a listed source without documents goes to the others in proportion, as the report shows; equal documents are
occurrences of their own; of the last document of a source at least half lies within its demand.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TILT = 0.5  # how much a source's weight changes from the middle to the end of training
ROWS_A_BUCKET = 5000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source and tokens of every document with text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer, "rb"))}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, tokens long").where("tokens > 0")


def plan(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens each source contributes."""
    live = {s: share for s, (share, _) in targets.items() if share > 0 and supply.get(s, 0) > 0}
    cap = {s: supply[s] * max(1, targets[s][1]) for s in live}
    norm = sum(live.values())
    if not live:
        return {}
    shares = {s: v / norm for s, v in live.items()}
    if total is None:
        return (lambda t: {s: t * v for s, v in shares.items()})(min(cap[s] / v for s, v in shares.items()))
    out: dict[str, float] = {}
    left, free = float(total), dict(shares)
    while free:
        norm = sum(free.values())
        full = [s for s, v in free.items() if left * v / norm >= cap[s]]
        if not full:
            return out | {s: left * v / norm for s, v in free.items()}
        for s in full:
            out[s] = float(cap[s])
            left -= cap[s]
            free.pop(s)
    return out


def slopes(shares: dict[str, float], repeats: dict[str, int], tilt: float = TILT) -> dict[str, float]:
    """Change of each source's weight over time: sources that may be repeated gain weight, the others lose it; the sum stays."""
    late = {s: 1.0 if repeats[s] > 1 else 0.0 for s in shares}
    mean = sum(shares[s] * late[s] for s in shares)
    return {s: tilt * (late[s] - mean) for s in shares}


def position(x: Column, demand: Column, slope: Column) -> Column:
    """Time at which a source with weight proportional to 1 + slope (2t - 1) has demanded x tokens of all its demand."""
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / demand))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q)
    return F.when(F.abs(slope) < 1e-9, q).otherwise((root - (1 - slope)) / (2 * slope))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, seed: int = 11) -> DataFrame:
    """doc_id, source, epoch, tokens and at_token (training position in tokens) of every occurrence, in training order."""
    spark = documents.sparkSession
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 1)) for r in targets.collect() if r["source"] is not None}
    sizes = written(token_counts(documents, tokenizer), "tokens")
    found = sizes.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).join(targets.select("source").distinct(), "source", "left_semi").collect()
    supply, rows = {r["source"]: r["n"] for r in found}, {r["source"]: r["rows"] for r in found}  # one row a listed source
    tokens = plan(supply, wanted, total)
    every = sum(tokens.values())
    tilt = slopes({s: t / every for s, t in tokens.items()}, {s: wanted[s][1] for s in tokens}) if every else {}
    terms = spark.createDataFrame(
        [(s, float(t), float(tilt[s]), int(-(-t // supply[s])), max(1, rows[s] // ROWS_A_BUCKET)) for s, t in tokens.items()] or [("", 0.0, 0.0, 0, 1)],
        "source string, demand double, slope double, epochs int, buckets int",
    )
    many = sizes.join(terms, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs"), F.lit(1)) - 1)))
    key = F.xxhash64("doc_id", "epoch", F.lit(seed))
    many = many.withColumns({"key": key}).withColumn("bucket", F.floor((F.shiftright(F.col("key"), 16) / F.lit(2.0**47) + 1) / 2 * F.col("buckets")).cast("int"))
    sums = many.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("n"))
    whole = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(whole), F.lit(0))).drop("n")
    inner = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = many.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(starts, ["source", "epoch", "bucket"])
    offset = F.col("start") + F.col("inner")
    kept = placed.where(offset + F.col("tokens") / 2 <= F.col("demand"))
    at = F.floor(position(offset.cast("double"), F.col("demand"), F.col("slope")) * F.lit(float(every))).alias("at_token")
    return kept.select("doc_id", "source", "epoch", "tokens", at).orderBy("at_token", "doc_id", "epoch")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, share reached and repeats used of every listed source."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("occurrences"), (F.max("epoch") + 1).alias("repeats"))
    every = Window.partitionBy()
    joined = targets.join(got, "source", "left").fillna(0, ["tokens", "occurrences", "repeats"])
    return joined.select("source", "target_share", "max_repeats", "tokens", "occurrences", "repeats", F.round(F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)), 6).alias("share"))
