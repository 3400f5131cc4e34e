"""Mixing sources to target weights by hash thresholds.

Each document has a hash that never changes. A source's budget of tokens is met by taking every
document as often as the budget allows in whole, and once more those whose hash lies below a threshold. The
threshold comes from a histogram of tokens by source and hash bucket; only the bucket in which the budget
runs out is refined, with a finer histogram of that bucket alone, until one document is left in it.
A larger budget raises the threshold, so smaller mixes are contained in larger ones. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import durable

BITS, STEP = 60, 12


def document_hash():
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 64 - BITS)


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, tuple[int, float]]]:
    """(total tokens, source -> (whole repeats, tokens beyond them)) of the largest mix in which every
    source has its share and no document is used more than its source's limit."""
    live = {s: (w, r) for s, (w, r) in targets.items() if w > 0}
    if not live or any(tokens.get(s, 0) == 0 or r < 1 for s, (w, r) in live.items()):
        return 0.0, {}
    total = min(r * tokens[s] / w for s, (w, r) in live.items())
    out = {}
    for s, (w, r) in live.items():
        budget = min(total * w, float(r * tokens[s]))
        whole = min(r, int(budget // tokens[s] + 1e-12))
        out[s] = (whole, 0.0 if whole == r else budget - whole * tokens[s])
    return total, out


def thresholds(docs: DataFrame, room: dict[str, float]) -> dict[str, int]:
    """Per source the hash below which documents are taken: the most whose tokens stay within its room."""
    spark = docs.sparkSession
    state = {s: (0, r) for s, r in room.items() if r > 0}  # threshold so far, room left
    found = {s: 0 for s in room}
    for level in range(BITS // STEP):
        if not state:
            break
        shift = BITS - STEP * (level + 1)
        at = spark.createDataFrame([(s, low, low + (1 << (shift + STEP)), left) for s, (low, left) in state.items()], "source string, low bigint, high bigint, room double")
        near = docs.join(F.broadcast(at), "source").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
        hist = near.groupBy("source", "low", "room", F.shiftright(F.col("h") - F.col("low"), shift).alias("b")).agg(F.sum("n_tokens").alias("t"))
        run = Window.partitionBy("source").orderBy("b")  # at most 2^STEP buckets a source
        over = hist.withColumn("upto", F.sum("t").over(run)).where("upto > room").groupBy("source").agg(F.min_by(F.struct("b", "t", "upto", "low", "room"), "b").alias("x"))
        edge = {r["source"]: r["x"] for r in over.collect()}  # one row a source
        for s in list(state):
            if s not in edge:  # all that is left here fits
                low, _ = state.pop(s)
                found[s] = low + (1 << (shift + STEP))
                continue
            x = edge[s]
            low = x["low"] + (x["b"] << shift)
            found[s] = low
            state[s] = (low, x["room"] - (x["upto"] - x["t"]))
            if level + 1 == BITS // STEP:
                state.pop(s)
    return found


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents in the mix, for docs with doc_id, source and n_tokens.

    The mix is the largest that reaches every target share exactly within one document a source; documents of
    sources without a target, and texts without tokens, are not in it. If a source with a target has no
    tokens no mix can reach the shares and the result is empty. targets is a fixed small table.
    """
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null").collect()}
    spark = docs.sparkSession
    listed = spark.createDataFrame([(s,) for s in want], "source string")
    # repeated rows of one doc_id are one document
    own = durable(docs.where("n_tokens > 0").join(F.broadcast(listed), "source").groupBy("doc_id").agg(F.first("source").alias("source"), F.max("n_tokens").alias("n_tokens")).withColumn("h", document_hash()))
    tokens = {r["source"]: int(r["t"]) for r in own.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    _, plan = budgets(tokens, want)
    cut = thresholds(own, {s: rest for s, (_, rest) in plan.items()})
    rows = [(s, whole, cut.get(s, 0)) for s, (whole, _) in plan.items()]
    rule = spark.createDataFrame(rows, "source string, whole bigint, below bigint")
    return (
        own.join(F.broadcast(rule), "source")
        .withColumn("repeats", F.col("whole") + (F.col("h") < F.col("below")).cast("bigint"))
        .where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    )


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the target list: documents, tokens with repeats, the share reached, and the most repeats."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"),
    )
    return (
        targets.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row per source
        .select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"))
    )
