"""Mixes sources to target weights by the cube method.

A source's rate is target / size. Every document is taken floor(rate) times; whether once more is a balanced sample with
inclusion probability frac(rate). Flight: three documents at a time have their probabilities moved along the vector that
leaves both totals (documents and words) as they are, until one is 0 or 1 and makes way for the next; large documents first,
so that what is left is small. Blocks of a source fly apart; the at most two undecided documents of each meet in the next
flight. Landing: at most two documents of a source are rounded, to the words nearest to balance, and what the rounding missed is
made up by documents kept back for the last flight.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import BLANK, stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents of one flight; about so many undecided ones of a source meet in the next.
BLOCK = 2000
#: Documents of a source that wait for its last flight, so that the landing has something to choose from.
RESERVE = 200


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    parts = F.split(text, BLANK)
    n = F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.coalesce(F.when(text.isNotNull(), n), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sizes(source, source_size) with target: weights by source order (null last), repeating, share the total of all sizes; a
    target above `most` times its size stops there and the rest shares the excess by weight, until none is above.

    With sources in order of cap / weight, the capped ones are a prefix: the first source whose cap exceeds its share of what
    the prefix before it leaves is the first uncapped one.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.lit(list(weights))
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    ranked = ranked.withColumn("at", F.row_number().over(by_ratio))
    chosen = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("at"))).over(everything)
    return ranked.withColumn("chosen", chosen).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("chosen"), F.col("cap"))).alias("target")
    )


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after the flight, at most two of them strictly between 0 and 1; documents and words in total unchanged.

    draw: a uniform number for each document, which picks one of the two directions of a move.
    """
    p = p.astype(float).copy()
    tiny = 1e-9
    hand: list[int] = []
    at = 0
    p_list, sizes, draws = p.tolist(), size.tolist(), draw.tolist()
    while True:
        while len(hand) < 3 and at < len(p_list):
            if tiny < p_list[at] < 1 - tiny:
                hand.append(at)
            at += 1
        if len(hand) < 3:
            break
        i, j, k = hand
        # the vector across (1, 1, 1) and the three sizes
        u = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = np.inf
        for x, s in zip(hand, u, strict=True):
            if s > 0:
                up, down = min(up, (1 - p_list[x]) / s), min(down, p_list[x] / s)
            elif s < 0:
                up, down = min(up, -p_list[x] / s), min(down, (p_list[x] - 1) / s)
        step = up if draws[i] * (up + down) < down else -down
        for x, s in zip(hand, u, strict=True):
            q = p_list[x] + step * s
            p_list[x] = 0.0 if q < tiny else 1.0 if q > 1 - tiny else q
        hand = [x for x in hand if tiny < p_list[x] < 1 - tiny]
        if len(hand) == 3:  # rounding kept all inside: settle the nearest
            x = min(hand, key=lambda x: min(p_list[x], 1 - p_list[x]))
            p_list[x] = float(round(p_list[x]))
            hand.remove(x)
    return np.array(p_list)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few undecided documents to the choice with words, then documents, nearest to their expectation."""
    out = np.where(p > 1 - 1e-9, 1.0, np.where(p < 1e-9, 0.0, p))
    at = np.flatnonzero((out > 0) & (out < 1))
    if not len(at):
        return out
    words, count = float((out[at] * size[at]).sum()), float(out[at].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(at)), key=lambda c: (abs(float((np.array(c) * size[at]).sum()) - words), abs(sum(c) - count), c))
    out[at] = best
    return out


def settle(x: np.ndarray, size: np.ndarray, words: float) -> np.ndarray:
    """Change single documents or pairs while that brings the words taken nearer to `words`; of equal choices the first counts."""
    x = x.copy()
    off = float((x * size).sum()) - words
    for _ in range(20):
        change = (1 - 2 * x) * size
        order = np.argsort(change, kind="stable")
        ranked = change[order]
        # each document alone, and with the partners whose change is nearest to what it leaves
        at = np.searchsorted(ranked, -off - change)
        choices = [(np.abs(off + change), np.full(len(x), -1))]
        for near in (at - 2, at - 1, at, at + 1):
            partner = order[np.clip(near, 0, len(x) - 1)]
            choices.append((np.where(partner == np.arange(len(x)), np.inf, np.abs(off + change + change[partner])), partner))
        left = np.stack([c for c, _ in choices])
        kind, i = np.unravel_index(np.argmin(left), left.shape)
        if left[kind, i] > abs(off) - 0.5:
            break
        j = choices[kind][1][i]
        for k in {int(i), int(j)} - {-1}:
            off += change[k]
            x[k] = 1 - x[k]
    return x


def _flight(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
        before, size = group["p"].to_numpy(), group["size"].to_numpy()
        p = fly(before, size, group["draw"].to_numpy())
        if last:
            by = np.argsort(group["draw"].to_numpy(), kind="stable")
            p[by] = settle(land(p, size)[by], size[by], float((before * size).sum()))
        return group.assign(p=p)

    return run


def _undecided() -> Column:
    return (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target, times for each row of docs(doc_id, source, text).

    times: how often the mix takes the document, 0 to `most`. Each source's words taken, repeats counted, differ from its target
    by a few words, unless one document outweighs those kept back for the last flight. Draws are hashes of seed, doc_id and text, so reruns agree. A null
    source is one of its own and last; a null text has no words; wordless documents weigh nothing and are taken at
    their source's rate. Rows equal in doc_id, source and text are drawn together and share what they get evenly, other rows with one
    doc_id and rows without are documents of their own. Texts of any length are counted whole. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(seed))
    table = stage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), key.alias("text_key")))  # texts are read once
    sizes = stage(table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    targets = source_targets(sizes.select("source", "source_size"), weights, most).join(sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    table = table.groupBy("doc_id", "source", "size", "text_key").agg(F.count("*").alias("copies"))
    table = table.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("copies")
    draw = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    table = table.withColumns({"sure": F.floor(rate + 1e-9).cast("long"), "draw": draw})
    table = table.withColumn("p", F.greatest(F.lit(0.0), rate - F.col("sure")))
    blocks = F.ceil(F.col("rows") / block)
    table = table.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed + 1)), blocks))
    done: list[DataFrame] = []
    columns = ["doc_id", "text_key", "size", "source", "source_size", "target", "rows", "copies", "sure", "draw", "p", "block"]
    schema = "doc_id long, text_key long, size long, source string, source_size long, target double, rows long, copies long, sure long, draw double, p double, block long"
    now = table.select(*columns)
    done.append(now.where(~_undecided()))
    now = now.where(_undecided())
    most_rows = sizes.agg(F.max("rows")).first()[0] or 0
    n = -(-most_rows // block)  # blocks of the largest source
    # documents kept back for the last flight: about RESERVE of each source, and those that hold over 1/RESERVE of its words
    late = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed + 2)), F.col("rows")) < RESERVE
    late = late | (F.col("size") * F.col("copies") * RESERVE > F.col("source_size"))
    kept_back, now = now.where(late), now.where(~late)
    while n > 1:
        flown = stage(now.groupBy("source", "block").applyInPandas(_flight(False), schema))
        done.append(flown.where(~_undecided()))
        now = flown.where(_undecided()).withColumn("block", F.floor(F.col("block") / (block // 2)))
        n = -(-n // (block // 2))
    now = now.unionByName(kept_back)
    done.append(now.groupBy("source").applyInPandas(_flight(True), schema))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    total = F.col("sure") + F.round("p").cast("long")
    out = out.withColumn("total", total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = F.floor(F.col("total") / F.col("copies")) + (F.col("copy") <= F.col("total") % F.col("copies")).cast("int")
    return out.select("doc_id", "text_key", "size", "source", "source_size", "target", own.cast("long").alias("times"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, source, text, ..) as often as `mix` takes them, all columns unchanged, whatever the other ones are
    called; null and empty texts, null ids and sources and repeated rows as there. An empty table gives no rows."""
    seed = options.get("seed", 7)
    times = mix(docs, **options).where("times > 0").groupBy(F.col("doc_id").alias("__mix_id"), F.col("text_key").alias("__mix_key"), F.col("source").alias("__mix_source"))
    times = times.agg(F.sum("times").alias("__mix_times"), F.count("*").alias("__mix_rows"))
    # rows equal in these columns share what was drawn for them
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(seed))
    keyed = docs.withColumn("__mix_text_key", key)
    taken = keyed.join(times, keyed["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & (keyed["__mix_text_key"] == F.col("__mix_key")) & keyed["source"].cast("string").eqNullSafe(F.col("__mix_source")))
    number = F.row_number().over(Window.partitionBy("__mix_id", "__mix_key", "__mix_source").orderBy(F.lit(0)))
    taken = taken.withColumn("__mix_number", number)
    own = F.floor(F.col("__mix_times") / F.col("__mix_rows")) + (F.col("__mix_number") <= F.col("__mix_times") % F.col("__mix_rows")).cast("int")
    taken = taken.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), own.cast("int"))))
    return taken.select(*(F.col(c) for c in docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
