"""Quotas, samples and the assignment of seeds to training samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.operators.pairs import with_position

INTENSITIES = ("extreme", "high", "medium", "natural")


def scrambled(*cols: Column | str, seed: int = 0, modulus: int = 1_000_003) -> Column:
    """A fixed pseudo-random order of integers that any SQL engine can repeat."""
    mixed = F.lit(seed)
    for c in cols:
        mixed = mixed * 7919 + (F.col(c) if isinstance(c, str) else c) % modulus
        mixed = (mixed * 104_729 + 13) % modulus
    return mixed


def assign_intensity(df: DataFrame, shares: dict[str, float], order: str = "pos") -> DataFrame:
    """df with intensity: the first int(n * share) rows extreme, then high, medium, natural; the rest goes to the largest share. Counts and
    numbers the rows when it is called."""
    n = df.count()
    quota = {k: int(n * shares.get(k, 0.0)) for k in INTENSITIES}
    largest = max(INTENSITIES, key=lambda k: shares.get(k, 0.0))
    quota[largest] += n - sum(quota.values())
    rows, out, upto = with_position(df, order), F.lit(None).cast("string"), n
    for k in reversed(INTENSITIES):
        out = F.when(F.col("position") < upto, k).otherwise(out)
        upto -= quota[k]
    return rows.withColumn("intensity", out).drop("position")


#: Values of scrambled(), and how many counts a group has in one step of a search for its cut.
MODULUS, STEP = 1_000_003, 1_024


def with_cut(df: DataFrame, group: list[str], value: Column, quota: DataFrame, size: int = MODULUS) -> DataFrame:
    """quota(group columns, _quota) with _cut and _left: of a whole-number value from 0 to size - 1, the smallest that with all below it holds _quota rows
    of the group, and how many of the rows that have it are still needed.

    An order statistic by counting: each step counts the rows of a group in STEP ranges of value and goes on inside the one with the cut, so a step shuffles at most
    STEP counts of a group from each task, and no row is sorted or written."""
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    at = quota.select(*group, "_quota", F.lit(0).cast("long").alias("_cut"), F.col("_quota").cast("long").alias("_left"))
    rows = df.select(*group, value.cast("long").alias("_v"))
    width = STEP ** max(1, -(-(size - 1).bit_length() // (STEP - 1).bit_length()))
    while width > 1:
        width //= STEP
        inside = (F.col("r._v") >= F.col("a._cut")) & (F.col("r._v") < F.col("a._cut") + width * STEP)
        joined = rows.alias("r").join((at if group else F.broadcast(at)).alias("a"), _all([*same("r", "a"), inside]))  # without groups one row
        counts = joined.groupBy(*(F.col(f"a.{g}").alias(g) for g in group), "_quota", "_cut", "_left", F.floor((F.col("_v") - F.col("_cut")) / width).cast("long").alias("_b")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group, "_quota", "_cut", "_left").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = counts.withColumn("_before", before).where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
        at = here.select(*group, "_quota", (F.col("_cut") + F.col("_b") * width).alias("_cut"), (F.col("_left") - F.col("_before")).alias("_left"))
    return at


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def subsample(df: DataFrame, ratio: float, seed: int = 0, max_rows: int | None = None, group: list[str] | None = None, key: str = "pos") -> DataFrame:
    """Exactly max(1, int(n * ratio)) rows of each group without replacement (all if ratio >= 1), at most max_rows; by a scrambled order of a unique
    whole-number key. Rows are kept by a cut through that order, found by counting; only the rows on the cut itself (about one in MODULUS) are ranked."""
    group, own = group or [], scrambled(key, seed=seed)
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    quota = F.col("_n") if ratio >= 1 else F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    quota = F.least(quota, F.lit(max_rows)) if max_rows is not None else quota
    at = with_cut(df, group, own, counts.where("_n > 0").select(*group, quota.cast("long").alias("_quota")))
    at = at.select(*(F.col(g).alias(f"_g_{g}") for g in group), "_cut", "_left")
    rows = df.join(at if group else F.broadcast(at), _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])).withColumn("_v", own.cast("long"))  # without groups one row
    on = rows.where("_v = _cut").withColumn("_r", F.row_number().over(Window.partitionBy(*(f"_g_{g}" for g in group), "_cut").orderBy(key)))
    return rows.where("_v < _cut").select(*df.columns).unionByName(on.where("_r <= _left").select(*df.columns))


def hash_text(s: str, start: int = 7) -> int:
    out = start
    for b in s.encode():
        out = (out * 31 + b) % 1_000_003
    return out


def text_hash(text: Column) -> Column:
    """hash_text of a column, in the engine: over the bytes of its UTF-8 form."""
    digits = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.floor(F.length(digits) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(7).cast("long"), lambda h, i: (h * 31 + byte(i)) % MODULUS)


def _hash_numbers(prefix: str, numbers: np.ndarray) -> np.ndarray:
    """hash_text(prefix + str(i)) of each i >= 0."""
    out = np.full(len(numbers), hash_text(prefix), np.int64)
    for p in range(len(str(numbers.max(initial=0))) - 1, -1, -1):
        has = (numbers >= 10**p) | (p == 0)
        out = np.where(has, (out * 31 + 48 + numbers // 10**p % 10) % 1_000_003, out)
    return out


def _covered(ranked: DataFrame, samples: DataFrame, n: int, num_samples: int, quota: int, randomize: bool) -> DataFrame:
    """sample_idx, slot, rank: a seed per component, then by rank.

    A sample has at most `quota` seeds and a seed at most `wide` components, so it passes over fewer than quota * wide of them; of a
    component, at most quota seeds with at most `many` entries each are taken already. So many components and entries reach the
    sample's group, and the ranks that follow are computed from the chosen ones.
    """
    components = F.coalesce(F.when(F.size("target_components") > 0, F.col("target_components")), F.array(F.lit("_general")))
    size, distinct = F.size(components), F.size(F.array_distinct(components))
    wide, many = ranked.agg(F.max(distinct), F.max(size - distinct) + 1).first()
    entries = ranked.select("rank", F.posexplode(components).alias("_copy", "_c")).select("rank", F.struct(F.col("_c").alias("component"), "rank", "_copy").alias("_e"))
    entries = with_position(entries, "_e").select(F.col("_e.component").alias("component"), "rank", "position")
    bases = entries.groupBy("component").agg(F.min("position").alias("_base"), F.count("*").alias("_len"))

    order = text_hash(F.concat_ws("/", F.col("sample_idx").cast("string"), "component")) if randomize else F.lit(0).cast("long")
    turns = samples.crossJoin(bases).withColumn("_h", order)
    turns = turns.withColumn("_turn", F.row_number().over(Window.partitionBy("sample_idx").orderBy("_h", "component"))).where(F.col("_turn") <= quota * wide)
    steps = turns.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_len"), F.lit(quota * many)) - 1)))
    steps = steps.withColumn("position", F.col("_base") + (F.col("sample_idx") + F.col("_step")) % F.col("_len"))
    near = steps.join(entries.select("position", "rank"), "position").select("sample_idx", "_turn", "_step", "rank")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        sample, chosen = int(pdf["sample_idx"].iloc[0]), []
        for _, mine in pdf.sort_values(["_turn", "_step"]).groupby("_turn")["rank"]:
            if len(chosen) == quota:
                break
            chosen += [i for i in mine.tolist() if i not in chosen][:1]
        taken, free = sorted(chosen), n - len(chosen)
        for j in range(min(quota - len(chosen), free)):
            i = (sample * free // max(num_samples, 1) + j) % free
            for t in taken:
                i += t <= i
            chosen.append(i)
        return pd.DataFrame({"sample_idx": sample, "slot": range(len(chosen)), "rank": chosen}).astype("int64")

    return near.groupBy("sample_idx").applyInPandas(choose, "sample_idx long, slot long, rank long")


def _balanced(picked: DataFrame, ranked: DataFrame, keys: tuple[str, ...], num_samples: int, quota: int) -> DataFrame:
    """Swap up to two rows of a value that covers over half of the sample for unchosen seeds with another.

    Such a seed is among the first quota + 2 with another value in the sample's hash order. Each partition hands out the first of
    all and the first without the commonest value among those, which hold these for every value.
    """
    values, most = [f"_v{k}" for k in range(len(keys))], quota + 2
    kind = f"sample_idx long, _k int, _h long, rank long, pos long, {', '.join(f'{v} string' for v in values)}"

    def leading(rows: pd.DataFrame, value: str) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "rank"])
        first = rows.head(2 * most)
        if not len(first):
            return first
        others = rows[rows[value] != first[value].mode().iloc[0]].head(most)
        return pd.concat([first, others]).drop_duplicates("rank")

    def spare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], pd.DataFrame] = {}
        for batch in batches:
            for k, key in enumerate(keys):
                rows = batch[batch[values[k]].notna()]
                for sample in range(num_samples):
                    hashed = rows.assign(sample_idx=sample, _k=k, _h=_hash_numbers(f"{sample}/{key}/", rows["rank"].to_numpy(np.int64)))
                    best[sample, k] = leading(pd.concat([best[sample, k], hashed]) if (sample, k) in best else hashed, values[k])
        yield from (rows[["sample_idx", "_k", "_h", "rank", "pos", *values]] for rows in best.values())

    def swap(mine: pd.DataFrame, spares: pd.DataFrame) -> pd.DataFrame:
        chosen = mine.sort_values("slot")[["rank", "pos", *values]].to_dict("records")
        sample = mine["sample_idx"].iloc[0] if len(mine) else 0
        spares = spares.sort_values(["_h", "rank"])
        for k, key in enumerate(values):
            pool = spares[spares["_k"] == k].to_dict("records")
            for value in sorted({x[key] for x in chosen if x[key]}):
                at = [j for j, x in enumerate(chosen) if x[key] == value]
                if len(at) * 2 <= len(chosen):
                    continue
                taken = {x["rank"] for x in chosen}
                other = (x for x in pool if x["rank"] not in taken and x[key] != value)
                for j, x in zip(at[-2:], other):
                    chosen[j] = x
        return pd.DataFrame({"sample_idx": sample, "slot": range(len(chosen)), "pos": [x["pos"] for x in chosen]}).astype("int64")

    spares = ranked.select("rank", "pos", *values).mapInPandas(spare, kind)
    return picked.groupBy("sample_idx").cogroup(spares.groupBy("sample_idx")).applyInPandas(swap, "sample_idx long, slot long, pos long")


def assign_territory(seeds: DataFrame, num_samples: int, per_sample: int, ensure_coverage: bool = True, randomize: bool = True, balance: tuple[str, ...] = ()) -> DataFrame:
    """sample_idx, slot, pos: seeds of each sample, the same seed at most once a sample.

    First one seed per component (offset by the sample, the next free on a clash) up to the quota, then by quality order
    turned by sample * free // samples. balance: attribute keys of which no value should cover over half of a sample. Seeds are
    ranked by ranges, written when this is called; a sample's wanted ranks are computed and joined to them.
    """
    q = F.col("quality_score")
    last = q.isNull() | F.isnan(q)
    values = [F.try_element_at("attributes", F.lit(k)).alias(f"_v{i}") for i, k in enumerate(balance)]
    rows = seeds.select(F.struct(last.alias("last"), F.when(last, 0.0).otherwise(-q).alias("q"), "pos").alias("_o"), "pos", "target_components", *values)
    ranked = with_position(rows, "_o").drop("_o").withColumnRenamed("position", "rank")
    n = ranked.count()
    quota = min(per_sample, n)
    samples = seeds.sparkSession.range(num_samples).withColumnRenamed("id", "sample_idx")
    if ensure_coverage and quota > 0:
        picked = _covered(ranked, samples, n, num_samples, quota, randomize)
    else:
        slots = samples.crossJoin(seeds.sparkSession.range(quota).withColumnRenamed("id", "slot"))
        picked = slots.withColumn("rank", F.expr(f"(sample_idx * {n} div {max(num_samples, 1)} + slot) % {max(n, 1)}"))
    picked = picked.join(ranked.drop("target_components"), "rank")
    return _balanced(picked, ranked, balance, num_samples, quota) if balance else picked.select("sample_idx", "slot", "pos")
