"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard on full shingle sets.

Two permutations make every signature: the first shuffles the hashed shingle space, the second is read circularly shifted by
0, 1, .. K-1, so that the K values of one shingle are K neighbours in memory and a signature is a minimum over rows.
Texts with equal shingle sets are one class with a number of its own before any bucket is formed, so thousands of copies
cost one row. Bands of a signature are buckets. A bucket never lists all its pairs: first each member meets the bucket's
first class, its lead; then, with the components of the confirmed links known, members outside the bucket's largest component meet
the rest inside tasks, as their differences from what most members hold: what a template gives to all of them costs nothing, and only members that share
rare differences are compared. A bucket too large for a task is cut into parts; a member of the largest component is in
one part only, the others in all, in blocks of bounded size. Only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import Words, column, mix, packed, shingle_sets, slices, stage
from contrail.llm.components import components

#: 32 bands of 5 rows: a pair of similarity 0.8 is missed with probability 3e-6, one of 0.3 met with 0.07.
BANDS, ROWS = 32, 5
#: Size of the permuted space; both permutations are built from this seed in each worker.
SPACE, SEED = 1 << 20, 11
#: Members of a bucket, and shingles in their sets, of one part.
PART, SHINGLES = 1 << 16, 1 << 23

_tables: dict[str, np.ndarray] = {}


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    if "first" not in _tables:
        rng = np.random.default_rng(SEED)
        _tables["first"] = rng.permutation(SPACE).astype(np.int64)
        second = rng.permutation(SPACE).astype(np.int32)
        _tables["second"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: k - 1]]), k)
    return _tables["first"], _tables["second"]


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """K coordinates of a non-empty set of 64-bit shingle hashes."""
    first, second = _permutations(k)
    at = first[(shingles & np.uint64(SPACE - 1)).astype(np.int64)]
    out = None
    for i in range(0, len(at), 4096):
        low = second[at[i : i + 4096]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.zeros(parts.shape[:2], np.uint64)
    out += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(ROWS):
        out = mix(out ^ (parts[:, :, j] + np.uint64((j + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1)))
    return out.view(np.int64)


def _key(shingles: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist())


SKETCH = "doc_id long, t1 long, t2 long, n_shingles long, k1 long, k2 long, bands array<long>"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(Words(*packed(column(batch, "text")), lower=True), k)
            full = [s for s in sets if len(s)]
            rows = iter(_bands(np.stack([signature(s) for s in full])) if full else ())
            keys = [_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, c) for c in ("doc_id", "t1", "t2")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in keys], pa.int64()),
                    pa.array([x for _, x in keys], pa.int64()),
                    pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "t1", "t2", "n_shingles", "k1", "k2", "bands"],
            )

    return run


def _sets(k: int):
    """The full shingle sets of the texts that stand for a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(Words(*packed(column(batch, "text")), lower=True), k)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "members"])

    return run


MET = "a long, b long, linked boolean, diff array<long>"


def _meet(percent: int):
    """A bucket's lead a against a member b on full sets: linked or not, and all shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, i), (y, j) = ((s.values.to_numpy(), s.offsets.to_numpy()) for s in (column(batch, "left"), column(batch, "right")))
            linked, ends, diffs = [], [0], []
            for row in range(batch.num_rows):
                u, v = x[i[row] : i[row + 1]], y[j[row] : j[row + 1]]
                both = np.sort(np.concatenate([u, v]))
                twice = both[1:] == both[:-1]
                same = int(twice.sum())
                single = np.ones(len(both), bool)
                single[1:] &= ~twice
                single[:-1] &= ~twice
                linked.append(100 * same >= percent * (len(both) - same))
                diffs.append(both[single])
                ends.append(ends[-1] + len(diffs[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(diffs) if diffs else np.empty(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(linked, pa.bool_()), lists], ["a", "b", "linked", "diff"])

    return run


def recentred(diffs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sets as differences from the set that most of them agree on: shingles that over half of the differences hold change sides. As places of
    rows in one array (starts), with shingles numbered by how many sets differ in them, rarest first, and how many those are. Shingles in which none or one differs from all others don't
    matter for what two sets have in common and are left out of the numbers, but not of the sizes."""
    count, sizes = len(diffs), np.array([len(d) for d in diffs])
    tokens, at, counts = np.unique(np.concatenate(diffs) if count else np.empty(0, np.int64), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), sizes)
    flip = np.flatnonzero(2 * counts > count)
    number = np.full(len(tokens), -1)
    number[flip] = np.arange(len(flip))
    have = number[at] >= 0
    # a set lacks a flipped shingle from its differences: now it has one; fewer do than had it before
    rows, cols = [owner[~have]], [at[~have]]
    mine, which = owner[have], number[at[have]]
    order = np.argsort(which, kind="stable")
    mine, which = mine[order], which[order]
    step = max(1, (1 << 24) // max(count, 1))
    for lo in range(0, len(flip), step):
        part = slice(*np.searchsorted(which, [lo, lo + step]))
        without = np.ones((min(step, len(flip) - lo), count), bool)
        without[which[part] - lo, mine[part]] = False
        col, row = np.nonzero(without)
        rows.append(row)
        cols.append(flip[lo + col])
    lacking = np.bincount(np.concatenate(rows[1:]), minlength=count) if len(rows) > 1 else np.zeros(count, np.int64)
    size = sizes - np.bincount(owner[have], minlength=count) + lacking
    row, col = np.concatenate(rows), np.concatenate(cols)
    times = np.bincount(col, minlength=len(tokens))
    keep = times[col] > 1
    row, col = row[keep], col[keep]
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((np.arange(len(tokens)), times))] = np.arange(len(tokens))
    col = rank[col]
    order = np.lexsort((col, row))
    starts = np.searchsorted(row[order], np.arange(count + 1))
    return size, col[order], starts


def cross_links(component: np.ndarray, guest: np.ndarray, n: np.ndarray, diffs: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a link between a guest and another member of a bucket joins, as many as join what can be joined.

    Members are differences from one set, d of them; two have n + m - 2 * |x & y| = d + e - 2 * |differences in common|. So a pair links iff its differences in common are at
    least (g + h) / 2 with g = d - n * (100 - percent) / (100 + percent). All with g + the smallest g at most 0 link with the member that has it; every other must share
    differences with whom it links, and at least one of its rarest ones: only such pairs are counted out. Differences that most members share fall away beforehand, so a
    text common to a bucket costs nothing.
    """
    size, cols, starts = recentred(diffs)
    # twice the needed number, in units of 1 / (100 + percent), in whole numbers
    g = size * (100 + percent) - n * (100 - percent)
    names, home = np.unique(component, return_inverse=True)
    root = list(range(len(names)))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        x, y = find(home[i]), find(home[j])
        if x != y:
            root[x] = y
            out.append((int(component[i]), int(component[j])))

    first = int(np.argmin(g))
    for i in np.flatnonzero(g + g[first] <= 0).tolist():
        join(i, first)
    unit = 2 * (100 + percent)
    lengths = np.diff(starts)
    needed = -(-(g + g[first]) // unit)  # differences in common with anyone, at least
    short = np.where(needed > 0, np.clip(lengths - needed + 1, 0, None), lengths)
    # the rarest differences of each member, by difference
    place = np.arange(len(cols)) - np.repeat(starts[:-1], lengths)
    inside = place < np.repeat(short, lengths)
    token, who = cols[inside], np.repeat(np.arange(len(size)), lengths)[inside]
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    sets: dict[int, frozenset] = {}

    def differences(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(cols[starts[i] : starts[i + 1]].tolist())
        return sets[i]

    for i in np.flatnonzero(guest & (short > 0)).tolist():
        mine = cols[starts[i] : starts[i] + short[i]]
        low, high = np.searchsorted(token, mine), np.searchsorted(token, mine, "right")
        met = np.unique(np.concatenate([who[a:b] for a, b in zip(low.tolist(), high.tolist())]))
        met = met[(home[met] != home[i]) & (~guest[met] | (met < i))]
        for j in met.tolist():
            if find(home[i]) != find(home[j]) and unit * len(differences(i) & differences(j)) >= g[i] + g[j]:
                join(i, j)
    return out


def _cross(percent: int):
    """Rows of one bucket (or of a block and a part of a large one) lie together, sorted by band, lo, hi."""
    names = ["band", "lo", "hi", "id", "component", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            _, _, _, ids, component, n = (np.concatenate([h[0][c] for h in held]) for c in names)
            guests = np.unique(ids[np.concatenate([h[2] for h in held])])
            diffs = [d for h in held for d in h[1]]
            held.clear()
            one = np.unique(ids, return_index=True)[1]  # a member may lie in a cell as guest and host
            ids, component, n, diffs = ids[one], component[one], n[one], [diffs[i] for i in one.tolist()]
            guest = np.isin(ids, guests)
            found = cross_links(component, guest, n, diffs, percent) if guest.any() and len(np.unique(component)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: column(batch, c).to_numpy() for c in names}
            lists, guests = column(batch, "diff"), column(batch, "guest").to_numpy(zero_copy_only=False)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            keys = np.stack([cols[c] for c in names[:3]], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a].tolist())
                if last is not None and key != last:
                    yield close()
                last = key
                held.append(({c: x[a:b] for c, x in cols.items()}, [values[ends[i] : ends[i + 1]] for i in range(a, b)], guests[a:b]))
        if held:
            yield close()

    return run


def _text_hashes(text: Column) -> dict[str, Column]:
    """128 bits that identify a text (null: empty)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def _components(docs: DataFrame, k: int, percent: int, part: int) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id, chosen for each row of docs; chosen: its id and text stand for the component."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(_text_hashes(F.col("text")))
    sketch = stage(docs.mapInArrow(_sketch(k), SKETCH))
    usable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    classes = stage(classes.select("k1", "k2", "least.*", "bands", "n", F.monotonically_increasing_id().alias("id")))
    banded = classes.select("id", "n", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("top")).where("lead.id <> top")
    met = stage(banded.join(full.select("band", F.col("lead.id").alias("lead")), "band"))
    ids = met.select("id").distinct().join(classes.select("id", "doc_id", "t1", "t2"), "id")
    texts = docs.join(ids, ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"])
    sets = stage(texts.select("id", "text").mapInArrow(_sets(k), "id long, members array<long>"))
    first = met.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    first = first.join(sets.select(F.col("id").alias("a"), F.col("members").alias("left")), "a")
    first = first.join(sets.select(F.col("id").alias("b"), F.col("members").alias("right")), "b")
    first = stage(first.select("a", "b", "left", "right").mapInArrow(_meet(percent), MET))
    label = components(first.where("linked").select("a", "b")).withColumnRenamed("node", "id")
    # buckets that still hold several components
    named = met.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    open_ = sizes.groupBy("band").agg(F.count("*").alias("several"), F.max_by("component", "c").alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max("c").alias("most"), F.max_by("w", "c").alias("main_w"))
    cut = lambda c, w: F.ceil(F.greatest(c / part, w / SHINGLES)).cast("int")
    open_ = open_.where("several > 1").select("band", "main", cut(F.col("c"), F.col("w")).alias("parts"), cut(F.col("c") - F.col("most"), F.col("w") - F.col("main_w")).alias("blocks"))
    rows = named.join(open_, "band").join(first.select(F.col("a").alias("lead"), F.col("b").alias("id"), "diff"), ["lead", "id"], "left")
    own, block = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    cell = lambda lo, hi, guest: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(guest).alias("guest"))
    member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: cell(i, own, False))
    guest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: cell(block, i, True))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("component") == F.col("main"), member).otherwise(F.concat(member, guest))))
    rows = rows.select("band", "cell.*", "id", "component", "n", F.coalesce("diff", F.array().cast("array<long>")).alias("diff"))
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    joined = components(rows.mapInArrow(_cross(percent), "a long, b long").distinct()).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    label = stage(label.join(joined, "component", "left").select("id", F.coalesce("wider", "component").alias("component")).unionByName(joined.select(F.col("component").alias("id"), F.col("wider").alias("component"))).distinct())
    linked = stage(classes.join(label, "id").select("k1", "k2", "component", F.struct("doc_id", "t1", "t2").alias("least")))
    least = linked.groupBy("component").agg(F.min("least").alias("least"))
    linked = stage(linked.drop("least").join(least, "component").select("k1", "k2", "least"))
    alone = classes.join(linked, ["k1", "k2"], "left_anti").select("k1", "k2", F.struct("doc_id", "t1", "t2").alias("least"))
    out = sketch.drop("bands").join(stage(linked.unionByName(alone)), ["k1", "k2"], "left")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id", "t1", "t2", "n_shingles", F.when(known, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(known, F.col("least") == F.struct("doc_id", "t1", "t2")).otherwise(True).alias("chosen"),
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set is a text's distinct k-word shingles (fewer words: the
    whole sequence as one). Documents link if 100 * intersection >= percent * union; component_id is the smallest
    doc_id reachable and kept marks it. Null or wordless texts have an empty set, link with nothing and are kept. Rows
    with equal sets are linked. A null doc_id links with nothing: component_id null, kept. Rows that repeat a doc_id with
    other texts are documents of their own: each gets the component of its text. Texts of any length are read whole.
    Empty tables give no rows; other columns are ignored, whatever their names.
    """
    return _components(docs, k, percent, part).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group of near-duplicates, all columns unchanged: of a group the row with the smallest
    doc_id (of rows that share it, one text) stays, of rows equal in doc_id and text one. Null or wordless texts are no copies of one
    another; rows with a null doc_id all stay. An empty table gives no rows."""
    chosen = _components(docs, k, percent, PART).where("chosen and doc_id is not null").select(*(F.col(c).alias(f"__near_{c}") for c in ("doc_id", "t1", "t2"))).distinct()
    keys = ["__near_doc_id", "__near_t1", "__near_t2"]
    hashes = _text_hashes(F.col("text"))
    keyed = docs.withColumns({"__near_doc_id": F.col("doc_id").cast("long"), "__near_t1": hashes["t1"], "__near_t2": hashes["t2"]})
    known = keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).select(*(F.col(c) for c in docs.columns))
    return known.unionByName(docs.where("doc_id is null"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)


#: Every pair that shares a shingle, exactly; then the components by a recursive walk over the links.
OP10_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 2 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
ids as (select g, row_number() over () as id from (select g from grams group by g having count(*) > 1)),
short as (select doc_id, id from grams join ids using (g)),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as same from short x join short y on x.id = y.id and x.doc_id < y.doc_id group by all),
links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * same >= 80 * (p.n + q.n - same)),
both_ways as (select a, b from links union select b, a from links),
walk as (
  select doc_id as node, doc_id as seen from words
  union
  select walk.node, both_ways.b from walk join both_ways on walk.seen = both_ways.a),
labels as (select node, min(seen) as component_id from walk group by node)
select words.doc_id, coalesce(n, 0) as n_shingles, component_id, words.doc_id = component_id as kept
from words left join sizes using (doc_id) join labels on labels.node = words.doc_id
"""
