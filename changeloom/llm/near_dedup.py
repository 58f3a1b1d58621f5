"""MinHash near-deduplication by a multi-index Hamming join, confirmed on full shingle sets.

A document's set is its distinct five-word shingles; its signature is ``SYMBOLS`` minima cut to 16 bits each, in
``CHUNKS`` chunks of ``WIDTH``. If two signatures differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols, some chunk
differs in at most ``ERRORS`` (pigeonhole). So each chunk is indexed under every choice of ``WIDTH - ERRORS`` of its
symbols, and each pair within that distance meets under some key. With 30 symbols the bound is 17, where a pair at
similarity 0.75 expects 7.5 and passes 17 with a chance below 0.0001.

Documents with equal sets are one class first. Then, over the classes:

1. every class is compared with the first class of each of its buckets; confirmed links give components;
2. in buckets that hold several components, every class is compared with the one that meets most others, the likely
   centre of a group of near copies;
3. buckets that still hold several components are compared inside, across components only. Pairs within the bound on
   the indexed symbols, and within ``LONG_DISTANCE`` on all ``SYMBOLS + MORE``, are confirmed there on full sets. At
   similarity 0.75 a pair expects 32 of 128 to differ, and passes 57 with a chance below 0.000001.

A bucket of over ``BLOCK`` classes, such as texts that share a passage but little else, is refined first: two sets of
similarity 0.75 share one of the rarest quarter of either's shingles, so its classes meet by those shingles instead.
Groups that are still larger are compared in blocks, each of one large component or of small ones, and no component
with itself. No link between different components is left out, and large groups of near copies cost a few comparisons
a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, bounded_broadcast, filled, map_batches, materialise, partitions, slices, split_mix
from .components import FILE_LINKS, connected_components
from .wordhash import SPACED, distinct_by_row, shingles, words_of

SHINGLE, SIMILARITY = 5, (75, 100)
SYMBOLS, CHUNKS, WIDTH, ERRORS = 30, 6, 5, 2
MASKS = list(combinations(range(WIDTH), WIDTH - ERRORS))
#: Signatures may differ in so many symbols.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Symbols of 8 bits that are compared but not indexed, and how many of all may differ.
MORE, LONG_DISTANCE = 98, 57
#: Members of a bucket that one task compares with each other.
BLOCK = 1024

_SEEDS = split_mix(np.arange(1, 2 * (SYMBOLS + MORE) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLIERS, _SHIFTS = _SEEDS[: SYMBOLS + MORE] | np.uint64(1), _SEEDS[SYMBOLS + MORE :]


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of ``SYMBOLS`` hash functions over each row's set, their low 16 bits; rows must not be empty."""
    out = np.empty((len(first) - 1, SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        x = (values ^ _SHIFTS[k]) * _MULTIPLIERS[k]
        x ^= x >> np.uint64(29)
        out[:, k] = (np.minimum.reduceat(x * _MULTIPLIERS[SYMBOLS - 1 - k], first[:-1]) >> np.uint64(40)).astype(np.uint16)
    return out


def more_symbols(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``MORE`` further minima, 8 bits each."""
    out = np.empty((len(first) - 1, MORE), np.uint8)
    for k in range(MORE):
        least = np.minimum.reduceat((values ^ _SHIFTS[SYMBOLS + k]) * _MULTIPLIERS[SYMBOLS + k], first[:-1])
        out[:, k] = split_mix(least).astype(np.uint8)
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """The 64-bit keys of each signature: a chunk and a choice of its symbols in the upper bits, the symbols below."""
    keys = np.empty((len(sig), CHUNKS * len(MASKS)), np.int64)
    for c in range(CHUNKS):
        for m, mask in enumerate(MASKS):
            key = np.full(len(sig), c * len(MASKS) + m, np.uint64)
            for s in mask:
                key = (key << np.uint64(16)) | sig[:, c * WIDTH + s]
            keys[:, c * len(MASKS) + m] = key.view(np.int64)
    return keys


#: For the equal symbols of a chunk, as bits: the first mask that they cover, or -1.
_FIRST_MASK = np.array([next((m for m, mask in enumerate(MASKS) if all(bits >> s & 1 for s in mask)), -1) for bits in range(1 << WIDTH)])


def first_shared_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which key is the first that two signatures share, so that a pair is given in one bucket only; -1 for none."""
    bits = ((a == b).reshape(len(a), CHUNKS, WIDTH) << np.arange(WIDTH)).sum(2)
    mask = _FIRST_MASK[bits]
    chunk = (mask >= 0).argmax(1)
    found = mask[np.arange(len(a)), chunk]
    return np.where(found >= 0, chunk * len(MASKS) + found, -1)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_row(*shingles(words_of(texts, SPACED), SHINGLE))


def _set_hash(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash of each row's set, 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(split_mix(values ^ _SHIFTS[k]), dtype=np.uint64)])
    return np.where(np.diff(first) > 0, split_mix(sums[first[1:]] - sums[first[:-1]]), np.uint64(0))


def _describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (a 128-bit hash of the set) and ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts):
                values, first = _sets(texts.slice(a, b - a))
                n = np.diff(first)
                full = np.flatnonzero(n)
                sig = np.zeros((len(n), 2 * SYMBOLS + MORE), np.uint8)
                sums = [_set_hash(values, first, k) for k in range(2)]
                if len(full):
                    starts = np.append(first[:-1][full], first[-1])
                    sig[full, : 2 * SYMBOLS] = signatures(values, starts).view(np.uint8)
                    sig[full, 2 * SYMBOLS :] = more_symbols(values, starts)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SYMBOLS + MORE), len(n), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), binary], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return map_batches(docs, run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def _signature_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indexed symbols and the others."""
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * SYMBOLS + MORE)
    return np.ascontiguousarray(both[:, : 2 * SYMBOLS]).view(np.uint16), both[:, 2 * SYMBOLS :]


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                keys = bucket_keys(_signature_arrays(part.column("sig"))[0])
                ids = np.repeat(part.column("id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return map_batches(classes.select("id", "sig"), run, "key long, id long")


def _shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """``id, set_a, items``: the full sets of the classes in ``ids``, from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column("text"))
            for a, b in slices(texts):
                values, first = _sets(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(_set_hash(values, first, 0).view(np.int64)), lists], ["id", "set_a", "items"])

    wanted = docs.join(bounded_broadcast(ids.withColumnRenamed("id", "doc_id"), n_ids), "doc_id", "left_semi")
    return map_batches(wanted, run, "id long, set_a long, items array<long>")


def _confirmed(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    pairs = scratch.write(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = scratch.write(ids.coalesce(-(-2 * pairs.count() // FILE_LINKS) or 1), "pair-ids")
    sets = scratch.write(_shingle_sets(docs, ids, ids.count()).select("id", "items"), "pair-sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - common
    links = scratch.write(both.filter(common * SIMILARITY[1] >= union * SIMILARITY[0]).select("a", "b"), "links")
    scratch.drop("pairs", "pair-ids", "pair-sets")
    return links


def _of_similar_size(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity."""
    size = lambda end: sets.select(F.col("id").alias(end), F.col("n_shingles").alias(f"n_{end}"))
    both = pairs.join(size("a"), "a").join(size("b"), "b")
    return both.filter(F.least("n_a", "n_b") * SIMILARITY[1] >= F.greatest("n_a", "n_b") * SIMILARITY[0]).select("a", "b").distinct()


def _mixed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (key, id, component, n) of the buckets that hold several components; n: their size."""
    own = buckets.select("key", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    return own.join(mixed.select("key", "n"), "key")


def _central_stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class of a mixed bucket and the class there that meets most others in all its buckets."""
    degree = rows.groupBy("id").agg(F.sum("n").alias("degree"))
    centre = rows.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"), "component")).alias("c"))
    both = rows.join(centre, "key").filter("component != c.component").select(F.col("id").alias("x"), (-F.col("c.id")).alias("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _near_pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a (key, block, block) group: of different components and similar size, within the signature
    bounds, and (for the keys of whole buckets) not in an earlier bucket too."""
    ordinal, i, j = (int(group.column(c)[0].as_py()) for c in ("ordinal", "i", "j"))
    ids, comp, size, block = (group.column(c).to_numpy() for c in ("id", "component", "n_shingles", "own"))
    sig, more = _signature_arrays(group.column("sig"))
    step = max(1, (1 << 20) // max(1, len(ids)))
    for s in range(0, len(ids), step):
        x = slice(s, s + step)
        ok = (ids[x, None] < ids[None, :]) & (comp[x, None] != comp[None, :])
        ok &= np.minimum(size[x, None], size[None, :]) * SIMILARITY[1] >= np.maximum(size[x, None], size[None, :]) * SIMILARITY[0]
        if i != j:
            ok &= block[x, None] != block[None, :]
        p, q = np.nonzero(ok)
        for t in range(0, len(p), 1 << 18):
            a, b = p[t : t + (1 << 18)] + s, q[t : t + (1 << 18)]
            differ = (sig[a] != sig[b]).sum(1)
            near = differ <= DISTANCE
            a, b, differ = a[near], b[near], differ[near]
            near = differ + (more[a] != more[b]).sum(1) <= LONG_DISTANCE
            a, b = a[near], b[near]
            if len(a):
                mine = first_shared_key(sig[a], sig[b]) == ordinal if ordinal >= 0 else slice(None)
                yield a[mine], b[mine]


def _by_rare_shingles(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes of large mixed buckets by each of the rarest quarter of their shingles, as mixed buckets (key, id, component, n).

    Two sets of which one has n shingles and that share 75 % of the union share 0.75 n of them at least, so in any one
    order of all shingles each has one that both hold among its first n / 4 + 1. Rare ones come first, so what many texts
    have in common brings nobody together.
    """
    ids = scratch.write(rows.select("id", "component").distinct(), "large-ids")
    found = scratch.write(_shingle_sets(docs, ids.select("id").distinct(), ids.count()).select("id", "set_a", F.explode("items").alias("key")), "large-shingles")
    number = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "key")))
    own = found.join(number, "key").groupBy("id", "set_a").agg(ordered.alias("o"))
    quarter = F.floor(F.size("o") * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1]).cast("int") + 1
    rare = own.select("id", F.explode(F.slice("o", 1, quarter)).alias("s")).filter("s.n > 1")
    buckets = scratch.write(rare.select(F.col("s.key").alias("key"), "id"), "rare")
    return scratch.write(_mixed(buckets, ids), "rare-mixed")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, id, component, n, ordinal) with the pairs of blocks (i, j) that each belongs to, and its ``own`` block.

    A group of up to ``BLOCK`` classes is one block. In a larger one, a component of ``BLOCK`` classes or more has blocks
    of its own, which meet the blocks of others only; the smaller components share blocks.
    """
    small = rows.filter(F.col("n") <= BLOCK).select("key", "ordinal", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "id", "component")
    large = rows.filter(F.col("n") > BLOCK)
    sizes = large.groupBy("key", "ordinal", "component").agg(F.count(F.lit(1)).alias("m"))
    whose = F.when(F.col("m") >= BLOCK, F.col("component"))  # NULL: the smaller ones together
    sizes = sizes.groupBy("key", "ordinal", whose.alias("whose")).agg(F.sum("m").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    plan = sizes.groupBy("key", "ordinal").agg(F.array_sort(F.collect_list(F.struct("whose", "blocks"))).alias("plan"))
    # blocks are numbered through the plan; each of its entries starts where those before it end
    starts = F.transform("plan", lambda x, k: F.struct(x.whose.alias("whose"), x.blocks.alias("blocks"), F.aggregate(F.slice("plan", 1, k), F.lit(0), lambda a, y: a + y.blocks).alias("start")))
    plan = plan.withColumn("plan", starts)
    both = large.join(plan, ["key", "ordinal"])
    first = lambda test: F.get(F.filter("plan", test), F.lit(0))
    mine = F.coalesce(first(lambda x: x.whose == F.col("component")), first(lambda x: x.whose.isNull()))
    both = both.withColumn("mine", mine).withColumn("own", F.col("mine.start") + F.pmod(F.xxhash64("id"), F.col("mine.blocks")).cast("int"))
    every = F.flatten(F.transform(F.filter("plan", lambda x: x.whose.isNull() | ~x.whose.eqNullSafe(F.col("mine.whose"))), lambda x: F.sequence(x.start, x.start + x.blocks - 1)))
    both = both.withColumn("other", F.explode(every))
    both = both.select("key", "ordinal", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    return small.unionByName(both)


def _linked_across(docs: DataFrame, rows: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components: pairs of a mixed bucket within the signature bounds, confirmed on full sets.

    Groups are two blocks at most. Only classes that have such a pair get their full sets, a row for each group; pairs
    are confirmed inside the group, so their number is never a number of rows.
    """
    ordinal = F.shiftrightunsigned("key", 16 * (WIDTH - ERRORS)).cast("int")
    groups = rows.filter(F.col("n") <= BLOCK).withColumn("ordinal", ordinal)
    large = rows.filter(F.col("n") > BLOCK)
    if not large.isEmpty():
        groups = groups.unionByName(_by_rare_shingles(docs, large, scratch).withColumn("ordinal", F.lit(-1)))
    rows = _in_blocks(groups).join(sets.select("id", "set_a", "n_shingles", "sig"), "id")
    rows = rows.select("key", "ordinal", "i", "j", "own", "id", "set_a", "component", "n_shingles", "sig")
    schema = "key long, ordinal int, i int, j int, own int, id long, set_a long, component long, n_shingles long, sig binary"

    def involved(group: pa.Table) -> pa.Table:
        found = [np.unique(np.concatenate(pair)) for pair in _near_pairs(group)]
        return group.take(pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *found]))))

    def confirm(group: pa.Table) -> pa.Table:
        ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
        lists = group.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        values, coded = np.unique(lists.values.to_numpy()[at[0] : at[-1]], return_inverse=True)
        at, sizes = at - at[0], np.diff(at)
        up = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        out: list[tuple[int, int]] = []
        marks = np.zeros(len(values), bool)
        for a, b in _near_pairs(group):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else []:
                x, others = int(a[part[0]]), b[part]
                marks[coded[at[x] : at[x + 1]]] = True
                n = sizes[others]
                ends = np.cumsum(n)
                inside = np.concatenate([[0], np.cumsum(marks[coded[np.repeat(at[others] - (ends - n), n) + np.arange(ends[-1])]])])
                common = inside[ends] - inside[ends - n]
                marks[coded[at[x] : at[x + 1]]] = False
                for y in others[common * SIMILARITY[1] >= (sizes[x] + n - common) * SIMILARITY[0]].tolist():
                    if (r := root(int(comp[x]))) != (q := root(int(comp[y]))):  # one link joins two components
                        up[r] = q
                        out.append((int(ids[x]), int(ids[y])))
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    bound_batches(docs.sparkSession)
    n, by = partitions(docs.sparkSession), ["key", "ordinal", "i", "j"]  # the groups' bytes are few, their work is not
    some = scratch.write(rows.repartition(n, *by).groupBy(*by).applyInArrow(involved, schema), "across")
    ids = scratch.write(some.select("id").distinct().coalesce(-(-some.count() // FILE_LINKS) or 1), "across-ids")
    full = some.join(_shingle_sets(docs, ids, ids.count()), ["id", "set_a"])
    return scratch.write(full.repartition(n, *by).groupBy(*by).applyInArrow(confirm, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    docs: ``doc_id, text``; other columns are ignored. Words are runs of other bytes than the six ASCII white-space
    ones, A-Z lower-cased; a text of fewer than five words is one shingle. Null, empty and blank texts have no shingle,
    are linked with nothing and kept. Sets are compared by 64-bit hashes of their shingles. Rows with a null doc_id are
    kept, by themselves. Rows that repeat a doc_id are reported each; they are one document, linked by any of them.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = scratch.write(_describe(texts), "signatures")
    named = described.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sets = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    sets = scratch.write(sets, "sets")
    keys = _keys(sets)
    stars = keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = scratch.write(keys.join(stars.select("key", "a"), "key").select("key", "id", "a"), "buckets")
    pairs = buckets.filter("a < id").select("a", F.col("id").alias("b"))
    components = connected_components(_confirmed(texts, _of_similar_size(pairs, sets), scratch))
    mixed = scratch.write(_mixed(buckets, components), "mixed")
    more = _confirmed(texts, _of_similar_size(_central_stars(mixed), sets), scratch)
    if not more.isEmpty():
        components = connected_components(more, components)
        mixed = scratch.write(_mixed(buckets, components), "mixed")
    more = _linked_across(texts, mixed, sets, scratch)
    components = components if more.isEmpty() else connected_components(more, components)
    scratch.drop(*(x for x in scratch.paths if x not in ("signatures", "sets")))
    of_set = sets.join(components, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    out = described.join(of_set, ["set_a", "set_b"], "left")
    # rows of one doc_id with different sets are one document
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest doc_id; all columns are kept.

    An empty table stays empty. Null, empty and blank texts and null doc_ids are kept; so are all rows that repeat a kept doc_id.
    """
    found = near_duplicates(docs)
    dropped = materialise(found.filter("NOT kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(bounded_broadcast(dropped, dropped.count()), "doc_id", "left_anti")
    return kept.select(*docs.columns)
