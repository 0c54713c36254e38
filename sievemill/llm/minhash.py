"""Near duplicates by b-bit MinHash.

1. Every text gives its set of five-word shingles, 128 minima in 32 bands of 4, and a signature that
   keeps the lowest two bits of every minimum: 32 bytes. Equal sets go on as one class.
2. A band key that several classes share is a bucket. Its smallest class is the leader, and every
   member is a candidate for a link with its leader: as many pairs as members, never all of them.
3. Candidates are estimated from their signatures by bit counts, corrected for bits that agree by
   chance, and confirmed on their full sets.
4. What the leaders' links leave in different components of one bucket is compared in blocks. A first
   pass over signatures and set sizes only says which members of a block may have a partner there; a
   second one takes the texts of those, counts shared shingles for all pairs of the block at once, and
   gives just enough links to join the components. No pair leaves a block unconfirmed.

Four minima meet in one of 32 bands with probability 1 - (1 - s^4)^32: 0.999995 at s = 0.75.
The estimate's cut is so low that it drops a pair of similarity 0.75 once in 10^9.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_map, join_keyed, spread, stored, unused
from .shingles import mix, overlap, shingle_sets

BANDS, ROWS, BITS = 32, 4, 2
MINIMA = BANDS * ROWS
PERCENT = 75
#: Members that are compared with one copy of their leader's text.
GROUP = 128
#: Shingles in one side of a block, and the members at which a component has blocks of its own.
BLOCK, OWN = 1 << 17, 256
#: Ids, of eight bytes each, up to which their table is broadcast.
BROADCAST_IDS = 1_000_000
#: Rows of texts a worker holds at a time, by bytes.
SLICE = 1 << 20

_ODD = np.random.Generator(np.random.PCG64(7)).integers(1, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig array<long>"


def least_matches(percent: int = PERCENT, miss: float = 1e-9) -> int:
    """Smallest number of agreeing minima whose lower tail, at this similarity, reaches ``miss``."""
    s = percent / 100
    p, tail = s + (1 - s) / 2**BITS, 0.0
    for k in range(MINIMA + 1):
        tail += math.comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)
        if tail > miss:
            return k
    return MINIMA


def estimated_similarity(matches: Column) -> Column:
    """Jaccard similarity from the share of agreeing low bits, less the share that agrees by chance."""
    chance = 1 / 2**BITS
    return F.greatest((matches / MINIMA - chance) / (1 - chance), F.lit(0.0))


def matches(a: Column, b: Column) -> Column:
    """How many of the two-bit minima agree, by bit counts over the packed signatures."""
    words = MINIMA * BITS // 64
    odd = 0x5555555555555555
    differ = [F.bit_count((a[k].bitwiseXOR(b[k])).bitwiseOR(F.shiftrightunsigned(a[k].bitwiseXOR(b[k]), 1)).bitwiseAND(F.lit(odd))) for k in range(words)]
    return F.lit(MINIMA) - sum(differ[1:], differ[0])


def _minima(keys: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, len(keys), 4096):
        np.minimum(least, (keys[i : i + 4096] * _ODD[:, None]).min(axis=1), out=least)
    return least


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold some MB of text each; a longer text stands alone."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > SLICE:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    spread = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    places = np.arange(0, 64, BITS, dtype=np.uint64)
    for whole in batches:
        for batch in _slices(whole, 1):
            sets = shingle_sets(batch.column(1))
            least = np.zeros((len(sets), MINIMA), np.uint32)
            names = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    least[i] = _minima((s >> np.uint64(32)).astype(np.uint32))
                    names[i] = s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
            wide = least.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
            key = np.zeros((len(sets), BANDS), np.uint64) + spread
            for r in range(ROWS):
                key = mix(key ^ wide[:, :, r])
            low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(sets), -1, len(places))
            packed = (low << places).sum(axis=2, dtype=np.uint64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (key, packed)]
            names = mix(names).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), *lists],
                ["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sig"],
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, set name, band keys and packed signature of every text."""
    return arrow_map(spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))), _sign, _SIGNED)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, member, text), sorted; a group's first row has no member and holds its leader's text."""
    import pyarrow.compute  # noqa: F401

    group, leader = None, np.zeros(0, np.uint64)
    for whole in batches:
        for batch in _slices(whole, 3):
            out: tuple[list, ...] = ([], [], [], [])
            ids = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (a, salt, b), s in zip(ids, shingle_sets(batch.column(3))):
                if b is None:
                    group, leader = (a, salt), s
                elif (a, salt) == group:
                    both = overlap(leader, s)
                    for x, v in zip(out, (a, b, both, len(leader) + len(s) - both)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "shared", "either"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets are similar enough.

    texts: ``doc_id, text``, one row an id. A leader's text goes once to each group of its members; of
    very many members there are as many groups as members in one.
    """
    pairs = stored(pairs, "candidates")
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("groups", F.ceil(F.col("n") / F.greatest(F.lit(float(GROUP)), F.sqrt("n"))))
    salted = join_keyed(pairs, counted, "a", "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"))
    salted = stored(salted, "pairs")
    wanted = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.col("b").alias("member")).unionByName(
        salted.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(None).cast("long").alias("member")).distinct()
    )
    rows = wanted.join(texts, "doc_id").select("a", "salt", "member", "text")
    grouped = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("member").asc_nulls_first())
    compared = arrow_map(grouped, _compare, "a long, b long, shared long, either long")
    return compared.where(F.col("shared") * 100 >= F.col("either") * percent).select("a", "b")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, given rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        if not len(block):
            continue
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        if held and held[-1].column(0)[0].as_py() != block[0]:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(i, j - i))
            if j < len(block):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block's two sides; a block without a second side meets itself."""
    side = rows.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left


def _possible(rows: pa.Table, left: np.ndarray, right: np.ndarray, cut: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the left side, those of the right that may be linked with it, in another component."""
    sig = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, -1)
    comp, n = rows.column("comp").to_numpy(), rows.column("n").to_numpy()
    odd, sig_r, comp_r, n_r = np.uint64(0x5555555555555555), sig[right], comp[right], n[right]
    for i in left.tolist():
        near = np.flatnonzero((comp_r != comp[i]) & (np.minimum(n_r, n[i]) * 100 >= np.maximum(n_r, n[i]) * percent))
        if len(near):
            x = sig_r[near] ^ sig[i]
            same = MINIMA - np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1, dtype=np.int64)
            near = near[same >= cut]
            if len(near):
                yield i, right[near]


def _with_partner(cut: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            some = np.zeros(rows.num_rows, bool)
            for i, near in _possible(rows, *_sides(rows), cut, percent):
                some[i] = True
                some[near] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().filter(pa.array(some)) for c in ("block", "side", "doc_id")], ["block", "side", "doc_id"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    both = np.intersect1d(*flat)
    shared = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for sets, all_of in zip((left, right), flat):
        at = np.searchsorted(both, all_of)
        at[at == len(both)] = 0
        hit = both[at] == all_of if len(both) else np.zeros(len(all_of), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        placed.append((row[order], at[hit][order]))
    for first in range(0, len(both), columns):
        slabs = []
        for (row, column), sets in zip(placed, (left, right)):
            a, b = np.searchsorted(column, [first, first + columns])
            slab = np.zeros((len(sets), columns), np.float32)
            slab[row[a:b], column[a:b] - first] = 1
            slabs.append(slab)
        shared += slabs[0] @ slabs[1].T
    return shared


def _links(cut: int, percent: int, slab: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches):
            near = dict(_possible(rows, *_sides(rows), cut, percent))
            if not near:
                continue
            sets = shingle_sets(rows.column("text").combine_chunks())
            size = np.array([len(s) for s in sets])
            comp, doc = rows.column("comp").to_pylist(), rows.column("doc_id").to_pylist()
            up: dict[int, int] = {}

            def root(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            found: list[tuple[int, int]] = []
            left, right = list(near), np.unique(np.concatenate(list(near.values())))
            for first in range(0, len(left), slab):
                some = left[first : first + slab]
                if sum(len(near[i]) for i in some) > 16:
                    shared = shared_counts([sets[i] for i in some], [sets[k] for k in right])
                    counts = [shared[j, np.searchsorted(right, near[i])] for j, i in enumerate(some)]
                else:
                    counts = [np.array([overlap(sets[i], sets[k]) for k in near[i]]) for i in some]
                for i, n in zip(some, counts):
                    for k in near[i][n * 100 >= (size[i] + size[near[i]] - n) * percent].tolist():
                        x, y = root(comp[i]), root(comp[k])
                        if x != y:
                            up[max(x, y)] = min(x, y)
                            found.append((doc[i], doc[k]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _left_over(members: DataFrame, component: DataFrame) -> DataFrame:
    """Bucket members of which the bucket has several components, the leader aside: it has met all others. members: stored."""
    now = members.where("doc_id <> leader").join(component, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    split = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
    return join_keyed(now, split, "bucket", "n", members.count()).select("bucket", "doc_id", "comp")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each id. So few ids that their table is small go to every task; more are joined by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _in_blocks(rest: DataFrame, sketch: DataFrame) -> DataFrame:
    """``block, side, doc_id, comp, n, sig``: every two members of a bucket in different components meet in a block.

    A component with many members of a bucket has parts of its own there, and those aren't held
    against each other; the others share parts. The size of a part is bounded in shingles.
    """
    rows = rest.join(sketch, "doc_id")
    own = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w")).withColumn("own", F.when(F.col("k") >= OWN, F.col("comp")))
    own = stored(own, "owners")
    pools = own.groupBy("bucket", "own").agg(F.sum("w").alias("w")).withColumn("parts", F.ceil(F.col("w") / BLOCK).cast("int"))

    def name(part):
        return F.xxhash64(F.coalesce("own", F.lit(-1).cast("long")), F.col("own").isNull(), part)

    parts = pools.select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("part_name", name(F.col("part")))
    met = parts.alias("p").join(parts.alias("q"), F.expr("p.bucket = q.bucket AND p.part_name <= q.part_name AND (p.own IS NULL OR NOT p.own <=> q.own)"))
    met = met.select(F.col("p.bucket").alias("bucket"), F.col("p.part_name").alias("p"), F.col("q.part_name").alias("q"))
    met = stored(met.withColumn("block", F.xxhash64("bucket", "p", "q")), "meetings")
    of = own.select("bucket", "comp", "own", "k").join(pools.select("bucket", F.col("own").alias("own_"), "parts").withColumnRenamed("bucket", "bucket_"), F.expr("bucket = bucket_ AND own <=> own_"))
    placed = join_keyed(rows, of.select("bucket", "comp", "own", "parts", "k"), ["bucket", "comp"], "k", rest.count())
    placed = placed.withColumn("part_name", name(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))).drop("own", "parts")
    ends = met.select("bucket", F.col("p").alias("part_name"), "block", F.lit(0).alias("side")).unionByName(
        met.where("p <> q").select("bucket", F.col("q").alias("part_name"), "block", F.lit(1).alias("side"))
    )
    return placed.join(ends, ["bucket", "part_name"]).select("block", "side", "doc_id", "comp", "n", "sig")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Component of every document under links of at least ``percent`` similarity.

    Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``. Documents are
    linked if 100 * intersection >= percent * union of their sets of distinct five-word shingles
    (words split at ASCII white space, A-Z lower-cased); component_id is the smallest id reachable and
    the row that has it is kept. A text without words, or null, has an empty set and links with nothing.
    Rows that repeat an id are one document and should have one text; they all get the same answer. A
    row with a null id links with nothing: component_id is null and kept is true. Other columns play
    no part. An empty table gives an empty one.
    """
    cut = least_matches(percent)
    sig = stored(signatures(docs, id_col, text_col), "signatures")
    total = sig.count()
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = stored(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    reps = join_keyed(full.select("doc_id", "set_hi", "set_lo"), copies, ["set_hi", "set_lo"], "n", total, "left").where("rep IS NULL OR rep = doc_id")
    reps = stored(full.join(reps.select("doc_id", "set_hi", "set_lo").distinct(), ["doc_id", "set_hi", "set_lo"], "left_semi"), "leaders")
    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("leader <> last")
    members = stored(join_keyed(banded, shared.select("bucket", "leader", "n"), "bucket", "n", BANDS * total).distinct(), "buckets")
    sketch = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["doc_id"])
    sketch = stored(sketch, "sketches")
    texts = stored(_texts_of(spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))), sketch.select("doc_id")), "texts")

    led = stored(members.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "led")
    ends = [sketch.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}")) for x in ("a", "b")]
    of_leaders = ends[0].join(led.groupBy("a").agg(F.count(F.lit(1)).alias("led")), "a")
    close = join_keyed(led, of_leaders, "a", "led", led.count()).join(ends[1], "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    links = stored(confirmed(close.where(matches(F.col("s_a"), F.col("s_b")) >= cut).select("a", "b"), texts, percent), "links")
    component = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))

    rest = stored(_left_over(members, component), "rest")
    if not rest.isEmpty():
        blocks = stored(_in_blocks(rest, sketch), "blocks")
        grouped = blocks.repartition("block").sortWithinPartitions("block")
        partners = stored(arrow_map(grouped, _with_partner(cut, percent), "block long, side int, doc_id long"), "partners")
        if not partners.isEmpty():
            full = blocks.join(partners, ["block", "side", "doc_id"]).join(texts, "doc_id").select("block", "side", "doc_id", "comp", "n", "sig", "text")
            more = arrow_map(full.repartition("block").sortWithinPartitions("block"), _links(cut, percent), "a long, b long")
            links = links.unionByName(stored(more, "links"))
            component = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))

    by_set = copies.join(component, copies.rep == component.doc_id, "left").select("set_hi", "set_lo", F.coalesce("comp", "rep").alias("c1"), "n")
    narrow = sig.select("doc_id", "n_shingles", "set_hi", "set_lo")
    whole = join_keyed(narrow.where("n_shingles > 0 AND doc_id IS NOT NULL"), by_set, ["set_hi", "set_lo"], "n", total, "left").join(component, "doc_id", "left")
    whole = whole.select("doc_id", "n_shingles", F.coalesce("c1", "comp", "doc_id").alias("component_id"))
    alone = narrow.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns: those with the smallest ids.

    Rows are numbered first, and linked by their numbers, so a row goes for its own text only, whatever
    ids repeat or are null. A null id counts as the largest; of equal ids in a component one row stays.
    Rows without words all stay. Columns may have any names.
    """
    number = unused(docs, "number")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, number, text_col, percent).select("doc_id", "component_id")
    found = stored(found, "components")
    # Components of one row need no choice.
    several = found.where("doc_id <> component_id").select("component_id").distinct()
    heads = found.join(several.withColumnRenamed("component_id", "doc_id"), "doc_id", "left_semi")
    members = found.where("doc_id <> component_id").unionByName(heads)
    ids = numbered.select(F.col(number).alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "doc_id")
    best = members.join(ids, "doc_id").groupBy("component_id").agg(F.min(order)["doc_id"].alias("doc_id"))
    gone = stored(members.select("doc_id").join(best, "doc_id", "left_anti").select(F.col("doc_id").alias(number)), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if few else gone, number, "left_anti").drop(number)
