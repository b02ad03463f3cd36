"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

Every document becomes the set of its word shingles. Documents with equal sets, told by a
128-bit cryptographic digest of the whole set, are one representative from the start. Representatives get a SuperMinHash signature, whose
registers use one permutation rank per element, are split into bands, and meet in the
buckets of equal bands. Links are confirmed on full sets and closed to components.

No bucket is expanded into all pairs. Each member is first tried against the smallest
member of one of its buckets; then, round by round, each component that shares a bucket
with another is tried once against the largest component of one such bucket, which joins
a group of copies in work linear in its size. When rounds join next to nothing more, the
pairs of one bucket that still lie in different components are tried in full, so that no
link that banding finds is lost. Those pairs are not listed by bucket either, where copies
that differ a little too much would meet in their square: two sets can only link if they
share one of their rarest elements, so they meet by those, and only where size and position
of the shared element leave room for a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.llm import texthash as H
from listingspark.llm.common import Scratch, spare
from listingspark.llm.components import connected_components

U = np.uint64
#: Rounds of single trials at most; what they leave is tried in full.
ROUNDS = 12
#: Rows of one rare element that one task takes on the side that is split.
SPLIT = 4096


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Signatures (sets x m, uint64) of hashed elements; ``owner`` is the set of each.

    Round j gives every element the j-th rank of its own random permutation of the
    registers: it enters the register of that rank with the value j plus a fraction.
    A set is finished, and its elements leave, once all its registers hold values below
    j + 1, since later rounds only bring larger ones.
    """
    out = np.full((sets, m), np.iinfo(U).max, dtype=U)
    flat = out.reshape(-1)
    live_e, live_o = elements, owner
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elements), m)).copy()
    rows = np.arange(len(elements))
    for j in range(m):
        r = H.mix(live_e + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (((r >> U(32)) * U(m - j)) >> U(32)).astype(np.int64)
        at = perm[rows, k]
        perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, live_o * m + at, (U(j) << U(32)) | (r & U(0xFFFFFFFF)))
        open_sets = out.max(axis=1) >= (U(j + 1) << U(32))
        keep = open_sets[live_o]
        if not keep.any():
            break
        if keep.mean() < 0.7:
            live_e, live_o, rows = live_e[keep], live_o[keep], rows[keep]
    return out


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, at, _, _ = H.words(column)
    return [np.unique(H.shingles(h[a:b], k)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sketcher(k: int, bands: int, width: int):
    m = bands * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, "text", 1 << 20):
                found = _sets(batch.column("text"), k)
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                flat = np.concatenate(found) if found else np.zeros(0, U)
                owner = np.repeat(np.arange(len(found)), sizes)
                sig = superminhash(flat, owner, len(found), m)
                keys = np.stack(
                    [
                        H.mix(H.fold([sig[:, b * width + i] for i in range(width)]) + U((b + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
                        for b in range(bands)
                    ],
                    axis=1,
                )
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(found) * bands + 1, bands, dtype=np.int32)),
                    pa.array(keys.reshape(-1).view(np.int64)),
                )
                low = (sig & U(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(sizes),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found], pa.binary()),
                        lists,
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["id", "n", "digest", "bands", "sig"],
                )

    return run


def _set_writer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.chunks(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([x.tobytes() for x in _sets(batch.column("text"), k)], pa.binary())],
                    ["id", "elements"],
                )

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each element of each set."""
    for batch in batches:
        found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("elements")]
        if found:
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], ["id", "e"])


def _verifier(num: int, den: int):
    """Keeps pairs with den * |A and B| >= num * |A or B|, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if den * min(len(p), len(q)) >= num * max(len(p), len(q)):
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    keep[i] = den * both >= num * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _alike(least: int):
    """Drops pairs whose signatures agree in fewer than ``least`` registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def meetings(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), possibly repeated: sets of different components that share an element where a link is still possible.

    ``prefix`` has a row (id, n, c, i, e) for an element ``e`` at position ``i`` (from 0) of
    the n elements of a set in component c. A row has room for partners of up to ``most``
    elements: with more, those from position i on are too few for a link. So the smaller
    set of a pair brings only rows with room for its own size, which copies just under the
    similarity have none of, and meets larger sets by blocks of size up to ``most``. The
    largest component of an element meets the others, never itself; an element of one component is left out.
    Rows of a frequent element are dealt out by SPLIT, so that no task takes it whole.
    """
    sizes = prefix.groupBy("e", "c").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy("e").agg(F.sum("rows").alias("rows"), F.count("*").alias("parts"), F.max(F.struct("rows", "c")).alias("hub"))
    sizes = sizes.filter("parts > 1").select("e", F.col("hub.c").alias("hub"), F.ceil(F.col("rows") / SPLIT).cast("int").alias("shares"))
    block = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))
    rows = prefix.withColumn("most", F.expr(f"(n - i) * {num + den} div {num} - n")).join(sizes, "e")
    hub = F.col("c") == F.col("hub")

    def side(df: DataFrame, kinds: Column, blocks: Column, shares: Column, name: str) -> DataFrame:
        df = df.withColumn("kind", F.explode(kinds)).withColumn("block", F.explode(blocks)).withColumn("share", F.explode(shares))
        return df.select("e", "kind", "block", "share", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "n", "c", "most")])

    # kinds of meeting: 1 the hub with a larger set, 2 with a smaller one, 3 none of the hub
    small = side(
        rows.filter("most >= n"),
        F.when(hub, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3))),
        F.sequence(block(F.col("n")), block(F.col("most"))),
        F.sequence(F.lit(0), F.col("shares") - 1),
        "a",
    )
    large = side(
        rows,
        F.when(hub, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3))),
        F.array(block(F.col("n"))),
        F.array(F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")),
        "b",
    )
    met = small.join(large, ["e", "kind", "block", "share"]).filter("n_a < n_b or (n_a = n_b and id_a < id_b)")
    met = met.filter("n_b <= most_a and n_a <= most_b and c_a <> c_b")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = 30,
    width: int = 4,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    ``similarity`` is a fraction of whole numbers: sets A and B link if
    den * |A and B| >= num * |A or B|. With 30 bands of 4 registers a link at 0.8 is
    missed once in seven million pairs, one at 0.85 in three thousand million.

    Defined results: null or empty texts and texts of white space alone have no set,
    are linked with nothing and form their own component. Texts shorter than the
    shingle are one element. Rows that share an id are one node, so repeated rows get
    the same answer. A null id has component null and is kept. Ids are integers.
    Further columns of ``docs`` are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.table(
        texts.mapInArrow(
            _sketcher(shingle, bands, width), "id long, n long, digest binary, bands array<long>, sig binary"
        ),
        "sketch",
    )
    real = sketch.filter("n > 0 and id is not null")
    # equal sets: one representative, found with map-side combining
    reps = scratch.table(real.groupBy("n", "digest").agg(F.min("id").alias("rep")), "reps")
    leading = scratch.table(
        real.join(reps.withColumnRenamed("rep", "id"), ["n", "digest", "id"], "left_semi").select("id", "n", "bands", "sig"),
        "leading",
    )
    placed = leading.select("id", F.explode("bands").alias("key"))
    shared = scratch.table(
        placed.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader <> last"),
        "shared",
    )
    members = scratch.table(placed.join(shared.select("key", "leader"), "key"), "members")
    ids = members.select("id").distinct()
    sets = scratch.table(texts.join(ids, "id", "left_semi").mapInArrow(_set_writer(shingle), "id long, elements binary"), "sets")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        right = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
        both = right.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
        return scratch.table(both.select("a", "b", "x", "y").mapInArrow(_verifier(num, den), "a long, b long"), label)

    # one trial for each member: against the smallest leader of its buckets
    first = members.groupBy("id").agg(F.min("leader").alias("a")).filter("a <> id").select("a", F.col("id").alias("b"))
    links = confirmed(first, "links_first")
    label = scratch.table(connected_components(scratch, links, "cc_first"), "label_first")

    # members and components once more by turns, each component with one trial a round
    for k in range(ROUNDS):
        now = scratch.table(members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), f"placed_{k}")
        drawn = F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("id"))
        fronts = now.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(drawn)["id"].alias("id"))
        fronts = scratch.table(fronts, f"fronts_{k}")
        hubs = fronts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "c", "id")).alias("hub")).filter("parts > 1")
        hubs = scratch.table(hubs.select("key", F.col("hub.c").alias("hub_c"), F.col("hub.id").alias("a")), f"hubs_{k}")
        met = fronts.join(hubs, "key").filter("c <> hub_c")
        trial = F.min(F.struct(F.xxhash64("key", F.lit(k)), F.col("a"), F.col("id").alias("b"), F.col("hub_c"), F.col("c"))).alias("t")
        trials = scratch.table(met.groupBy("c").agg(trial).select("t.a", "t.b", "t.hub_c", "t.c"), f"trials_{k}")
        n = trials.count()
        if not n:
            break
        good = confirmed(trials.select("a", "b"), f"links_{k}")
        joins = trials.join(good, ["a", "b"], "left_semi").select(F.col("hub_c").alias("a"), F.col("c").alias("b"))
        joins = scratch.table(joins, f"joins_{k}")
        won = joins.count()
        if won:
            # components join components; members follow
            moved = connected_components(scratch, joins, f"cc_{k}").select(F.col("id").alias("c"), F.col("component").alias("to"))
            labelled = now.select("id", "c").distinct().join(moved, "c", "left")
            label = scratch.table(labelled.select("id", F.coalesce("to", "c").alias("component")), f"label_{k}")
        scratch.drop(f"placed_{k}", f"fronts_{k}", f"hubs_{k}", f"trials_{k}", f"links_{k}", f"joins_{k}")
        if won * 20 < n:
            break

    # buckets that still span components: what is left across components is tried in full
    now = members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    now = scratch.table(now, "placed_now")
    spanning = scratch.table(
        now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key"), "spanning"
    )
    open_ids = scratch.table(now.join(spanning, "key", "left_semi").select("id", "c").distinct(), "open")
    # sets that link share one of their rarest elements, of n the first n - ceil(p n) + 1
    held = sets.join(open_ids, "id", "left_semi").mapInArrow(_occurrences, "id long, e long")
    often = scratch.table(held.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    ranked = held.join(often, "e", "left").select("id", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "e").alias("x"))
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    first_ones = F.expr(f"slice(xs, 1, cast(size(xs) - ({num} * size(xs) + {den - 1}) div {den} + 1 as int))")
    prefix = lists.select("id", F.size("xs").alias("n"), F.posexplode(first_ones).alias("i", "x")).filter("x.df > 1")
    prefix = scratch.table(prefix.join(open_ids, "id").select("id", "n", "c", "i", F.col("x.e").alias("e")), "prefix")
    pairs = scratch.table(meetings(prefix, num, den).distinct(), "pairs")
    # of those, the ones that share a bucket
    signs = leading.select("id", "bands", "sig")
    tried = pairs.join(signs.select(F.col("id").alias("a"), F.col("bands").alias("ka"), F.col("sig").alias("x")), "a").join(
        signs.select(F.col("id").alias("b"), F.col("bands").alias("kb"), F.col("sig").alias("y")), "b"
    )
    tried = tried.filter(F.arrays_overlap("ka", "kb")).select("a", "b", "x", "y")
    m = bands * width
    p = num / den
    least = int(m * p - 6.5 * (m * p * (1 - p)) ** 0.5)  # six and a half deviations below the mean
    likely = scratch.table(tried.mapInArrow(_alike(least), "a long, b long"), "likely")
    more = confirmed(likely, "links_more")
    found = label
    if more.take(1):
        hung = label.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = scratch.table(connected_components(scratch, hung.unionAll(more), "cc_more"), "label")
    scratch.drop("shared", "members", "sets", "placed_now", "spanning", "open", "often", "prefix", "pairs", "likely", "links_first", "links_more", "leading")

    # representatives that took part in a link, then every row by its set
    joined = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    groups = scratch.table(joined.select("n", "digest", F.coalesce("component", "rep").alias("component")), "groups")
    linked = sketch.select("id", "n", "digest", F.when((F.col("n") > 0) & F.col("id").isNotNull(), True).alias("real"))
    groups = groups.select("n", "digest", "component", F.lit(True).alias("real"))
    out = linked.join(groups, ["n", "digest", "real"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` finds.

    The row with the smallest id stays; of rows that share it, one. Rows with a null id
    all stay. All columns pass through.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    (key,) = spare(docs, "key")
    found = scratch.table(near_duplicates(docs, id_col, **options).select(F.col(id_col).alias(key), "kept"), "found")
    gone = found.filter(~F.col("kept")).select(key).distinct()
    rest = docs.join(gone, docs[id_col] == gone[key], "left_anti")
    twice = found.filter(F.col("kept") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(key)
    twice = scratch.table(twice, "twice")
    if not twice.take(1):
        return rest
    single = rest.join(twice, rest[id_col] == twice[key], "left_anti")
    return single.unionAll(rest.join(twice, rest[id_col] == twice[key], "left_semi").dropDuplicates([id_col]))
