"""MinHash near-duplicates (operator 6): one-permutation hashing with optimal densification, banded buckets, star edges.

1. One hash of each distinct word shingle fills BINS bins by its top bits; a bin keeps its smallest hash. An empty bin takes
   the value of the first filled bin in a fixed pseudo-random sequence of its own (optimal densification).
2. Documents with equal shingle sets become one class, so large groups of copies weigh as much as one document.
3. BANDS bands of ROWS bins make bucket keys. Two sets of similarity 0.75 share none of them with a chance of 5e-6.
4. Each bucket gives a star: edges from its smallest id to the others, as many as it has members. Each edge is confirmed on the
   full sets of both texts.
5. What a star may have missed is found exactly. Jaccard distance is a metric, so a member over 0.5 away from the centre cannot
   link to one that the centre is linked to. Members that stay undecided, and lie in different components, get new centres, STARS times;
   each takes the ball of its links out of the bucket, so groups of near copies are closed here.
6. The rest are bucket members that are alike but not enough, such as pages of one template. At most SMALL members of a bucket are compared
   as pairs; more, in blocks of about BLOCK members, of which a task takes two and multiplies their membership matrices, and
   returns a spanning forest of their links, never pairs.
7. Buckets of more than LARGE such members are cut up first, without loss: of two sets of similarity 0.75 one holds, among the rarest
   quarter of its shingles, a shingle that is in the other's rarest quarter too (prefix filter). Their members meet by those shingles
   in place of the bucket, so that what a template shares brings none of its pages together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import batch_of, mix, runs_hash, slices, texts, word_hashes, written
from scanlake.llm.components import components

WORDS, BANDS, ROWS, STARS, SMALL, BLOCK, LARGE = 5, 32, 4, 2, 16, 384, 1536
BINS = BANDS * ROWS
#: Rows of a table of numbers that may be broadcast.
FEW = 1 << 20
#: Bins that an empty bin tries in turn before it takes the nearest filled one.
TRIES = 2048


def _sequences() -> np.ndarray:
    at = np.arange(BINS * TRIES, dtype=np.uint64).reshape(BINS, TRIES)
    return (mix(at + np.uint64(0x5DEECE66D)) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int32)


SEQUENCES = _sequences()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle has make one; no words, none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    n = min(words, len(h))
    return np.unique(runs_hash(h, n, n))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin, with empty bins densified. found: sorted and not empty."""
    bins = (found >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    out[bins[first]], full[bins[first]] = found[first], True
    empty = np.flatnonzero(~full)
    for lo, hi in ((0, 16), (16, 256), (256, TRIES)):
        if not len(empty):
            break
        tried = SEQUENCES[empty, lo:hi]
        hit = full[tried]
        done = hit.any(axis=1)
        out[empty[done]] = out[tried[done, hit[done].argmax(axis=1)]]
        empty = empty[~done]
    if len(empty):
        out[empty] = out[bins[first[0]]]
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """Bucket keys of a set."""
    s = signature(found).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return key


def signed_list(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def few(numbers: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it has few rows (FEW, some 64 MB in an executor), so that what it picks from need not be shuffled."""
    return F.broadcast(numbers) if numbers.limit(FEW + 1).count() <= FEW else numbers.hint("merge")


def described(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, s1 and s2 (a 128-bit digest of the set; null without shingles), keys (array)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                d = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64).tolist() if len(found) else [None, None]
                rows.append((len(found), *d, bands(found) if len(found) else found))
            yield batch_of(schema, batch.column(0), *([r[i] for r in rows] for i in range(3)), signed_list([r[3] for r in rows]))

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def similarities(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """pairs(a, b) with the sizes of the intersection (`both`) and union (`either`) of the full shingle sets of their texts in whole(id, text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "both", "either")])

    def run(batches):
        last, of_last = None, None
        for batch in slices(batches, 64):
            rows = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is None or x != last:
                    last, of_last = x, shingles(x)
                other = shingles(y)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                rows.append((a, b, both, len(of_last) + len(other) - both))
            yield batch_of(schema, *([r[i] for r in rows] for i in range(4)))

    # Texts are never broadcast.
    rows = pairs.join(whole.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    rows = rows.join(whole.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, both long, either long")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from each id to the smallest id that it reaches by links among the given ids."""
    sizes = np.array(list(map(len, sets)), dtype=np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    row, column = row[place[column] >= 0], place[column][place[column] >= 0]
    both = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for lo in range(0, len(shared), 4096):
        part = (column >= lo) & (column < lo + 4096)
        x = np.zeros((len(ids), min(4096, len(shared) - lo)), dtype=np.float32)
        x[row[part], column[part] - lo] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    linked = both * 100 >= (sizes[:, None] + sizes[None] - both) * percent
    np.fill_diagonal(linked, True)
    label = np.array(ids)
    while True:
        lower = np.where(linked, label[None], np.iinfo(np.int64).max).min(axis=1)
        if (lower == label).all():
            return [(int(a), int(b)) for a, b in zip(label, ids, strict=True) if a != b]
        label = lower


def told_apart(entries: DataFrame, *more: Column) -> DataFrame:
    """(key, n, centre: the smallest id, and what more asks for) of keys with several members; of keys with the same members, one.

    Near copies share most of their bands and rare shingles, so this leaves few keys. Members are told by their number, the smallest and a
    64-bit sum of their hashes.
    """
    keys = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre"), F.bit_xor(F.xxhash64("id")).alias("members"), *more).filter("n > 1")
    others = [c for c in keys.columns if c not in ("key", "n", "centre", "members")]
    return keys.groupBy("n", "centre", "members").agg(F.min("key").alias("key"), *[F.min(c).alias(c) for c in others])


def hashed_sets(whole: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found): the shingle set of each text of the given ids."""
    schema = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.int64()))])

    def hashed(batches):
        for batch in slices(batches):
            yield batch_of(schema, batch.column(0), signed_list([shingles(t) for t in batch.column(1).to_pylist()]))

    return whole.join(ids.select("id"), "id", "left_semi").mapInArrow(hashed, "id long, found array<long>")


def _in_blocks(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """entries(key, id, n): links (a, b) that connect, among the n members of each key, what any of their links connects."""
    import pandas as pd

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        keyed = group.assign(digest=[xxhash.xxh3_128_digest(x.tobytes()) for x in group["found"]]).drop_duplicates(["id", "digest"])
        edges = forest(keyed["id"].to_numpy(), [x.view(np.uint64) for x in keyed["found"]], percent)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    dealt = entries.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(id, key), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets, "id").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id): the rarest shingles of each set, one of which two sets of at least percent / 100 share.

    Two such sets share at least percent / 100 of either one's shingles; in any one order of all shingles, here by how many sets
    have them, the first (100 - percent) / 100 of each and one more meet. Shingles of one set alone come first and meet nothing.
    """
    rows = sets.distinct().select("id", F.xxhash64("found").alias("set"), F.size("found").alias("size"), F.explode("found").alias("key"))
    rows = written(rows, "shingles")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = rows.join(often, "key").groupBy("id", "set", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("shared"))
    take = F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * percent / 100).cast("int") + 1 - (F.col("size") - F.size("shared")))
    return ordered.select("id", F.explode(F.slice("shared", 1, take)).alias("p")).select(F.col("p.key").alias("key"), "id")


def _compared(state: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """state(key, id, component): links (a, b) that connect all that links between members of a key in different components connect."""
    sizes = written(state.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    large = state.join(sizes.filter(F.col("n") > LARGE).select("key"), "key")
    state = state.join(sizes.filter(F.col("n") <= LARGE).select("key"), "key").select("key", "id", "component")
    sets = written(hashed_sets(whole, state.union(large.select("key", "id", "component")).select("id").distinct()), "sets")
    of_large = prefixes(sets.join(large.select("id").distinct(), "id", "left_semi"), percent)
    by_shingle = of_large.join(large.select("id", "component").distinct(), "id").select("key", "id", "component").distinct()
    entries = written(state.withColumn("by", F.lit(0)).union(by_shingle.withColumn("by", F.lit(1))).withColumn("key", F.xxhash64("by", "key")).drop("by"), "undecided")
    several = [F.min("component").alias("c0"), F.max("component").alias("c1")]
    entries = written(entries.join(told_apart(entries, *several).filter("c0 < c1").select("key", "n"), "key"), "undecided")
    small = entries.filter(F.col("n") <= SMALL)
    one, other = (small.select("key", F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "ab")
    pairs = written(one.join(other, "key").filter("a < b and of_a <> of_b").select("a", "b").distinct(), "rest")
    more = similarities(pairs, whole).filter(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
    return more.union(_in_blocks(entries.filter(F.col("n") > SMALL).select("key", "id", "n"), sets, percent))


def _after_star(state: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """state(key, id, component, centre) without the centres and what they decide; components as they were.

    checked: (a: centre, b: id, both, either) of the pairs that were compared. Members near the centre cannot link to members far from it;
    they stay if some are in between, or if some were not compared (being in the centre's component).
    """
    near = F.col("both") * 100 >= F.col("either") * percent
    state = state.filter("id <> centre").join(checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), "both", "either"), ["centre", "id"], "left")
    state = state.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("middle", F.coalesce(~near & (F.col("both") * 100 >= F.col("either") * (2 * percent - 100)), F.lit(True)))
    open_keys = state.groupBy("key").agg(F.max("middle").alias("any_middle"))
    return state.join(open_keys, "key").filter("any_middle or not near").select("key", "id", "component")


def _several(state: DataFrame) -> DataFrame:
    """state, of keys with members of several components; the others need no more links."""
    keys = state.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
    return state.join(keys, "key")


def links(entries: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """From distinct entries(key, id), bucket members: links (a, b) of at least percent / 100 that connect all that any link in a bucket connects."""
    entries = written(entries, "entries")
    buckets = written(told_apart(entries).select("key", "centre"), "buckets")
    state = written(entries.join(few(buckets), "key"), "members").withColumn("component", F.col("id"))
    # The texts of bucket members alone; they are read several times.
    ids = written(state.select("id").distinct(), "ids")
    whole = written(texts(docs, F.col("doc_id").cast("long").alias("id")).join(few(ids), "id", "left_semi"), "texts")
    found = None
    for turn in range(STARS):
        if turn:
            centres = state.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(turn))).alias("c")).select("key", F.col("c.id").alias("centre"), F.col("c.component").alias("of_centre"))
            state = written(state.join(centres, "key"), "members")
            pairs = state.filter("component <> of_centre")
        else:
            pairs = state.filter("id <> centre")
        pairs = written(pairs.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
        checked = written(similarities(pairs, whole), "checked")
        linked = checked.filter(F.col("both") * 100 >= F.col("either") * percent).select("a", "b")
        found = linked if found is None else found.union(linked)
        groups = components(found)
        state = _after_star(state, checked, percent).join(groups, "id", "left").select("key", "id", F.coalesce(groups["component"], "id").alias("component"))
        state = written(_several(state), "undecided")
        if state.isEmpty():
            return found
        ids = written(state.select("id").distinct(), "ids")
        whole = written(whole.join(few(ids), "id", "left_semi"), "texts")
    return found.union(_compared(state, whole, percent))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Null and empty texts and texts of white space have no shingles and link with nothing. Rows that repeat a doc_id are one
    node and are kept or not together. A row with a null doc_id takes no part: its component_id is null, and it is kept.
    Other columns are ignored; an empty table gives an empty result; texts are compared whole.
    """
    rows = written(described(docs), "described")
    classes = written(rows.filter("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(rows.join(classes, ["s1", "s2"]).select("doc_id", "rep", "n_shingles", "keys"), "members")
    entries = members.filter("doc_id = rep").select("keys", "rep").distinct().select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    edges = links(entries, docs, percent)
    # A doc_id with different texts joins the classes of all of them.
    double = members.groupBy("doc_id").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 < r1").select(F.col("r0").alias("a"), F.col("r1").alias("b"))
    groups = components(edges.union(double))
    placed = members.select("doc_id", "rep").distinct().join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.expr("component_id <=> doc_id").alias("kept"))
