"""LM scoring (operator 4): whole-document log-probabilities of a gated recurrent language model, and of add-one unigrams.

1. Documents are packed into blocks of about TOKENS tokens, which are numbers of the block's own word list.
2. The words of all lists are dealt by hash to buckets of about PAIRS (block, word) pairs. A bucket adds up the training counts of its words
   and gives each block the totals of its own; a word has one entry a block at most, so that no bucket grows with a word's popularity.
3. The WORDS commonest words of all training tokens have an output each in the model. Others belong to one of TAIL classes by their last two
   bytes; within a tail class a word has probability (count - DISCOUNT) in proportion. A word met once in training is learnt as the unseen
   symbol (as it would be if it were left out), which gives unseen words their probability. So the model is a distribution over the same
   outcomes as the base: the known words, the end, and one unseen word.
4. The recurrent part (recurrent.py) is fitted by rounds of local passes: each task trains a copy of the model on about SHARD_TOKENS tokens of
   the training documents whose round it is, and parameters are averaged by tokens. Every training document has one round. Tasks grow
   with the input, and rounds with its logarithm.
5. Every block is scored with the state carried through each whole document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm import recurrent
from scanlake.llm.common import batch_of, mix, removed, slices, written
from scanlake.llm.words import bytes_of, packed_words, unpacked_words, word_hashes_of, words_of

WORDS, TAIL, DISCOUNT = 4096, 64, 0.6
TOKENS, PAIRS, SHARD_TOKENS, RATE = 1 << 21, 1 << 20, 1 << 22, 0.02
#: Shards that the training documents of a block go to in a round, at most.
SPREAD = 4
#: Documents of a batch that are cut into words together.
TOGETHER = 64
#: Words of more bytes have no output of their own, so that what is broadcast is bounded.
LONGEST = 64
#: Tail classes by the last two bytes of a word.
SLOTS = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) % np.uint64(TAIL)).astype(np.int64)

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64())])
BLOCK_SQL = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, sizes binary, words binary, counts binary, n_words long"
TOTALS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("top", pa.list_(pa.string())), ("top_counts", pa.list_(pa.int64())), ("types", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("singles", pa.list_(pa.int64()))])
TOTALS_SQL = "block long, bucket long, totals binary, top array<string>, top_counts array<long>, types array<long>, tokens array<long>, singles array<long>"
SYMBOLS = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("symbols", pa.binary()), ("once", pa.binary()), ("base", pa.list_(pa.float64())), ("rare", pa.list_(pa.float64())), ("known", pa.list_(pa.int64()))])
SYMBOLS_SQL = "block long, ids array<long>, held array<boolean>, lengths array<int>, symbols binary, once binary, base array<double>, rare array<double>, known array<long>"


def tail_classes(words: pa.Array) -> np.ndarray:
    ends, data = bytes_of(words)
    data = np.r_[data, np.zeros(2, np.uint8)].astype(np.int64)
    size = np.diff(ends)
    return SLOTS[np.where(size > 0, data[ends[1:] - 1], 0) + 256 * np.where(size > 1, data[ends[1:] - 2], 0)]


def in_buckets(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of words by their bucket, and where each bucket begins and ends in it. Equal words have equal buckets."""
    of = word_hashes_of(words) % np.uint64(buckets)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))


def words_in(batch: pa.RecordBatch) -> pa.Array:
    """The word list of a block's row."""
    return unpacked_words(batch.column("sizes")[0].as_py(), batch.column("words")[0].as_py())


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of whole documents as numbers, with the training counts of their words; numbered by partition, so a retry gives the same."""

    def block(number: int, parts: list[tuple]) -> pa.RecordBatch:
        found = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
        tokens, words = found.indices.to_numpy(), found.dictionary
        lengths, held = (np.concatenate([p[i] for p in parts]) for i in (3, 1))
        counts = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words))
        ids = pa.concat_arrays([p[0] for p in parts])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return batch_of(
            BLOCK, [number], one(ids), one(pa.array(held)), one(pa.array(lengths.astype(np.int32))), [tokens.astype("<i4").tobytes()],
            *([v] for v in packed_words(words)), [counts.astype("<i4").tobytes()], [len(words)],
        )

    def run(batches):
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, TOGETHER):
            if not batch.num_rows:
                continue
            words, lengths = words_of(batch.column(2))
            parts.append((batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), words, lengths))
            size += len(words)
            if size >= TOKENS:
                yield block(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield block(number, parts)

    return rows.mapInArrow(run, BLOCK_SQL)


def counted(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket, the total training counts of the block's words in the bucket; for each bucket, a row without a block.

    That row has the bucket's commonest words, at most WORDS, and for each tail class how many of its words have a count, their
    tokens, and how many have count 1.
    """

    def dealt(batches):
        for batch in slices(batches, 1):
            words, counts = words_in(batch), np.frombuffer(batch.column("counts")[0].as_py(), dtype="<i4")
            order, ends = in_buckets(words, buckets)
            words, counts, used = words.take(pa.array(order)), counts[order], np.flatnonzero(np.diff(ends))
            cut = [(*packed_words(words[ends[k] : ends[k + 1]]), counts[ends[k] : ends[k + 1]].tobytes()) for k in used]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.repeat(batch.column("block").to_numpy(), len(used))), *(pa.array([c[i] for c in cut], pa.binary()) for i in range(3))], names=["bucket", "block", "sizes", "words", "counts"])

    def added(group: pa.Table) -> pa.Table:
        sizes = group.column("sizes").to_pylist()
        found = unpacked_words(b"".join(sizes), b"".join(group.column("words").to_pylist())).dictionary_encode()
        numbers, words = found.indices.to_numpy(), found.dictionary
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), dtype="<i4")
        totals = np.bincount(numbers, weights=counts, minlength=len(words)).astype(np.int64)
        slots = tail_classes(words)
        per_slot = [np.bincount(slots[totals > 0], minlength=TAIL).tolist(), np.bincount(slots, totals, minlength=TAIL).astype(np.int64).tolist(), np.bincount(slots[totals == 1], minlength=TAIL).tolist()]
        able = np.flatnonzero((totals > 1) & (np.diff(bytes_of(words)[0]) <= LONGEST))
        # Of words with equal counts the first in order are taken, whatever their order here.
        least = np.sort(totals[able])[-WORDS] if len(able) > WORDS else 0
        able = able[totals[able] >= least]
        top = sorted(zip((-totals[able]).tolist(), words.take(pa.array(able)).to_pylist(), strict=True))[:WORDS]
        rows, none = len(sizes), [None] * len(sizes)
        ends = np.cumsum([0, *(len(s) // 4 for s in sizes)])
        every = totals[numbers]
        return pa.Table.from_batches([batch_of(
            TOTALS, group.column("block").to_pylist() + [None], [group.column("bucket")[0].as_py()] * (rows + 1), [every[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] + [None],
            none + [[w for _, w in top]], none + [[-c for c, _ in top]], *[none + [v] for v in per_slot],
        )])

    pieces = blocks.select("block", "sizes", "words", "counts").mapInArrow(dealt, "bucket long, block long, sizes binary, words binary, counts binary")
    return written(pieces.groupBy("bucket").applyInArrow(added, TOTALS_SQL), "counts")


def corpus_facts(totals: DataFrame) -> dict:
    """What every task needs to know of the counts; its size is bounded by WORDS and TAIL.

    n and v; own, the WORDS commonest words; the numbers of symbols (own words, then tail classes, then unseen) in descending order
    of their counts, which are in `sizes`; mass, the discounted tokens of each tail class.
    """
    of_bucket = totals.filter("block is null")
    slots = of_bucket.select(F.posexplode(F.arrays_zip("types", "tokens", "singles")).alias("slot", "s")).groupBy("slot").agg(*[F.sum(f"s.{c}").alias(c) for c in ("types", "tokens", "singles")]).toPandas()
    types, tokens, singles = (np.zeros(TAIL, dtype=np.int64) for _ in range(3))
    for v, c in ((types, "types"), (tokens, "tokens"), (singles, "singles")):
        v[slots["slot"].to_numpy(dtype=int)] = slots[c].to_numpy()
    n, v = int(tokens.sum()), int(types.sum())
    top = of_bucket.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).select("t.top", "t.top_counts").orderBy(F.desc("top_counts"), "top").limit(WORDS).collect()
    own, counts = pa.array([r[0] for r in top], pa.string()), np.array([r[1] for r in top], dtype=np.int64)
    if top:
        np.subtract.at(types, tail_classes(own), 1)
        np.subtract.at(tokens, tail_classes(own), counts)
    sizes = np.r_[counts, tokens - singles, singles.sum()].astype(float)
    order = np.argsort(-sizes, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return {"own": own, "numbers": number, "sizes": sizes[order], "mass": tokens - DISCOUNT * types, "n": n, "v": v}


def coded(blocks: DataFrame, totals: DataFrame, buckets: int, facts) -> DataFrame:
    """Blocks in the model's symbols, with each document's base score, known tokens and the part of its score that has no state."""
    lists = totals.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("parts"))
    joined = blocks.select("block", "ids", "held", "lengths", "tokens", "sizes", "words").join(lists.hint("shuffle_hash"), "block")
    joined = joined.withColumn("totals", F.col("parts.totals")).drop("parts")

    def run(batches):
        f = facts.value
        own, number = f["own"], f["numbers"]
        for batch in slices(batches, 1):
            tokens = np.frombuffer(batch.column("tokens")[0].as_py(), dtype="<i4")
            words, lengths = words_in(batch), batch.column("lengths")[0].values.to_numpy()
            order, _ = in_buckets(words, buckets)
            counts = np.empty(len(words), dtype=np.int64)
            counts[order] = np.frombuffer(b"".join(batch.column("totals")[0].as_py()), dtype=np.int64)
            slots = tail_classes(words)
            at = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy()
            tail = (at < 0) & (counts > 0)
            symbol = number[np.where(tail, len(own) + slots, at)]  # -1 is the last, unseen
            rare = np.zeros(len(counts))
            rare[tail] = np.log(np.maximum(counts[tail] - DISCOUNT, 1e-9) / np.maximum(f["mass"][slots[tail]], 1e-9))
            once = np.packbits(((counts == 1) & tail)[tokens])
            starts = np.cumsum(lengths) - lengths
            per_doc = lambda v: np.add.reduceat(v[tokens], starts)
            log10 = np.log10((counts + 1) / (f["n"] + f["v"] + 1))
            yield batch_of(
                SYMBOLS, batch.column("block"), batch.column("ids"), batch.column("held"), batch.column("lengths"), [symbol.astype("<u2")[tokens].tobytes()], [once.tobytes()],
                [per_doc(log10).tolist()], [per_doc(rare).tolist()], [per_doc((counts > 0).astype(np.int64)).tolist()],
            )

    return joined.mapInArrow(run, SYMBOLS_SQL)


def documents_of(batch: pa.RecordBatch, unseen: int | None = None) -> list[np.ndarray]:
    """The documents of a block's row as symbols; with `unseen`, words met once in training become that symbol, as they are learnt."""
    lengths = batch.column("lengths")[0].values.to_numpy()
    symbols = np.frombuffer(batch.column("symbols")[0].as_py(), dtype="<u2")
    if unseen is not None:
        symbols = np.where(np.unpackbits(np.frombuffer(batch.column("once")[0].as_py(), dtype=np.uint8), count=len(symbols)), np.uint16(unseen), symbols)
    return np.split(symbols, np.cumsum(lengths)[:-1])


def training_rows(blocks: DataFrame, unseen: int, rounds: int, shards: int) -> DataFrame:
    """(turn, shard, block, lengths, symbols): each training document in one round and one of its shards, in folders by turn."""

    def dealt(batches):
        for batch in slices(batches, 1):
            docs, held = documents_of(batch, unseen), batch.column("held")[0].values.to_numpy(zero_copy_only=False)
            block = batch.column("block")[0].as_py()
            rnd = np.random.default_rng(block)
            turn, part = rnd.integers(0, rounds, len(docs)), rnd.integers(0, SPREAD, len(docs))
            shard = rnd.integers(0, shards, (rounds, SPREAD))
            rows = []
            for t in range(rounds):
                for k in range(SPREAD):
                    chosen = [docs[i] for i in np.flatnonzero(~held & (turn == t) & (part == k))]
                    if chosen:
                        rows.append((int(shard[t, k]), block, [len(d) for d in chosen], b"".join(d.tobytes() for d in chosen), t))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "block", "lengths", "symbols", "turn"])

    pieces = blocks.select("block", "held", "lengths", "symbols", "once").mapInArrow(dealt, "shard long, block long, lengths array<int>, symbols binary, turn int")
    return written(pieces, "training", "turn")


def trained_copies(rows: DataFrame, model: dict, edges: np.ndarray, turn: int) -> DataFrame:
    """(seen, sums): a copy of the model from each shard of a round's rows, times the tokens that it has seen."""
    start = rows.sparkSession.sparkContext.broadcast(recurrent.flat(model))

    def local(group: pd.DataFrame) -> pd.DataFrame:
        docs = []
        for _, row in group.sort_values(["block", "symbols"]).iterrows():
            docs += np.split(np.frombuffer(row["symbols"], dtype="<u2"), np.cumsum(row["lengths"])[:-1])
        own, seen = recurrent.train(recurrent.shaped(start.value, edges), edges, docs, RATE / math.sqrt(turn + 1), seed=turn)
        return pd.DataFrame({"seen": [seen], "sums": [(recurrent.flat(own).astype(np.float64) * seen).tobytes()]})

    return written(rows.filter(F.col("turn") == turn).drop("turn").groupBy("shard").applyInPandas(local, "seen long, sums binary"), "models")


def averaged(copies: DataFrame, shards: int) -> np.ndarray | None:
    """The mean of copies by tokens: sums within partitions, 32 copies a task, until one is left; none where no copy has seen a token."""

    def add(batches):
        seen, total = 0, 0.0
        for batch in batches:
            for n, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, total = seen + n, total + np.frombuffer(sums)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["seen", "sums"])

    while shards > 32:
        shards, before = -(-shards // 32), copies
        copies = written(copies.repartition(shards).mapInArrow(add, copies.schema), "sums")
        removed(before)
    row = copies.repartition(1).mapInArrow(add, copies.schema).first()
    removed(copies)
    return None if row is None else np.frombuffer(row["sums"]) / row["seen"]


def fitted(blocks: DataFrame, sizes: np.ndarray, unseen: int) -> dict:
    """The model after rounds of local training and averaging by tokens."""
    model, edges = recurrent.initial(sizes), recurrent.class_edges(sizes)
    units = max(1.0, sizes.sum() / SHARD_TOKENS)
    rounds = 2 + int(math.log2(units)) // 2
    shards = max(1, round(units / rounds))
    rows = training_rows(blocks, unseen, rounds, shards)
    for turn in range(rounds):
        mean = averaged(trained_copies(rows, model, edges, turn), shards)
        if mean is not None:
            model = recurrent.shaped(mean, edges)
    removed(rows)
    return model


def language_model_scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text).

    held_out: a condition on doc_id; by default crc32(doc_id as text) mod 7 = 2. The model learns from the other rows, those with a null
    doc_id among them. Null and empty texts are the end token alone. Repeated rows are each scored (and learnt from); other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    blocks = written(packed(rows), "blocks")
    buckets = max(1, round((blocks.agg(F.sum("n_words")).first()[0] or 0) / PAIRS))
    totals = counted(blocks, buckets)
    facts = corpus_facts(totals)
    in_symbols = written(coded(blocks, totals, buckets, spark.sparkContext.broadcast(facts)), "symbols")
    removed(blocks, totals)
    model, edges = fitted(in_symbols, facts["sizes"], int(facts["numbers"][-1])), recurrent.class_edges(facts["sizes"])
    final = spark.sparkContext.broadcast(recurrent.flat(model))

    def scored(batches):
        model = recurrent.shaped(final.value, edges)
        for batch in slices(batches, 1):
            lengths = batch.column("lengths")[0].values.to_numpy()
            found = recurrent.log_probabilities(model, edges, documents_of(batch))
            own = {c: batch.column(c)[0].values for c in ("ids", "held", "base", "known", "rare")}
            score = (found + own["rare"].to_numpy()) / np.log(10)
            yield pa.RecordBatch.from_arrays([own["ids"], own["held"], pa.array(lengths.astype(np.int64)), own["known"], own["base"], pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = in_symbols.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["n"]).cast("long").alias("train_tokens"), "base_score", "score")
