import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from scanlake.llm import byte_bpe, common, mixing, substring_repeats, toxicity
from tests.llm.test_near_duplicates import brute as brute_near
from tests.llm.test_substring_repeats import brute as brute_repeats


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_toxicity_drops_what_it_predicts(stages, spark, sf_dir):
    before, after = stages[0]
    scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores if r.score < 0.5}
    assert 0.5 * before.count() < after.count() <= before.count()
    assert after.exceptAll(before).count() == 0


def test_near_duplicates_keep_one_of_each_group(stages):
    before, after = stages[1]
    want = {i for i, v in brute_near([(r.doc_id, r.text) for r in before.collect()]).items() if v[2]}
    assert {r.doc_id for r in after.collect()} == want


def test_repeats_are_cut(stages):
    before, after = stages[2]
    want = brute_repeats([(r.doc_id, r.text) for r in before.collect()])
    got = {r.doc_id: r for r in after.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert got.keys() == want.keys() and any(v[1] for v in want.values())
    for i, (n, gone, _) in want.items():
        assert len(got[i].text.encode().split()) == n - gone
        assert gone or got[i].text == texts[i]


def test_mixing_samples(stages):
    """The documents that a plain draw by the cells' probabilities keeps."""
    before, after = stages[3]
    rows = mixing.mixed(before, P.MIX, P.MIX_SHARE, public_tokenizers.path("piece_bpe_32k.model")).collect()
    draw = lambda i: int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / 16**13
    assert {r.doc_id for r in after.collect()} == {r.row.doc_id for r in rows if draw(r.row.doc_id) < r.probability}
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) - P.MIX_SHARE * total) < 0.01 * total
    assert after.exceptAll(before).count() == 0 and 0.5 * before.count() < after.count() <= before.count()


def test_encoding(stages):
    before, after = stages[4]
    bpe = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {r.doc_id: bpe.encode_ordinary(r.text) for r in before.collect()}
    got = after.collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_edge_rows_pass_every_stage(spark, edge_docs, sf_dir):
    docs = edge_docs
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() >= 4


def test_run_on_tables(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.count() > 50


def test_a_text_goes_to_workers_once_and_in_small_batches(spark, sf_dir):
    """The memory of a stage follows neither from 10,000 texts at once nor from two copies of each."""
    docs, key = spark.read.parquet(f"{sf_dir}/documents.parquet"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    many = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), *[F.lit("x").alias(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")], F.lit(11).alias("n_chars")).select(*docs.columns)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    spark.conf.unset(key)
    assert max(r.n for r in common.texts(many).mapInArrow(sizes, "n long").collect()) <= common.BATCH
    spark.conf.set(key, 7)
    try:
        common.texts(many)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)
    kept = tuple(docs.columns)
    for plan in (P.drop_toxic(spark, docs, sf_dir), substring_repeats.without_repeats(docs, *kept), byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, *kept), mixing.described(docs, public_tokenizers.path("piece_bpe_32k.model"))):
        node = plan._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != "MapInArrow":
            node = node.children().head()
        assert node.child().output().mkString(" ").count("text#") == 0  # within the row alone


def test_the_last_stage_takes_one_worker_a_task(spark, sf_dir):
    plan = P.encode(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
