"""Shards, packing, the pipeline and the registry."""

import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from raresift.llm import certified_packing, kd_shards

SF = "/root/testdata/sf0.001"
PATH = vocab.path("word_bpe_49k.json")


def test_shards_are_even_and_keep_equal_texts_together(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.md5((F.col("id") % 2500).cast("string")), (F.col("id") % 2500 % 40 + 1).cast("int")).alias("text")
    )
    hot = spark.range(6000, 9000).select(F.col("id").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    rows = docs.unionByName(hot)
    found = kd_shards.shard_report(rows).cache()
    sizes = [r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.08 * sum(sizes) / 16 and min(sizes) > 0.92 * sum(sizes) / 16
    split = found.join(rows, "doc_id").where("doc_id < 6000").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert split.where("n > 1").count() == 0
    slots = found.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n"), F.count("*").alias("m"))
    assert slots.where("a <> 0 or b <> m - 1 or n <> m").count() == 0 and found.count() == 9000
    odd = kd_shards.kd_shards(rows, shards=5).groupBy("shard").agg(F.sum("size").alias("b"))
    sizes = [r.b for r in odd.collect()]
    assert len(sizes) == 5 and max(sizes) < 1.08 * sum(sizes) / 5
    leaves = kd_shards.kd_shards(rows, target_bytes=sum(sizes) // 3).select("shard").distinct().count()
    assert leaves == 3


def test_shards_of_awkward_rows(awkward, no_rows):
    found = kd_shards.shard_report(awkward)
    assert found.count() == awkward.count() and kd_shards.shard_report(no_rows).count() == 0
    rows = {r.doc_id: r for r in found.where("doc_id is not null").collect()}
    assert rows[2].size == rows[3].size == 1 and rows[2].text_crc32 == 0
    assert rows[5].size == rows[6].size > 100_000  # heavier than a shard together, so they may be apart
    assert rows[7].text_crc32 == zlib.crc32(("é" * 300).encode()) and rows[7].size == 601


def test_chunk_ids_equal_the_tokenizer(spark):
    with open(PATH, encoding="utf-8") as file:
        text = file.read()
    tokenizer, own = Tokenizer.from_str(text), certified_packing.ChunkIds(text)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(4)
    letters = list("aB cé ñ\n\t'sthe中\x1c\x85 　 1२Σ́İ.,<|>!?-")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["It's a DOG'S life... don't! 3.5%", "<|endoftext|> x"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    for t in texts:
        assert np.frombuffer(own(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_bounds_never_exceed_a_packing_and_certify_easy_cases():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, rng.choice([200, 1100, 2049]), 300)
        bins, offsets, rooms = certified_packing.best_fit_decreasing(lengths, 2048)
        bound = certified_packing.lower_bound(lengths, 2048)
        assert -(-lengths.sum() // 2048) <= bound <= len(rooms) <= 1.25 * bound + 1
        fill = np.bincount(bins, lengths)
        assert (fill + rooms == 2048).all()
        for b in range(len(rooms)):
            own = np.sort(offsets[bins == b])
            assert own[0] == 0
    assert certified_packing.lower_bound(np.full(10, 1025), 2048) == 10  # no two fit, though the volume would
    assert certified_packing.lower_bound(np.full(9, 700), 2048) == 5 == len(certified_packing.best_fit_decreasing(np.full(9, 700), 2048)[2])


def check_packing(rows, expected_ids):
    rows = rows.toPandas()
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all() and group["length"].sum() <= 2048
    for doc, group in rows.dropna(subset=["doc_id"]).groupby("doc_id"):
        ids = expected_ids[doc]
        for r in group.itertuples():
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        assert group["length"].sum() % len(ids) == 0
    return rows


@pytest.mark.parametrize("per_part", [4096, 16])
def test_packing_is_whole_and_tight(spark, per_part):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rows = docs.collect()
    found = tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    ids = {r.doc_id: [*e.ids, 0] for r, e in zip(rows, found, strict=True)}
    packed = check_packing(certified_packing.pack_sequences(docs, PATH, per_part=per_part), ids)
    bound = certified_packing.lower_bound(packed["length"].to_numpy(), 2048)
    assert packed["length"].sum() == sum(map(len, ids.values())) and packed["sequence_id"].nunique() <= 1.02 * bound + 1


def test_packing_of_awkward_rows(awkward, no_rows):
    rows = certified_packing.pack_sequences(awkward, PATH).toPandas()
    assert (rows[rows["doc_id"].isin([2, 3, 4])]["length"] == 1).all() and rows["doc_id"].isna().sum() == 2
    assert len(rows[rows["doc_id"] == 1]) == 2 and certified_packing.pack_sequences(no_rows, PATH).count() == 0


def test_registry():
    names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(names, key=lambda n: (len(n.split("_")[0]), n)) and len(names) == 11
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "SimHash near-dedup", "secret scans", "best-fit packing"
    ]


def test_stages_on_awkward_rows(spark, awkward, no_rows):
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.secrets):
        kept = stage(spark, awkward, SF)
        assert kept.columns == awkward.columns and kept.count() <= awkward.count()
        assert stage(spark, no_rows, SF).count() == 0
    assert corpus_pipeline.packing(spark, awkward, SF).count() >= awkward.count()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, awkward, SF).collect()}
    assert kept == {1, 2, 5, 7, 8, None}  # 3 and 4 go with 2, 6 with 5
    spoken = corpus_pipeline.language_id(spark, awkward, SF)
    assert {r.doc_id for r in spoken.collect()} == {1, 5, 6, 7, 8, None}


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert 0.85 * before.count() <= kept.count() <= before.count(), name
    assert kept.where(F.length("text") != F.col("n_chars")).count() == 0
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows["doc_id"]) == {r.doc_id for r in kept.select("doc_id").collect()}
