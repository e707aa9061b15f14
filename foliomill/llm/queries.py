"""The queries of this folder, each next to its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import alignment, ball_tree, gru_lm, host_rules, html_blocks, interleave, learned_ann, packing, repeats, simhash, sp_bpe, token_files, warc
from foliomill.llm.tokens import byte_level_encoder, word_end_encoder
from foliomill.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_ann.search(_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query(host_rules.SQL)
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed host_rejected kept".split()
    return host_rules.judge(_table(spark, sf_dir, "documents")).select(columns)


@query()
def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return packing.pack(
        _table(spark, sf_dir, "documents"), lambda: byte_level_encoder(path, pattern), end_id=0, vocabulary=50_257
    )


@query(repeats.SQL)
def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


@query()
def op5_sp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return sp_bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query(warc.SQL)
def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(warc.resolved(_table(spark, sf_dir, "pages"))))


@query()
def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


@query()
def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(_table(spark, sf_dir, "documents"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), lambda: word_end_encoder(path), end_id=2, partitions=partitions
    )
    return token_files.read_token_files(files)


@query()
def op11_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sides() -> tuple[alignment.Side, alignment.Side]:
        import public_tokenizers as names

        return alignment.byte_and_piece_sides(names.path("byte_bpe_50k.json"), names.PATTERN, names.path("piece_bpe_32k.model"))

    return alignment.aligned_documents(_table(spark, sf_dir, "documents"), sides)


@query(ball_tree.SQL)
def op12_sparse_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query(interleave.SQL)
def op13_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.assign_shards(_table(spark, sf_dir, "documents"))
