"""The registered queries of this subpackage, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm import (
    automaton_dedup, chat, graph_search, mixing, packing, periodic, simhash, spelling, suffix_dedup, tokenfile, topk, toxicity,
    winnowing,
)
from evidlake.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold the template's own control strings."""
    probe = spark.range(2).selectExpr(
        "-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role",
        "'<|im_end|><|im_start|>assistant ok' as text",
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.prefix_targets(rows))


SQL["op1_prefix_targets"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, turn, role, '<|im_end|><|im_start|>assistant ok'
  from (values (0, 'user'), (1, 'assistant')) as t (turn, role)
), n as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    sum(32 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))
      over (w rows unbounded preceding) as prefix
  from c window w as (partition by conv_id order by turn, role, text)
)
select conv_id, max(n) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(prefix) filter (role = 'assistant' or k = n) as bigint) as formatted_chars
from n group by conv_id
"""


@query
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").where(topk.whole(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), topk.scaled(F.col("embedding")).alias("vector")
    )
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


SQL["op9_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10
"""


@query
def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.digest(table(spark, folder, "documents"))


@query
def op10_bin_slack_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.edited_fingerprints(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_automaton_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return automaton_dedup.dedup(table(spark, folder, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.groups(table(spark, folder, "documents"))


@query
def op12_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.collapse(periodic.with_planted_runs(table(spark, folder, "documents"))))
