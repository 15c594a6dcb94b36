"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelens.llm import bpe, language, lexical, neighbours, packing, quality, resampling, sharding, simhash, suffix_dedup, token_counts, token_files
from tidelens.llm._spark import documents, shared_folder
from tidelens.llm.substring_dedup import remove_repeats

#: The public ranks that are encoded by.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The public byte-level vocabulary and the id that ends a document.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.digests(token_files.read_token_files(spark, path))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text; a token across lines counts where it begins."""
    return token_counts.section_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_ID)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_language_id, op3_byte_bpe, op4_token_files, op5_sharding, op6_quality_rules, op7_token_counts, op8_best_fit_packing, op9_simhash, op10_nearest_neighbours, op11_importance_resampling, op12_lexical_search, op13_suffix_dedup)
    return {f.__name__: f for f in own}


#: CRC-32 byte by byte over each distinct run of words.
RESAMPLING_SQL = r"""
with crc_table as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
), texts as (
    select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), words as (
    select side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from texts
), runs as (
    select side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as feature from words
), counted as (
    select side, id, feature, count(*) as n from runs group by all
), hexes as (
    select feature, hex(feature) as h from (select distinct feature from counted)
), hashed as (
    select feature, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h), 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from hexes, crc_table
), placed as (
    select side, id, bucket, sum(n)::bigint as n from counted join hashed using (feature) group by all
), totals as (
    select coalesce(sum(n) filter (side = 'd'), 0)::double as s_all, coalesce(sum(n) filter (side = 'b'), 0)::double as t_all from placed
), gains as (
    select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain
    from (select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from placed group by bucket), totals
), weighed as (
    select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from placed join gains using (bucket) where side = 'd' group by id
), scored as (
    select w.id as doc_id, len(w.w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
    from words w left join weighed on w.id = weighed.id where side = 'd'
), ranked as (
    select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as eligible from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when place <= 5 * eligible // 100 then place end::bigint as "rank" from scored left join ranked using (doc_id)
"""


LEXICAL_SQL = r"""
with texts as (
    select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), words as (
    select side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from texts
), held as (
    select id as doc_id, term, count(*) as tf from words where side = 'd' group by all
), asked as (
    select id as item_id, term, count(*) as times from words where side = 'b' group by all
), sizes as (
    select doc_id, sum(tf)::bigint as n from held group by doc_id
), totals as (
    select count(*) as n_docs, sum(n)::bigint as n_all from sizes
), weights as (
    select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from held, totals group by term
), scores as (
    select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all))))::bigint as score
    from asked join held using (term) join sizes using (doc_id) join weights using (term), totals group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as "rank", doc_id, score
from scores where score > 0 qualify "rank" <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": RESAMPLING_SQL, "op12_lexical_search": LEXICAL_SQL}
