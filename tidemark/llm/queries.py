"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.dedup import id_part, page_part, repeats
from tidemark.llm.leakage import leaks
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import pack
from tidemark.llm.residue import residue
from tidemark.llm.split import split_chunks, split_oversized
from tidemark.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    near = nearest(table(spark, sf, "rag_chunks"), key="id", vector="embedding", dim=512, k=5, least=0.70)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    cut = split_oversized(table(spark, sf, "rag_chunks"), key="id", text="content")
    return cut.select(F.col("id").alias("chunk_id"), "boundary").distinct()


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_chunks(table(spark, sf, "rag_chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "rag_documents")
    parts = [id_part(F.col("external_id"), F.col("source")), page_part(F.col("url"))]
    pairs = repeats(docs, doc="id", ts="ingested_at", parts=parts)
    return pairs.select(F.least("doc", "repeats").alias("id_a"), F.greatest("doc", "repeats").alias("id_b")).distinct()


def p7_windows(spark: SparkSession, sf: str) -> DataFrame:
    placed = pack(table(spark, sf, "documents"), key="doc_id", size="n_tokens", capacity=2048)
    return placed.select("doc_id", "piece", F.col("first_unit").alias("first_token"), F.col("units").alias("n_tokens"), F.col("container").alias("window_id"))


def _leaks(spark: SparkSession, sf: str, clean: bool) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), key="doc_id", text="text", item_key="item_id", item_text="text", clean=clean, max_coverage=0.5)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf, False).select("doc_id", F.explode("items").alias("item_id")).distinct()


def p8_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Every leaking text with its matched spans, the share of it they cover, and what is left without them: null where they are most of it."""
    return _leaks(spark, sf, True).select("doc_id", "spans", "coverage", "rest")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents"), key="doc_id", text="text").select("doc_id").distinct()


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p5_found": p5_found, "p7_windows": p7_windows, "p8_found": p8_found, "p8_removed": p8_removed, "p9_found": p9_found}


_LONG = "length(replace(x, chr(2), 'ab')) > 2000"  # chr(2) stands for a line break of two characters
_NL = r"[\x02\n\r]"

_P2_SQL = rf"""
with c as (select id, replace(content, chr(13) || chr(10), chr(2)) t from rag_chunks),
a as (select id, list_filter([t], lambda x: {_LONG}) l from c),
p as (select id, list_filter(regexp_split_to_array(l[1], '{_NL}([ \t]*{_NL})+'), lambda x: {_LONG}) l from a where len(l) > 0),
n as (select id, l p, list_filter(flatten(list_transform(l, lambda t: regexp_split_to_array(t, '{_NL}'))), lambda x: {_LONG}) l from p),
s as (select id, p, l n, list_filter(flatten(list_transform(l, lambda t: string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: {_LONG}) l from n),
w as (select id, p, n, l s, list_filter(flatten(list_transform(l, lambda t: regexp_split_to_array(t, '\s+'))), lambda x: {_LONG}) w from s)
select distinct id chunk_id, case when len(p) = 0 then 'paragraph' when len(n) = 0 then 'line' when len(s) = 0 then 'sentence' when len(w) = 0 then 'word' else 'inside_word' end boundary from w
"""

_HIDDEN = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]"

_P8_SQL = rf"""
with d as (select doc_id id, regexp_extract_all(lower(regexp_replace(text, '{_HIDDEN}', '', 'g')), '[\p{{L}}\p{{N}}]+') w from documents where text is not null),
i as (select item_id id, regexp_extract_all(lower(regexp_replace(text, '{_HIDDEN}', '', 'g')), '[\p{{L}}\p{{N}}]+') w from eval_items where text is not null),
di as (select distinct id, array_to_string(w[k:k + 12], ' ') g from (select id, w, unnest(range(1, len(w) - 11)) k from d where len(w) >= 13)),
ii as (select distinct id, array_to_string(w[k:k + 12], ' ') g from (select id, w, unnest(range(1, len(w) - 11)) k from i where len(w) >= 13))
select distinct di.id doc_id, ii.id item_id from di join ii using (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2_SQL, "p8_found": _P8_SQL}
