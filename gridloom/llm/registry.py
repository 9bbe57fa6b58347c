"""The queries of this subpackage with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from gridloom.llm.bpe import encode_decode
from gridloom.llm.common import new_path, table
from gridloom.llm.embedding import near_vectors
from gridloom.llm.language import identify
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.packing import pack
from gridloom.llm.substring import dedup_substrings
from gridloom.llm.token_counts import count_tokens
from gridloom.llm.topk import exact_top_k
from gridloom.llm.warc import read_archive, write_archive


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents
), sets as (
  select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) end) as shingle
  from words where len(w) > 0
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id
  join sizes s on s.doc_id = a.doc_id join sizes t on t.doc_id = b.doc_id
  where 10 * s.n >= 8 * t.n and 10 * t.n >= 8 * s.n
  group by a.doc_id, b.doc_id, s.n, t.n having 100 * count(*) >= 80 * (s.n + t.n - count(*))
), both_ways as (
  select a, b from links union select b, a from links
), reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.b from reach r join both_ways l on r.other = l.a
)
select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join reach r on r.doc_id = d.doc_id group by d.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed WARC archive and read back."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with keyed as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages
), bits as (
  select page_id, html, max(page_id) over (partition by html) as first,
         list_reduce(list_transform(generate_series(0, 31), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
             (('0x' || substr(digest, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))) & 31)::integer, 1)),
           lambda a, b: a || b) as payload_digest
  from keyed
)
select page_id, octet_length(encode(html))::bigint as payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from bits
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded again."""
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of power-of-two lengths up to 2048."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, max_tokens=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in windows of thirteen that a smaller document holds too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, window=13).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), placed as (
  select doc_id, unnest(generate_series(1, len(w))) as pos, unnest(w) as word from words
), windows as (
  select doc_id, unnest(generate_series(1, len(w) - 12)) as pos,
         unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) as gram
  from words where len(w) > 12
), repeated as (
  select doc_id, pos, min(doc_id) over (partition by gram) < doc_id as gone from windows
), judged as (
  select p.doc_id, p.pos, p.word,
         coalesce(max(r.gone::integer) over (partition by p.doc_id order by p.pos rows between 12 preceding and current row), 0) = 1 as gone
  from placed p left join repeated r on p.doc_id = r.doc_id and p.pos = r.pos
)
select d.doc_id, count(pos)::bigint as n_words, (count(*) filter (where gone))::bigint as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '')) as kept_sha256
from documents d left join judged j on d.doc_id = j.doc_id group by d.doc_id
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the 20 others with the highest integer inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20, scale=64.0)


OP8_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as w from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), dims as (
  select vec_id, unnest(generate_series(1, len(w))) as t, unnest(w) as v from usable
), scored as (
  select q.vec_id as query_id, c.vec_id, sum(q.v * c.v)::bigint as score
  from dims q join dims c on q.t = c.t and q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0 group by all
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share, over the whole of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
with lines as (
  select doc_id, unnest(generate_series(1, len(parts))) as pos, unnest(parts) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
), judged as (
  select k.doc_id, k.pos, k.line, (c.key is not null and k.doc_id <> c.keeper) as dropped
  from keyed k left join common c on k.key = c.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""


def queries() -> dict:
    return {
        "op1_minhash": op1_minhash,
        "op2_warc": op2_warc,
        "op3_bpe": op3_bpe,
        "op4_packing": op4_packing,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_language": op6_language,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_top_k": op8_top_k,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op2_warc": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op8_top_k": OP8_SQL, "op10_line_dedup": OP10_SQL}
