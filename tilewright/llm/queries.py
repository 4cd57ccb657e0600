"""The queries of this subpackage, by name, and their SQL where SQL can express them. Each applies its operator to whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has plain turns, so each user turn is read as a call, the turn after it as its result if an assistant speaks there, and each call needs the call two turns before."""
    from tilewright.llm.tool_calls import link_calls

    talk = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    call_id = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    asked = F.struct(F.col("turn").alias("turn"), F.regexp_extract(text, "[A-Za-z]+", 0).alias("first"), F.length(text).alias("chars"))
    calls = talk.filter("role = 'user'").select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(text.contains("?"), "ask").otherwise("tell").alias("name"), F.to_json(asked).alias("arguments"))
    results = talk.filter("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", text.alias("content"))
    needs = calls.filter("turn >= 2").select("conv_id", "call_id", call_id(F.col("turn") - 2).alias("needs"))
    tell = {"type": "object", "required": ["turn", "first", "chars"], "additionalProperties": False, "properties": {"turn": {"type": "integer", "minimum": 0}, "first": {"type": "string", "minLength": 2}, "chars": {"type": "integer", "maximum": 300}}}
    return link_calls(calls, results, needs, {"tell": tell, "ask": tell})


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.language import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs.filter(~held_out))
    docs = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.quality import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, labels.filter(~held_out))
    return score(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.order_minhash import order_minhash

    return order_minhash(table(spark, sf_dir, "documents"))


def op7_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.word_pieces import count_pieces

    return count_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), lone_space=True)


def op8_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.token_files import token_digest, write_tokens

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_digest(spark, path)


def op9_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm.piece_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.quality_rules import apply_rules, train

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_kneser_ney_language": op2_kneser_ney_language,
    "op3_pairwise_quality": op3_pairwise_quality,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
    "op6_order_minhash": op6_order_minhash,
    "op7_word_piece_counts": op7_word_piece_counts,
    "op8_orc_token_files": op8_orc_token_files,
    "op9_piece_encode_decode": op9_piece_encode_decode,
    "op10_secret_scan": op10_secret_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_tool_calls": r"""
with recursive talk as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
), calls as (
  select conv_id, turn, call_id, s.name as name, s.first as first, s.chars as chars from (
    select conv_id, turn, conv_id || '/' || turn as call_id, min(struct_pack(
      name := case when contains(text, '?') then 'ask' else 'tell' end, first := regexp_extract(text, '[A-Za-z]+'), chars := length(text))) as s
    from talk where role = 'user' group by all)
), answers as (
  select conv_id, turn - 1 as turn, min(turn) as result_turn, count(*) as n_results, min(text) as content from talk where role = 'assistant' group by conv_id, turn
), depth as (
  select c.conv_id, c.turn, 0 as level from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
  union all select c.conv_id, c.turn, d.level + 1 from depth d join calls c on c.conv_id = d.conv_id and c.turn = d.turn + 2
), judged as (
  select *, concat_ws('; ', case when chars > 300 then '$.chars: range' end, case when length(first) < 2 then '$.first: length' end, case when turn < 0 then '$.turn: range' end) as problems,
    '{"chars":' || chars || ',"first":"' || first || '","turn":' || turn || '}' as arguments from calls
)
select conv_id, call_id, j.turn, name, level, row_number() over (partition by conv_id order by level, j.turn, call_id) - 1 as position, n_results is not null as linked, result_turn, coalesce(n_results, 0) as n_results,
  arguments, problems = '' as valid, problems,
  '{"role":"assistant","tool_calls":[{"function":{"arguments":' || to_json(arguments) || ',"name":"' || name || '"},"id":"' || call_id || '","type":"function"}]}' as call_message,
  '{"content":' || to_json(content) || ',"role":"tool","tool_call_id":"' || call_id || '"}' as result_message
from judged j join depth using (conv_id, turn) left join answers using (conv_id, turn)
""",
    "op5_minhash_near_duplicates": r"""
with recursive word as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from word
), size as (
  select doc_id, count(s) as n from (select doc_id from documents) left join shingle using (doc_id) group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by all
), link as (
  select x, y from common join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
), reach as (
  select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join link l on l.x = r.y
)
select doc_id, n as n_shingles, m as component_id, m = doc_id as kept
from size join (select x as doc_id, min(y) as m from reach group by x) using (doc_id)
""",
    "op13_collocations": r"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
), word as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece
), total as (
  select lang, sum(len(w)) as n from word group by lang
), phrase as (
  select lang, w[i:i+k-1] as p, count(*) as f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from word, (select unnest([1, 2, 3, 4, 5]) as k)) group by all having count(*) >= 100
), cut as (
  select c.lang, c.p, c.f as a, k, l.f as l, r.f as r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, len(p))) as k from phrase where len(p) > 1) c join total using (lang)
  join phrase l on l.lang = c.lang and l.p = c.p[1:k] join phrase r on r.lang = c.lang and r.p = c.p[k+1:len(c.p)]
), lowest as (
  select *, row_number() over (partition by lang, p order by score, k) as o from cut
), covered as (
  select lang, p[i:i+k-1] as p, max(f) as around from (select lang, p, f, k, unnest(range(1, len(p) - k + 2)) as i from (select *, unnest(range(2, len(p))) as k from phrase where len(p) > 2)) group by all
), ranked as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
  from lowest left join covered using (lang, p) where o = 1 and (around is null or 100 * around < 100 * a)
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
""",
}
