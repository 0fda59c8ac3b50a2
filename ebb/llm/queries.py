"""The operators as registered queries, with DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from . import common
from .bpe import round_trip
from .ctw import lm_score
from .embed_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .merkle import verified_documents
from .ngram_join import ngram_join
from .packing import pack
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup_digests
from .token_files import read_tokens, write_tokens
from .toxicity import toxicity
from .url_filter import url_filter
from .whitening import whitened_components

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(common.table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return read_tokens(spark, write_tokens(common.table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0))


def op3_url_filter(spark, sf_dir):
    return url_filter(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_best_fit_packing(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, capacity=1024)


def op5_toxicity(spark, sf_dir):
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(common.table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_lm_scoring(spark, sf_dir):
    return lm_score(common.table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "documents"), WORD_BPE)


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup(common.table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(common.table(spark, sf_dir, "documents"), window=20)


def op11_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup_digests(common.table(spark, sf_dir, "documents"), depth=400)


def op12_merkle_manifest(spark, sf_dir):
    return verified_documents(common.table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitened_components(common.table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_files, op3_url_filter, op4_best_fit_packing,
                                   op5_toxicity, op6_ngram_jaccard_join, op7_lm_scoring, op8_bpe_round_trip, op9_embedding_dedup,
                                   op10_substring_dedup, op11_suffix_array_dedup,
                                   op12_merkle_manifest, op13_embedding_whitening)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
                      for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

ORACLE_SQL = {
    "op1_exact_dedup": f"""
with d as (select doc_id, length(coalesce(text, '')) as cp, {_NORM} as norm from documents),
k as (select *, row_number() over (partition by norm order by cp desc, doc_id) as pos,
             first_value(doc_id) over (partition by norm order by cp desc, doc_id) as keep_id,
             count(*) over (partition by norm) as group_size from d)
select doc_id, keep_id, group_size, pos = 1 as kept, sha256(norm) as text_sha256 from k
""",
    # runs of eight to one root per lang, then the same over the langs; crc32 bit by bit
    "op12_merkle_manifest": f"""
with recursive d as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos,
         count(*) over (partition by lang) as cnt,
         sha256({_FIELDS.format(text="text")}) as leaf,
         case when crc.c % 3 = 0 then sha256({_FIELDS.format(text=_LOWER)}) else sha256({_FIELDS.format(text="text")}) end as seen
  from documents, lateral (select xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384)))) as c) as crc),
nodes as (
  select 0 as lvl, lang, pos, leaf as h, cnt from d
  union all
  select lvl + 1, lang, pos // 8, sha256(string_agg(h, '' order by pos)), any_value((cnt + 7) // 8)
  from nodes where cnt > 1 group by lvl, lang, pos // 8),
subs as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as cnt from nodes where cnt = 1),
tops as (
  select 0 as lvl, pos, h, cnt from subs
  union all
  select lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), any_value((cnt + 7) // 8) from tops where cnt > 1 group by lvl, pos // 8),
steps as (
  select d.doc_id, n.lvl, string_agg(n.h, '' order by n.pos) filter (n.pos < d.pos >> (3 * n.lvl)) as before,
         string_agg(n.h, '' order by n.pos) filter (n.pos > d.pos >> (3 * n.lvl)) as after
  from d join nodes n on n.lang is not distinct from d.lang and n.cnt > 1 and n.pos >> 3 = d.pos >> (3 * n.lvl + 3)
  group by d.doc_id, n.lvl
  union all
  select d.doc_id, 100 + t.lvl, string_agg(t.h, '' order by t.pos) filter (t.pos < s.pos >> (3 * t.lvl)),
         string_agg(t.h, '' order by t.pos) filter (t.pos > s.pos >> (3 * t.lvl))
  from d join subs s on s.lang is not distinct from d.lang
  join tops t on t.cnt > 1 and t.pos >> 3 = s.pos >> (3 * t.lvl + 3) group by d.doc_id, t.lvl),
numbered as (select doc_id, coalesce(before, '') as before, coalesce(after, '') as after,
                    row_number() over (partition by doc_id order by lvl) as step from steps),
folds as (
  select doc_id, 1 as step, seen as h from d
  union all
  select f.doc_id, f.step + 1, sha256(n.before || f.h || n.after) from folds f join numbered n using (doc_id, step)),
folded as (select doc_id, max_by(h, step) as folded_root from folds group by doc_id),
proofs as (select doc_id, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from numbered group by doc_id)
select d.doc_id, d.leaf, s.h as subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.folded_root,
       f.folded_root = t.h as verified
from d join subs s on s.lang is not distinct from d.lang join tops t on t.cnt = 1
join folded f using (doc_id) left join proofs p using (doc_id)
""",
}
