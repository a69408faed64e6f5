"""The registered queries of the corpus operators: thin layers over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .bpe import encode_documents
from .common import table
from .count_transducer import count_tokens
from .decontaminate import find_contamination
from .fill_middle import fill_in_middle
from .langid import identify
from .media import text_media_report
from .packing import pack_documents
from .pii import report
from .simhash import group
from .superkmer import remove_repeats
from .url_filter import filter_urls
from .warc import archive_report


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op4_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op5_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_report(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), keep_output=False)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_warc_records": op3_warc_records,
    "op4_bpe_encode": op4_bpe_encode,
    "op5_media_features": op5_media_features,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_alignment": op11_alignment,
    "op12_fill_middle": op12_fill_middle,
    "op13_packing": op13_packing,
}

#: The others need a tokenizer, a fitted model, XXH64 or match positions, which SQL has not; the tests hold them against
#: brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_warc_records": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        d as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
        m as (select payload_digest, payload_bytes, max(page_id) as last from d where payload_bytes >= 1000 group by all)
        select page_id, d.payload_bytes, d.payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type, case when last <> page_id then last end as refers_to
        from d left join m on d.payload_digest = m.payload_digest and d.payload_bytes = m.payload_bytes
    """,
    "op6_url_filter": """
        with r as (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
        p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        f as (select *, '.' || host as h from p),
        j as (select *, case when ends_with(h, '.example.net') and starts_with(path, '/en/') then 'example.net/en/' when ends_with(h, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
          when ends_with(h, '.org') and starts_with(path, '/fr/') then 'org/fr/' when ends_with(h, '.net') and starts_with(path, '/') then 'net/' end as rule from f)
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from j
    """,
    "op7_substring_dedup": """
        with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
        win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from w, lateral (select unnest(range(1, len(ws) - 11)) as i)),
        first as (select k, min(doc_id) as least from win group by k),
        hit as (select doc_id, i from win join first on win.k = first.k where least < doc_id),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from hit),
        word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
        kept as (select word.doc_id, string_agg(word, ' ' order by word.j) as t, count(*) as n from word left join gone on word.doc_id = gone.doc_id and word.j = gone.j where gone.j is null group by 1)
        select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id
    """,
    "op9_decontamination": """
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
        b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
        iw as (select item, least(10, len(ws)) as n, array_to_string(ws[i : i + 9], ' ') as k from b, lateral (select unnest(range(1, greatest(2, len(ws) - 8))) as i) where len(ws) > 0),
        sizes as (select distinct n from iw),
        dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as k from d, sizes, lateral (select unnest(range(1, len(ws) - n + 2)) as i)),
        hit as (select doc_id, dw.n, i, item from dw join iw on dw.n = iw.n and dw.k = iw.k),
        gone as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
        owner as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit where item is not null) group by 1)
        select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join gone on gone.doc_id = d.doc_id left join owner on owner.doc_id = d.doc_id
    """,
    "op12_fill_middle": """
        with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || cast(doc_id as varchar)) as h from documents),
        w as (select *, list_transform(regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'), lambda x: length(x)) as sizes, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substring(h, i, 8) as bigint)) as r from d),
        c as (select *, len(sizes) as n, least(r[1] % (len(sizes) + 1), r[2] % (len(sizes) + 1)) as a, greatest(r[1] % (len(sizes) + 1), r[2] % (len(sizes) + 1)) as b from w),
        f as (select *, cast(coalesce(list_sum(sizes[1 : a]), 0) as bigint) as p, cast(coalesce(list_sum(sizes[a + 1 : b]), 0) as bigint) as m,
          case when t = '' or regexp_matches(t, '<[PSM]>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form from c),
        o as (select *, case form when 'plain' then t when 'spm' then '<S>' || substring(t, p + m + 1) || '<P>' || substring(t, 1, p) || '<M>' || substring(t, p + 1, m)
          else '<P>' || substring(t, 1, p) || '<S>' || substring(t, p + m + 1) || '<M>' || substring(t, p + 1, m) end as out from f)
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m end as middle_chars, sha256(out) as output_sha256, sha256(t) as restored_sha256 from o
    """,
}
