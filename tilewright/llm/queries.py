"""The operators' queries over the tables, and SQL for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, decontaminate, jaccard, line_dedup, suffix_dedup, token_counts, token_files, topk, toxicity, warc
from tilewright.runtime import ship, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), byte_fallback=True)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = warc.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_files": op2_token_files,
    "op3_topk": op3_topk,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op5_line_dedup": """
        with a as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        b as (select doc_id, lines, unnest(lines) as line, generate_subscripts(lines, 1) as p from a),
        c as (select doc_id, lines, line, p, sum(length(line)) over (partition by doc_id order by p) as upto, upto - length(line) as before from b),
        k as (select doc_id, lines, p, (before + 60) * 1000000000 as need, upto * 1000000000 + p as have,
                (upto - 60) * 1000000000 + 999999999 as most, before * 1000000000 + p as left from c),
        r as (select x.doc_id, x.lines, x.p as a, y.p as z from k x asof join k y on x.doc_id = y.doc_id and x.need <= y.have
              union select x.doc_id, x.lines, y.p, x.p from k x asof join k y on x.doc_id = y.doc_id and x.most >= y.left),
        f as (select doc_id, a, z, min(struct_pack(d := doc_id, p := a)) over (partition by array_to_string(lines[a:z], chr(10))) as first from r),
        e as (select distinct doc_id, unnest(range(a, z + 1)) as p from f where struct_pack(d := doc_id, p := a) > first)
        select b.doc_id, count(*) as n_lines, count(e.p) as n_deleted,
          sha256(coalesce(string_agg(b.line, chr(10) order by b.p) filter (where e.p is null), '')) as kept_sha256
        from b left join e on b.doc_id = e.doc_id and b.p = e.p group by b.doc_id""",
    "op3_topk": """
        with v as (select vec_id, len(embedding) as d, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
                   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b using (d) where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""",
    "op4_suffix_dedup": """
        with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) as p from h)),
        f as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as first from w) where first < doc_id),
        i as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 50 then 1 else 0 end as new from f),
        g as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from i),
        r as (select doc_id, min(p) as a, max(p) + 50 as z from g group by doc_id, k),
        e as (select doc_id, z, coalesce(lead(a) over (partition by doc_id order by a), 1000000000000) as nxt from (select doc_id, a, z from r union all select doc_id, -1, 0 from h)),
        kept as (select e.doc_id, string_agg(substr(h.h, 2 * e.z + 1, 2 * least(e.nxt - e.z, 1000000000)), '' order by e.z) as k from e join h using (doc_id) group by e.doc_id),
        n as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from r group by doc_id)
        select h.doc_id, len(h.h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(k)) as kept_sha256
        from h join kept using (doc_id) left join n using (doc_id)""",
    "op8_jaccard_join": """
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select distinct doc_id, array_to_string(w[i + 1:i + least(4, len(w))], ' ') || '/' || least(4, len(w)) as s
              from (select doc_id, w, unnest(range(greatest(len(w) - 3, 1))) as i from w where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (s) where a.doc_id < b.doc_id group by all),
        l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r(a, b) as (select doc_id, doc_id from w union select r.a, e.b from r join e on e.a = r.b),
        m as (select a as doc_id, min(b) as component_id from r group by a)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from w join m using (doc_id) left join n using (doc_id)""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as h, min(page_id) over (partition by sha1(html)) as first from p),
        q as (select *, list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::bigint) as n from d)
        select page_id, payload_bytes::bigint as payload_bytes,
          array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as payload_digest,
          case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from q""",
    "op10_decontaminate": """
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
        bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i + 1:i + least(13, len(w))], ' ') as s
               from (select item_id, w, unnest(range(greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
        dw as (select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as s from (select doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) as i from w, (select distinct n from bw))),
        hit as (select doc_id, i, n, item_id from dw join bw using (n, s)),
        hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as x from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(x, '')) as items_sha256,
          coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from w left join hw using (doc_id) left join it using (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for k, f in QUERIES.items()}
