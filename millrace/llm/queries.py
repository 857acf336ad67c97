"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import hmm, langid, media, merkle, mixing, ngram_join, packing, phrases, quality, setsketch, substring, topk, warc
from millrace.llm.common import read, remainder

WORD = mixing.WORD


def tokenizer_path() -> str:
    """The vocabulary of the public word-level tokenizer; it lies beside the installed libraries of every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), remainder("doc_id", 3) == 1)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(read(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages_of(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(read(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.proofs(merkle.build(docs, merkle.tampered())).drop("path")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join, "op2_quality": op2_quality, "op3_media": op3_media, "op4_packing": op4_packing, "op5_mixing": op5_mixing,
        "op6_substring": op6_substring, "op7_topk": op7_topk, "op8_hmm": op8_hmm, "op9_warc": op9_warc, "op10_langid": op10_langid,
        "op11_merkle": op11_merkle, "op12_phrases": op12_phrases, "op13_setsketch": op13_setsketch,
    }


SQL = {
    "op1_ngram_join": r"""
        with recursive d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
             s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) i from d)),
             n as (select doc_id, count(*) n from s group by 1),
             c as (select a.doc_id x, b.doc_id y, count(*) m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
             l as (select x, y, m, a.n nx, b.n ny from c join n a on a.doc_id = x join n b on b.doc_id = y where 5 * m >= 4 * (a.n + b.n - m)),
             r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
        select d.doc_id, least(d.doc_id, coalesce((select min(y) from r where x = d.doc_id), d.doc_id)) class_id,
               (select count(*) from l where x = d.doc_id) n_links, 1 + (select count(*) from l where x = d.doc_id and m = nx and m = ny) n_copies,
               coalesce((select n from n where n.doc_id = d.doc_id), 0) n_shingles
        from d""",
    "op5_mixing": rf"""
        with d as (select doc_id, coalesce('s' || source, 'n') s, source,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
                          md5('mix:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) k from documents),
             t as (select s, any_value(source) source, sum(size)::bigint source_size from d group by s),
             r as (select *, (1 + (row_number() over (order by source nulls last) - 1) % 3)::double w from t),
             o as (select *, 3.0::double * source_size cap, row_number() over (order by 3.0::double * source_size / w, source nulls last) i from r),
             l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by i rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by i rows between current row and unbounded following) level from o),
             m as (select min_by(level, i) level from l where cap / w > level),
             g as (select s, source_size, coalesce(least(cap, w * (select level from m)), cap)::double target from l),
             p as (select doc_id, size, source_size, target, coalesce(sum(size) over (partition by d.s order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) before,
                          case when source_size > 0 then floor(floor(target) / source_size) else 0 end passes from d join g on d.s = g.s)
        select doc_id, size, source_size, target,
               (passes * size + least(greatest(floor(target) - passes * source_size - before, 0), size))::bigint taken from p""",
    "op7_topk": """
        with e as (select row_number() over () u, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.u, q.vec_id query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::bigint score
                   from e q join e x on q.vec_id % 100 = 0 and x.u <> q.u)
        select query_id, (row_number() over (partition by u order by score desc, vec_id))::int as rank, vec_id, score
        from s qualify rank <= 10""",
    "op11_merkle": r"""
        with recursive d as (select *, source is null r, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
                                    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)) crc from documents),
             f as (select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
                          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') head,
                          coalesce(xor(crc, 4294967295) % 5 = 0, false) t from d),
             h as (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) changed, t from f),
             b as (select doc_id, leaf, case when t then changed else leaf end given, dense_rank() over (order by source nulls first) tree,
                          row_number() over (partition by source order by doc_id nulls first, leaf) - 1 p from h),
             n as (select tree, 0 l, p, leaf x from b union all
                   select tree, l + 1, p // 16, sha256(string_agg(x, '' order by p)) from (select *, count(*) over (partition by tree) c from n) where c > 1 group by tree, l, p // 16),
             s as (select tree, arg_max(x, l) subroot from n group by 1),
             m as (select 0 l, tree - 1 p, subroot x from s union all
                   select l + 1, p // 16, sha256(string_agg(x, '' order by p)) from (select *, count(*) over () c from m) where c > 1 group by l, p // 16),
             g as (select a.tree, a.l, a.p, coalesce(string_agg(o.x, '' order by o.p) filter (o.p < a.p), '') lo, coalesce(string_agg(o.x, '' order by o.p) filter (o.p > a.p), '') hi
                   from n a join n o on a.tree = o.tree and a.l = o.l and a.p // 16 = o.p // 16 where a.l < (select max(l) from n z where z.tree = a.tree) group by 1, 2, 3),
             k as (select a.l, a.p, coalesce(string_agg(o.x, '' order by o.p) filter (o.p < a.p), '') lo, coalesce(string_agg(o.x, '' order by o.p) filter (o.p > a.p), '') hi
                   from m a join m o on a.l = o.l and a.p // 16 = o.p // 16 where a.l < (select max(l) from m) group by 1, 2),
             u as (select doc_id, leaf, tree, p pos, 0 l, p, given x, '' proof from b union all
                   select doc_id, leaf, u.tree, pos, u.l + 1, u.p // 16, sha256(lo || x || hi), proof || lo || hi from u join g on u.tree = g.tree and u.l = g.l and u.p = g.p),
             v as (select tree, pos, doc_id, leaf, arg_max(x, l) x, arg_max(proof, l) proof from u group by 1, 2, 3, 4),
             w as (select tree, pos, doc_id, leaf, 0 l, tree - 1 p, x, proof from v union all
                   select tree, pos, doc_id, leaf, w.l + 1, w.p // 16, sha256(lo || x || hi), proof || lo || hi from w join k on w.l = k.l and w.p = k.p),
             z as (select tree, pos, doc_id, leaf, arg_max(x, l) folded_root, sha256(arg_max(proof, l)) proof_sha256 from w group by 1, 2, 3, 4)
        select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified
        from z join s on z.tree = s.tree cross join (select arg_max(x, l) root from m)""",
    "op12_phrases": r"""
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
             w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') w from p),
             t as (select lang, sum(len(w))::bigint n from w group by 1),
             f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') g, count(*) f
                   from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w cross join range(1, 5) r(k)) group by 1, 2, 3 having count(*) >= 30),
             g as materialized (select *, string_split(g, ' ') v from f),
             c as (select * from g where k > 1),
             u as (select c.lang, array_to_string(c.v[i:i + k2 - 1], ' ') g, k2, max(c.f) f from c cross join range(2, 4) r(k2) cross join range(1, 4) s(i)
                   where k2 < k and i <= k - k2 + 1 group by 1, 2, 3),
             s as (select c.lang, c.g, c.f a, l.f l, r.f r, (2000000 * c.f::hugeint // (l.f + r.f))::bigint score, m
                   from c cross join range(1, 4) x(m)
                   join g l on l.lang = c.lang and l.k = m and l.g = array_to_string(c.v[:m], ' ')
                   join g r on r.lang = c.lang and r.k = c.k - m and r.g = array_to_string(c.v[m + 1:], ' ')
                   left join u on u.lang = c.lang and u.g = c.g and u.k2 = c.k
                   where m < c.k and (u.f is null or 100 * u.f::hugeint < 80 * c.f::hugeint)),
             b as (select * from s qualify row_number() over (partition by lang, g order by score, m) = 1)
        select b.lang, row_number() over (partition by b.lang order by score desc, a desc, g) as rank, g phrase, a, l, r, n, score
        from b join t on t.lang = b.lang qualify rank <= 2000""",
    "op13_setsketch": r"""
        with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
             s as (select distinct doc_id, array_to_string(w[i:i + 1], ' ') g, len(w) = 1 one from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) i from d)),
             n as (select doc_id, count(*) n from s group by 1),
             c as (select a.doc_id x, b.doc_id y, count(*) m from s a join s b on a.g = b.g and a.one = b.one and a.doc_id <> b.doc_id group by 1, 2),
             l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * m >= 80 * (a.n + b.n - m)),
             r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
             k as (select doc_id, coalesce((select n from n where n.doc_id = d.doc_id), 0) n_shingles, least(doc_id, coalesce((select min(y) from r where x = doc_id), doc_id)) component_id from d)
        select *, doc_id = component_id kept from k""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) n from pages),
             g as (select sha1(html) d, max(page_id) top from p where n >= 1000 group by 1)
        select page_id, n::bigint payload_bytes, sha1(html) payload_digest,
               case when top <> page_id then 'revisit' else 'response' end record_type,
               case when top <> page_id then top end refers_to
        from p left join g on n >= 1000 and d = sha1(html)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


