"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .decontaminate import decontaminate
from .divergence import source_divergence
from .infill import fill_in_middle, restored
from .jaccard import jaccard_classes
from .language import identify_languages
from .licenses import scan_licenses
from .phrases import remove_phrases
from .recipes import exact_duplicates
from .store import new_path
from .suffix import remove_repeats
from .token_counts import count_tokens
from .vectors import near_duplicates
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op3_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95).drop("recall")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(_table(spark, sf_dir, "documents"), n=13)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = exact_duplicates(docs, carry=["text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "rest.text_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_embedding_graph": op3_embedding_graph,
        "op4_warc": op4_warc,
        "op5_decontamination": op5_decontamination,
        "op6_token_counts": op6_token_counts,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_repeated_phrases": op9_repeated_phrases,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_source_divergence": op13_source_divergence,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

SQL = {
    "op3_embedding_graph": """with recursive e as (select vec_id, embedding::double[] v from embeddings),
l as (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, b) as (select vec_id, vec_id from e union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) n_links, min(r.b) component_id, e.vec_id = min(r.b) kept from e join r on r.a = e.vec_id group by e.vec_id""",
    "op4_warc": """with p as (select page_id, coalesce(html, '') h from pages), m as (select *, min(page_id) over (partition by h) f from p)
select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest, case when strlen(h) >= 100 and page_id > f then 'revisit' else 'response' end record_type, case when strlen(h) >= 100 and page_id > f then f end refers_to from m""",
    "op5_decontamination": f"""with d as (select doc_id, regexp_extract_all({LOWER}, {ALNUM}) ws from documents), i as (select item_id, regexp_extract_all({LOWER}, {ALNUM}) ws from benchmark where item_id is not null),
iw as (select item_id, ws, least(10, len(ws)) k from i where len(ws) > 0), ig as (select distinct item_id, k, array_to_string(ws[p:p + k - 1], ' ') g from (select *, unnest(range(1, len(ws) - k + 2)) p from iw)),
dg as (select doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) p from d, (select distinct k from iw))),
h as (select doc_id, item_id, p, k from dg join ig using (k, g)), c as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + k)) q from h) group by 1),
t as (select doc_id, count(*) n, string_agg(item, ',' order by item) s from (select distinct doc_id, item_id::varchar item from h) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(c.n, 0) n_hit, coalesce(t.n, 0) n_items, sha256(coalesce(t.s, '')) items_sha256, c.n is not null contaminated from d left join c using (doc_id) left join t using (doc_id)""",
    "op8_jaccard_join": f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, {SPACED}) ws from documents),
g as (select distinct doc_id, array_to_string(ws[p:p + k - 1], ' ') g from (select doc_id, ws, least(5, len(ws)) k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) p from w where len(ws) > 0)),
n as (select doc_id, count(*) n from g group by 1), x as (select a.doc_id a, b.doc_id b, count(*) i from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from x join n p on p.doc_id = a join n q on q.doc_id = b where 100 * i >= 75 * (p.n + q.n - i)), r(a, b) as (select doc_id, doc_id from w union select r.a, l.b from r join l on r.b = l.a)
select w.doc_id, coalesce(max(n.n), 0) n_shingles, min(r.b) component_id from w join r on r.a = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id""",
    "op9_repeated_phrases": f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) ws from documents), k as (select doc_id, p, array_to_string(ws[p:p + 12], ' ') g from (select *, unnest(range(1, len(ws) - 11)) p from w where len(ws) >= 13)),
f as (select g, min(doc_id) first_doc from k group by 1), c as (select distinct doc_id, unnest(range(p, p + 13)) q from k join f using (g) where doc_id > first_doc),
u as (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) q from w), t as (select doc_id, string_agg(x, ' ' order by q) s, count(*) n from u anti join c using (doc_id, q) group by 1)
select doc_id, len(ws)::bigint n_words, len(ws) - coalesce(t.n, 0) n_removed, sha256(coalesce(t.s, '')) kept_sha256 from w left join t using (doc_id)""",
    "op10_suffix_dedup": """with d as (select doc_id, encode(coalesce(text, '')) b, strlen(coalesce(text, ''))::bigint n from documents), w as (select doc_id, p, sha256(b[p:p + 199]) g from (select *, unnest(range(1, n - 198)) p from d where n >= 200)),
r as (select g from w group by g having count(*) > 1), s as (select doc_id, p, lag(p) over (partition by doc_id order by p) q from w semi join r using (g)), t as (select doc_id, p, sum(case when q is null or p > q + 200 then 1 else 0 end) over (partition by doc_id order by p) k from s),
v as (select doc_id, k, min(p) lo, max(p) + 200 hi from t group by 1, 2), e as (select doc_id, lo, hi, lag(hi) over (partition by doc_id order by lo) f from v union all select doc_id, n + 1, n + 1, (select max(hi) from v where v.doc_id = d.doc_id) from d),
m as (select doc_id, string_agg(hex(b[coalesce(f, 1):lo - 1]), '' order by lo, hi) h, sum(hi - lo)::bigint removed, (count(*) - 1)::bigint spans from e join d using (doc_id) group by 1)
select doc_id, n n_bytes, removed n_removed, spans n_spans, sha256(unhex(coalesce(h, ''))) kept_sha256 from m join d using (doc_id)""",
    "op11_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') t, sha256('1:' || doc_id) h from documents),
u as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') us, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
r as (select *, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) b,
case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from u),
p as (select *, array_to_string(us[1:a], '') x, array_to_string(us[a + 1:b], '') y, array_to_string(us[b + 1:], '') z from r)
select doc_id, len(us)::bigint n, form, case when form <> 'plain' then length(x) end prefix_chars, case when form <> 'plain' then length(y) end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256, sha256(t) restored_sha256 from p""",
    "op12_exact_dedup": """with d as (select doc_id, coalesce(text, '') t from documents), g as (select t, max(doc_id) keep_id, count(*) n from d group by t)
select doc_id, keep_id, n group_size, doc_id = keep_id kept, sha256(t) text_sha256 from d join g using (t)""",
    "op13_source_divergence": r"""with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source from documents),
w as (select doc_id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term, count(*) c from w group by 1, 2 having count(distinct doc_id) >= 3), c as (select lang, source, term, count(*) c from w semi join k using (lang, term) group by 1, 2, 3),
g as (select distinct lang, source from d), v as (select lang, count(*) v, sum(c) n from k group by 1), s as (select lang, source, sum(c) n from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) c, (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (coalesce(s.n, 0)::hugeint + v.v))::hugeint p, (1 + (1000000000::hugeint * (k.c + 1)) // (v.n::hugeint + v.v))::hugeint q
from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
x as (select a.lang, a.source, b.source item, coalesce((select sum((m.p - o.p) * (m.p - o.p) // o.p) from p m join p o on o.lang = m.lang and o.term = m.term where m.lang = a.lang and m.source = a.source and o.source = b.source), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source),
y as (select lang, source, term item, ((p - q) * (p - q) // q)::bigint as value from p where c > 0 and p > q)
select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from x
union all select * from (select lang, source, 'term' part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from y) where rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
