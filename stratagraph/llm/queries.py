"""The registered queries of the corpus operators, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, fim, html_text, jaccard, langid, licenses, mixing, ordinal, packing, substring
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard.classes(docs, n=3, num=90, den=100, lower=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


OP2_SQL = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id x, b.doc_id y, count(*) o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * o >= 90 * (p.n + q.n - o)),
e as (select x, y from l union select y, x from l),
r as (select doc_id, doc_id root from d union select e.y, r.root from r join e on e.x = r.doc_id),
k as (select doc_id, min(doc_id) over (partition by h) class_id from (select doc_id, sha256(string_agg(g, chr(10) order by g)) h from s group by doc_id)),
m as (select e.x doc_id, count(distinct b.class_id) n_links from e join k a on a.doc_id = e.x join k b on b.doc_id = e.y where a.class_id <> b.class_id group by e.x)
select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(root) component_id, coalesce(any_value(k.class_id), d.doc_id) class_id, coalesce(any_value(m.n_links), 0) n_links
from d join r using (doc_id) left join n using (doc_id) left join k using (doc_id) left join m using (doc_id) group by d.doc_id"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return substring.deduplicate(docs, keep=["doc_id"], digest="kept_sha256")


OP3_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
x as (select doc_id, w, unnest(range(1, len(w) - 18)) s from d),
g as (select doc_id, s, min(struct_pack(doc_id := doc_id, s := s)) over (partition by array_to_string(w[s : s + 19], ' ')) f from x),
m as (select distinct doc_id, unnest(range(s, s + 20)) p from g where f.doc_id < doc_id or f.s < s),
k as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
r as (select k.doc_id, string_agg(word, ' ' order by k.p) filter (m.p is null) t, count(m.p) n from k left join m on m.doc_id = k.doc_id and m.p = k.p group by k.doc_id)
select d.doc_id, len(w) n_words, coalesce(r.n, 0) n_removed, sha256(coalesce(r.t, '')) kept_sha256 from d left join r using (doc_id)"""


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = ordinal.fit(docs, read(spark, sf_dir, "labels"), "quality", "quality")
    got = ordinal.grade(docs, model, "quality", keep=["doc_id"], names=("expected_grade", "p_high"))
    return got.withColumn("kept", F.col("p_high") >= 0.5)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = ordinal.fit(docs, read(spark, sf_dir, "labels"), "toxic", "words")
    got = ordinal.grade(docs, model, "words", keep=["doc_id"], names=("severity", "p_toxic"))
    return got.withColumn("toxic", F.col("p_toxic") >= ordinal.TOXIC_FROM)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    trees = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), trees, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    got = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
with pat as (select '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' p),
d as (select doc_id, coalesce(regexp_extract_all({_LOW.format('text')}, p), []) w from documents, pat),
b as (select cast(item_id as varchar) item, regexp_extract_all({_LOW.format('text')}, p) w from benchmark, pat where text is not null),
bw as (select distinct item, least(10, len(w)) m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') g
       from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) s from b where len(w) > 0)),
dw as (select doc_id, s, m, array_to_string(w[s : s + m - 1], ' ') g
       from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) s from d, (select distinct m from bw) where len(w) >= m)),
h as (select doc_id, s, dw.m, item from dw join bw on dw.g = bw.g and dw.m = bw.m),
x as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + m)) p from (select distinct doc_id, s, m from h)) group by doc_id),
i as (select doc_id, count(distinct item) n, string_agg(distinct item, ',' order by item) items from h group by doc_id)
select d.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(i.n, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join x using (doc_id) left join i using (doc_id)"""

def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.transform(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore("output", "form"), 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) x from documents),
t as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w from d),
h as (select *, len(w) n, cast('0x' || x[1:8] as bigint) h1, cast('0x' || x[9:16] as bigint) h2, cast('0x' || x[17:24] as bigint) h3, cast('0x' || x[25:32] as bigint) h4 from t),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
      case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from h),
p as (select *, array_to_string(w[1 : a], '') p, array_to_string(w[a + 1 : b], '') m, array_to_string(w[b + 1 : n], '') s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(text) restored_sha256 from p"""

def op12_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


# a source is full if its part is above its top when all that fill up before it are; these come first by size over weight
OP12_SQL = r"""
with d as (select doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) size, sha256('42:' || coalesce(cast(doc_id as varchar), ''))[1:15] k from documents),
s as (select source, sum(size)::bigint source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 w from d group by source),
o as (select *, sum(source_size) over () t, sum(w) over () ws, coalesce(sum(3 * source_size) over r, 0) given, coalesce(sum(w) over r, 0) gone from s
      window r as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, 3 * source_size * (ws - gone) < w * (t - given) filled from o),
x as (select *, sum(case when filled then 3 * source_size else 0 end) over () g, sum(case when filled then 0 else w end) over () v from f),
y as (select source, source_size, case when filled then (3 * source_size)::double else (w * (t - g))::double / v::double end target from x),
z as (select *, floor(target + 0.5)::bigint budget from y),
p as (select *, coalesce(sum(size) over (partition by source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint before from d)
select doc_id, size, source_size, target, case when source_size = 0 then 0 else budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end::bigint taken
from p join z on p.source is not distinct from z.source"""

def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversations.digests(conversations.repair(rows, present="present"))


# crc32 bit by bit; then, from the last row backwards, for each role before a row (0 none, 1 s, 2 u, 3 a) the least (cost, audit) with its lines
OP13_SQL = r"""
with recursive c as (select conv_id, coalesce('=' || conv_id, '') key, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') w from conversations),
h as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(w, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 z from c),
d as (select conv_id, key, turn, case when z = 4 then 'user' else role end as role, case z when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when z = 3 then [0, 1] else [0] end) copy from h where z <> 0),
r as (select *, row_number() over (partition by key order by turn nulls first, role, sha256(text), copy) - 1 i, left(role, 1) l from d),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when row_number() over (partition by key, role, text order by i) > 1 then 2
  when not contains('.!?', regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)) then 3 else 0 end fault, coalesce(lag(l) over (partition by key order by i) || l not in ('su', 'ua', 'au'), false) bad,
  case l when 's' then 1 when 'u' then 2 when 'a' then 3 else 0 end own from r),
n as (select conv_id, key, count(f.i) n, coalesce(max(f.turn) - min(f.turn) + 1 - count(distinct f.turn), 0) gaps, count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated, count(*) filter (bad) illegal
  from (select distinct conv_id, key from c) left join (select * exclude (conv_id) from f) f using (key) group by conv_id, key),
g(q, t, many, line) as (values (0, 1, 0, ''), (0, 2, 0, ''), (0, 3, 1, E'user:\n'), (1, 2, 0, ''), (1, 3, 1, E'user:\n'), (2, 2, 1, E'assistant:\n'), (2, 3, 0, ''), (3, 2, 0, ''), (3, 3, 1, E'user:\n')),
b(q, cost, audit, body) as (values (0, 0, '', ''), (1, 4, 'II', E'user:\nassistant:\n'), (2, 2, 'I', E'assistant:\n'), (3, 0, '', '')),
e as (select key, n i, q, {'cost': cost::bigint, 'audit': audit, 'body': body} x from n, b union all
  select key, i, q, min(x) from (
    select e.key, f.i, e.q, {'cost': x.cost + 3, 'audit': 'D' || x.audit, 'body': x.body} x from e join f on f.key = e.key and f.i = e.i - 1
    union all
    select e.key, f.i, g.q, {'cost': x.cost + 2 * many + case when own = t then 0 else 2 end + case when fault = 3 then 1 else 0 end, 'audit': repeat('I', many) || case when own = t then 'K' else 'R' end || x.audit,
      'body': line || case when own = t then role when t = 2 then 'user' else 'assistant' end || ':' || text || E'\n' || x.body}
    from e join f on f.key = e.key and f.i = e.i - 1 join g on g.t = e.q where fault in (0, 3) and (own = t or t > 1)) group by key, i, q)
select conv_id, gaps, blank, duplicate, truncated, illegal, x.cost as cost, x.audit as audit, sha256(left(x.body, greatest(length(x.body) - 1, 0))) repaired_sha256 from n join e using (key) where e.i = 0 and e.q = 0"""

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_pack": op6_pack,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_mix_sources": op12_mix_sources,
    "op13_repair_conversations": op13_repair_conversations,
}
ORACLES = {"op1_license_scan": licenses.scan_sql(), "op2_jaccard_join": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op10_decontaminate": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_mix_sources": OP12_SQL, "op13_repair_conversations": OP13_SQL}
