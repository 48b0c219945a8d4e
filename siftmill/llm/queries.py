"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.ball_kmeans import ball_kmeans
from siftmill.llm.common import table
from siftmill.llm.decontaminate import contaminated
from siftmill.llm.licenses import HINTS, NOISE, RULES, SENTENCES, scan_licenses, sentence_forms
from siftmill.llm.lm import score_documents
from siftmill.llm.media import media_column
from siftmill.llm.mixing import mix, word_count
from siftmill.llm.near_dedup import near_duplicates
from siftmill.llm.quality import resample
from siftmill.llm.sharding import shard_documents
from siftmill.llm.spelling import spelling_variants
from siftmill.llm.substrings import remove_repeats
from siftmill.llm.token_planes import token_columns
from siftmill.llm.warc import build_warc

SHARDS = 16
BALLS, BALL_ROUNDS = 16, 3
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], (3, 2), 2


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 50, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0))
    return kept.withColumn("kept", F.lit(True))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(F.col("text")), MIX_WEIGHTS, MIX_SHARE, MIX_MOST).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_warc(table(spark, sf_dir, "pages"))
    return built.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_columns(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"), BALLS, BALL_ROUNDS, 64, 64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_quality_classifier, op3_sharding, op4_license_scan, op5_minhash_near_dedup, op6_mixing, op7_warc_derivatives, op8_decontamination, op9_media_columns, op10_lm_scoring, op11_token_planes, op12_spelling_variants, op13_ball_kmeans)
}

_HASH60 = "('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint"


def _jump(shards: int) -> str:
    return f"""
      select doc_id, last(shard order by step) as shard from (
        with recursive j(doc_id, state, shard, jump, step) as (
          select doc_id, (coalesce(doc_id, 0)::hugeint + 18446744073709551616) % 18446744073709551616, -1::bigint, 0::bigint, 0 from (select distinct doc_id from documents)
          union all
          select doc_id, s, jump, floor((jump + 1) * (2147483648.0::double / ((s // 8589934592) + 1)::double))::bigint, step + 1
          from (select *, (state * 2862933555777941757 + 1) % 18446744073709551616 as s from j where jump < {shards})
        ) select * from j
      ) group by doc_id"""


SHARDING_SQL = f"""
with a as ({_jump(SHARDS)}), b as ({_jump(SHARDS + 1)}),
crc as (
  with recursive t(i, k, c) as (
    select i, 0, i::bigint from range(256) r(i) union all
    select i, k + 1, case when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end from t where k < 8)
  select list(c order by i) as tab from t where k = 8)
select d.doc_id, coalesce(strlen(d.text), 0)::bigint + 1 as size,
  case when coalesce(d.text, '') = '' then 0::bigint else xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(d.text) + 1), lambda i: ('0x' || substr(hex(encode(d.text)), (2 * i - 1)::bigint, 2))::bigint)), lambda acc, x: xor((acc >> 8), tab[xor(acc & 255, x) + 1]))) end as text_crc32,
  'key' as law, a.shard::int as shard,
  (row_number() over (partition by a.shard order by {_HASH60.replace('doc_id', 'd.doc_id')} % 1, {_HASH60.replace('doc_id', 'd.doc_id')}, d.doc_id) - 1)::bigint as slot, b.shard::int as grown_shard
from documents d join a on a.doc_id is not distinct from d.doc_id join b on b.doc_id is not distinct from d.doc_id, crc
"""

MIXING_SQL = rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, {_HASH60} as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as i from s),
c as (select *, [3, 1, 2][(i % 3 + 1)::int]::bigint as w, 2 * source_size as cap, sum(source_size) over () * 3 / 2 as budget from w),
e as (select *, coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as before_, sum(w) over (order by cap / w, i rows between current row and unbounded following) as left_ from c),
f as (select *, w * (budget - before_) > cap * left_ as capped from e),
g as (select *, sum(case when capped then cap else 0 end) over () as cs, sum(case when capped then 0 else w end) over () as ws from f),
t as (select source, source_size, case when capped then cap::double else (w * (budget - cs))::double / ws::double end as target from g),
r as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole from d join t on d.source is not distinct from t.source),
q as (select *, target - whole * source_size as rest, sum(size) over (partition by source order by h range between unbounded preceding and current row) as cum from r)
select doc_id, size, source_size, target, (size * (whole + case when rest > 0 and cum <= rest then 1 else 0 end))::bigint as taken from q
"""


def _quoted(text: str) -> str:
    return "E'" + text.replace("\n", "\\n") + "'"


def license_sql() -> str:
    """Lines are numbered, and every known sentence is followed line by line; of overlapping ones the first and longest stays."""
    known = " union all ".join(f"select {_quoted(form)} as f, '{i}' as ident" for i, sentences in SENTENCES.items() for s in sentences for form in sentence_forms(s))
    groups: dict[str, list[str]] = {}
    for group, name, ids, never in RULES:
        # RE2 has no lookahead: a forbidden sentence is looked for after the last one of the rule.
        test = f"regexp_matches(seq, '{';' + '([a-z0-9_]+;)*'.join(x + ';' for x in ids)}')"
        for x in never:
            test += f" and not regexp_matches(seq, '{';' + '([a-z0-9_]+;)*'.join(y + ';' for y in [*ids, x])}')"
        groups.setdefault(group, []).append(f"when {test} then '{name}'")
    cases = ", ".join(f"case {' '.join(x)} end" for x in groups.values())
    return rf"""
with recursive k as ({known}),
p as (select row_number() over () as r, doc_id, text as t from documents where regexp_matches(text, '(?i){HINTS}')),
q as (select r, regexp_split_to_array(regexp_replace(t, '([.!?;:]+)([ \t\n\r]|$)', '\1' || chr(1) || '\2', 'g'), '[.!?;:]+\x01|\n[ \t\r]*\n') as parts from p),
u as (select r, unnest(parts) as part, generate_subscripts(parts, 1) as i from q),
l as (select r, i, unnest(string_split(part, chr(10))) as line, generate_subscripts(string_split(part, chr(10)), 1) as j from u where trim(part, ' \t\n\r' || chr(9) || chr(10) || chr(13)) <> ''),
n as (select r, i, j, trim(regexp_replace(lower(line), '{NOISE.replace('(?=[^a-z0-9]|$)', '([^a-z0-9]|$)')}', ' ', 'g')) as s from l),
o as (select r, s, row_number() over (partition by r order by i, j) as pos, dense_rank() over (partition by r order by i) as part from n where s <> ''),
w(r, a, pos, part, f, ident, done) as (
  select r, pos, pos, part, f, ident, length(s) from o join k on starts_with(f, s) and (f = s or substr(f, length(s) + 1, 1) in (' ', chr(10)))
  union all
  select o.r, a, o.pos, o.part, f, ident, done + 1 + length(s) from w join o on o.r = w.r and o.pos = w.pos + 1
  where starts_with(substr(f, done + 1), case when o.part = w.part then ' ' when o.part = w.part + 1 then chr(10) end || s) and (done + 1 + length(s) = length(f) or substr(f, done + length(s) + 2, 1) in (' ', chr(10)))),
h as (select distinct r, a, pos as z, ident from w where done = length(f)),
m as (select r, count(*) as n_sentences, string_agg(ident, ',' order by a) as sentence_ids, ';' || string_agg(ident, ';' order by a) || ';' as seq
  from h where not exists (select 1 from h x where x.r = h.r and x.a <= h.a and x.z >= h.z and (x.a < h.a or x.z > h.z)) group by r)
select doc_id, n_sentences, sentence_ids, array_to_string(list_filter([{cases}], lambda x: x is not null), ',') as licenses from m join p using (r)
"""


SUFFIX_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, p, array_slice(b, (p + 1)::bigint, (p + 50)::bigint) as s from (select doc_id, b, unnest(range(0, n - 49)) as p from d where n >= 50)),
m as (select s, min(doc_id) as first from w group by s),
k as (select distinct doc_id, p from w join m using (s) where first < doc_id),
g as (select doc_id, p, sum(case when p - before <= 50 then 0 else 1 end) over (partition by doc_id order by p) as g from (select *, lag(p) over (partition by doc_id order by p) as before from k)),
r as (select doc_id, g, min(p) as a, max(p) + 50 as e from g group by doc_id, g),
c as (select doc_id, e as a, coalesce(lead(a) over (partition by doc_id order by a), n) as z from r join d using (doc_id)
  union all select doc_id, 0, coalesce(min(a), any_value(n)) from d left join r using (doc_id) group by doc_id),
t as (select doc_id, string_agg(case when z > a then hex(array_slice(b, (a + 1)::bigint, z::bigint)) else '' end, '' order by a) as kept from c join d using (doc_id) group by doc_id),
x as (select doc_id, sum(e - a)::bigint as n_removed, count(*) as n_spans from r group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
from d join t using (doc_id) left join x using (doc_id)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

NEAR_SQL = f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:(i + 3)], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2) join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
reach(id, other) as (select doc_id, doc_id from w union select reach.id, e.b from reach join e on e.a = reach.other)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id, w.doc_id = min(other) as kept from w join reach on id = w.doc_id left join n on n.doc_id = w.doc_id group by w.doc_id
"""

LEAKS_SQL = f"""
with dw as (select doc_id, unnest(ws) as t, generate_subscripts(ws, 1) - 1 as p, len(ws) as dn from (select doc_id, {_WORDS} as ws from documents)),
iw as (select item_id, unnest(ws) as t, generate_subscripts(ws, 1) - 1 as q, len(ws) as n, least(16, len(ws)) as width from (select item_id, {_WORDS} as ws from benchmark)),
m as (select doc_id, item_id, p - q as shift, q, dn, n, width from dw join iw using (t)),
a as (select doc_id, item_id, shift, width, list(q) as qs, count(*) as whole, greatest(0, -shift) as lo, least(n, dn - shift) as hi from m group by doc_id, item_id, shift, width, dn, n having count(*) * 16 >= 13 * width),
v as (select *, unnest(range(lo, hi - width + 1)) as start from a where hi - lo >= width),
c as (select *, len(list_filter(qs, lambda x: x >= start and x < start + width)) as hits from v),
b as (select doc_id, item_id, shift, whole, lo, hi, width, max(hits) as most, arg_max(start, hits * 100000 - start) as start from c group by all having max(hits) * 16 >= 13 * width),
o as (select *, row_number() over (partition by doc_id, item_id order by whole desc, shift) as r from b)
select doc_id, item_id, whole::int as n_matched, (start + shift)::int as doc_start, start::int as item_start, (hi - lo)::int as length from o where r = 1
"""

_CRC_TABLE = """crc as (
  with recursive t(i, k, c) as (
    select i, 0, i::bigint from range(256) r(i) union all
    select i, k + 1, case when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end from t where k < 8)
  select list(c order by i) as tab from t where k = 8)"""


def _crc(text: str) -> str:
    step = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::bigint, 2))::bigint)"
    return f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {step}), lambda acc, x: xor((acc >> 8), tab[xor(acc & 255, x) + 1])))"


SPELLING_SQL = f"""
with recursive {_CRC_TABLE},
r as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as run from documents) group by all),
s as (select run, c, coalesce(doc_id::varchar, '') || ':' || run as said from r where length(run) >= 6),
h as (select run, c, {_crc('said')} as h from s, crc),
d as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
w as (select word, sum(c)::bigint as n from d group by word having length(word) >= 6 and sum(c) >= 5),
e as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
cut as (select distinct word, n, substr(word, 1, (i - 1)::bigint) || substr(word, (i + 1)::bigint) as rest from e),
gap as (select word, n, i, substr(word, 1, (i - 1)::bigint) || chr(1) || substr(word, (i + 1)::bigint) as rest from e),
near as (
  select a.word, b.word as near, b.n from gap a join gap b using (rest) where a.word <> b.word
  union select cut.word, w.word, w.n from cut join w on w.word = cut.rest
  union select w.word, cut.word, cut.n from cut join w on w.word = cut.rest),
best as (select word, count(*) as n_near, first({{'near': near, 'n': n}} order by n desc, near) as best from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.n >= 5 * w.n then best.near end as form, case when best.n >= 5 * w.n then best.n end as form_n from w left join best using (word)),
walk(word, here, depth) as (select word, word, 0 from f union all select walk.word, f.form, depth + 1 from walk join f on f.word = walk.here where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, root from f join (select word, arg_max(here, depth) as root from walk group by word) using (word)
"""


def _balls_sql() -> str:
    nearest = "(select vec_id, v, dist.c as c, dist.d as d from (select vec_id, v, (select {{'c': c, 'd': d}} from (select c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from {0}) order by d, c limit 1) as dist from k))"
    steps = []
    for t in range(BALL_ROUNDS):
        steps.append(f"""a{t} as {nearest.format(f"m{t}")},
u{t} as (select c, list(x order by i) as m from (select c, i, (s - ((s % n) + n) % n) // n as x from (select c, i, sum(x)::hugeint as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{t}) group by c, i)) group by c),
m{t + 1} as (select m{t}.c, coalesce(u{t}.m, m{t}.m) as m from m{t} left join u{t} using (c))""")
    return f"""
with k as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
m0 as (select row_number() over (order by h, v) - 1 as c, v as m from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, v from k) order by h, v limit {BALLS}),
{', '.join(steps)},
z as {nearest.format(f"m{BALL_ROUNDS}")}
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from z join m{BALL_ROUNDS} using (c)
"""


ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": SUFFIX_SQL, "op5_minhash_near_dedup": NEAR_SQL, "op8_decontamination": LEAKS_SQL, "op3_sharding": SHARDING_SQL, "op4_license_scan": license_sql(), "op6_mixing": MIXING_SQL, "op12_spelling_variants": SPELLING_SQL, "op13_ball_kmeans": _balls_sql()}
