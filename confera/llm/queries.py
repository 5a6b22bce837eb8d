"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confera.llm.common import table
from confera.llm.divergence import source_divergence
from confera.llm.exact_dedup import exact_dedup
from confera.llm.imatch import COMMONEST, FAMILIES, PRIME, RAREST, edit_study, multipliers
from confera.llm.importance import importance_scores
from confera.llm.line_dedup import repeated_units
from confera.llm.mixing import mix
from confera.llm.packing import pack
from confera.llm.quality_rules import base_failed, quality_rules, text_statistics
from confera.llm.revisits import resolve_revisits
from confera.llm.simhash import near_duplicates
from confera.llm.sstable import token_store
from confera.llm.toxicity import toxicity
from confera.llm.url_filter import FIRST, SECOND, ZONES, unwanted_hosts, url_filter


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BLOCKED_HOSTS = unwanted_hosts()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express: the statistics of its base rules and what they say."""
    stats = text_statistics(table(spark, sf_dir, "documents")).withColumn("base_failed", base_failed())
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


#: Words of a passage that op3 takes out: of a copied passage of 50 words, about as many lie in clauses that it holds whole.
PASSAGE_WORDS = 30


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per clause that goes with its passage, with its place in the original text and that of the one that stays."""
    return repeated_units(table(spark, sf_dir, "documents"), unit="clause", min_run_words=PASSAGE_WORDS).drop("text_hash")


def line_dedup_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator by its defaults: every repeated line with a word goes, however short."""
    return repeated_units(table(spark, sf_dir, "documents")).drop("text_hash")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of every page, by a fixed rule: a full response and two not-modified revisits in the days after.

    Every third page has a second full response two days later, every ninth of which has changed, so revisits choose between
    two; every fifth page has a revisit before its first response. The first revisit carries the first response's ETag as a
    weak one; the second only Last-Modified or, for every fourth page, an ETag that no response has; the early one nothing.
    """
    page, html = F.col("page_id"), F.coalesce(F.col("html"), F.lit(""))
    tag, changed = F.substring(F.md5(html), 1, 12), F.substring(F.md5(F.concat(html, F.lit("v2"))), 1, 12)
    at = 1_600_000_000 + page * 600
    text = lambda c: c.cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = lambda **k: F.map_filter(F.create_map(*[x for n, c in k.items() for x in (F.lit(n.replace("_", "-")), c)]), lambda _, v: v.isNotNull())
    record = lambda n, ts, kind, headers: F.struct((page * 5 + n).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"))
    full = lambda ts, tag: fields(etag=quoted(tag), last_modified=text(ts - 1000), content_length=text(F.length("html")), cache_control=F.lit("max-age=60"), date=text(ts))
    later, last, second, early = at + 86_400 * (1 + page % 5), at + 86_400 * 7, at + 86_400 * 2, at - 3600
    weak = fields(etag=F.concat(F.lit("W/"), quoted(tag)), content_length=F.lit("0"), cache_control=F.lit("max-age=90"), date=text(later))
    other = fields(etag=F.when(page % 4 == 0, F.lit('"none"')), last_modified=text(at - 1000), date=text(last))
    again = F.when(page % 3 == 0, record(3, second, "response", full(second, F.when(page % 9 == 0, changed).otherwise(tag))))
    before = F.when(page % 5 == 0, record(4, early, "revisit", fields(date=text(early))))
    rows = F.array_compact(F.array(record(0, at, "response", full(at, tag)), record(1, later, "revisit", weak), record(2, last, "revisit", other), again, before))
    return pages.select("url", F.explode(rows).alias("r")).select("url", "r.*")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("headers", lines)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of the documents that is drawn towards the benchmark's words and word pairs, and every document's score."""
    out = importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_study(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_revisits": op4_revisits,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_token_store": op10_token_store,
    "op11_importance": op11_importance,
    "op12_imatch": op12_imatch,
    "op13_divergence": op13_divergence,
    "line_dedup_every_line": line_dedup_every_line,
    "quality_statistics": quality_statistics,
}


def _units_sql(end: str) -> str:
    """Units that end with what the pattern matches; their places, words and normalised texts, with the rank of each."""
    return rf"""
with cut as (select doc_id, string_split(regexp_replace(text, '({end})', '\1' || chr(57344), 'g'), chr(57344)) as parts from documents),
units as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as unit from cut),
placed as (select doc_id, unit::int as unit, sum(length(part)) over (partition by doc_id order by unit)::bigint - length(part) as start, length(part)::int as length,
    trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from units),
ranked as (select *, len(string_split(norm, ' '))::int as words, row_number() over (partition by doc_id order by unit) as k, first_value(doc_id) over w as keep_doc_id,
    first_value(start) over w as keep_start, count(*) over (partition by norm) as copies, row_number() over w as nth from placed where norm <> '' window w as (partition by norm order by doc_id, unit)),
again as (select *, k - row_number() over (partition by doc_id order by k) as run from ranked where nth > 1)"""


#: The terms' bytes bit by bit: what a CRC takes in, eight steps a byte; and the CRC of a column `bits`.
_BITS = "flatten(list_transform(range(1, length(hex(encode(term))), 2), lambda i: [('0x' || substr(hex(encode(term)), i, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, bits), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "quality_statistics": r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, unnest(range(len(words) - 2)) as i, words from d where len(words) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, words[i + 1], words[i + 2], words[i + 3]) as times from w),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where times > 1) group by 1),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
s as (select d.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words from d join l using (doc_id) left join c using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s""",
    "op2_url_filter": rf"""
with words as (select {FIRST} as a, {SECOND} as b, {ZONES} as z),
unwanted as (select x || '-' || y || '.' || zone as bad from (select unnest(a) as x, b, z from words) w, unnest(b) as t(y), unnest(z) as u(zone)),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
rules as (select * from (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, rhost, rpath, rverdict)),
fits as (select p.page_id, p.host, p.path, r.rule, r.rverdict, row_number() over (partition by p.page_id order by length(r.rule) desc nulls last) as k
    from parts p left join rules r on (p.host = r.rhost or p.host like '%.' || r.rhost) and starts_with(p.path, r.rpath))
select page_id, host, path, rule, case when rule is not null then rverdict
    when exists (select 1 from unwanted where host = bad or host like '%.' || bad) then 'block' else 'allow' end as verdict
from fits where k = 1""",
    "op3_line_dedup": _units_sql(r"[.,;:!?][\x20\x09-\x0D]+|\n") + f""",
runs as (select *, sum(words) over (partition by doc_id, run) as run_words from again)
select doc_id, start, length, words, keep_doc_id, keep_start, copies from runs where run_words >= {PASSAGE_WORDS}""",
    "line_dedup_every_line": _units_sql(r"\n") + """
select doc_id, start, length, words, keep_doc_id, keep_start, copies from again""",
    "op4_revisits": r"""
with p as (select page_id, 1600000000 + page_id * 600 as t0, substr(md5(coalesce(html, '')), 1, 12) as tag, substr(md5(coalesce(html, '') || 'v2'), 1, 12) as changed, length(html) as n, regexp_replace(url, '#.*$', '') as bare from pages),
h as (select *, regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1) as head from p),
t as (select *, substr(bare, length(head) + 1) as tail from h),
c as (select page_id, t0, tag, changed, n, regexp_replace(regexp_replace(lower(head), '^(http://[^/?]*):80$', '\1'), '^(https://[^/?]*):443$', '\1')
    || regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(tail, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as params from t),
u as (select page_id, t0, tag, changed, n, path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as url from c),
full_ as (select page_id * 5 as id, t0 as ts, url, tag, n, (t0 - 1000)::varchar as lm from u
    union all select page_id * 5 + 3, t0 + 172800, url, case when page_id % 9 = 0 then changed else tag end, n, (t0 + 171800)::varchar from u where page_id % 3 = 0),
rev as (select page_id * 5 + 1 as record_id, t0 + 86400 * (1 + page_id % 5) as ts, url, tag as etag, 'W/"' || tag || '"' as shown, null as lm, 'max-age=90' as cc from u
    union all select page_id * 5 + 2, t0 + 86400 * 7, url, case when page_id % 4 = 0 then 'none' end, null, (t0 - 1000)::varchar, null from u
    union all select page_id * 5 + 4, t0 - 3600, url, null, null, null, null from u where page_id % 5 = 0),
j as (select r.*, f.id, f.ts as fts, f.tag as ftag, f.n, f.lm as flm,
    row_number() over (partition by r.record_id order by f.ts desc nulls last, f.id desc) as k from rev r left join full_ f on f.url = r.url and f.ts < r.ts),
s as (select *, case when id is null then 'no_base' when case when etag is not null then etag = ftag when lm is not null then lm = flm else true end then 'resolved' else 'mismatch' end as status from j where k = 1)
select record_id, url as canonical_url, ts, case when status = 'resolved' then id end as base_id, case when status = 'resolved' then fts end as base_ts, status,
    case when status = 'resolved' then 'cache-control=' || coalesce(cc, 'max-age=60') || ';content-length=' || n || ';date=' || ts || ';etag=' || coalesce(shown, '"' || ftag || '"')
        || ';last-modified=' || coalesce(lm, flm) end as headers from s""",
    "op7_exact_dedup": r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from n""",
    "op9_mixing": r"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, case when source is null then 'b' else 'a' || source end as name,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as draw from documents),
s as (select name, sum(size)::bigint as size, [3, 1, 2][(row_number() over (order by name) - 1) % 3 + 1]::double as w from d group by name),
-- Sources reach their caps in the order of cap by weight; the level is the first at which the next isn't above its cap.
o as (select *, sum(size) over () * 1.5::double as total, coalesce(sum(2 * size) over (order by 2 * size / w, name rows between unbounded preceding and 1 preceding), 0)::double as before,
    sum(w) over (order by 2 * size / w, name rows between current row and unbounded following) as rest_w, row_number() over (order by 2 * size / w, name) as k from s),
l as (select min(k) as k from o where (total - before) * w / rest_w <= 2 * size),
lev as (select total - before as rest, rest_w from o where k = (select k from l)),
t as (select o.name, o.size, case when o.k < (select k from l) then 2.0 * o.size else lev.rest * o.w / lev.rest_w end as target from o, lev),
p as (select name, size as source_size, target, case when size > 0 then least(floor(target / size), 2)::bigint else 0 end as whole from t),
r as (select d.*, p.source_size, p.target, p.whole, greatest(0, p.target - p.whole * p.source_size) as rest,
    sum(d.size) over (partition by d.name order by d.draw)::bigint as upto from d join p using (name))
select doc_id, size, source_size, target, size * (whole + (case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end)) as taken from r""",
    "op11_importance": rf"""
with texts as (select 'd' as side, doc_id as id, coalesce(text, '') as text from documents union all select 'b', item_id, coalesce(text, '') from benchmark),
w as (select side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts),
f as (select side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as term from w),
terms as (select term, {_CRC} % 10000 as bucket from (select term, {_BITS} as bits from (select distinct term from f))),
c as (select side, id, bucket, count(*) as n from f join terms using (term) group by all),
g as (select bucket, coalesce(sum(n) filter (side = 'd'), 0) as s, coalesce(sum(n) filter (side = 'b'), 0) as t from c group by bucket),
total as (select sum(s) as s, sum(t) as t from g),
gain as (select bucket, floor(1000 * ln((g.t + 1)::double * (total.s + 10000)::double / ((g.s + 1)::double * (total.t + 10000)::double)))::bigint as gain from g, total),
d as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as gains from c join gain using (bucket) where side = 'd' group by id),
scored as (select doc_id, len(words) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(floor(gains::double / n_features), 0)::bigint as weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h from (select id as doc_id, words from w where side = 'd') left join d on d.id = doc_id),
s as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () * 25 // 100 as most from s where n_words >= 20)
select s.doc_id, n_features, weight, score, case when rank <= most then rank end as rank from s left join r using (doc_id)""",
    "op12_imatch": rf"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n_chars from documents),
n as (select *, coalesce(lead(text) over w, first_value(text) over w) as next_text, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id from d
    window w as (order by doc_id rows between unbounded preceding and unbounded following)),
e as (select *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) as edited from n),
t as (select 'own' as kind, doc_id, text from e union all select 'edited', doc_id, edited from e),
w as (select kind, doc_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as words from t),
df as (select term, count(*) as df from (select unnest(words) as term from w where kind = 'own') group by term),
lexicon as (select term from df where df >= 2 and df * {RAREST} >= (select count(*) from documents) and df * {COMMONEST} <= (select count(*) from documents)),
pairs as (select kind, doc_id, unnest(words) as term from w),
band as (select kind, doc_id, list(term) as terms from pairs semi join lexicon using (term) group by all),
kept as (select kind, doc_id, list_sort(case when terms is not null then terms when len(words) > 0 then words else [' ' || text] end) as terms from w left join band using (kind, doc_id)),
coded as (select term, {_CRC} as code from (select term, {_BITS} as bits from (select distinct unnest(terms) as term from kept))),
each as (select kind, doc_id, i, terms[i] as term from (select kind, doc_id, terms, unnest(range(1, len(terms) + 1)) as i from kept)),
family as (select unnest(range({FAMILIES})) as k, unnest({multipliers()}) as a),
y as (select kind, doc_id, k, i, code * a % {PRIME} as y from each join coded using (term) cross join family),
m as (select kind, doc_id, k, 1::bigint << length(bin(min(y))) as below from y group by all),
h as (select kind, doc_id, k, substr(md5(string_agg(y::varchar, ' ' order by i)), 1, 8) as digest from y join m using (kind, doc_id, k) where y < below group by all),
f as (select kind, doc_id, substr(md5(array_to_string(any_value(terms), ' ')), 1, 8) || string_agg(digest, '' order by k) as fingerprint from h join kept using (kind, doc_id) group by kind, doc_id),
j as (select e.doc_id, n_chars, sha256(edited) as edited_sha256, a.fingerprint, b.fingerprint as edited_fingerprint, c.fingerprint as next_fingerprint
    from e join f a on a.kind = 'own' and a.doc_id = e.doc_id join f b on b.kind = 'edited' and b.doc_id = e.doc_id join f c on c.kind = 'own' and c.doc_id = e.next_id)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    len(list_filter(range({FAMILIES + 1}), lambda i: substr(fingerprint, i * 8 + 1, 8) = substr(edited_fingerprint, i * 8 + 1, 8))) / {FAMILIES + 1}.0::double as near_edited,
    len(list_filter(range({FAMILIES + 1}), lambda i: substr(fingerprint, i * 8 + 1, 8) = substr(next_fingerprint, i * 8 + 1, 8))) / {FAMILIES + 1}.0::double as near_next from j""",
    "op13_divergence": r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select doc_id, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by lang, term having count(distinct doc_id) >= 3),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
groups as (select lang, source from d group by all),
c as (select lang, source, term, count(*)::hugeint as n from w semi join kept using (lang, term) group by all),
size as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from groups g left join c using (lang, source) group by all),
p as (select s.lang, s.source, kept.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (s.total + v.v) as p, 1 + 1000000000::hugeint * (kept.n + 1) // (v.total + v.v) as q
    from size s join kept using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = kept.term),
f as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pair as (select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
own as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
rows as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from own),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from rows)
select * from ranked where part = 'pair' or rank <= 200""",
}
