"""Registered queries of the text operators, each over its whole table.

``QUERIES`` holds (name, build, DuckDB SQL or None).  SQL is given where it
can say the same: the others hash with XXH64, learn a model or need offsets of
regular-expression matches, and are tested against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, langid, lm, mixing, phrases, quality, secrets, simhash, substring_dedup, suffix_dedup,
               toxicity, urls, vector_codes)
from .common import read_table

#: Hosts whose pages make up the listed URLs of op6: the unwanted families
#: (spam, casino, bets, pills, adult, ads) by the label that names them.
LISTED_HOSTS = r"(^|\.)(spam|casino|adult|ads|free-bets|cheap-pills)[-.]"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.judge(docs, labels.filter("quality = 1")).drop("rid")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.listed_hosts(pages, LISTED_HOSTS))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "fingerprint", "component_id")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, *langid.train(docs))


OP3_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, h, length(h) // 2 as n from d),
p as (select doc_id, unnest(range(0, n - 199)) as i, h from s where n >= 200),
w as (select doc_id, i, substr(h, 2 * i + 1, 400) as x from p),
r as (select x from w group by x having count(*) > 1),
hit as (select doc_id, i from w semi join r using (x)),
far as (select doc_id, i, max(i + 200) over (partition by doc_id order by i
          rows between unbounded preceding and 1 preceding) as reach from hit),
part as (select doc_id, i, sum(case when reach is null or i > reach then 1 else 0 end)
          over (partition by doc_id order by i) as k from far),
span as (select doc_id, k, min(i) as a, max(i) + 200 as b from part group by doc_id, k),
gap as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as e from span),
agg as (select doc_id, sum(b - a) as removed, count(*) as spans, max(b) as last from span group by doc_id),
kept as (select g.doc_id, string_agg(substr(s.h, 2 * g.e + 1, 2 * (g.a - g.e)), '' order by g.a) as t
          from gap g join s using (doc_id) group by g.doc_id)
select s.doc_id, s.n as n_bytes, coalesce(a.removed, 0)::bigint as n_removed,
  coalesce(a.spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k.t, '') || substr(s.h, 2 * coalesce(a.last, 0) + 1))) as kept_sha256
from s left join agg a using (doc_id) left join kept k using (doc_id)
"""

OP4_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
             lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from d where len(w) >= 13),
x as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from p),
m as (select s, min(doc_id) as least from x group by s),
hit as (select x.doc_id, x.i from x join m using (s) where m.least < x.doc_id),
cov as (select distinct doc_id, unnest(range(i, i + 13)) as j from hit),
word as (select doc_id, unnest(range(1, len(w) + 1)) as j, unnest(w) as t from d),
kept as (select word.doc_id, string_agg(t, ' ' order by j) as t from word anti join cov using (doc_id, j)
          group by word.doc_id),
gone as (select doc_id, count(*) as n from cov group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(gone.n, 0)::bigint as n_removed,
  sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id) left join gone using (doc_id)
"""

OP6_SQL = r"""
with u as (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
c as (select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '')
      || regexp_replace(path, '(\.html?|/+)$', '') end as canonical from u),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit as (select c.page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
        from c join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        group by c.page_id),
spam as (select distinct canonical from c where regexp_matches(host, '(^|\.)(spam|casino|adult|ads|free-bets|cheap-pills)[-.]') and canonical is not null)
select c.page_id, c.host, c.path, fit.rule,
  coalesce(fit.verdict, case when spam.canonical is not null then 'block' else 'allow' end) as verdict,
  c.canonical,
  spam.canonical is not null as listed
from c left join fit using (page_id) left join spam on c.canonical = spam.canonical
"""

OP11_SQL = r"""
with d as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
x as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from p),
g as (select lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' ')))
        as phrase from x, unnest([1, 2, 3]) as u(s) where len(w) >= s),
c as (select lang, s, phrase, count(*) as a from g group by all),
total as (select lang, sum(a)::bigint as n from c where s = 1 group by lang),
cand as (select lang, s, phrase, a, string_split(phrase, ' ') as w from c where s >= 2 and a >= 10),
cut as (select lang, s, phrase, a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
        from (select *, unnest(range(1, s)) as k from cand)),
scored as (select cut.*, l.a as l, r.a as r, (1000000::hugeint * cut.a * cut.a) // (l.a::hugeint * r.a) as score
        from cut join c l on l.lang = cut.lang and l.phrase = first join c r on r.lang = cut.lang and r.phrase = rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, phrase, max(a) as most from (
        select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase
        from cand where s = 3) group by all),
kept as (select best.* from best left join inside using (lang, phrase)
        where best.s = 3 or most is null or 100 * most < 50 * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [f"""x as materialized (select vec_id, label, list_transform(embedding, lambda e: floor(4096 * e::double)::bigint) as v
      from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
    y as materialized (select vec_id, (j - 1) // (n // {parts}) as part, (j - 1) % (n // {parts}) as i, z from
      (select vec_id, len(v) as n, unnest(v) as z, unnest(range(1, len(v) + 1)) as j from x)),
    b0 as materialized (select part, k, i, z from y join
      (select vec_id, row_number() over (order by vec_id) - 1 as k from x order by vec_id limit {entries}) using (vec_id))"""]
    near = """select vec_id, part, (min(d * {e} + k) % {e})::bigint as k, min(d)::bigint as d from
      (select y.vec_id, y.part, b.k, sum((y.z - b.z) * (y.z - b.z)) as d from y join b{r} b using (part, i)
       group by all) group by all"""
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized ({near.format(e=entries, r=r)})")
        if r < rounds:
            steps.append(f"""b{r + 1} as materialized (select part, k, i, coalesce(m.z, b.z) as z from b{r} b left join
      (select part, k, i, floor(sum(y.z) / count(*))::bigint as z from y join a{r} using (vec_id, part) group by all) m
      using (part, k, i))""")
    return f"""with {", ".join(steps)},
    coded as (select vec_id, string_agg(printf('%02x', k), '' order by part) as code, sum(d)::bigint as error
      from a{rounds} group by vec_id)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
      (select sha256(string_agg(z::varchar, ',' order by part, k, i)) from b{rounds}) as codebooks_sha256
    from coded join x using (vec_id)"""


OP12_SQL = _op12_sql()

QUERIES: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = [
    ("op1_toxicity", op1_toxicity, None),
    ("op2_mixing", op2_mixing, None),
    ("op3_suffix_dedup", op3_suffix_dedup, OP3_SQL),
    ("op4_substring_dedup", op4_substring_dedup, OP4_SQL),
    ("op5_quality", op5_quality, None),
    ("op6_urls", op6_urls, OP6_SQL),
    ("op7_secrets", op7_secrets, None),
    ("op8_decontamination", op8_decontamination, None),
    ("op9_simhash", op9_simhash, None),
    ("op10_lm", op10_lm, None),
    ("op11_phrases", op11_phrases, OP11_SQL),
    ("op12_vector_codes", op12_vector_codes, OP12_SQL),
    ("op13_language_id", op13_language_id, None),
]
