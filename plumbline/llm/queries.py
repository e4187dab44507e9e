"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact_dups, html_text, lexical, line_dedup, mixing, near_dups, pii, quality, spelling, token_store, toxicity, url_filter
from plumbline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_url_filter(spark, sf):
    return url_filter.judged(table(spark, sf, "pages"))


@query
def op2_near_dups(spark, sf):
    return near_dups.near_duplicates(table(spark, sf, "documents")).drop("text_key")


@query
def op3_quality(spark, sf):
    return quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_toxicity(spark, sf):
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_exact_dups(spark, sf):
    return exact_dups.exact_duplicates(table(spark, sf, "documents"), digest_all=True)


@query
def op6_decontaminate(spark, sf):
    found = decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"), spread=decontaminate.MAX_EDITS)
    return found.drop("text_key")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_token_store(spark, sf):
    path = shared_folder(spark)
    token_store.write_store(table(spark, sf, "documents"), path, word_tokenizer())
    return token_store.read_documents(spark, path)


@query
def op8_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    drawn = mixing.mixed(docs)
    return drawn.select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__pass").alias("pass"),
        F.col("__block").alias("block"),
        F.col("__place").alias("place"),
    )


@query
def op9_html_text(spark, sf):
    return html_text.extracted(table(spark, sf, "pages"))


@query
def op10_pii(spark, sf):
    return pii.digest(pii.personal_data(table(spark, sf, "documents")))


@query
def op11_spelling(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query
def op12_line_dedup(spark, sf):
    rows = line_dedup.without_repeated_lines(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_lexical_search(spark, sf):
    return lexical.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# ---- SQL ----------------------------------------------------------------------------


def _url_sql() -> str:
    fits = " union all ".join(
        f"select '{verdict}' as verdict, '{rule}' as rule, '{rule.partition('/')[0]}' as rule_host, "
        f"'/{rule.partition('/')[2]}' as start"
        for verdict, rule in url_filter.RULES
    )
    link = url_filter.LINK.replace("'", "''")
    rest, damping = 100 - url_filter.DAMPING_PERCENT, url_filter.DAMPING_PERCENT
    # without any edge nothing flows and the seeds stand as they are
    return f"""
with recursive rules as ({fits}),
parsed as materialized (
  select row_number() over () as k, page_id, html,
    case when position('://' in url) > 0 then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*') else '' end as raw_host,
    case when position('://' in url) > 0 then regexp_extract(substr(url, position('://' in url) + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rows as materialized (select k, page_id, html, coalesce(translate(raw_host, '{url_filter.UPPER}', '{url_filter.LOWER}'), '') as host, coalesce(path, '') as path from parsed),
fit as (
  select k, arg_max(rule, (length(rule), rule)) as rule, arg_max(verdict, (length(rule), rule)) as verdict
  from rows join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, start) group by k),
fitted as materialized (select rows.*, rule, verdict from rows left join fit using (k)),
hosts as materialized (
  select host, count(*) filter (verdict = 'allow') as trusted, count(*) filter (verdict = 'block') as blocked
  from fitted group by host),
found as (
  select distinct host as u, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{url_filter.UPPER}', '{url_filter.LOWER}') as v from rows
  union select host, regexp_extract(host, '^[^.]*\\.(.*)$', 1) from hosts
  union select regexp_extract(host, '^[^.]*\\.(.*)$', 1), host from hosts),
edges as materialized (
  select distinct u, v from found where u <> v and u in (select host from hosts where host <> '') and v in (select host from hosts where host <> '')),
outs as (select u as host, count(*) as n_out from edges group by u),
ins as (select v as host, count(*) as n_in from edges group by v),
seeds as (
  select host, coalesce((trusted::hugeint * {url_filter.TOTAL} // nullif((select sum(trusted) from hosts), 0))::bigint, 0) as seed_t,
    coalesce((blocked::hugeint * {url_filter.TOTAL} // nullif((select sum(blocked) from hosts), 0))::bigint, 0) as seed_b from hosts),
rounds as (
  select 0 as i, host, seed_t, seed_b, seed_t as trust, seed_b as distrust, {4 * url_filter.TOTAL}::hugeint as moved from seeds
  union all
  select i + 1, host, seed_t, seed_b, new_t, new_b, sum(abs(new_t - trust) + abs(new_b - distrust)) over ()
  from (
    select r.*, (seed_t * {rest} + coalesce(t, 0) * {damping}) // 100 as new_t, (seed_b * {rest} + coalesce(b, 0) * {damping}) // 100 as new_b
    from rounds r left join (
      select host, sum(t)::bigint as t, sum(b)::bigint as b from (
        select v as host, trust // n_out as t, 0 as b from edges join rounds x on u = x.host join outs on outs.host = u
        union all
        select u as host, 0 as t, distrust // n_in as b from edges join rounds y on v = y.host join ins on ins.host = v
      ) group by host) g using (host)
    where moved > {url_filter.SETTLED} and (select count(*) from edges) > 0)),
scores as (select host, trust, distrust from rounds where i = (select max(i) from rounds))
select page_id, host, path, rule,
  coalesce(verdict, case when host <> '' and distrust > trust then 'block' else 'allow' end) as verdict,
  trust, distrust
from fitted left join scores using (host)"""


SQL["op1_url_filter"] = _url_sql()

SQL["op2_near_dups"] = r"""
with recursive words as (
  select row_number() over () as k, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as materialized (
  select k, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
shingles as materialized (select k, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.k as u, b.k as v, count(*) as n_both, any_value(a.n) as na, any_value(b.n) as nb
  from shingles a join shingles b on a.x = b.x and a.k < b.k group by a.k, b.k),
links as materialized (select u, v from pairs where 100 * n_both >= 75 * (na + nb - n_both)),
ways as materialized (select u, v from links union select v, u from links),
reach as (
  select k as u, k as v from sets
  union select reach.u, ways.v from reach join ways on reach.v = ways.u)
select s.doc_id, len(s.s)::bigint as n_shingles, m.component_id, coalesce(s.doc_id = m.component_id, false) as kept
from sets s join (
  select reach.u as k, min(t.doc_id) as component_id from reach join sets t on t.k = reach.v group by reach.u
) m using (k)"""

SQL["op5_exact_dups"] = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id is not distinct from first_value(doc_id) over w as kept, text_sha256
from rows
window w as (partition by text_sha256 order by n_chars desc, doc_id nulls last)"""


def _mix_sql() -> str:
    def draw(*parts: str) -> str:
        text = " || '|' || ".join(f"coalesce({p}::varchar, '~')" for p in parts)
        return f"('0x' || substr(md5({text}), 1, 15))::bigint"

    steps, span = [], 1.0
    for i in range(mixing.LOOKS):
        low = "0.0::double" if i == 0 else f"(select low from look{i - 1})"
        steps.append(f"""
grid{i} as (select {low} + {span!r}::double * i / {2**mixing.STEPS} as x from range(1, {2**mixing.STEPS}) t(i)),
look{i} as (
  select coalesce(min(x), {low} + {span!r}::double) - {span / 2**mixing.STEPS!r}::double as low,
    coalesce(min(x), {low} + {span!r}::double) as high
  from (select x, max(exp(x * ln(share)) * total / tokens) / sum(exp(x * ln(share))) as most from grid{i}, totals group by x)
  where most <= {mixing.MAX_REPEAT!r})""")
        span /= 2**mixing.STEPS
    return f"""
with words as materialized (
  select doc_id, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens,
    {draw("'mix'", "coalesce(source, '')", "doc_id")} as draw
  from documents),
facts as materialized (select doc_id, source, tokens, draw >> 48 as block, (draw >> 36) & {mixing.CELLS - 1} as part from words),
totals as materialized (
  select *, tokens / total::double as share from (
    select source, sum(tokens)::bigint as tokens, (sum(sum(tokens)) over ())::bigint as total from facts group by source having sum(tokens) > 0)),
{",".join(steps)},
powers as materialized (select *, exp((select high from look{mixing.LOOKS - 1}) * ln(share)) as power from totals),
quotas as (select source, tokens, floor(power / (select sum(power) from powers) * total)::bigint as quota from powers),
sources as materialized (select source, tokens, quota // tokens as passes, quota % tokens as rest from quotas),
blocks as (
  select source, block, passes, rest, sum(f.tokens) as tokens, {draw("'mix'", "source", "passes", "block")} as place
  from facts f join sources using (source) group by source, block, passes, rest),
upto as (select *, sum(tokens) over (partition by source order by place, block) as u from blocks),
cut as materialized (
  select source, rest - coalesce(max(u) filter (u <= rest), 0) as room,
    arg_min(block, (place, block)) filter (u > rest) as block, min(place) filter (u > rest) as place
  from upto group by source, rest),
parts as (
  select source, room, part, sum(sum(tokens)) over (partition by source order by part) as u
  from facts join cut using (source, block) group by source, room, part),
stops as (select source, min(part) filter (u > room) as stop_part from parts group by source),
drawn as (
  select f.*, passes + case
    when {draw("'mix'", "source", "passes", "f.block")} < cut.place then 1
    when {draw("'mix'", "source", "passes", "f.block")} = cut.place and f.block < cut.block then 1
    when f.block = cut.block and part < stop_part then 1 else 0 end as copies
  from facts f join sources using (source) join cut using (source) left join stops using (source)),
passed as (select doc_id, source, block, unnest(range(copies::bigint)) as pass from drawn)
select doc_id, source, pass, block, {draw("'mix'", "source", "pass", "block")} as place from passed"""


SQL["op8_mixing"] = _mix_sql()


SQL["op12_line_dedup"] = f"""
with rows as (select row_number() over () as k, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as materialized (select k, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as place from rows),
keyed as materialized (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') as key from lines),
firsts as materialized (select key, min(doc_id) as first from keyed where length(key) >= {line_dedup.LEAST_LETTERS} group by key having count(distinct doc_id) >= 2),
judged as (select keyed.*, coalesce(doc_id <> first, false) as gone from keyed left join firsts using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from judged group by k, doc_id"""


SQL["op13_lexical_search"] = rf"""
with docs as (
  select row_number() over () as k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
items as (
  select row_number() over () as i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark),
sizes as (select k, doc_id, len(terms) as n from docs where len(terms) > 0),
whole as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from sizes),
asked as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(terms) as term from items) group by i, item_id, term),
counts as materialized (
  select k, term, count(*)::bigint as tf from (select k, unnest(terms) as term from docs)
  where term in (select term from asked) group by k, term),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, whole group by term, big_n),
lengths as (select k, doc_id, 75 + (25 * n * big_n) // big_l as m from sizes, whole),
scores as (
  select i, item_id, doc_id, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join weights using (term) join counts using (term) join lengths using (k) group by i, item_id, doc_id, k)
select item_id, rank, doc_id, score from (
  select *, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank from scores where score > 0)
where rank <= {lexical.K}"""
