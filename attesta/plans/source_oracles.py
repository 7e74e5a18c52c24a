"""DuckDB twins of the queries over payloads and stored records."""

from attesta.plans.oracle_views import with_views as wv

ORACLES: dict[str, str] = {}
O = ORACLES

_ASK = "select *, cast(event_id as varchar) as run_id, event_type || ' ' || user_id as query from log"

O["web_search_rows"] = wv("log", """
select run_id, query, cast(0 as bigint) as rank, 'Tavily answer: ' || query as title,
       'tavily://answer/' || replace(query, ' ', '_') as url, 'about ' || k as snippet, 'tavily-answer' as source,
       cast(null as bigint) as centi
from ask where k % 4 <> 0 and k % 17 <> 0
union all
select run_id, query, i, 'T' || i || ' of ' || event_id, 'https://w' || i || '.example.com/' || event_id, 'c' || k, 'tavily', k
from (select *, unnest(range(1, k % 3 + 1)) as i from ask where k % 17 <> 0)""", ask=_ASK)

O["chat_answer_rows"] = wv("log", """
select run_id, query, cast(0 as bigint) as rank, 'Perplexity answer: ' || query as title,
       'perplexity://answer/' || replace(query, ' ', '_') as url, 'said ' || k as snippet, 'perplexity-answer' as source
from ask where k % 5 <> 0
union all
select run_id, query, i, 'Perplexity citation ' || i, 'https://c' || i || '.example.com/', '', 'perplexity'
from (select *, unnest(range(1, least(k % 13, 10) + 1)) as i from ask)""", ask=_ASK)

O["html_result_rows"] = """
select cast(page_id as varchar) as run_id, 'q' as query, cast(0 as bigint) as rank, 'Page & ' || page_id as title,
       'https://p.example.com/' || page_id as url, 'Some <text> here' as snippet, 'duckduckgo' as source from pages
union all
select cast(page_id as varchar), 'q', 1, 'Two', 'https://q.example.com/' || page_id, '', 'duckduckgo' from pages"""

O["article_summary_rows"] = wv("log", """
select 'r' || user_id as run_id, event_type as query,
       row_number() over (partition by user_id, event_type order by event_id) - 1 as rank,
       'Title ' || event_id as title, case when k % 4 = 0 then 'https://en.wikipedia.org/wiki/Title_' || event_id
            else 'https://e.example.org/' || event_id end as url, 'text ' || k as snippet, 'wikipedia' as source
from log where k % 6 <> 0
qualify row_number() over (partition by user_id, event_type order by event_id) <= 10""")

O["normalized_result_rows"] = wv("log", """
select run_id, query, cast(0 as bigint) as rank, 'A' || k as title, '' as url, '' as snippet, 'cached' as source from ask
union all select run_id, query, 4, '', 'u', 's' || event_id, 'web' from ask""", ask=_ASK)

_AVAILABLE = """
select url, page_id, page_id % 3 = 2 as archived,
       case when page_id % 3 = 2 then 'https://a.example.org/' || page_id end as wayback_url,
       case when page_id % 3 = 2 then case when page_id % 2 = 0 then 1577923200 else 1577934245 end end as archived_at,
       case when page_id % 3 = 2 then '200' end as available_status from pages"""
O["archive_availability_rows"] = f"select * exclude (page_id) from ({_AVAILABLE})"
O["archive_hits_recorded"] = wv("src", """
select s.url, coalesce(a.wayback_url, s.wayback_url) as wayback_url,
       case when a.wayback_url is not null then a.archived_at else s.archived_at end as archived_at, s.fetched_at
from src s left join (
  select v.url, v.wayback_url, v.archived_at from (
    select * from av where page_id % 5 <> 0) v
  where archived) a on a.url = s.url""", av=_AVAILABLE)

O["captures_recorded"] = wv("src", """
select s.url, s.title, s.fetched_at,
       case when p.page_id % 8 = 0 then null when p.page_id % 4 = 0 then 'w' || p.page_id else s.wayback_url end as wayback_url,
       case when p.page_id % 4 = 0 then p.page_id else s.archived_at end as archived_at
from src s join pages p on p.url = s.url
union all
select 'https://new.example.com/' || page_id, '', page_id, 'n', page_id from pages where page_id % 9 = 0""")

O["upsert_runs"] = wv("log", """
select 'run' || user_id as id, arg_min(event_type, (tm, event_id)) as query, arg_min(tm, (tm, event_id)) as started_at,
       max(tm) as completed_at, cast(arg_min(k, (tm, event_id)) as int) as sources_count,
       cast(arg_max(k, (tm, event_id)) as int) as claims_count,
       nullif(arg_max(case when k % 3 = 0 then 'boom' else '' end, (tm, event_id)), '') as error,
       cast(arg_max(k, (tm, event_id)) as int) as llm_calls
from log group by user_id""")

O["cache_stored"] = wv("log", """
select cache_key, payload, sha256('{"a":' || event_id || ',"z":' || k || '}') as content_hash, tm as fetched_at, tm + 3600 as expires_at, cast(0 as bigint) as hits
from (select user_id || ':' || event_type as cache_key, '{"z": ' || k || ', "a" : ' || event_id || '}' as payload, event_id, k, tm from log where k % 5 <> 0)
qualify row_number() over (partition by cache_key order by tm desc, payload desc) = 1""")

O["remaining_evidence"] = wv("obs edges", """
select k.child_slug, k.parent_slug, coalesce(n, 0) as remaining_observations, e.agreement,
       coalesce(e.source_count, 0) as source_count, coalesce(e.domain_count, 0) as domain_count
from (select distinct child_slug, parent_slug from obs union select distinct child_slug, 'nowhere' from obs) k
left join (select child_slug, parent_slug, count(*) as n from obs where not quarantined group by 1, 2) o
  on o.child_slug = k.child_slug and o.parent_slug = k.parent_slug
left join edges e on e.child = k.child_slug and e.parent = k.parent_slug""")

O["request_keys"] = wv("amap", """
select p_partkey, 'web:search:' || coalesce(m.slug, 'n' || p_partkey) || ':' || case when p_partkey % 2 = 0 then 'deep' else '' end as cache_key
from part left join amap m on m.alias = 'n' || p_partkey""")

O["found_entities"] = wv("amap strains", """
select p.p_partkey, coalesce(s.slug, n.slug) as slug from (
  select p_partkey, case p_partkey % 3 when 0 then ' N' || p_partkey when 1 then upper(p_name) || ' ' || p_partkey
                         else 'nobody ' || p_partkey end as name from part) p
left join amap m on m.alias = regexp_replace(lower(trim(p.name)), '\\s+', '-', 'g')
left join strains s on s.slug = m.slug
left join (select lower(name) as l, min(slug) as slug from strains group by 1) n on n.l = lower(trim(p.name))""")

O["alias_release"] = wv("gated amap", """
select w.parent_slug, w.rows, w.held, w.gated, e.edges
from (select parent_slug, count(*) as rows, count(*) filter (where quarantined or still) as held,
             count(*) filter (where still) as gated from now group by 1) w
left join (select coalesce(p.slug, n.parent_slug) as parent_slug, count(distinct coalesce(c.slug, n.child_slug)) as edges
           from now n left join known p on p.alias = n.parent_slug left join known c on c.alias = n.child_slug
           where not (quarantined or still) group by 1) e on e.parent_slug = w.parent_slug""",
    now="select *, gate and parent_slug not in ('n3', 'n9') as still from gated",
    known="select alias, slug from amap union all values ('n3', 'n1'), ('n9', 'n7')")

O["research_claims"] = """
with p as (select p_partkey as n, p_partkey % 7 as s, 'https://r.example.com/' || p_partkey || '/' as u from part)
select cast(n as varchar) as run_id, stage, 'Kid ' || n as child, a || n as parent_a, b || n as parent_b,
       case when place >= 0 then u || place else 'https://en.wikipedia.org/wiki/Kid_' || n end as source_url, engine as source_engine
from p join (values (0, 1, 'Alpha', 'Beta', 0, 'web'), (1, 0, 'Mona', 'Nora', 0, 'web'), (1, 1, 'Gamma', 'Delta', 1, 'web'),
                    (2, 3, 'Foo', 'Bar', 9, 'web'), (3, 2, 'Ana', 'Bob', -1, 'wikipedia-full'), (4, 1, 'Alpha', 'Beta', 0, 'web'),
                    (6, 1, 'Gamma', 'Delta', 1, 'web')) as c(shape, stage, a, b, place, engine) on c.shape = p.s"""

O["research_sources"] = """
select cast(n as varchar) as run_id, cast(case s when 3 then 3 when 5 then 1 else 2 end as bigint) as visited,
       cast(case s when 5 then 1 else 2 end as bigint) as urls,
       case when s = 0 then 'Kid ' || n || ' is a hybrid cultivar from the coast. It flowers early.' end as summary,
       case when s = 0 then 'https://r.example.com/' || n || '/1' end as summary_source_url
from (select p_partkey as n, p_partkey % 7 as s from part)"""

O["claims_inserted"] = wv("rclaims", """
select child_slug, value, source_url, arg_min(milli, seq) as milli, min(seq) as created_at from (
  select regexp_replace(lower(child), '\\s+', '-', 'g') as child_slug, source_url, milli, seq,
         child || ' = ' || array_to_string(list_filter(list_concat([parent_a, parent_b], extras), lambda x: x <> ''), ' × ') as value
  from rclaims) group by 1, 2, 3""")

O["stated_roles"] = """
select p_partkey, case p_partkey % 5 when 0 then 'female' when 2 then 'male' when 4 then 'male' end as a_role,
       case p_partkey % 5 when 1 then 'male' when 2 then 'female' end as b_role from part"""

O["utc_dates"] = wv("log", """
select event_id, case when k % 5 = 0 then '' else strftime(to_timestamp(tm) at time zone 'UTC', '%Y-%m-%d') end as day from log""")

O["cleared_profiles"] = wv("strains", """
select slug, case when k % 4 = 2 then 'https://img.example.com/' || k end as image_url,
       case when k % 3 = 0 then name || ' is a hybrid cultivar.' when k % 3 = 1 and k % 2 = 1 then name || ' is a song.' end as summary,
       case when k % 2 = 0 and k % 3 <> 1 then 'https://w.example.org/' end as summary_source_url
from (select *, cast(slug[2:] as bigint) as k from strains)""")

O["run_stage_details"] = wv("rclaims", """
select run_id, 'hunter' as stage, pos, source_url as detail
from (select *, row_number() over (partition by run_id order by seq) as pos from rclaims) where pos <= 5
union all
select run_id, 'connector', pos, child || ' ← ' || parent_a || ' × ' || parent_b
from (select *, row_number() over (partition by run_id order by seq) as pos from rclaims) where pos <= 8""")

O["wikitext_articles"] = """
select n as doc_id, regexp_replace(trim(case n % 6
    when 0 then 'Intro ' || body
    when 1 then body || case when body = '' then '' else e'\\n\\n\\n' end
                || 'name = Nice ' || n || e'\\nhybrid = A × B\\n\\n\\ntail'
    when 2 then '{{Infobox never ' || body || ' closed'
    when 3 then 'z'
    when 4 then case when k = 0 then 'q ' else repeat('{{t|', greatest(k - 10, 0)) || repeat('}}', greatest(k - 10, 0)) || ' ' end || body
    else 'Bold shown xplain }} ]] [[c ' || body end), ' +', ' ', 'g') as text
from (select doc_id as n, doc_id % 13 as k, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,]+', ' ', 'g')) as body
      from documents)"""
