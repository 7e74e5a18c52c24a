"""DuckDB statements giving the same results as the registered queries."""

from __future__ import annotations

from attesta.plans.oracle_views import with_views as wv

_SLUG = "regexp_replace(lower(trim({0})), '\\s+', '-', 'g')"
_DOMAIN = """case when source_url = '' or {s} in ('tavily', 'perplexity') then null
    else array_to_string(list_slice(string_split(lower(regexp_extract(source_url,
         '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '.'), -2, -1), '.') end""".format(
    s="lower(regexp_extract(source_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))")
_BP = "cast({0} * 10000 // nullif({1}, 0) as bigint)"

ORACLES: dict[str, str] = {}
O = ORACLES

# --- scalar rules -----------------------------------------------------------

O["url_registrable_domain"] = wv("pg", f"""
select page_id, {_DOMAIN} as domain, source_url like 'tavily:%' as synthesized from pg""")

O["url_display_host"] = wv("pg", """
select page_id,
       case when source_url = '' then '' else regexp_replace(lower(regexp_extract(source_url,
            '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') end as host,
       source_url like 'http%' as http,
       case when source_url like 'tavily:%' then 'Provider answer · Tavily' end as label
from pg""")

O["slugify_names"] = f"""
select p_partkey, s as slug,
       array_to_string(list_transform(string_split(s, '-'),
           lambda x: upper(x[1:1]) || lower(x[2:])), ' ') as title
from (select p_partkey, {_SLUG.format("upper(p_name) || '  ' || p_brand")} as s from part)"""

O["identify_names"] = wv("amap strains", """
select p_partkey, coalesce(m.slug, 'n' || p_partkey) as identity, s.slug is not null as known,
       coalesce(s.name, ' N' || p_partkey) as display_name
from part left join amap m on m.alias = 'n' || p_partkey left join strains s on s.slug = m.slug""")

O["topic_gate"] = """
with d as (select *, regexp_matches(lower(text), 'license|the heron|ention') as topical from documents)
select doc_id as rank, contains(lower(text), 'license') as strong from d where topical
union all
select min(doc_id), contains(lower(arg_min(text, doc_id)), 'license') from d
group by source, lang having not bool_or(topical)"""

O["mention_filter"] = """
with p as (select page_id, html, replace(lower(regexp_extract(url,
           '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '-', ' ') as host from pages)
select page_id, host from p
where contains(regexp_replace(lower(html), '[\\s_-]+', ' ', 'g'), host)
   or contains(regexp_replace(lower(html), '[\\s_-]+', '', 'g'), replace(host, ' ', ''))"""

O["html_to_text"] = """
with t as (select page_id, regexp_replace(regexp_replace(html,
  '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g') as x from pages),
u as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x,
  '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'),
  '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g')) as x from t)
select page_id, length(x) as chars, md5(x) as digest from u"""

O["excerpt_trim"] = """
with t as (select doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) as t from documents)
select doc_id, case when length(t) <= 220 then t else
  regexp_replace(case when contains(substr(substr(t, 1, 220), 2), ' ')
                      then regexp_replace(substr(t, 1, 220), ' [^ ]*$', '') else substr(t, 1, 220) end,
                 '[,;:.\\s]+$', '') || '…' end as excerpt
from t"""

# --- derivation -------------------------------------------------------------

O["assertion_sets"] = wv("assertions", """
select child as child_slug, source_url, array_to_string(parents, '|') as parents from assertions""")

O["conflict_children"] = wv("disputed", "select child as child_slug from disputed")

O["edge_agreement"] = wv("edges", """
select child as child_slug, parent as parent_slug, source_count, domain_count, avg_milli,
       agreement, first_seen, role from edges""")

O["edge_lists"] = wv("dom", """
select child as child_slug, parent as parent_slug,
       coalesce(array_to_string(list_slice(list_sort(list(distinct source_url)
                filter (where source_url <> '')), 1, 10), ' '), '') as sources,
       coalesce(array_to_string(list_sort(list(distinct domain) filter (where domain is not null)), ' '), '') as domains
from dom group by 1, 2""")

_TIERED = """
select s.*, case when s.curated_tier is null and t.machine_tier is not null then t.machine_tier
                 else s.trust_tier end as tier, coalesce(t.machine_milli, 500) as milli
from strains s left join tiers t on t.child = s.slug"""

O["entity_tiers"] = wv("strains tiers", "select slug, tier as trust_tier, milli from tiered", tiered=_TIERED)

O["conflict_components"] = wv("assertions canon", """
select r.child as child_slug, r.label, array_to_string(a.parents, '|') as parents,
       count(*) as sources, max(m.t) as newest
from (select child, parents, min(other) as label from reach group by 1, 2) r
join assertions a on a.child = r.child and a.parents = r.parents
join (select child, source_url, max(observed_at) as t from canon where not quarantined group by 1, 2) m
  on m.child = a.child and m.source_url = a.source_url
group by 1, 2, 3""", pairs="""
select distinct a.child, a.parents, b.parents as other from assertions a join assertions b on a.child = b.child
where not list_has_all(a.parents, b.parents) and not list_has_all(b.parents, a.parents)""", reach="""
select child, parents, array_to_string(parents, '|') as other, parents as at from pairs
union
select r.child, r.parents, array_to_string(p.other, '|'), p.other
from reach r join pairs p on p.child = r.child and p.parents = r.at""")

# --- graph ------------------------------------------------------------------

_UNDIRECTED = "select child as a, parent as b from edges union all select parent, child from edges"


def _hops(depth: int) -> dict[str, str]:
    """The unrolled breadth-first search, one CTE per hop."""
    ctes = {"und": _UNDIRECTED, "h0": "select seed as node, 0 as hop from subject"}
    seen = "select node from h0"
    for d in range(1, depth + 1):
        ctes[f"h{d}"] = (f"select distinct b as node, {d} as hop from h{d - 1} join und on a = node "
                         f"where b not in ({seen})")
        seen += f" union all select node from h{d}"
    ctes["reached"] = " union all ".join(f"select * from h{d}" for d in range(depth + 1))
    return ctes


_ABOVE = {
    "above": """select parent as node from edges, subject where child = seed
                union select e.parent from above a join edges e on e.child = a.node""",
    "par": "select parent as node from edges where child = (select seed from subject)",
}


def _labelled(depth: int) -> str:
    return f"""
select node, cast(hop as bigint) as hop,
  case when hop = 0 then 'subject' when node in (select node from par) then 'parent'
       when node in (select child from edges where parent = (select seed from subject)) then 'child'
       when node in (select child from edges where parent in (select node from par)) then 'sibling'
       when hop < {depth} and node in (select node from above) then 'ancestor'
       when hop < {depth} then 'descendant' else 'related' end as relation
from reached"""


def _khop(depth: int) -> str:
    return wv("subject edges", _labelled(depth), **_hops(depth), **_ABOVE)


for _d in range(4):
    O[f"khop_neighborhood_d{_d}"] = _khop(_d)

# Towards an ancestor the first parent, in name order, that is below it; likewise towards a descendant.
O["evidence_edges"] = wv("subject edges", """
select node, relation,
  case when relation in ('parent', 'sibling', 'ancestor') then case when far_up is not null or relation <> 'ancestor' then seed end
       when relation = 'child' then node when relation = 'descendant' then far_down end as child_slug,
  case relation when 'parent' then node when 'child' then seed when 'sibling' then shared when 'ancestor' then far_up
       when 'descendant' then case when far_down is not null then seed end end as parent_slug
from (select k.node, k.relation, seed,
             (select min(a.parent) from edges a join edges b on a.parent = b.parent where a.child = seed and b.child = k.node) as shared,
             (select min(a.parent) from edges a join up on up.node = a.parent where a.child = seed and up.above = k.node) as far_up,
             (select min(d.child) from edges d join up on up.above = d.child where d.parent = seed and up.node = k.node) as far_down
      from k, subject)""", **_hops(2), **_ABOVE, k=_labelled(2),
    up="select child as node, parent as above from edges union select u.node, e.parent from up u join edges e on e.child = u.above")

_NODE_PARTS = {
    **_hops(1),
    "par": "select parent as node from edges where child = (select seed from subject)",
    "kids": "select child as node from edges where parent = (select seed from subject)",
    "people": """select breeder, min(slug) as slug from strains join reached on node = slug
                 where coalesce(breeder, '') <> '' group by 1""",
    "shown": """select * from (select c.*, row_number() over (order by (hop > 0), created_at desc, claim_key desc) as r
                from claims c join reached on node = child_slug where not quarantined) where r <= 24""",
    "nodes": """
select s.slug as id, 'Strain' as type, s.name as label,
       case when hop = 0 then 'subject' when node in (select node from par) then 'parent'
            when node in (select node from kids) then 'child'
            when node in (select child from edges where parent in (select node from par)) then 'sibling'
            else 'related' end as relation, s.trust_tier, cast(null as varchar) as source_url
from strains s join reached on node = s.slug
union all
select 'person::' || regexp_replace(lower(breeder), '\\s+', '-', 'g'), 'Person', breeder, 'breeder', 'ANECDOTAL', null from people
union all
select 'claim::' || claim_key, 'Claim', value, 'claim', trust_tier, source_url from shown""",
    "links": """
select 'e::' || child || '::' || parent as id, child as source, parent as target, 'CHILD_OF' as type, agreement,
       case agreement when 'multi_source' then 'green' when 'disagreement' then 'red' else 'amber' end as color
from edges where child in (select node from reached) and parent in (select node from reached)
union all
select 'e::' || slug || '::bred_by::person::' || regexp_replace(lower(breeder), '\\s+', '-', 'g'), slug,
       'person::' || regexp_replace(lower(breeder), '\\s+', '-', 'g'), 'BRED_BY', 'single_source', 'amber' from people
union all
select 'e::claim::' || claim_key, 'claim::' || claim_key, child_slug, 'ABOUT_STRAIN',
       case when trust_tier = 'COMMUNITY_CONSENSUS' then 'multi_source' else 'single_source' end,
       case when trust_tier = 'COMMUNITY_CONSENSUS' then 'green' else 'amber' end from shown""",
}
_GRAPH_VIEWS = "subject edges strains claims"
O["neighborhood_nodes"] = wv(_GRAPH_VIEWS, "select id, type, label, relation, trust_tier from nodes", **_NODE_PARTS)
O["neighborhood_links"] = wv(_GRAPH_VIEWS, "select * from links", **_NODE_PARTS)
O["neighborhood_stats"] = wv(_GRAPH_VIEWS, """
select count(*) as node_count, (select count(*) from links) as edge_count,
       count(*) filter (where type = 'Strain') as strain_nodes,
       count(*) filter (where type = 'Person') as person_nodes,
       count(*) filter (where type = 'Claim') as claim_nodes,
       count(distinct nullif(source_url, '')) as sources_consulted
from nodes""", **_NODE_PARTS)

O["ancestor_closure"] = wv("edges", "select node, ancestor from above", above="""
select child as node, parent as ancestor from edges
union select a.node, e.parent from above a join edges e on e.child = a.ancestor""")

O["sibling_counts"] = wv("edges", """
select child as child_slug, parent as parent_slug, count(*) over (partition by parent) - 1 as siblings,
       min(child) over (partition by parent) as first_child from edges""")

O["disagreement_only_nodes"] = wv("edges", """
select node, count(*) as edges from (select child as node, agreement from edges
                                     union all select parent, agreement from edges)
group by 1 having bool_and(agreement = 'disagreement')""")

O["frontier_expansion"] = wv("subject edges", """
select seed as name, cast(0 as bigint) as depth from subject
union all select name, 1 from l1 union all select name, 2 from l2""",
    l1="""select distinct parent as name from edges where child = (select seed from subject)
          and parent <> (select seed from subject) order by 1 limit 30""",
    l2="""select name from (select distinct e.parent as name, (select count(*) from l1) as used
                            from edges e join l1 on l1.name = e.child
                            where e.parent not in (select name from l1) and e.parent <> (select seed from subject))
          qualify row_number() over (order by name) + used <= 30""")

# --- identity and gate ------------------------------------------------------

O["alias_resolution"] = wv("canon", """
select raw_child, raw_parent, source_url, child as child_slug, parent as parent_slug from canon""")

O["parent_gate_split"] = wv("gated", """
select child_slug, parent_slug, source_url, quarantined or gate as quarantined,
       case when gate then 'UNRESOLVED_PARENT' end as quarantine_reason from gated""")

O["parent_gate_release"] = wv("gated claims", """
select g.child_slug, parent_slug, count(*) as rows, count(*) filter (where quarantined or still) as held,
       count(*) filter (where still) as gated, any_value(h.n) as hidden_claims
from rel g left join hid h on h.child_slug = g.child_slug group by 1, 2""",
    rel="select *, gate and parent_slug not in ('n3', 'n9', 'n15', 'n21') as still from gated",
    hid="""select c.child_slug, count(*) filter (where case
             when c.quarantined then true
             when not exists (select 1 from rel r where r.gate and r.child_slug = c.child_slug and r.source_url = c.source_url) then false
             else exists (select 1 from rel r where r.child_slug = c.child_slug and r.source_url = c.source_url
                          and (r.quarantined or r.still)) end) as n from claims c group by 1""")

O["claim_gate_sync"] = wv("gated claims", """
select claim_key, quarantined or hide as quarantined,
       case when not quarantined and hide then 'UNRESOLVED_PARENT' end as quarantine_reason
from (select c.*, exists (select 1 from gated g where g.gate and g.child_slug = c.child_slug
                          and g.source_url = c.source_url) as hide from claims c)""")

O["pending_parents"] = wv("gated", """
select parent_slug, upper(parent_slug[1:1]) || lower(parent_slug[2:]) as parent_name,
       count(*) as observation_count, max(observed_at) as newest, max(total) as total_observations,
       (select count(distinct parent_slug) from gated where gate) as total_parents,
       arg_min(child_slug, (-observed_at, child_slug, source_url)) as first_child
from (select *, count(*) over () as total from gated where gate
      order by observed_at desc, parent_slug, child_slug, source_url limit 200)
group by parent_slug""")

# --- upserts ----------------------------------------------------------------

O["upsert_observations"] = wv("log", """
select 'u' || user_id as child_slug, event_type || (k % 3) as parent_slug,
       'https://h' || (k % 5) || '.example.com/' as source_url,
       arg_min('title ' || event_id, (tm, event_id)) as source_title, max(cents % 1000) as milli,
       coalesce(arg_max('x' || event_id, (tm, event_id)) filter (where k % 2 = 0), '') as excerpt,
       min(tm) as observed_at, max(case when k % 7 = 0 then 'female' end) as role
from log group by 1, 2, 3""")

O["upsert_strains"] = wv("log", """
select 'u' || user_id as slug, arg_max(event_type || ' ' || event_id, (tm, event_id)) as name,
       arg_min('s' || event_id, (tm, event_id)) filter (where k % 3 = 0) as summary,
       arg_min(case when k % 10 = 0 then '' else 'b' || event_id end, (tm, event_id)) filter (where k % 5 = 0) as breeder,
       min(tm) as first_seen, max(tm) as last_researched
from log group by 1""")

O["upsert_sources"] = wv("log", """
select 'https://u' || user_id || '.example.com/' as url,
       coalesce(arg_max('t' || event_id, (tm, event_id)) filter (where k % 4 <> 0), '') as title,
       coalesce(arg_max(event_type, (tm, event_id)) filter (where k % 4 <> 1), '') as engine,
       min(tm) as fetched_at
from log where k <> 0 group by 1""")

O["pending_archive_lookups"] = """
select 'r' || (page_id % 20) as run_id, url,
       row_number() over (partition by page_id % 20 order by page_id) as rank
from pages where page_id % 5 <> 0"""

O["catalog_page_deep"] = wv("strains tiers", """
select slug, name, milli, total from (
  select *, count(*) over () as total, row_number() over (order by milli desc, name, slug) - 1 as place from tiered)
where place >= total // 2 and place < total // 2 + 50""", tiered=_TIERED)

O["named_subjects"] = wv("amap edges", """
select n.name, m.slug as seed, e.neighbours from named n join amap m on m.alias = regexp_replace(lower(trim(n.name)), '\\s+', '-', 'g')
left join (select a, count(distinct b) as neighbours from und group by 1) e on e.a = m.slug""", named="""
select ' N' || p_partkey as name from part union all select n_name from nation""", und=_UNDIRECTED)

O["cache_purge"] = wv("log", """
select cast(0 as bigint) as hits, (select count(*) from log) as misses, cast(0 as bigint) as entries,
       count(distinct user_id || ':' || event_type) as purged from log where event_type <> 'signup'""")

O["ledger_round_trip"] = wv("rclaims", """
select run_id, cast(1 as bigint) as summaries, count(*) as claims, count(*) as stated from rclaims group by 1""")

# --- readers ----------------------------------------------------------------

O["evidence_drilldown"] = wv("canon edges strains src", """
select e.child as child_slug, e.parent as parent_slug, coalesce(s.name, e.parent) as parent_name,
       e.agreement, e.source_count, e.domain_count, e.avg_milli,
       max(c.observed_at) over (partition by e.child, e.parent) as newest,
       c.source_url, c.observed_at, src.wayback_url
from edges e join canon c on c.child = e.child and c.parent = e.parent and not c.quarantined
left join strains s on s.slug = e.parent left join src on src.url = c.source_url""")

O["catalog_page"] = wv("strains tiers", """
select slug, name, tier as trust_tier, milli, breeder, count(*) over () as total from tiered
order by milli desc, name, slug limit 50 offset 100""", tiered=_TIERED)

O["source_page"] = wv("src", """
select url, title, fetched_at, wayback_url, count(*) over () as total from src order by fetched_at desc, url limit 50 offset 10""")

_SCORES = """
select slug, name, case when lower(name) = '{q}' or slug = '{q}' or alias = '{q}' then 3
    when starts_with(lower(name), '{q}') or starts_with(slug, '{q}') or starts_with(alias, '{q}') then 2
    when contains(lower(name), '{q}') or contains(slug, '{q}') or contains(alias, '{q}') then 1
    else 0 end as score from strains"""
O["autocomplete_topk"] = wv("strains", """
select slug, name, cast(score as bigint) as score from scored where score > 0
order by score desc, name, slug limit 8""", scored=_SCORES.format(q="blue bolt 1"))
O["search_scores"] = wv("strains", """
select cast(score as bigint) as score, count(*) as entities, min(slug) as first
from scored where score > 0 group by 1""", scored=_SCORES.format(q="n2"))

O["claim_budget"] = wv("subject edges claims", """
select claim_key, distant, r as rank from (
  select claim_key, cast(hop > 0 as int) as distant,
         row_number() over (order by (hop > 0), created_at desc, claim_key desc) as r
  from claims join reached on node = child_slug where not quarantined) where r <= 24""", **_hops(1))

O["top_claims"] = wv("claims", """
select child_slug, claim_key, row_number() over w as rank,
       greatest(count(*) over (partition by child_slug) - 6, 0) as hidden
from claims where not quarantined
window w as (partition by child_slug order by milli desc, claim_key)
qualify row_number() over w <= 6""")

# --- dossier ----------------------------------------------------------------

_ACCOUNTS = """
select c.*, string_split(value, ' = ')[1] as kid, string_split(string_split(value, ' = ')[2], ' × ') as parents
from claims c"""
_ACCOUNT_KEY = "kid || '::' || array_to_string(list_sort(parents), '§')"

O["account_groups"] = wv("claims", f"""
select {_ACCOUNT_KEY} as account, any_value(value) as assertion, count(*) as claims,
       count(distinct nullif(source_url, '')) as sources,
       arg_min(claim_key, (-length(excerpt), -milli, claim_key)) as best,
       true as demoted
from acc group by 1""", acc=_ACCOUNTS)

O["provenance_cards"] = wv("claims src", f"""
select {_ACCOUNT_KEY} as account, replace('N' || any_value(value)[2:], 'n', 'N') as assertion,
       count(distinct nullif(acc.source_url, '')) as source_count,
       case when length(arg_min(excerpt, o)) > 220 then null else trim(arg_min(excerpt, o)) end as excerpt,
       arg_min(trust_tier, o) as tier, arg_min(milli, o) as milli,
       arg_min(wayback_url, claim_key) filter (where wayback_url is not null) as wayback_url
from (select *, (-length(excerpt), -milli, claim_key) as o from acc) acc
left join src on src.url = acc.source_url group by 1""", acc=_ACCOUNTS)

O["edge_color_counts"] = wv("edges", """
select child as child_slug, count(*) filter (where agreement = 'multi_source') as green,
       count(*) filter (where agreement = 'disagreement') as red,
       count(*) filter (where agreement = 'single_source') as amber
from edges group by 1""")

O["dossier_domains"] = wv("dom claims", """
select child_slug, count(*) as domains from (
  select child as child_slug, domain from dom where domain is not null
  union
  select child_slug, regexp_replace(lower(regexp_extract(source_url,
         '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') from claims where source_url like 'http%')
group by 1""")

O["dossiers"] = wv("strains edges dom claims src", f"""
select s.slug, coalesce(g.accounts, 0) as accounts, coalesce(g.accounts, 0) >= 2 as conflicting, cast(0 as bigint) as malformed,
       coalesce(e.green, 0) as green, coalesce(e.amber, 0) as amber, coalesce(e.red, 0) as red, coalesce(d.domains, 0) as domains,
       coalesce(u.sources, 0) as sources, greatest(coalesce(g.accounts, 0) - 3, 0) as hidden, g.cards
from strains s
left join (select child_slug, count(*) as accounts, string_agg(card, ' / ' order by place) filter (where place <= 3) as cards
           from carded group by 1) g on g.child_slug = s.slug
left join ({O["edge_color_counts"].rsplit(chr(10) + "select child as", 1)[1].join(["select child as", ""])}) e on e.child_slug = s.slug
left join (select child_slug, count(*) as domains from (
  select child as child_slug, domain from dom where domain is not null union
  select child_slug, regexp_replace(lower(regexp_extract(source_url,
         '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') from claims where source_url like 'http%') group by 1) d
  on d.child_slug = s.slug
left join (select child_slug, count(distinct nullif(source_url, '')) as sources from claims group by 1) u on u.child_slug = s.slug""",
    acc=_ACCOUNTS, grouped=f"""
select child_slug, {_ACCOUNT_KEY} as account, count(distinct nullif(acc.source_url, '')) as n,
       upper(any_value(array_to_string(parents, ' × '))) as said, arg_min(trust_tier, (-length(excerpt), -milli, claim_key)) as tier,
       arg_min(wayback_url, claim_key) filter (where wayback_url is not null) as wayback_url
from acc left join src on src.url = acc.source_url group by 1, 2""", carded="""
select g.child_slug, row_number() over (partition by g.child_slug order by n desc, s.name || ' = ' || said, account) as place,
       concat_ws('|', s.name || ' = ' || said, n, tier, wayback_url) as card
from grouped g join strains s on s.slug = g.child_slug""")

O["source_trail"] = wv("members claims", """
select child_slug, coalesce(claims, 0) as claims, coalesce(edges, 0) as edges, coalesce(urls, 0) as urls
from (select child as child_slug, count(distinct parent) as edges,
             count(distinct nullif(source_url, '')) as urls from members group by 1)
full join (select child_slug, count(*) as claims from claims where not quarantined group by 1) using (child_slug)""")

O["node_source_counts"] = wv("members", """
select node, count(distinct source_url) as urls from (
  select child as node, source_url from members union all select parent, source_url from members)
where source_url <> '' group by 1""")

# --- statistics -------------------------------------------------------------

_RUNS = """
select 'run' || user_id as id, min(tm) as started_at, max(tm) as completed_at,
       count(*) filter (where event_type = 'purchase') as llm_calls, cast(sum(k) as bigint) as prompt_tokens,
       cast(sum(cents) as bigint) as completion_tokens, cast(sum(k) + sum(cents) as bigint) as total_tokens
from log group by 1"""

O["run_page"] = wv("log", """
select id, started_at, completed_at, llm_calls, count(*) over () as total from runs order by started_at desc, id limit 20 offset 5""", runs=_RUNS)

O["kb_stats"] = wv("strains claims edges gated src log", """
select s.*, c.*, e.*, r.*, p.*, (select count(*) from src) as total_sources, strain_nodes + total_claims as total_nodes
from (select count(*) as strain_nodes, count(*) filter (where trust_tier = 'VERIFIED') as verified,
             count(*) filter (where trust_tier = 'COMMUNITY_CONSENSUS') as community_consensus,
             count(*) filter (where trust_tier = 'ANECDOTAL') as anecdotal,
             count(*) filter (where trust_tier = 'CONTRADICTED') as contradicted from strains) s,
     (select count(*) filter (where not quarantined) as total_claims from claims) c,
     (select count(*) as total_edges from edges) e,
     (select count(*) filter (where gate) as pending_observations from gated) p,
     (select count(*) as research_runs, cast(sum(llm_calls) as bigint) as llm_calls,
             cast(sum(prompt_tokens) as bigint) as prompt_tokens,
             cast(sum(completion_tokens) as bigint) as completion_tokens,
             cast(sum(total_tokens) as bigint) as total_tokens from runs) r""", runs=_RUNS)

O["tier_distribution"] = wv("strains tiers", f"""
select tier as trust_tier, count(*) as entities,
       {_BP.format("count(*)", "(select count(*) from strains)")} as basis_points
from tiered group by 1""", tiered=_TIERED)

O["llm_spend"] = wv("log", """
select 'run' || user_id as run_id, count(*) as calls,
       arg_max(event_type, event_id) filter (where event_type <> 'view') as model,
       cast(sum(k) as bigint) as prompt_tokens, cast(sum(cents) as bigint) as completion_tokens,
       cast(coalesce(sum(k + cents) filter (where k % 2 = 0), 0) as bigint) as total_tokens
from log where k % 9 <> 0 group by 1""")

_CLASSIFIED = """
select l.event_id, l.user_id || ':' || l.event_type as cache_key, 'r' || (l.user_id % 40) as run_id,
       case when f.key is null then 'miss' when f.tm + 604800 <= l.tm then 'expired'
            when f.k % 7 = 0 or f.k % 11 = 0 then 'corrupt' else 'hit' end as outcome
from log l left join (select user_id || ':' || event_type as key, arg_min(tm, event_id) as tm,
                             arg_min(k, event_id) as k from log where event_type <> 'signup' group by 1) f
  on f.key = l.user_id || ':' || l.event_type"""
O["ttl_classification"] = wv("log", "select event_id, cache_key, outcome from c", c=_CLASSIFIED)
O["cache_stats"] = wv("log", """
select count(*) filter (where outcome = 'hit') as hits, count(*) filter (where outcome <> 'hit') as misses,
       cast(round(count(*) filter (where outcome = 'hit') / count(*), 4) * 10000 as bigint) as hit_rate_bp,
       (select count(distinct user_id || ':' || event_type) from log where event_type <> 'signup') as entries
from c""", c=_CLASSIFIED)
O["cache_run_usage"] = wv("log", """
select run_id, count(*) filter (where outcome = 'hit') as hits,
       count(*) filter (where outcome <> 'hit') as misses from c group by 1""", c=_CLASSIFIED)

# --- runs and claims --------------------------------------------------------

O["run_consensus"] = wv("rclaims", """
select run_id, parent_a, parent_b, count(*) as sources, count(distinct domain) as domains,
       cast((2 * sum(milli) + count(*)) // (2 * count(*)) as bigint) as milli
from rclaims group by 1, 2, 3""")

O["claim_time_tiers"] = wv("rclaims rdisputed", """
select c.run_id, c.seq, case when d.child is not null then 'CONTRADICTED'
       when t.n >= 2 then 'COMMUNITY_CONSENSUS' else 'ANECDOTAL' end as tier
from rclaims c left join rdisputed d on d.run_id = c.run_id and d.child = lower(c.child)
left join (select run_id, lower(child) as child, lower(parent_a) as a, lower(parent_b) as b,
                  count(distinct domain) as n from rclaims group by 1, 2, 3, 4) t
  on t.run_id = c.run_id and t.child = lower(c.child) and t.a = lower(c.parent_a) and t.b = lower(c.parent_b)""")

O["run_disagreements"] = wv("rsets rdisputed", """
select run_id, child, array_to_string(parents, '|') as parents, sources,
       child || ' has ' || count(*) over (partition by run_id, child) || ' conflicting parent-strain assertions' as summary
from (select s.run_id, s.child, s.parents, count(distinct nullif(s.source_url, '')) as sources
      from rsets s join rdisputed d on d.run_id = s.run_id and d.child = s.child group by 1, 2, 3)""")

_GROUPS = {
    "tup": """select *, lower(child) as kid, list_filter(list_concat([parent_a, parent_b], extras), lambda x: x <> '') as ps
              from rclaims""",
    "grp": """select t.run_id, t.kid, ps, min(seq) as ord, count(distinct nullif(source_url, '')) as source_count,
                     cast((2 * sum(milli) + count(*)) // (2 * count(*)) as bigint) as milli,
                     case when any_value(d.child) is not null then 'disagreement'
                          when count(distinct domain) >= 2 then 'multi_source' else 'single_source' end as agreement
              from tup t left join rdisputed d on d.run_id = t.run_id and d.child = t.kid group by 1, 2, 3""",
    "per": "select *, unnest(ps) as p, unnest(range(len(ps))) as pos from grp",
    "sl": """select *, regexp_replace(kid, '\\s+', '-', 'g') as src, regexp_replace(lower(p), '\\s+', '-', 'g') as tgt from per""",
}
O["run_graph_edges"] = wv("rclaims rdisputed", """
select run_id, 'e::' || src || '::' || tgt as id, agreement,
       case agreement when 'multi_source' then 'green' when 'disagreement' then 'red' else 'amber' end as color,
       source_count, milli, array_to_string(list_filter(ps, lambda x: x <> p), '|') as other_parents,
       case when pos = 0 then array_to_string(ps, ' × ') else '' end as label
from sl qualify row_number() over (partition by run_id, src, tgt order by ord desc, pos desc) = 1""", **_GROUPS)
O["run_graph_nodes"] = wv("rclaims rdisputed", """
select run_id, slug, bool_or(root) as is_root from (
  select run_id, regexp_replace(lower(query), '\\s+', '-', 'g') as slug, true as root from rclaims
  union all select run_id, src, false from sl union all select run_id, tgt, false from sl) group by 1, 2""", **_GROUPS)
O["run_summaries"] = wv("rclaims rdisputed", """
select run_id, any_value(query) as query, count(*) as sources_count, count(distinct engine) as engines,
       count(*) as lineage_claims_count, count(distinct (parent_a, parent_b)) as consensus_count,
       (select count(*) from rdisputed d where d.run_id = c.run_id) as disagreement_count,
       (select count(distinct s) from (select regexp_replace(lower(query), '\\s+', '-', 'g') as s, run_id from rclaims
          union all select src, run_id from sl union all select tgt, run_id from sl) n where n.run_id = c.run_id) as node_count,
       (select count(distinct (src, tgt)) from sl where sl.run_id = c.run_id) as edge_count
from rclaims c group by run_id""", **_GROUPS)

O["ingest_claims"] = wv("rclaims", """
select run_id, seq, child, a as parent_a, parent_b from (
  select *, case when parent_a = 'chem-dog' then 'Chemdawg' else parent_a end as a from rclaims)
where a <> 'sources as Kush' and parent_b <> ''
qualify row_number() over (partition by run_id, lower(a), lower(parent_b) order by seq) = 1""")

O["first_seen_urls"] = wv("rclaims", """
select run_id, source_url as url, min(seq) as seq, arg_min(child, seq) as child
from rclaims where source_url <> '' group by 1, 2""")

O["context_packing"] = """
select conv_id, turn, used from (
  select conv_id, turn, cast(sum(length(substr(role || chr(10) || text, 1, 2400)))
         over (partition by conv_id order by turn) as bigint) as used from conversations)
where used <= 2000"""

O["lead_sentences"] = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^.!?]+[.!?]+') as s from documents),
walk as (
  select doc_id, 0 as i, cast([] as varchar[]) as p, true as open, s from texts
  union all
  select doc_id, i + 1, case when short then list_append(p[1:len(p) - 1], p[len(p)] || ' ' || x)
                             when full_ then p else list_append(p, x) end, short or not full_, s
  from (select *, trim(s[i + 1]) as x, len(p) > 0 and length(p[len(p)]) < 12 as short,
               len(p) = 3 or (len(p) > 0 and length(p[1]) > 400) as full_
        from walk where open and i < len(s))),
done as (select doc_id, arg_max(p, i) as p from walk group by 1)
select doc_id, case
  when len(p) = 0 then ''
  when length(p[1]) > 400 then trim(regexp_replace(left(p[1], 400), '^(.+) [^ ]*$', '\1'))
  when len(p) >= 3 and length(p[1]) + length(p[2]) + length(p[3]) + 2 <= 400 then p[1] || ' ' || p[2] || ' ' || p[3]
  when len(p) >= 2 and length(p[1]) + length(p[2]) + 1 <= 400 then p[1] || ' ' || p[2]
  else p[1] end as lead
from done"""

O["url_odd_hosts"] = """
select page_id, case page_id % 8 when 0 then 'site' || page_id || '.co.uk' when 1 then 'site' || page_id || '.org'
         when 2 then 'a note about page ' || page_id when 3 then '2001:db8::' || page_id
         when 4 then 'site' || page_id || '.com.au' when 6 then 'site' || page_id || '.net' end as domain,
       case page_id % 8 when 0 then 'shop.site' || page_id || '.co.uk' when 1 then 'www.site' || page_id || '.org'
         when 3 then '2001:db8::' || page_id when 4 then 'cdn.site' || page_id || '.com.au'
         when 5 then 'answer' when 6 then 'a..b.site' || page_id || '.net' else '' end as host
from pages"""

# --- extraction -------------------------------------------------------------

_TITLED = """array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ')"""
O["extract_lineage"] = f"""
select cast(p_partkey as varchar) as run_id, 'Child ' || p_partkey as child, {_TITLED.format("p_name")} as parent_a,
       'Kind ' || upper(p_type[1:1]) || lower(p_type[2:]) as parent_b,
       cast(case p_partkey % 5 when 0 then 500 when 1 then 400 when 2 then 550 else 500 end as bigint) as milli,
       'https://p.example.com/' || p_partkey as source_url
from part where p_partkey % 5 < 3"""

# One row per pair and text, in the order of the patterns; equal names are no pair.
O["extract_from_documents"] = """
with d as (select doc_id as n, 'Alpha' || doc_id as a, 'Beta' || doc_id % 7 as b, 'Gamma' || doc_id % 3 as g from documents),
said as (
  select n, 0 as pos, a as parent_a, b as parent_b, '' as extra_parents from d where n % 6 = 0
  union all select n, 0, a, b, g from d where n % 6 = 1
  union all select n, 0, a, b, '' from d where n % 6 = 2
  union all select n, 0, b, a, '' from d where n % 6 = 3
  union all select n, 1, 'Delta' || n, g, '' from d where n % 6 = 3
  union all select n, 0, b, a, '' from d where n % 6 = 4)
select cast(n as varchar) as run_id, pos, parent_a, parent_b, extra_parents from said"""

O["model_response_validation"] = wv("log", """
select cast(event_id as varchar) as run_id, case when k % 6 = 0 then 'Subject' else 'C' || k end as child,
       case when k % 7 = 0 then 'B' else 'A' || k end as parent_a, case when k % 7 = 0 then '' else 'B' end as parent_b,
       'https://x.example.com/' || (k % 4 - 1) as source_url,
       cast(case when k % 5 = 0 then 600 else greatest(50, least(980, k * 20)) end as bigint) as milli, 'male' as b_role
from log where k % 4 in (1, 2) and (k % 13 <> 0 or k % 9 = 0)""")

O["summary_candidates"] = f"""
select cast(p_partkey as varchar) as run_id,
       case p_partkey % 5 when 0 then n || ' is a popular cannabis variety with a sweet aroma. It flowers early.'
            else 'A hybrid cultivar named ' || n || ' was bred on the coast.' end as summary,
       'https://w.example.org/' || p_partkey as summary_source_url, n as summary_source_title
from (select p_partkey, {_TITLED.format("p_name")} || ' ' || p_partkey as n from part) where p_partkey % 5 in (0, 2)"""

# --- ledger -----------------------------------------------------------------

O["ledger_by_entity"] = wv("rclaims", """
select run_id, child, parent_a, seq as ingested_at from rclaims
where seq % 5 <> 0 and seq % 7 > 1 and parent_a = 'Parent 3' order by seq desc limit 20""")

# --- curation ---------------------------------------------------------------

O["review_fold"] = wv("strains edges", """
select s.slug, case when v.slug is not null then v.tier else s.curated_tier end as curated_tier,
       case when v.tier is not null then v.note end as curated_note,
       case when v.tier is not null then v.at end as curated_at,
       case when v.tier is not null then 'curated' else 'researched' end as origin,
       case when v.slug is null then s.trust_tier when v.tier is not null then v.tier
            else coalesce(m.tier, 'ANECDOTAL') end as trust_tier
from strains s left join v on v.slug = s.slug left join (
  select child, case when bool_or(agreement = 'disagreement') then 'CONTRADICTED'
         when bool_or(agreement = 'multi_source') then 'COMMUNITY_CONSENSUS' else 'ANECDOTAL' end as tier
  from edges group by 1) m on m.child = s.slug""", v="""
select 'n' || o_custkey as slug, case when o_orderstatus = 'F' then 'VERIFIED' end as tier,
       o_orderpriority as note, cast(epoch(o_orderdate) as bigint) as at
from orders where o_orderstatus <> 'P'
qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""")

_VERDICTS = "select *, not quarantined and role is not null as verdict from obs"
O["quarantine_fold"] = wv("obs", """
select child_slug, parent_slug, source_url, verdict as quarantined,
       case when not verdict then 'HUMAN_APPROVED' end as quarantine_reason from d""", d=_VERDICTS)
O["quarantine_fold_claims"] = wv("obs", """
select child_slug || '|' || source_url as claim_key, arg_max(verdict, (observed_at, parent_slug)) as quarantined,
       case when not arg_max(verdict, (observed_at, parent_slug)) then 'HUMAN_APPROVED' end as quarantine_reason
from d group by child_slug, source_url""", d=_VERDICTS)

O["resolve_fold"] = wv("gated amap", """
select w.parent_slug, w.target, c.children, w.n as resolved_observations
from (select parent_slug, case when parent_slug in ('n6', 'n18') then 'n1' else parent_slug end as target,
             count(*) as n from gated where gate group by 1, 2) w
join (select case when p.slug is not null then p.slug when parent_slug in ('n6', 'n18') then 'n1'
                  else parent_slug end as target, count(distinct coalesce(m.slug, child_slug)) as children
      from gated left join amap m on m.alias = child_slug left join amap p on p.alias = parent_slug
      where not quarantined group by 1) c using (target)""")

# --- streams ----------------------------------------------------------------

O["stream_first_urls"] = """
select distinct user_id || '/' || cast(cast(ts as date) as varchar) as run_id,
       'https://' || event_type || '.example.com/' || (cast(regexp_extract(props, '[0-9]+') as int) % 3) as url
from events"""

O["stream_spend"] = wv("log", """
select tm - tm % 86400 as window_start, count(*) as calls, cast(sum(k) as bigint) as tokens from log group by 1""")

# A block is coded as 1000 * length - place in x: the longest, of equal ones the first; its place in y is the first.
_BLOCK = """coalesce(list_max(flatten(list_transform(range(1, length({x}) + 1), lambda i: list_transform(
  range(1, length({x}) - i + 2), lambda l: case when contains({y}, substr({x}, i, l)) then 1000 * l - i else 0 end)))), 0)"""
_COMMON = " + ".join(f"least(length(name) - length(replace(name, '{c}', '')), length(needle) - length(replace(needle, '{c}', '')))"
                     for c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
O["fuzzy_suggestions"] = wv("strains", """
select needle, place, slug, name, ppm from (
  select needle, slug, name, cast(floor(1000000 * (2.0 * m / (length(name) + length(needle)))) as bigint) as ppm,
         cast(row_number() over (partition by needle order by 2.0 * m / (length(name) + length(needle)) desc, name desc, slug) as integer) as place
  from (select needle, name, sum((code + 999) // 1000) as m from walk group by 1, 2) join strains using (name)
  where 2.0 * m / (length(name) + length(needle)) >= 0.7)
where place <= 4""", asked="""
select distinct substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) as needle from part""", pairs=f"""
select needle, name from asked, (select distinct name from strains)
where 2.0 * least(length(name), length(needle)) >= 0.7 * (length(name) + length(needle))
  and 2.0 * ({_COMMON}) >= 0.7 * (length(name) + length(needle))""", walk=f"""
select needle, name, name as x, needle as y, {_BLOCK.format(x="name", y="needle")} as code from pairs
union all
select needle, name, x, y, {_BLOCK.format(x="x", y="y")} as code from (
  select needle, name, unnest([substr(x, 1, i - 1), substr(x, i + l)]) as x, unnest([substr(y, 1, j - 1), substr(y, j + l)]) as y
  from (select *, strpos(y, substr(x, i, l)) as j from (
          select *, (code + 999) // 1000 as l, 1000 * ((code + 999) // 1000) - code as i from walk where code > 0)))
where x <> '' and y <> ''""")

# Event by event: who owns an alias after its first rn events, and how many of them were refused.
O["alias_fold"] = wv("strains log", """
select w.alias, w.owner, w.refused from walk w
join (select alias, max(rn) as rn from e group by 1) last using (alias, rn)""", e="""
select *, row_number() over (partition by alias order by event_id) as rn, alias in (select slug from strains) as taken,
       slug in (select slug from strains) as on_file
from (select event_id, event_type, 'n' || (100 + k % 7) as slug,
             case when k % 19 = 0 then 'n5000000' when k % 23 = 0 then 'n' || ((select count(*) from part) - 1)
                  else 'aka-' || user_id end as alias from log)""", walk="""
select distinct alias, cast(0 as bigint) as rn, cast(null as varchar) as owner, cast(0 as bigint) as refused from e
union all
select w.alias, e.rn,
       case when not on_file then owner when event_type = 'error' then case when owner = slug then null else owner end
            when taken then owner else coalesce(owner, slug) end,
       refused + case when not on_file or (event_type <> 'error' and (taken or coalesce(owner, slug) <> slug)) then 1 else 0 end
from walk w join e on e.alias = w.alias and e.rn = w.rn + 1""")

O["stream_tiers"] = wv("tiers", "select child as child_slug, machine_tier as tier from tiers")

O["stream_merge_equals_batch"] = wv("log", """
select child as child_slug, parent as parent_slug, count(distinct url) as source_count,
       count(distinct dom) as domain_count,
       cast((2 * sum(milli) + count(*)) // (2 * count(*)) as bigint) as milli,
       case when child in (select a.child from ps a join ps b on a.child = b.child
                           where not list_has_all(a.p, b.p) and not list_has_all(b.p, a.p)) then 'disagreement'
            when count(distinct dom) >= 2 then 'multi_source' else 'single_source' end as agreement
from o group by 1, 2""", o="""
select child, parent, url, dom, max(milli) as milli from (
  select case when k % 6 = 0 then 'parent-' || (user_id % 5) else event_type || '-' || user_id end as child,
         'parent-' || (k % 5) as parent,
         'https://s' || (k % 4) || '.site' || (user_id % 3) || '.org/' || (k % 8) as url,
         'site' || (user_id % 3) || '.org' as dom, 300 + k as milli from log)
where child <> parent and parent in (select 'parent-' || (user_id % 5) from log where k % 6 = 0)
group by 1, 2, 3, 4""", ps="""
select distinct child, p from (select child, url, list_sort(list(distinct parent)) as p from o group by 1, 2)""")
