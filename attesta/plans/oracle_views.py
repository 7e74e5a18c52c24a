"""DuckDB text of the evidence views, for the side-by-side checks."""

VIEWS = {
    "pg": """
select page_id, case when page_id % 50 = 0 then ''
                     when page_id % 10 = 0 then 'tavily://answer/' || page_id
                     else url end as source_url
from pages""",
    "obs": """
select 'n' || (l_partkey + (select count(*) from part) * (l_orderkey % 20)) as child_slug,
       'n' || (l_suppkey % 3 + 1 + 3 * (l_partkey % 7)) as parent_slug,
       pg.source_url,
       'e' || (length(pg.source_url) % 4) as engine,
       max(cast(round(300 + 1000 * l_discount) as bigint)) as milli,
       min(cast(epoch(l_shipdate) as bigint)) as observed_at,
       min(case when l_linenumber = 1 then 'female' when l_linenumber = 2 then 'male' end) as role,
       bool_and(l_returnflag = 'R') as quarantined
from lineitem l join pg on pg.page_id = l_orderkey % (select count(*) from pages)
where l_partkey + (select count(*) from part) * (l_orderkey % 20)
      <> l_suppkey % 3 + 1 + 3 * (l_partkey % 7)
group by 1, 2, 3, 4""",
    "strains": """
select 'n' || k as slug, p_name || ' ' || k as name, p_type as strain_type,
       case when p_partkey % 4 = 0 then p_brand end as breeder,
       1700000000 + k as first_seen,
       case when k % 97 = 0 then 'VERIFIED' end as curated_tier,
       case when k % 97 = 0 then 'VERIFIED' else 'ANECDOTAL' end as trust_tier,
       case when k between 1 and 21 and k % 3 = 1 then 'n' || (k + 1) end as alias
from (select p.*, p_partkey + (select count(*) from part) * slot as k
      from part p, unnest(range(20)) as s(slot))
where not (k between 1 and 21 and k % 3 <> 1)""",
    "amap": """
select slug as alias, slug from strains
union all
select alias, slug from strains where alias is not null""",
    "src": """
select url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
       'e' || (page_id % 4) as engine, page_id + 1700000000 as fetched_at,
       case when page_id % 5 = 0 then 'https://web.archive.org/web/' || url end as wayback_url,
       case when page_id % 5 = 0 then page_id + 1700000000 end as archived_at
from pages""",
    "canon": """
select coalesce(c.slug, o.child_slug) as child, coalesce(p.slug, o.parent_slug) as parent,
       o.child_slug as raw_child, o.parent_slug as raw_parent,
       o.source_url, o.engine, o.milli, o.observed_at, o.role, o.quarantined
from obs o left join amap c on c.alias = o.child_slug
           left join amap p on p.alias = o.parent_slug""",
    "members": """
select child, parent, source_url, count(*) as n_rows, sum(milli) as milli
from canon where not quarantined group by 1, 2, 3""",
    "assertions": """
select child, source_url, list_sort(list(distinct parent)) as parents
from members group by 1, 2""",
    "psets": """
select distinct child, parents from assertions""",
    "disputed": """
select distinct a.child from psets a join psets b on a.child = b.child
where not list_has_all(a.parents, b.parents) and not list_has_all(b.parents, a.parents)""",
    "dom": """
select *, case
    when source_url = '' or lower(regexp_extract(source_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))
         in ('tavily', 'perplexity') then null
    else array_to_string(list_slice(string_split(lower(regexp_extract(source_url,
         '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '.'), -2, -1), '.') end as domain
from members""",
    "edges": """
select e.child, e.parent, source_count, domain_count, avg_milli,
       case when e.child in (select child from disputed) then 'disagreement'
            when domain_count >= 2 then 'multi_source' else 'single_source' end as agreement,
       f.first_seen, r.role
from (select child, parent, count(distinct nullif(source_url, '')) as source_count,
             count(distinct domain) as domain_count,
             cast((2 * sum(milli) + sum(n_rows)) // (2 * sum(n_rows)) as bigint) as avg_milli
      from dom group by 1, 2) e
join (select c.child, c.parent, min(m.t) as first_seen
      from (select distinct child, parent, raw_child, raw_parent from canon where not quarantined) c
      join (select raw_child, raw_parent, min(observed_at) as t from canon group by 1, 2) m
        using (raw_child, raw_parent)
      group by 1, 2) f using (child, parent)
join (select child, parent, case when count(distinct role) = 1 then min(role) end as role
      from canon where not quarantined group by 1, 2) r using (child, parent)""",
    "tiers": """
select h.child, e.child is not null as has_edges,
       case when any_disputed then 'CONTRADICTED' when any_multi then 'COMMUNITY_CONSENSUS'
            else 'ANECDOTAL' end as machine_tier, machine_milli
from (select distinct child from canon) h
left join (select child, bool_or(agreement = 'disagreement') as any_disputed,
                  bool_or(agreement = 'multi_source') as any_multi,
                  cast((2 * sum(avg_milli) + count(*)) // (2 * count(*)) as bigint) as machine_milli
           from edges group by 1) e on e.child = h.child""",
    "claims": """
select child_slug || '|' || source_url as claim_key, child_slug, 'LINEAGE' as type,
       child_slug || ' = ' || array_to_string(list_sort(list(distinct parent_slug)), ' × ') as value,
       case when max(milli) >= 350 then 'COMMUNITY_CONSENSUS' else 'ANECDOTAL' end as trust_tier,
       max(milli) as milli, source_url, 'seen in ' || source_url as excerpt,
       min(observed_at) as created_at, bool_and(quarantined) as quarantined
from obs group by child_slug, source_url""",
}

VIEWS |= {
    "subject": """
select child as seed from edges group by 1 order by count(*) desc, child limit 1""",
    "log": """
select event_id, cast(epoch(date_trunc('second', ts)) as bigint) as tm, user_id, event_type,
       cast(round(value * 100) as bigint) as cents,
       cast(regexp_extract(props, '[0-9]+') as bigint) as k, props
from events""",
    "rclaims": """
select 'r' || (user_id % 40) as run_id, event_id as seq, 'Query ' || (user_id % 40) as query,
       event_type || ' ' || user_id || '-' || (event_id % 3) as child,
       case when k % 29 = 0 then 'chem-dog' when k % 31 = 0 then 'sources as Kush'
            else 'Parent ' || ((case when user_id % 4 = 0 then user_id else k end) % 5) end as parent_a,
       case when k % 17 = 0 then '' else 'Mate ' || ((case when user_id % 4 = 0 then user_id else k end) % 3) end as parent_b,
       case when k % 10 = 0 and user_id % 4 <> 0 then ['Third ' || (k % 4)] else [] end as extras,
       case when k % 13 = 0 then '' when k % 11 = 0 then 'tavily://answer/' || k
            else 'https://www.s' || (event_id % 7) || '.example' || (event_id % 3) || '.org/p/' || k end as source_url,
       case when k % 13 = 0 or k % 11 = 0 then null else 'example' || (event_id % 3) || '.org' end as domain,
       'e' || (k % 4) as engine, 300 + k as milli
from log""",
    "gated": """
select *, not quarantined and parent_slug not in (select alias from amap) as gate
from obs""",
    "rsets": """
select run_id, lower(child) as child, seq, list_sort(list_distinct(list_filter(
       list_concat([parent_a, parent_b], extras), lambda x: x <> ''))) as parents, source_url
from rclaims""",
    "rdisputed": """
select distinct a.run_id, a.child
from (select distinct run_id, child, parents from rsets) a
join (select distinct run_id, child, parents from rsets) b
  on a.run_id = b.run_id and a.child = b.child
where not list_has_all(a.parents, b.parents) and not list_has_all(b.parents, a.parents)""",
}

_NEEDS = {
    "subject": ["edges"], "rclaims": ["log"], "gated": ["obs", "amap"], "rsets": ["rclaims"],
    "rdisputed": ["rsets"],
    "obs": ["pg"], "amap": ["strains"], "canon": ["obs", "amap"], "members": ["canon"],
    "assertions": ["members"], "psets": ["assertions"], "disputed": ["psets"],
    "dom": ["members"], "edges": ["dom", "disputed", "canon"], "tiers": ["edges", "canon"],
    "claims": ["obs"],
}


def with_views(names: str, body: str, **extra: str) -> str:
    """``WITH`` the named views and what they need, then any extra CTEs, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = [f"{n} as materialized ({VIEWS[n]})" for n in order]
    ctes += [f"{n} as ({q})" for n, q in extra.items()]
    # RECURSIVE only widens what a CTE may refer to.
    return "with recursive " + ",\n".join(ctes) + "\n" + body
