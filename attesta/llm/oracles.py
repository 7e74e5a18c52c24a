"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}


def _host_bad(rule: str) -> str:
    return f"""
    select source, '{rule}' as rule from (
      select source, n, (k + m * w) / (n + w) as rate, n + w + 1 as size from (
        select source, n, k, m, case when spread > 0 and m > 0 and m < 1
               then least(10000.0, greatest(1.0, m * (1 - m) / spread - 1)) else 10000.0 end as w
        from (select source, n, k, sum(k) over () / sum(n) over () as m,
                     greatest(0.0, sum(k * k / n) over () / sum(n) over ()
                                   - (sum(k) over () / sum(n) over ()) ** 2) as spread
              from (select source, count(*)::double as n,
                           count(*) filter (where {_RULES[rule]})::double as k
                    from measured group by source))))
    where (rate - 2.0 * sqrt(rate * (1 - rate) / size)) * 1000 >= 800"""


MEASURED = r"""
  rows as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
  words as (select rid, w, i from (
      select rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w,
             generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) as i from rows)),
  grams as (select rid, i, w, lead(w) over r as w2, lead(w, 2) over r as w3 from words
            window r as (partition by rid order by i)),
  marked as (select rid, i, w3 is not null and count(*) over (partition by rid, w, w2, w3) > 1 as rep from grams),
  covered as (select rid, rep or coalesce(lag(rep) over r, false) or coalesce(lag(rep, 2) over r, false) as c
              from marked window r as (partition by rid order by i)),
  repeats as (select rid, count(*) filter (where c) as n from covered group by rid),
  counts as (select rid, count(*) as n, sum(length(w)) as chars from words group by rid),
  lines as (select rid, l from (select rid, unnest(string_split(t, chr(10))) as l from rows)
            where regexp_matches(l, '[^\x20\x09-\x0D]')),
  dups as (select rid, count(*) - count(distinct l) as n from lines group by rid),
  measured as (
    select rows.rid, doc_id, source, coalesce(counts.n, 0)::bigint as n_words,
           coalesce(counts.chars, 0)::bigint as word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
           coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(repeats.n, 0)::bigint as n_repeat_words
    from rows left join counts using (rid) left join dups using (rid) left join repeats using (rid))"""

_BAD = " union all ".join(_host_bad(r) for r in _RULES)

JUDGED = f"""{MEASURED},
  bad as ({_BAD}),
  listed as (select source, string_agg(rule, ',' order by
               list_position({list(_RULES)!r}, rule)) as fails from bad group by source),
  judged as (
    select m.rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
           not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and h.fails is null as kept,
           coalesce(h.fails, '') as host_fails
    from measured m left join listed h on m.source is not distinct from h.source)"""

_KEYWORDS = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
             "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_ASSIGN = f"({_KEYWORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _secret_hits(rank: int, pattern: str, group: int) -> str:
    return f"""
    select rid, owner, repo, {rank} as rank, k, length(gaps[k]) as gap, length(found[k]) as len, vals[k] as v
    from (select rid, owner, repo, gaps, found, vals, unnest(range(1, len(found) + 1)) as k
          from (select rid, owner, repo, string_split_regex(t, '{pattern}') as gaps,
                       regexp_extract_all(t, '{pattern}') as found,
                       regexp_extract_all(t, '{pattern}', {group}) as vals
                from srows where regexp_matches(t, '{pattern}')))"""


_LIVE = ("regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') "
         "and len(list_distinct(string_split(v, ''))) >= 8")

SECRETS = f"""
with srows as (select row_number() over () as rid, source as owner, doc_id as repo, coalesce(text, '') as t
               from documents),
  hits as ({_secret_hits(0, _ASSIGN, 2)} union all {_secret_hits(1, 'AKIA[A-Z0-9]{16,}', 0)}
           union all {_secret_hits(2, '[0-9a-f]{24,}', 0)} union all {_secret_hits(3, '[A-Za-z0-9+/_=-]{20,}', 0)}),
  placed as (select *, coalesce(sum(gap + len) over (partition by rid, rank order by k
                       rows between unbounded preceding and 1 preceding), 0) + gap as s from hits),
  cands as (select rid, owner, repo, rank, s::bigint as s, (s + len)::bigint as e, v from placed
            where length(v) >= [6, 20, 24, 20][rank + 1]),
  lone as (select * from cands c where rank < 3 or ({_LIVE} and not exists (
             select 1 from cands b where b.rid = c.rid and b.rank < 3 and b.s < c.e and b.e > c.s))),
  texts as (select rid, sha256(t) as content from srows),
  owned as (select v, count(distinct coalesce(owner, chr(1))) > 2 or count(distinct coalesce(owner, chr(1)) || content) > 20 as example
            from lone join texts using (rid) group by v),
  marked as (select l.*, example, ({_LIVE}) and not example as live,
                    ['assign', 'access', 'hex', 'token'][rank + 1] || ':' || s || ':' || e as label
             from lone l join owned using (v)),
  listed as (select rid, count(*) filter (where rank = 0) as n0, count(*) filter (where rank = 1) as n1,
                    count(*) filter (where rank = 2) as n2,
                    string_agg(label, ',' order by s, rank) filter (where rank < 3) as base,
                    string_agg(label, ',' order by s, rank) as spans,
                    count(*) filter (where live) as n_live, count(*) filter (where example) as n_example
             from marked where rank < 3 or live group by rid)
select repo as doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access,
       coalesce(n2, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example
from srows left join listed using (rid)"""

EXACT = r"""
with rows as (select row_number() over () as rid, doc_id, coalesce(text, '') as t,
                     regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by norm)::bigint as group_size,
       first_value(rid) over g = rid as kept, sha256(norm) as text_sha256
from rows
window g as (partition by norm order by length(t) desc, doc_id nulls last, rid
             rows between unbounded preceding and unbounded following)"""

LINES = r"""
with parts as (select row_number() over () as rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) as p from documents),
  raw as (select rid, doc_id, unnest(range(0, len(p))) as pos, unnest(p) as line from parts),
  lines as (select rid, doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as l,
                   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from raw
            where regexp_matches(line, '[^\x20\x09-\x0D]')),
  cum as (select *, coalesce(sum(n) over (partition by rid order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before
          from lines),
  ends as (select *, before + n as upto from cum),
  wins as (
    select rid, doc_id, list_sort(list({'p': pos, 'l': l}) over w) as c, max(upto) over w - min(before) over w as total
    from ends window w as (partition by rid order by before range between current row and 49 following)
    union all
    select rid, doc_id, list_sort(list({'p': pos, 'l': l}) over w), max(upto) over w - min(before) over w
    from ends window w as (partition by rid order by upto range between 49 preceding and current row)),
  placed as (select rid, doc_id, list_transform(c, lambda x: x.l) as content, c[1].p as s, c[len(c)].p as e
             from wins where total >= 50),
  firsts as (select content, arg_min({'rid': rid, 'e': e}, {'d': doc_id, 's': s}) as f from placed group by content),
  gone as (select distinct rid, unnest(range(s, e + 1)) as pos from placed join firsts using (content)
           where rid <> f.rid or s > f.e),
  runs as (select rid, string_agg(lo || ':' || hi, ',' order by lo) as runs, sum(hi - lo)::bigint as n from (
             select rid, min(pos) as lo, max(pos) + 1 as hi from (
               select rid, pos, pos - row_number() over (partition by rid order by pos) as g from gone) group by rid, g)
           group by rid),
  left_ as (select rid, string_agg(line, chr(10) order by pos) as text from raw anti join gone using (rid, pos) group by rid)
select doc_id, case when r.runs is null then parts.text else coalesce(l.text, '') end as text, len(p)::bigint as n_lines,
       coalesce(r.n, 0)::bigint as n_deleted, coalesce(r.runs, '') as runs
from parts left join runs r using (rid) left join left_ l using (rid)"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
MIX = f"""
with recursive docs as (select row_number() over () as rid, doc_id, source, {_WORDS}::bigint as size,
                md5('shuffle|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as h from documents),
  sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
              from docs group by source),
  weighed as (select *, case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w from sources),
  ranked as (select *, 3.0 * source_size / w as r from weighed),
  levels as (select r, (sum(source_size) over () - coalesce(sum(3.0 * source_size) over before, 0.0))
                       / (sum(w) over () - coalesce(sum(w) over before, 0.0)) as level
             from ranked window before as (order by r, place rows between unbounded preceding and 1 preceding)),
  aimed as (select ranked.*, least(3.0 * source_size, w * (select min_by(level, r) from levels where level <= r)) as target
            from ranked),
  total as (select sum(source_size)::bigint as n, greatest(1, least(2048, sum(source_size) // 131072))::bigint as block,
                   sum(target) as goal from aimed),
  spans as (select aimed.*, round(coalesce(sum(target) over (order by place rows between unbounded preceding and 1 preceding), 0.0)
                   / goal * 2147483648)::bigint as first, greatest(1, ceil(source_size / block::double))::bigint as n_blocks
            from aimed, total),
  slots as (select i, ((i % 2147483648) * 1327217885 + 1073741824) % 2147483648 as point
            from (select unnest(range(0, n // block)) as i from total)),
  named as (select i, s.place, s.n_blocks, row_number() over (partition by s.place order by i) - 1 as rank
            from slots asof join (select * from spans where target > 0) s on slots.point >= s.first),
  uses as (select place, rank % n_blocks as b, count(*) as uses from named where rank < 3 * n_blocks group by 1, 2),
  stream as (select docs.*, s.place, coalesce(sum(size) over (partition by docs.source order by h, rid
                   rows between unbounded preceding and 1 preceding), 0)::bigint as p0
             from docs join spans s on s.source is not distinct from docs.source),
  pieces as (select rid, place, p0, size, block, unnest(range(p0 // block, (p0 + size - 1) // block + 1)) as b
             from stream, total where size > 0),
  took as (select rid, sum((least(p0 + size, (b + 1) * block) - greatest(p0, b * block)) * uses)::bigint as n
           from pieces join uses using (place, b) group by rid)
select docs.doc_id, docs.size, s.source_size, s.target, coalesce(took.n, 0)::bigint as taken
from docs join spans s on s.source is not distinct from docs.source left join took using (rid)"""

ORACLES: dict[str, str] = {
    "op5_secret_scan": SECRETS,
    "op4_mixing": MIX,
    "op6_chunk_dedup": EXACT,
    "op8_line_dedup": LINES,
    "op1_host_quality": f"with {JUDGED} select * exclude (rid) from judged",
}
