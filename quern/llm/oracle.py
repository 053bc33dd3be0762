"""Queries of the ten problems that SQL can state, for DuckDB."""

from __future__ import annotations

from quern.plans.oracle import LABEL, repo, split, strip, valid


TERMS = f"""v as (select id, type, scope from {LABEL}),
t as (select id, 'type' as field, regexp_replace(rtrim(lower({strip('type')}), '!'), '[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]+$', '', 'g') as term from v
  union all select id, 'scope', lower({strip('p')}) from (select id, unnest(regexp_split_to_array(coalesce(scope, ''), '[,/+]')) as p from v)),
n as (select count(*) as n from v),
f as (select field, term, count(*) as occurrences, count(distinct id) as records from t where term <> '' group by 1, 2),
m as (select field, term, occurrences, records, case when records < 3 then 'rare' when records > n * 0.05::double then 'common' else 'useful' end as mark from f, n)"""

PATH = "regexp_replace(replace({}, '\\', '/'), '^(\\./+)+', '')"
# Fixed values, stated again here so that a wrong list can't be wrong on both sides.
KIND = r"""case
  when nm in ('package-lock.json', 'npm-shrinkwrap.json', 'pnpm-lock.yaml', 'pnpm-lock.yml', 'yarn.lock', 'go.sum', 'go.work.sum', 'packages.lock.json', 'gradle.lockfile', 'package.resolved', 'bun.lockb', 'mix.lock', 'cargo.lock', 'gopkg.lock') or nm like '%.lock' then 'lock'
  when regexp_matches(nm, '[.-]min\.(js|mjs|cjs|css|html|js\.map|css\.map)$') then 'minified'
  when regexp_matches(nm, '\.(bundle|chunk|packed)\.(js|mjs|css)$') or regexp_matches(nm, '\.(js|mjs|css|ts)\.map$')
    or (regexp_matches(nm, '[.-][0-9a-f]{8,}\.(js|mjs|css)$') and regexp_matches(regexp_extract(nm, '[.-]([0-9a-f]{8,})\.(js|mjs|css)$', 1), '[0-9]')) then 'bundled'
  when regexp_matches(nm, '\.(generated|gen|g|freezed)\.[a-z]+$') or regexp_matches(nm, '_generated\.[a-z]+$') or nm like 'zz\_generated.%' escape '\' or regexp_matches(nm, '_pb2(_grpc)?\.pyi?$')
    or regexp_matches(nm, '\.pb(\.gw|\.validate)?\.(go|cc|h|swift|dart)$') or regexp_matches(nm, '_grpc\.pb\.(go|cc|h)$') or regexp_matches(nm, '\.designer\.(cs|vb)$') or regexp_matches(nm, '^(moc|qrc|ui)_.*\.(cpp|cxx|cc|h|py)$')
    or regexp_matches(nm, '\.tab\.(c|h|cc|cpp|hh)$') or nm = 'lex.yy.c' or regexp_matches(nm, '\.yy\.(c|cc|cpp)$') or regexp_matches(nm, '\.graphql\.(js|ts|tsx)$') or regexp_matches(nm, '\.(swagger|openapi)\.json$') then 'generated'
  when regexp_matches(nm, '\.bin\.(h|c|hpp|inc)$') or regexp_matches(nm, '[_.-](wasm_binary|wasm|base64|b64|blob|binary|font|hexdump)\.(js|ts|mjs|py|go|c|h|rs|java)$') or regexp_matches(nm, '\.(wasm|bin|dat|ttf|woff2?|eot)\.(js|ts|h|c|go|py)$') then 'data'
  when regexp_matches(nm, '^[a-z0-9_.+-]+[-.]v?[0-9]+\.[0-9]+(\.[0-9]+)*\.(js|mjs|css)$') then 'library'
  when list_has_any(fo, ['generated', '__generated__', 'autogenerated', 'auto_generated', 'autogen', 'gen-src', 'generated-src', 'generated-sources', 'generated_sources', 'src-gen', 'codegen-out']) then 'generated'
  when list_has_any(fo, ['vendor', 'vendors', 'vendored', '_vendor', 'third_party', 'third-party', 'thirdparty', '3rdparty', '3rd_party', 'node_modules', 'bower_components', 'jspm_packages', 'godeps', 'site-packages', 'dist-packages', 'pods', 'carthage', 'externals'])
    or regexp_matches(lp, '(^|/)deps/[^/]+-v?[0-9]+\.[0-9][^/]*/') then 'third_party'
  when list_has_any(fo, ['dist', 'build', 'target', 'out', 'obj', '_build', '.next', '.nuxt', '__pycache__', 'coverage', 'htmlcov', 'deriveddata', 'cmakefiles']) then 'build' end"""
# a shell glob as a regex: its own characters escaped, sets kept; * also crosses /
GLOB = "'^' || replace(replace(replace(regexp_replace(g, '([.+()|^${}\\\\])', '\\\\\\1', 'g'), '[!', '[^'), '*', '.*'), '?', '.') || '$'"

FOUND2 = f"""recursive al as (select {repo('alias_url')} as a, {repo('repo_url')} as b from repo_alias), ed as (select a, b from al union select b, a from al),
reach as (select a as v, a as w from ed union select reach.v, ed.b from reach join ed on reach.w = ed.a), comp as (select v as repo, min(w) as owner from reach group by v),
l as (select id, {repo('source_repo_url')} as repo, changed_paths from {LABEL}), p as (select distinct id, repo, unnest(changed_paths) as raw from l),
q as (select id, repo, raw, {PATH.format('raw')} as path from p where length(raw) > 0),
k as (select *, lower(path) as lp, string_split(lower(path), '/')[-1] as nm, string_split(lower(path), '/')[:-2] as fo from q),
mf as (select {repo('repo_url')} as repo, exclude_globs from source_manifest where {repo('repo_url')} is not null qualify row_number() over (partition by {repo('repo_url')} order by _ord desc) = 1),
gl as (select repo, string_agg({GLOB}, '|') as rx from (select repo, unnest(exclude_globs) as g from mf) where g <> '' group by repo),
ow as (select k.*, coalesce(owner, repo) as own, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from k left join comp using (repo)),
dn as (select distinct own, dir, regexp_replace(nm, '[0-9]+', '0', 'g') as n from ow where own is not null and contains(path, '/')),
gr as (select own, dir, n, n || '/' || lead(n, 1) over o || '/' || lead(n, 2) over o as g from dn window o as (partition by own, dir order by n)),
pr as (select distinct own, dir, min(g) over (partition by own, dir order by n rows between current row and 1 following) as p from gr where g is not null),
rc as (select p, count(distinct own) as repos from pr group by p),
cp as (select own, dir, true as copy from pr join rc using (p) group by own, dir having count(*) filter (repos >= 20) >= 0.8 * count(*)),
kd as (select id, raw, case when copy then 'copy' else coalesce({KIND}, case when coalesce(regexp_matches(path, rx), false) then 'glob' end) end as kind from ow left join cp using (own, dir) left join gl using (repo))"""

# Entities of plans on a circle by hash, tried with 32 hashes and 100 starts.
SPLITS4 = f"""recursive e as (select {repo('alias_url')} as a, {repo('repo_url')} as b from repo_alias), ed as (select a, b from e union select b, a from e), reach as (select a as v, a as w from ed union select reach.v, ed.b from reach join ed on reach.w = ed.a), comp as (select v, min(w) as c from reach group by v),
w as (select id, plan_id, coalesce({repo('repo_url')}, 'window:' || id) as r, {split('split')} as s, greatest(coalesce(target_records, 0), 0) as target from {valid('split_plan', 'id')}), x as (select w.*, coalesce(c, r) as ent from w left join comp on v = r),
per as (select plan_id, ent, sum(target) as t, count(*) as n from x group by 1, 2), tot as (select plan_id, sum(t) as total, sum(n) as cnt from per group by 1),
z as (select per.plan_id, ent, case when total > 0 then t else n end::double as weight, case when total > 0 then total else cnt end::double as total from per join tot on per.plan_id is not distinct from tot.plan_id),
h as (select z.*, seed, ('0x' || substr(sha256(ent || ':' || seed), 1, 15))::ubigint as hash from z, (select unnest(range(32)) as seed)),
m as (select *, (sum(weight) over (partition by plan_id, seed order by hash, ent rows unbounded preceding) - weight / 2) / total as middle from h),
g as (select {split('split')} as s, max(share) as share from split_target where share > 0 group by 1), gs as (select s, share, row_number() over (order by s) - 1 as k, sum(share) over (order by s) / sum(share) over () as upto, share / sum(share) over () as part from g where s is not null),
tr as (select m.*, turn, (middle - turn / 100.0::double) % 1.0::double as o from m, (select unnest(range(100)) as turn)), pl as (select *, (select count(*) from gs where k < (select max(k) from gs) and (case when o < 0 then (o + 1.0::double) % 1.0::double else o end) >= upto) as place from tr),
er as (select pl.plan_id, seed, turn, gs.k, abs(sum(case when place = gs.k then weight else 0.0 end) / max(total) - max(part)) as e from pl, gs group by 1, 2, 3, 4), bt as (select plan_id, seed, turn, round(max(e), 9) as e from er group by 1, 2, 3),
be as (select * from bt qualify row_number() over (partition by plan_id order by e, seed, turn) = 1),
asg as (select pl.plan_id, ent, gs.s as split from pl join be on pl.plan_id is not distinct from be.plan_id and pl.seed = be.seed and pl.turn = be.turn join gs on gs.k = place)"""

OVERLAP = f"""v as (select id, {repo('source_repo_url')} as repo, {split('data_split')} as s, lower({strip('source_commit')}) as c, list_sort(list_distinct(list_transform(list_filter(changed_paths, lambda x: length(x) > 0), lambda x: {PATH.format('x')}))) as ps from {LABEL}),
w as (select * from v where s is not null), d as (select * from w where s = 'DEV'), h as (select * from w where s <> 'DEV'),
a as (select d.id as x, h.id as y from d join h on substr(d.c, 1, 7) = substr(h.c, 1, 7) and length(d.c) >= 7 and length(h.c) >= 7 and (starts_with(d.c, h.c) or starts_with(h.c, d.c)) where regexp_matches(d.c, '^[0-9a-f]+$') and regexp_matches(h.c, '^[0-9a-f]+$')),
dp as (select id, len(ps) as n, unnest(ps) as p from d where len(ps) >= 5), hp as (select id, len(ps) as n, unnest(ps) as p from h where len(ps) >= 5),
b as (select dp.id as x, hp.id as y from dp join hp using (p) group by dp.id, hp.id, dp.n, hp.n having count(*) * 5 >= (dp.n + hp.n - count(*)) * 4)"""

CAP = f"""v as (select id, coalesce({repo('source_repo_url')}, '') as repo, case when confidence is null or isnan(confidence) or confidence < 0 or confidence > 1 then -1 else confidence end as q from {LABEL}),
r as (select *, row_number() over (partition by repo order by q desc, id) as rn, (select count(*) // 100 from v) as cap from v)"""

SQL: dict[str, str] = {
    "p1_found": f"with {TERMS} select field, term, mark from m where mark <> 'useful'",
    "p1_terms": f"with {TERMS} select * from m",
    "p2_found": f"with {FOUND2} select id as label_id, raw as path from kd where kind is not null",
    "p2_report": f"with {FOUND2} select kind, count(*) as paths, count(distinct id) as labels from kd group by kind",
    "p2_recurring": f"with {FOUND2} select repos, count(*) as prints from rc group by repos",
    "p3_found": f"with {OVERLAP} select distinct least(x, y) as label_id_a, greatest(x, y) as label_id_b from (from a union all from b)",
    "p3_report": f"""with {OVERLAP}, sets as (select distinct ps, s = 'DEV' as dev from w where len(ps) >= 5), sp as (select ps, dev, k, ps[k : k + 2] as span from (select *, unnest(range(1, len(ps) - 1)) as k from sets)),
      sh as (select span from sp group by span having bool_or(dev) and bool_or(not dev)), cv as (select ps, count(distinct k + j) as covered from (select ps, k from sp where not dev and span in (from sh)) cross join (values (0), (1), (2)) o(j) group by ps),
      al as (select y, true as l from a group by y), bl as (select y, true as l from b group by y)
      select h.s as split, repo, count(*) as labels, count(*) filter (al.l or bl.l) as leaked, count(*) filter (al.l) as by_commit, count(*) filter (bl.l) as by_paths,
      cast(coalesce(sum(case when len(h.ps) >= 5 then len(h.ps) end), 0) as bigint) as paths, cast(coalesce(sum(covered), 0) as bigint) as covered
      from h left join al on al.y = h.id left join bl on bl.y = h.id left join cv on cv.ps = h.ps group by 1, 2""",
    "p4_found": f"""with recursive e as (select {repo('alias_url')} as a, {repo('repo_url')} as b from repo_alias), ed as (select a, b from e union select b, a from e),
      reach as (select a as v, a as w from ed union select reach.v, ed.b from reach join ed on reach.w = ed.a), comp as (select v, min(w) as c from reach group by v),
      w as (select id, plan_id, coalesce({repo('repo_url')}, 'window:' || id) as r, {split('split')} as s from {valid('split_plan', 'id')}), x as (select w.*, coalesce(c, r) as ent from w left join comp on v = r)
      select id as window_id from x where (coalesce(plan_id, chr(0)), ent) in (select (coalesce(plan_id, chr(0)), ent) from x group by coalesce(plan_id, chr(0)), ent having count(distinct s) > 1)""",
    "p4_splits": f"with {SPLITS4} select x.plan_id, x.id as window_id, x.r as repo, x.ent as entity, x.s as split_now, asg.split, x.target from x join asg on x.plan_id is not distinct from asg.plan_id and x.ent = asg.ent",
    "p4_report": f"with {SPLITS4}, q as (select x.plan_id, asg.split, cast(sum(x.target) as bigint) as target from x join asg on x.plan_id is not distinct from asg.plan_id and x.ent = asg.ent group by 1, 2) select *, target / nullif(sum(target) over (partition by plan_id), 0) as part from q",
    "p5_loss_tokens": f"""with v as (select * from {valid('sequence_metadata', 'record_id')}), g as (select *, coalesce(loss_tokens > 0, false) and not coalesce(input_length > 0 and loss_tokens > input_length, false) as good from v),
      l as (select regexp_replace(id, '^generated-', '') as source_diff_id, {repo('source_repo_url')} as repo from {LABEL} where starts_with(id, 'generated-')),
      s as (select repo, count(*) as records, count(*) filter (not good) as invalid, cast(sum(case when good then loss_tokens else 0 end) as bigint) as tokens from g left join l using (source_diff_id) group by repo),
      mf as (select {repo('repo_url')} as repo, nullif(lower({strip('ecosystem')}), '') as ecosystem from source_manifest where {repo('repo_url')} is not null qualify row_number() over (partition by {repo('repo_url')} order by _ord desc) = 1)
      select s.repo, ecosystem, records, invalid, tokens from s left join mf using (repo)""",
    "p6_found": f"with {CAP} select id as label_id from r where rn > cap",
    "p6_report": f"with {CAP} select repo, count(*) as labels, count(*) filter (rn > cap) as beyond from r group by repo",
    "p7_found": f"""select record_id from {valid('sequence_metadata', 'record_id')} m left join (select materialization_id, max(context_tokens) as run from sequence_run where context_tokens > 0 group by 1) using (materialization_id)
      where input_length > coalesce(case when context_tokens > 0 then context_tokens end, run)""",
    "p8_found": """with w as (select item_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '\\p{Cf}', '', 'g')), '[\\p{L}\\p{N}]+') as ws from eval_item),
      i as (select distinct item_id, array_to_string(ws[k : k + 12], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 11)) as k from w where len(ws) >= 13)),
      d as (select doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '\\p{Cf}', '', 'g')), '[\\p{L}\\p{N}]+') as ws from documents),
      g as (select doc_id, array_to_string(ws[k : k + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as k from d where len(ws) >= 13))
      select distinct doc_id, item_id from g join i using (g)""",
}
