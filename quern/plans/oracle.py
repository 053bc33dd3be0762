"""The core queries in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from quern.functions.columns import REPO_KEY_SQL, STRIP_SQL
from quern.functions.commits import TYPES, VAGUE
from quern.functions.paths import GENERIC_TOKENS
from quern.functions.tokens import SPECIAL, TOKEN
from quern.operators.models import DEFAULT_SUBJECT, SUBJECTS


def quoted(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def repo(c: str) -> str:
    return REPO_KEY_SQL.format(c=c)


def strip(c: str) -> str:
    return STRIP_SQL.format(c=c)


def split(c: str) -> str:
    return f"(case when upper({strip(c)}) in ('DEV','REPORT','HELD_OUT') then upper({strip(c)}) end)"


def valid(name: str, key: str) -> str:
    return f"(select * from {name} where {key} is not null qualify row_number() over (partition by {key} order by _ord desc) = 1)"


HEADER = r"^([a-z][a-z0-9-]*)(?:\(([^()\r\n]+)\))?(!)?: ([^\r\n]+)$"
FOOTER = r"^(BREAKING CHANGE|[A-Za-z-]+)(: | #).+"

PARSED = f"""m as (select *, regexp_replace(array_to_string(list_concat([header], coalesce(body, []), coalesce(footers, [])), chr(10)), '^\\n+|\\n+$', '', 'g') as raw from {valid('generated_label', 'id')}),
l as (select *, case when raw = '' then [] else string_split(raw, chr(10)) end as lines from m),
h as (select *, coalesce(lines[1], '') as head, lines[2:] as rest from l),
f as (select *, coalesce(list_position(list_transform(rest, lambda x: regexp_matches(x, '{FOOTER}')), true), 0) as foot,
  case when len(lines) = 0 then 'empty commit message' when not regexp_matches(head, '{HEADER}') then 'invalid Conventional Commit header' end as error from h),
p as (select *, case when error is null then regexp_extract(head, '{HEADER}', 1) end as ptype, case when error is null then nullif(regexp_extract(head, '{HEADER}', 2), '') end as pscope,
  case when error is null then trim(regexp_extract(head, '{HEADER}', 4)) end as psubject,
  case when error is null then (case when foot = 0 then rest else rest[1:foot-1] end) end as pbody,
  case when error is null then (case when foot = 0 then [] else rest[foot:] end) end as pfoot from f)"""

PATH = "regexp_replace(regexp_replace(replace(x, '\\', '/'), '/+', '/', 'g'), '^/|/$', '', 'g')"
VISIBLE = f"""len(list_filter(list_transform(changed_paths, lambda x: {PATH}), lambda x: x <> '' and (
  x = sc or ends_with(x, '/' || sc) or regexp_replace(x, '\\.[^.]*$', '') = sc or ends_with(regexp_replace(x, '\\.[^.]*$', ''), '/' || sc)
  or ltrim(regexp_replace(string_split(x, '/')[-1], '\\.[^.]*$', ''), '_') = sc
  or list_contains(string_split(x, '/')[:-2], sc) or list_contains(list_transform(string_split(x, '/')[:-2], lambda y: ltrim(y, '_')), sc)))) > 0"""

SCORED = f"""{PARSED},
v as (select *, trim(trim(trim(pscope), '/')) as sc, lower(regexp_replace(psubject, '\\s+', ' ', 'g')) as su from p),
s as (select *, {split('data_split')} as split,
  case when error is null then ptype in ({quoted(TYPES)}) else false end as format_validity,
  case when error is null and pscope is not null and len(changed_paths) > 0 then (sc <> '' and {VISIBLE}) end as scope_quality,
  case when error is null then not su in ({quoted(VAGUE)}) and len(string_split(su, ' ')) >= 2 else false end as specificity,
  case when error is null then length(psubject) between 1 and 72 else false end as brevity from v),
e as (select *, case when error is not null then [error] else list_filter([
  case when not format_validity then 'unknown type: ' || ptype end,
  case when not scope_quality then 'scope ''' || pscope || ''' is not visible in changed paths' end,
  case when not specificity then 'subject is too vague' end, case when not brevity then 'subject length is outside the configured limit' end], lambda x: x is not null) end as errors from s)"""

TOKENS = "list_filter(flatten(list_transform(flatten(list_transform(list_transform(changed_paths, lambda p: trim(lower(replace(p, '\\', '/')), '/')), lambda p: string_split(p, '/'))), lambda s: regexp_split_to_array(ltrim(regexp_replace(s, '\\.[^.]*$', ''), '_'), '[^a-z0-9]+'))), lambda t: t <> '')"

LABEL = valid("generated_label", "id")

WANTED = {"type_accuracy": "want_type is not null", "factuality": "len(claims) > 0", "body_presence": "confidence > 0.7", "footer_presence": "confidence < 0.5", "mixed_change_warning": "verifier_score < 0.7", "breaking_change_detection": "ends_with(type, '!')"}
JUDGED = {
    "type_accuracy": "ptype = want_type", "factuality": "not contains(lower(raw), lower(claims[1]))", "body_presence": "len(list_filter(pbody, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) > 0", "footer_presence": "len(pfoot) > 0",
    "mixed_change_warning": "contains(lower(raw), 'mixed') or contains(lower(raw), 'split') or contains(lower(raw), 'separate commit')", "breaking_change_detection": "regexp_extract(head, '{h}', 3) = '!' or len(list_filter(pfoot, lambda x: starts_with(x, 'BREAKING CHANGE:'))) > 0".replace("{h}", HEADER),
}
#: The ten signals with what the label's other columns lead one to expect.
SIGNALS = f"""{PARSED}, v as (select *, trim(trim(trim(pscope), '/')) as sc, lower(regexp_replace(psubject, '\\s+', ' ', 'g')) as su, lower({strip('type')}) as want_type, case when confidence > 0.9 then scope end as want_scope, {TOKENS}[1:1] as claims from p),
g as (select *, case when error is null then ptype in ({quoted(TYPES)}) else false end as format_validity,
  case when want_scope is not null then error is null and pscope is not distinct from want_scope when error is null and pscope is not null and len(changed_paths) > 0 then (sc <> '' and {VISIBLE}) end as scope_quality,
  case when error is null then not su in ({quoted(VAGUE)}) and len(string_split(su, ' ')) >= 2 else false end as specificity, case when error is null then length(psubject) between 1 and 72 else false end as brevity,
  {", ".join(f"case when {w} then error is null and ({JUDGED[k]}) end as {k}" for k, w in WANTED.items())} from v)"""
# a shell glob as a regex: its own characters escaped, sets kept; * also crosses /
GLOB = "'^' || replace(replace(replace(regexp_replace(g, '([.+()|^${}\\\\])', '\\\\\\1', 'g'), '[!', '[^'), '*', '.*'), '?', '.') || '$'"
PLAN = f"(select id, plan_id, {repo('repo_url')} as repo, {split('split')} as split, case when regexp_matches(start_at, '(Z|[+-]\\d\\d:?\\d\\d)$') then try_cast(start_at as timestamptz) end as s, case when regexp_matches(end_at, '(Z|[+-]\\d\\d:?\\d\\d)$') then try_cast(end_at as timestamptz) end as e, target_records from {valid('split_plan', 'id')})"



def tokenized(c: str) -> str:
    """RE2 knows blanks outside ASCII only by class, so they are made spaces first."""
    return f"regexp_extract_all(regexp_replace({c}, '[\\p{{Z}}\\x{{85}}\\x1C-\\x1F]', ' ', 'g'), '{TOKEN}')"


def ints_sha(ids: str) -> str:
    """SHA-256 over 4-byte little-endian integers."""
    h = "printf('%08x', x & 4294967295)"
    return f"sha256(unhex(array_to_string(list_transform({ids}, lambda x: {' || '.join(f'substr({h}, {k}, 2)' for k in (7, 5, 3, 1))}), '')))"


STREAMS = f"""c as (select id, coalesce({split('data_split')}, 'NONE') as data_split, array_to_string(changed_paths, chr(10)) as usr, array_to_string(list_concat([header], coalesce(body, []), coalesce(footers, [])), chr(10)) as reply from {LABEL}),
st as (select *, list_transform({tokenized('usr')}, lambda t: case when t = chr(10) then '<nl>' else t end) as u, list_transform({tokenized('reply')}, lambda t: case when t = chr(10) then '<nl>' else t end) as a from c),
tk as (select *, list_concat(['<bos>', '<user>'], u, ['<sep>', '<assistant>'], a, ['<sep>', '<eos>']) as tokens from st)"""
VOCAB = f"""cnt as (select token, count(*) as n from (select unnest(tokens) as token from tk where data_split = 'DEV') group by token),
voc as (select row_number() over (order by n desc, token) - 1 + {len(SPECIAL)} as id, token, n from cnt where token not in ({quoted(SPECIAL)}) and n >= 2 order by n desc, token limit {32000 - len(SPECIAL)}),
spec as (select unnest(range({len(SPECIAL)})) as id, unnest([{quoted(SPECIAL)}]) as token),
vocab as (select cast(id as integer) as id, token, n as "count" from voc union all select cast(spec.id as integer), spec.token, coalesce(cnt.n, 0) from spec left join cnt using (token))"""

DOCS = "(starts_with({p}, 'docs/') or ends_with({p}, '.md') or contains({p}, '/docs/'))".format(p="lower(replace(x, '\\', '/'))")
TESTS = "regexp_matches(lower(replace(x, '\\', '/')), '^tests?/|/tests?/|test_|_test\\.')"
CHURN = "case ty " + " ".join("when '{}' then {}".format(k, " || ".join(p for p in (f"'{t.split('{}')[0]}'", "topic", f"'{t.split('{}')[1]}'"))) for k, t in SUBJECTS.items()) + " else '{}' || topic || '{}' end".format(*DEFAULT_SUBJECT.split("{}"))

MERGED = """with recursive r as (select id, source_commit, _ord, row_number() over (order by _ord % 2 desc, _ord) as rn, count(*) over (partition by id) as ni, count(*) over (partition by source_commit) as nc from generated_label where id is not null and source_commit is not null),
      d as (select *, row_number() over (order by rn) as k from r where ni > 1 or nc > 1),
      g as (select 0::bigint as k, false as kept, []::varchar[] as ps, []::varchar[] as ss union all select d.k, not list_contains(ps, d.id) and not list_contains(ss, d.source_commit), case when not list_contains(ps, d.id) and not list_contains(ss, d.source_commit) then list_append(ps, d.id) else ps end,
        case when not list_contains(ps, d.id) and not list_contains(ss, d.source_commit) then list_append(ss, d.source_commit) else ss end from g join d on d.k = g.k + 1)"""

PREDICTED = f"""{PARSED}, d as (select id, {split('data_split')} as sp, changed_paths, ptype, raw, pscope, {TOKENS} as tk from p where ptype in ({quoted(TYPES)})),
      mo as (select token, ptype as ty, count(*) as n from (select unnest(tk) as token, ptype from d where sp = 'DEV') group by 1, 2),
      e as (select id, unnest(tk) as token, unnest(range(len(tk))) as pos from d where sp = 'REPORT'), g as (select id, token, count(*) as k, min(pos) as pos from e group by 1, 2),
      s1 as (select id, ty, sum(k * n) as score, min(pos) as pos from g join mo using (token) group by 1, 2),
      s2 as (select d.id, x.ty, x.n as score, 0 as pos from d cross join (select ptype as ty, count(*) as n from d where sp = 'DEV' group by 1) x where d.sp = 'REPORT' and d.id not in (select id from s1)),
      s3 as (select id, 'docs' as ty, 3 as score, 1073741824 as pos from d where sp = 'REPORT' and len(list_filter(changed_paths, lambda x: {DOCS})) > 0 union all select id, 'test', 2, 1073741824 from d where sp = 'REPORT' and len(list_filter(changed_paths, lambda x: {TESTS})) > 0),
      a as (select id, ty, sum(score) as score, min(pos) as pos from (from s1 union all from s2 union all from s3) group by 1, 2),
      w as (select id, case when ty in ({quoted(TYPES)}) then ty else 'chore' end as ty from a qualify row_number() over (partition by id order by score desc, pos, ty) = 1),
      t as (select w.id, w.ty, d.ptype, coalesce(list_filter(d.tk, lambda t: t not in ({quoted(GENERIC_TOKENS)}))[1], 'project') as topic from w join d using (id))"""

SQL: dict[str, str] = {
    "commit_parse": f"""with {PARSED} select id, ptype as type, pscope as scope, psubject as subject, cast(len(pbody) as bigint) as n_body, cast(len(pfoot) as bigint) as n_footers,
      case when error is null then regexp_extract(head, '{HEADER}', 3) = '!' or len(list_filter(pfoot, lambda x: starts_with(x, 'BREAKING CHANGE:'))) > 0 end as breaking, error from p""",
    "commit_score": f"""with {SIGNALS} select id, format_validity, type_accuracy, scope_quality, factuality, specificity, brevity, body_presence, footer_presence, mixed_change_warning, breaking_change_detection,
      case when error is not null then 1 else cast(len(list_filter([format_validity, type_accuracy, scope_quality, factuality, specificity, brevity, body_presence, footer_presence, mixed_change_warning, breaking_change_detection], lambda x: not x)) as bigint) end as n_errors from g""",
    "mixed_messages": f"""with p as (select unnest(range(5)) as phrase, unnest(['', 'Mixed: ', 'split of ', 'a separate commit: ', 'separate ']) as p), x as (select phrase, lower('fix: ' || p || coalesce(header, '')) as low from p, {LABEL})
      select phrase, contains(low, 'mixed') or contains(low, 'split') or contains(low, 'separate commit') as mixed, count(*) as labels from x group by 1, 2""",
    "score_report": f"""with {SCORED}, x as (select coalesce(split, 'NONE') as split, unnest(['format_validity','scope_quality','specificity','brevity']) as signal, unnest([format_validity, scope_quality, specificity, brevity]) as v from e)
      select coalesce(split, 'ALL') as split, signal, count(*) filter (v) as n_true, count(*) filter (not v) as n_false, count(*) filter (v is null) as n_null from x group by grouping sets ((split, signal), (signal))""",
    "verifier": f"""with {SCORED}, ev as (select *, list_transform(evidence_paths, lambda p: regexp_replace(p, '(#L\\d+(?:-L?\\d+)?|:\\d+(?::\\d+)?)$', '')) as bare from e),
      k as (select *, list_distinct(list_filter(bare, lambda p: list_contains(changed_paths, p))) as kept from ev)
      select id, round((format_validity::int + specificity::int + brevity::int + (len(list_filter(errors, lambda x: not (starts_with(x, 'scope ') and contains(x, ' is not visible in changed paths')))) = 0)::int + (len(kept) > 0)::int + 1) / 6.0::double, 6) as verifier,
      cast(len(kept) as bigint) as kept, cast(len(list_filter(bare, lambda p: not list_contains(changed_paths, p))) as bigint) as dropped from k""",
    "top_errors": f"with {SCORED} select error, count(*) as n from (select unnest(errors) as error from e) group by error order by n desc, error limit 10",
    "path_tokens": f"select token, count(*) as n from (select unnest({TOKENS}) as token from {LABEL}) group by token",
    "path_flags": f"""select id, len(list_filter(changed_paths, lambda x: {DOCS})) > 0 as docs, len(list_filter(changed_paths, lambda x: {TESTS})) > 0 as tests,
      len(list_filter(changed_paths, lambda x: list_has_any(string_split(lower(x), '/'), ['snapshot','snapshots','baselines']))) > 0 as snapshots,
      cast(len(list_distinct(list_transform(changed_paths, lambda x: regexp_extract(string_split(x, '/')[-1], '(\\.[^.]*)$', 1)))) as bigint) as extensions,
      coalesce(list_filter({TOKENS}, lambda t: t not in ({quoted(GENERIC_TOKENS)}))[1], 'project') as topic from {LABEL}""",
    "repo_keys": f"select {repo('source_repo_url')} as repo, count(*) as rows, count(distinct source_repo_url) as spellings from generated_label group by 1",
    "change_ids": f"""select id, replace(split_part(regexp_replace(regexp_replace(source_repo_url, '/+$', ''), '\\.git$', ''), 'github.com/', -1), '/', '-') || '-' || substr(source_commit, 1, 12) as change_id, regexp_replace(id, '^generated-', '') as source_diff_id from {LABEL}""",
    "window_overlaps": f"select plan_id, repo, id from (select *, lag(e) over (partition by plan_id, repo order by s nulls first, e nulls first, id) as pe from {PLAN}) where s < pe",
    "split_assign": f"""with r as (select id, {repo('source_repo_url')} as repo, case when regexp_matches(generation_timestamp, '(Z|[+-]\\d\\d:?\\d\\d)$') then try_cast(generation_timestamp as timestamptz) end as t from {LABEL}),
      j as (select r.id, r.repo, w.split from r join {PLAN} w on r.repo = w.repo and t >= w.s and t < w.e qualify row_number() over (partition by r.id order by w.plan_id || '/' || w.id) = 1)
      select split, count(*) as labels, count(distinct repo) as repos from j group by split""",
    "split_summary": f"""select s.split, count(distinct w.repo) as repos, count(w.id) as windows, cast(coalesce(sum(w.target_records), 0) as bigint) as target_records, coalesce(bool_or(w.target_records is null) filter (w.id is not null), false) as missing_targets
      from (values ('DEV'), ('REPORT'), ('HELD_OUT')) s(split) left join {PLAN} w on w.split = s.split group by s.split""",
    "repo_share": f"with n as (select {repo('source_repo_url')} as repo, count(*) as n from {LABEL} group by 1) select cast(sum(n) as bigint) as total, max(n) as largest, round(max(n) / sum(n), 6) as share from n",
    "gate_table": f"""with o as (select count(*) filter ({split('data_split')} = 'DEV') as dev, count(*) filter ({split('data_split')} = 'REPORT') as report, count(distinct {repo('source_repo_url')}) as repos from {LABEL})
      select 'dev_records' as name, dev::double as actual, 'min' as op, 1000.0::double as bound, case when dev >= 1000 then 'pass' else 'fail' end as status from o
      union all select 'report_records', report::double, 'min', 1000000.0, case when report >= 1000000 then 'pass' else 'fail' end from o
      union all select 'repos', repos::double, 'max', 1000.0, case when repos <= 1000 then 'pass' else 'fail' end from o
      union all select 'unmeasured', null, 'min', 1.0, 'unknown'""",
    "label_reference": f"""select case when l.id is null then 'unknown source_diff_id' when m.data_split is distinct from l.data_split then 'data_split does not match' else '' end as errors, count(*) as records
      from {valid('sequence_metadata', 'record_id')} m left join {LABEL} l on regexp_replace(l.id, '^generated-', '') = m.source_diff_id group by 1""",
    "missing_sequences": f"select distinct regexp_replace(id, '^generated-', '') as source_diff_id from generated_label where id is not null and regexp_replace(id, '^generated-', '') not in (select source_diff_id from sequence_metadata where source_diff_id is not null)",
    "duplicate_labels": 'select id, count(*) as n, min(_ord) as "first" from generated_label group by id having count(*) > 1',
    "first_labels": "select id, _ord, header from generated_label qualify row_number() over (partition by id order by _ord) = 1",
    "per_repo_limit": f"select coalesce({repo('source_repo_url')}, '') as repo, id, _ord from generated_label qualify row_number() over (partition by coalesce({repo('source_repo_url')}, '') order by _ord) <= 5",
    "doc_token_counts": f"select doc_id, cast(len({tokenized('text')}) as bigint) as tokens from documents",
    "vocabulary_top": f"with {STREAMS}, {VOCAB} select * from vocab",
    "token_coverage": f"""with {STREAMS}, {VOCAB}, t as (select data_split, unnest(tokens) as token from tk), k as (select t.data_split, count(*) as tokens, count(v.token) as known from t left join vocab v using (token) group by 1),
      r as (select data_split, count(*) as records from tk group by 1) select r.data_split, records, tokens, known, tokens - known as unknown, round(known / tokens, 6) as known_fraction from r join k using (data_split)""",
    "vocabulary_errors": f"""with {STREAMS}, {VOCAB}, v as (select id + case when id >= 100 then 1 else 0 end as id, lower(token) as token from vocab), x as (select *, row_number() over (order by id, token) - 1 as place, row_number() over (partition by token order by id) as k from v)
      select id, token, unnest(list_filter([case when id <> place then 'vocab entry ' || place || ' has a non-contiguous id' end, case when coalesce(length(token), 0) = 0 then 'vocab entry ' || place || ' has an invalid token' when k > 1 then 'duplicate vocab token: ' || token end], lambda x: x is not null)) as error from x""",
    "sequence_plan": f"""with {STREAMS}, {VOCAB}, t as (select id, unnest(tokens) as token from tk), u as (select t.id, count(*) as unknown from t anti join vocab using (token) group by 1)
      select tk.id, data_split, len(tokens) as raw_token_count, coalesce(unknown, 0) as unknown_token_count, cast(ceil(len(tokens) / 8192) as bigint) as raw_sequences_at_context, case when len(tokens) > 65536 then 'exclude_oversize' when len(tokens) > 8192 then 'use_truncated' else 'use_full' end as decision,
      case when len(tokens) > 65536 then 'raw_token_count exceeds max_raw_record_tokens' when len(tokens) > 8192 then 'raw_token_count exceeds context_tokens' else 'raw_token_count fits context_tokens' end as reason, cast(8192 as bigint) as trainer_context_tokens, case when len(tokens) > 65536 then 0 else least(len(tokens), 8192) end as trainer_tokens from tk left join u using (id)""",
    "sequence_accounting": f"""with n as (select case when repo_url is not null then 'DEV' else 'REPORT' end as data_split, len({tokenized("coalesce(text, '')")}) as n from documents), p as (select * from n union all select 'HELD_OUT', null)
      select coalesce(data_split, 'ALL') as data_split, count(n) as records, cast(coalesce(sum(n), 0) as bigint) as raw_tokens, cast(coalesce(sum(case when n > 8192 then 0 when n > 2048 then 2048 else n end), 0) as bigint) as kept_tokens, coalesce(max(n), 0) as longest, count(*) filter (n <= 2048) as use_full, count(*) filter (n > 2048 and n <= 8192) as use_truncated,
      count(*) filter (n > 8192) as exclude_oversize, cast(coalesce(sum(n - 2048) filter (n > 2048 and n <= 8192), 0) as bigint) as truncated_tokens, cast(coalesce(sum(n) filter (n > 8192), 0) as bigint) as excluded_tokens from p group by rollup (data_split)""",
    "sequence_crop": f"""with d as (select doc_id, list_transform({tokenized("coalesce(text, '')")}, lambda t: case when t = chr(10) then '<nl>' else t end) as u, {tokenized("coalesce(source, 'none')")} as a from documents), b as (select *, greatest(2048 - 4 - len(a) - 8, 0) as budget from d),
      c2 as (select *, case when len(u) <= budget then u else list_concat(u[1:(budget + 1) // 2], case when budget // 2 > 0 then u[len(u) - budget // 2 + 1:] else [] end) end as cr from b)
      select doc_id, cast(len(cr) as bigint) as kept, cast(len(cr) + len(a) + 4 + 8 as bigint) as length, cast(len(a) + 2 as bigint) as loss, sha256(array_to_string(list_concat(list_concat(list_concat(['<bos>', '<system>', 'Name', 'the', 'source', '.', '<sep>', '<user>'], cr), ['<sep>', '<assistant>']), list_concat(a, ['<sep>', '<eos>'])), ' ')) as sha256 from c2""",
    "sequence_rows": f"""with {STREAMS}, {VOCAB}, q as (select id, list_concat(list_concat(list_concat(['<bos>', '<system>', 'Commit', 'messages', '.', '<sep>', '<user>'], u), ['<sep>', '<assistant>']), list_concat(a, ['<sep>', '<eos>'])) as t, len(u) as nu, len(a) as na from st),
      e as (select id, unnest(range(len(t))) as pos, unnest(t) as token from q), k as (select e.id, list(coalesce(v.id, 1) order by pos) as ids, count(*) filter (v.id is null) as unknown from e left join vocab v using (token) group by e.id)
      select q.id, 'use_full' as decision, len(t) as raw_token_count, len(t) as input_length, cast(na + 2 as bigint) as loss_tokens, unknown as unknown_tokens, {ints_sha('ids')} as input_ids_sha256, {ints_sha('list_concat(list_transform(range(nu + 9), lambda z: 0), list_transform(range(na + 2), lambda z: 1))')} as loss_mask_sha256, 'full' as policy from q join k using (id)""",
    "input_hashes": f"""select record_id, _ord, {ints_sha('[coalesce(input_length, -1), coalesce(loss_tokens, -1), coalesce(unknown_tokens, -1)]')} as ids_sha256, sha256(record_id) as record_sha256,
      cast(('0x' || {"||".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))})::ubigint % 1000 as integer) as bucket from (select *, sha256(_ord || ':' || (_ord + 1) || ':0') as h from sequence_metadata)""",
    "margin_weights": f"""with {STREAMS}, {VOCAB}, tok as (select id, unnest(range(len(a))) as pos, unnest(a) as token from st where data_split = 'DEV'), cd as (select tok.id, pos, coalesce(v.id, 1) as v from tok left join vocab v using (token)),
      sg as (select *, coalesce(lag(v) over (partition by id order by pos), 0) as p from cd), hs as (select *, sha256(p || ':' || v || ':' || pos) as h, case when v % 2 <> 0 then 1 else -1 end as sign from sg),
      bk as (select *, cast(('0x' || {"||".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))})::ubigint % 256 as integer) as bucket from hs),
      st2 as (select bucket, list({{'s': sign::bigint, 'w': 0::bigint, 'l': 0::bigint, 'n': 0::bigint}} order by id, pos) as steps from bk group by bucket),
      fd as (select bucket, len(steps) as tokens, list_reduce(list_prepend({{'s': 0::bigint, 'w': 0::bigint, 'l': 0::bigint, 'n': 0::bigint}}, steps), lambda q, x: {{'s': 0::bigint, 'w': q.w + case when 1000 - x.s * q.w > 0 then 3 * x.s else 0 end, 'l': q.l + greatest(1000 - x.s * q.w, 0), 'n': q.n + case when 1000 - x.s * q.w > 0 then 1 else 0 end}}) as r from st2)
      select bucket, r.w as weight, r.l as loss, r.n as steps, tokens from fd""",
    "glob_partition": f"""with mf as (select {repo('repo_url')} as repo, exclude_globs from source_manifest where {repo('repo_url')} is not null qualify row_number() over (partition by {repo('repo_url')} order by _ord desc) = 1),
      gl as (select repo, string_agg({GLOB}, '|') as rx from (select repo, unnest(exclude_globs) as g from mf) where g <> '' group by repo)
      select id, cast(len(list_filter(changed_paths, lambda x: not coalesce(regexp_matches(x, rx), false))) as bigint) as included, cast(len(list_filter(changed_paths, lambda x: coalesce(regexp_matches(x, rx), false))) as bigint) as excluded from (select id, {repo('source_repo_url')} as repo, changed_paths from {LABEL}) l left join gl using (repo)""",
    "merged_labels": f"""{MERGED}
      select id, source_commit, _ord from r where ni = 1 and nc = 1 union all select d.id, d.source_commit, d._ord from d join g using (k) where kept""",
    "merge_report": f"""{MERGED}, kp as (select _ord from r where ni = 1 and nc = 1 union all select d._ord from d join g using (k) where kept)
      select cast(case when l._ord % 2 = 1 then 0 else 1 end as integer) as input, count(*) as rows, count(kp._ord) as kept, count(*) - count(kp._ord) as skipped from generated_label l left join kp on kp._ord = l._ord group by 1""",
    "prediction_report": f"""with {PREDICTED}, u as (select t.id, ty || ': ' || {CHURN} as said, ty, t.ptype, raw, pscope, changed_paths, trim(trim(trim(pscope), '/')) as sc from t join d using (id))
      select count(*) as records, count(*) filter (said = raw) as exact_match, count(*) filter (ty = ptype) as type_match, count(*) as valid, count(*) filter (pscope is not null and len(changed_paths) > 0 and sc <> '' and {VISIBLE}) as target_scopes from u""",
    "type_matrix": f"""with {PARSED}, d as (select changed_paths, ptype from p where {split('data_split')} = 'DEV' and ptype in ({quoted(TYPES)}))
      select token, ptype as type, count(*) as n from (select unnest({TOKENS}) as token, ptype from d) group by 1, 2 union all select null, ptype, count(*) from d group by ptype""",
    "predicted_types": f"""with {PREDICTED}
      select id, ty as predicted, {CHURN} as subject, ty = ptype as type_match from t""",
}
