"""The queries of the stages in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from quern.plans.oracle import LABEL, PARSED, SCORED, VISIBLE, repo, split, valid

FIRST = "(select * from generated_label qualify row_number() over (partition by id order by _ord) = 1)"
SPLITS = "('DEV', 'REPORT', 'HELD_OUT')"
KEY = "regexp_replace(id, '^generated-', '')"
ACCEPTED = "accepted_for_teacher_labeling"


def filled(*names: str, at: str = "''") -> list[tuple[str, str]]:
    return [(f"coalesce(length({n}), 0) = 0", f"{at} || '{n} must be a non-empty string'") for n in names]


def begins(name: str, *prefixes: str) -> list[tuple[str, str]]:
    said = "(" + ", ".join(f"''{p}''" for p in prefixes) + (",)" if len(prefixes) == 1 else ")")
    known = " or ".join(f"starts_with({name}, '{p}')" for p in prefixes)
    return [(f"coalesce(length({name}), 0) = 0", f"'{name} must be a non-empty string'"), (f"length({name}) > 0 and not ({known})", f"'{name} must start with one of {said}'")]


def revision(*names: str, most: int = 40) -> list[tuple[str, str]]:
    return [(f"not regexp_matches({n}, '^[0-9a-f]{{7,{most}}}$')", f"'{n} must be a 7-{most} character lowercase hex revision'") for n in names]


def listed(*names: str, least: int = 0) -> list[tuple[str, str]]:
    return [(f"{n} is null", f"'{n} must be a list'") for n in names] + [(f"len({n}) < {least}", f"'{n} must contain at least {least} item(s)'") for n in names if least]


def fraction(*names: str) -> list[tuple[str, str]]:
    return [(f"not coalesce({n} >= 0 and {n} <= 1 and not isnan({n}), false)", f"'{n} must be a number from 0.0 to 1.0'") for n in names]


def differ(what: str, *fields: str, other: str) -> list[tuple[str, str]]:
    entries = lambda c: f"list_sort(map_entries({c}))" if c.endswith("decoding_config") else c
    return [(f"{entries(f)} is distinct from {entries(f'{other}.{f}')}", f"'{f} does not match {what}'") for f in fields]


def errors(rules: list[tuple[str, str]], when: str = "true") -> str:
    """A list of the messages of rules that don't hold."""
    return "list_filter([" + ", ".join(f"case when ({when}) and ({bad}) then {say} end" for bad, say in rules) + "], lambda x: x is not null)"


DATA_SPLIT = [(f"data_split is not null and data_split not in {SPLITS}", "'invalid data_split: ' || data_split")]
PROMPT = [("not regexp_matches(prompt_version, '^[a-z0-9][a-z0-9_.-]*$')", "'prompt_version must be a stable lowercase identifier'")]
SHARED = ["source_repo_url", "source_license", "source_commit", "parent_commit", "data_split", "changed_paths"]
TEACHER = ["teacher_model_id", "teacher_runtime", "teacher_runtime_model_id", "teacher_revision", "teacher_license", "teacher_size", "teacher_context_length", "prompt_version", "decoding_config"]

LABEL_RULES = [
    *filled("id", *SHARED[:5], *TEACHER[:8], "generation_timestamp", "header", "human_review_status"), *DATA_SPLIT, ("data_split = 'HELD_OUT'", "'teacher-generated labels must not be stored as HELD_OUT labels'"), *revision("source_commit", "parent_commit"), *revision("teacher_revision", most=64), *PROMPT,
    *listed("changed_paths", least=1), *listed("body", "footers", "warnings", "evidence_paths"), *fraction("confidence", "verifier_score"), ("decoding_config is null", "'decoding_config must be an object'"), ("parser_result is null", "'parser_result must be an object'"),
]
SOURCES = "(select {k} as id, _ord, source_repo_url, source_license, source_commit, parent_commit, data_split, changed_paths, parent_commit as manifest_revision, header as historical_subject, generation_timestamp as source_commit_timestamp, len(changed_paths) || ' files changed' as diff_stat from {{}})".format(k=KEY)
SOURCE_RULES = [
    *filled("id", *SHARED[:3], "manifest_revision", *SHARED[3:5], "historical_subject"), *filled("source_commit")[:0], *DATA_SPLIT, *revision("manifest_revision", "source_commit", "parent_commit"), ("not regexp_matches(source_commit_timestamp, '^\\d{4}-\\d{2}-\\d{2}T')", "'source_commit_timestamp must be an RFC3339 string when present'"), *listed("changed_paths", least=1),
    ("diff_stat is null", "'diff_stat must be a string'"),
]
SOURCE_REVIEWS = f"(select 'review-' || {KEY} as id, {KEY} as source_diff_id, source_repo_url, source_commit, parent_commit, data_split, changed_paths, case when human_review_status = 'reject' then 'rejected' else '{ACCEPTED}' end as decision, human_review_status as reason, generation_timestamp as review_timestamp, _ord from {FIRST})"
SOURCE_REVIEW_RULES = [*filled("id", "source_diff_id", "source_repo_url", "source_commit", "parent_commit", "data_split", "decision", "review_timestamp"), *DATA_SPLIT, *revision("source_commit", "parent_commit"), *listed("changed_paths", least=1)]
INPUTS = "(select 'teacher-input-' || {k} as id, {k} as source_diff_id, 'review-' || {k} as review_decision_id, {c}, array_to_string(changed_paths, chr(10)) as user_message, header as diff, sha256(header) as diff_sha256, header as historical_subject, len(changed_paths) || ' files changed' as diff_stat, _ord from {{}})".format(k=KEY, c=", ".join(SHARED + TEACHER))
INPUT_RULES = [
    *filled("id", "source_diff_id", "review_decision_id", *SHARED[:5], "teacher_model_id", "teacher_revision", "teacher_license", "prompt_version", "user_message", "diff", "diff_sha256"), *DATA_SPLIT, ("data_split = 'HELD_OUT'", "'teacher inputs must not be generated for HELD_OUT records'"), *revision("source_commit", "parent_commit", "teacher_revision"), *PROMPT,
    *listed("changed_paths", least=1), ("decoding_config is null", "'decoding_config must be an object'"),
]
LABEL_REVIEWS = f"""(select 'review-' || id as id, id as generated_label_id, source_repo_url, source_commit, teacher_model_id, prompt_version, header, case human_review_status when 'accept_as_is' then 'accept' when 'accept_with_light_edit' then 'edit' when 'reject' then 'reject' when 'not_reviewed' then 'needs_review' end as decision,
  case when human_review_status = 'accept_with_light_edit' then header || ' again' end as edited_header, generation_timestamp as review_timestamp, _ord from {FIRST})"""
LABEL_REVIEW_RULES = [*filled("id", "generated_label_id", "source_repo_url", "source_commit", "teacher_model_id", "prompt_version", "header", "decision", "review_timestamp"), *revision("source_commit"), *PROMPT]
AGAINST = [("l.id <> 'generated-' || i.source_diff_id", "'id does not match teacher input source_diff_id'"), *[(b.replace(b.split(" is distinct")[0], b.split(" is distinct")[0].replace("map_entries(", "map_entries(l.") if "map_entries" in b else "l." + b.split(" is distinct")[0], 1), m) for b, m in differ("teacher input", *SHARED, *TEACHER, other="i")]]
STRANGE = "list_sort(list_distinct(list_filter(l.evidence_paths, lambda x: not list_contains(i.changed_paths, x))))"
AGAINST.append((f"len({STRANGE}) > 0", f"'evidence_paths not present in changed_paths: [' || array_to_string(list_transform({STRANGE}, lambda x: '''' || x || ''''), ', ') || ']'"))
TRAINED = f"""lb as (select *, {errors(LABEL_RULES)} as own from {LABEL}), inp as (select *, {errors(INPUT_RULES)} as own from {INPUTS.format(LABEL)}), src as (select *, {errors(SOURCE_RULES)} as own from {SOURCES.format(LABEL)}), rv as (select *, {errors(LABEL_REVIEW_RULES)} as own from {LABEL_REVIEWS}),
tr as (select rv.id as review_id, rv.generated_label_id, rv.decision, rv.edited_header, rv.review_timestamp, l.*, i.id as input_id, i.diff, i.diff_sha256, i.user_message, s.id as source_id,
  list_concat(list_concat(list_concat(rv.own, i.own), list_concat(l.own, {errors(AGAINST)})), list_concat(s.own, case when rv.decision = 'needs_review' then ['generated label review is still needs_review'] else [] end)) as errs
  from rv join lb l on l.id = rv.generated_label_id join inp i on i.source_diff_id = regexp_replace(l.id, '^generated-', '') join src s on s.id = i.source_diff_id),
ok as (select *, coalesce(edited_header, header) as target_header, array_to_string(list_concat([coalesce(edited_header, header)], case when len(body) > 0 then list_concat([''], body) else [] end, case when len(footers) > 0 then list_concat([''], footers) else [] end), chr(10)) as target_message from tr where len(errs) = 0 and decision in ('accept', 'edit'))"""
FIRST_INPUTS = INPUTS.format(FIRST)
LINEAGE = [
    *[(f"{'list_sort(map_entries(o.' + f + '))' if f == 'decoding_config' else 'o.' + f} is distinct from {'list_sort(map_entries(f.' + f + '))' if f == 'decoding_config' else 'f.' + f}", f"'{f} does not match generated label'") for f in [*SHARED, *TEACHER] if f not in ("teacher_size", "teacher_context_length")],
    ("o.diff is distinct from i.diff", "'diff does not match teacher input'"), ("o.diff_sha256 is distinct from i.diff_sha256", "'diff_sha256 does not match teacher input'"), ("o.decision = 'accept' and o.target_header is distinct from f.header", "'accepted target_header does not match generated label'"), ("o.footers is distinct from f.footers", "'target_footers does not match generated label'"),
]

# A window's number in its plan, its own errors, and the overlaps of windows without any.
AT = "'windows[' || n || '].'"
WINDOW_RULES = [
    *[(f"coalesce(length({c}), 0) = 0", f"{AT} || '{c} must be a non-empty string'") for c in ("id", "repo_url", "split", "start", "end", "reason")], ("id is not null and k > 1", f"{AT} || 'id is duplicated: ' || id"), (f"split is not null and split not in {SPLITS}", f"{AT} || 'split is invalid: ' || split"),
    ("start is not null and \"end\" is not null and (s is null or e is null)", "'windows[' || n || '] has invalid timestamp'"), ("s >= e", f"{AT} || 'start must be earlier than end'"), ("target_records < 0", f"{AT} || 'target_records must be a non-negative integer'"),
]
WINDOW_RULES = [(b.replace("length(end)", 'length("end")'), m) for b, m in WINDOW_RULES]
STAMP = "case when regexp_matches({c}, '(Z|[+-]\\d\\d:?\\d\\d)$') then try_cast({c} as timestamptz) end"
MANIFEST = f"(select {repo('repo_url')} as repo, allowed_splits, review_status, ecosystem from source_manifest where {repo('repo_url')} is not null qualify row_number() over (partition by {repo('repo_url')} order by _ord desc) = 1)"
PLAN = f"(select id, {repo('repo_url')} as repo, {split('split')} as split from {valid('split_plan', 'id')})"

MESSAGE = "array_to_string(list_concat([header], coalesce(body, []), coalesce(footers, [])), chr(10))"
SIDES = f"""tg as (select id, coalesce({split('data_split')}, 'NONE') as data_split, changed_paths, {MESSAGE} as target from {LABEL}), te as (select id, {MESSAGE} as teacher from {FIRST}),
sd as (select tg.*, teacher, 'update ' || coalesce(changed_paths[1], '') as historical from tg join te using (id))"""
# PARSED reads generated_label's valid rows as m; here m is a row per message
SCORES = f"""with {SIDES}, m as (select id, data_split, changed_paths, message, regexp_replace(text, '^\\n+|\\n+$', '', 'g') as raw from (select id, data_split, changed_paths, unnest(['target', 'teacher', 'historical']) as message, unnest([target, teacher, historical]) as text from sd)),
{PARSED[PARSED.index('l as (select'):]}, v as (select *, trim(trim(trim(pscope), '/')) as sc, lower(regexp_replace(psubject, '\\s+', ' ', 'g')) as su from p),
s as (select *, case when error is null then ptype in ('build', 'chore', 'ci', 'docs', 'feat', 'fix', 'perf', 'refactor', 'revert', 'style', 'test') else false end as format_validity, case when error is null and pscope is not null and len(changed_paths) > 0 then (sc <> '' and {VISIBLE}) end as scope_quality,
  case when error is null then not su in ('change files', 'changes', 'fix', 'fix bug', 'fix issue', 'misc', 'update', 'update files', 'updates', 'wip', 'work in progress') and len(string_split(su, ' ')) >= 2 else false end as specificity, case when error is null then length(psubject) between 1 and 72 else false end as brevity from v),
e as (select *, case when error is not null then [error] else list_filter([case when not format_validity then 'unknown type: ' || ptype end, case when not scope_quality then 'scope ''' || pscope || ''' is not visible in changed paths' end,
  case when not specificity then 'subject is too vague' end, case when not brevity then 'subject length is outside the configured limit' end], lambda x: x is not null) end as errors from s)"""

NAMED = "string_split(lower(x), '/')"
EXT = "regexp_extract(string_split(lower(x), '/')[-1], '(\\.[^.]*)$', 1)"
NOISE = f"""(list_has_any({NAMED}, ['.github', 'docs', 'doc', 'documentation', 'changelog', 'changes', 'news', 'release', 'releases', 'vendor', 'generated', 'dist', 'build', 'coverage'])
  or {NAMED}[-1] in ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'uv.lock', 'cargo.lock', 'go.sum', 'package.json', '.pre-commit-config.yaml') or {EXT} in ('.md', '.rst', '.txt', '.adoc', '.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico'))"""
CODE = f"({EXT} in ('.py', '.pyi', '.js', '.jsx', '.ts', '.tsx', '.rs', '.go', '.java', '.kt', '.c', '.h', '.cc', '.cpp', '.hpp', '.cs', '.rb', '.php', '.swift', '.vue', '.svelte') or list_has_any({NAMED}, ['test', 'tests', 'testing', 'spec', 'specs', 'cases']))"

SUMMARY = f"""r as (select {split('data_split')} as sp, {repo('source_repo_url')} as repo, source_license, human_review_status, prompt_version from {LABEL}), per as (select sp, repo, count(*) as n from r group by 1, 2), dev as (select * from per where sp = 'DEV'),
own as (select distinct per.repo, m.repo as m, lower(trim(ecosystem)) as eco from per left join {MANIFEST} m on m.repo = per.repo where per.repo is not null)"""

SQL: dict[str, str] = {
    "manifest_errors": f"""with x as (select *, case when {repo('repo_url')} is not null and row_number() over (partition by {repo('repo_url')} order by _ord) > 1 then 'duplicate repo_url: ' || repo_url end as dup from source_manifest),
      y as (select repo_url, _ord, list_filter(list_append({errors([*begins('repo_url', 'https://', 'git@'), *filled('default_branch', 'source_license'), *begins('license_url', 'https://'), *filled('license_review_date', 'reviewer', 'review_status', 'source_revision'), *revision('source_revision'), ("coalesce(len(allowed_splits), 0) < 1", "'allowed_splits must be a non-empty list'"), (f"len(list_filter(allowed_splits, lambda s: s not in {SPLITS})) > 0", f"'invalid allowed_splits: [' || array_to_string(list_transform(list_filter(allowed_splits, lambda s: s not in {SPLITS}), lambda s: '''' || s || ''''), ', ') || ']'"), ("ecosystem = ''", "'ecosystem must be a non-empty string when present'")])}, dup), lambda q: q is not null) as e from x)
      select repo_url, _ord, unnest(e) as error from y""",
    "label_errors": f"select id, _ord, unnest({errors(LABEL_RULES)}) as error from generated_label",
    "plan_errors": f"""with w as (select plan_id, id, repo_url, split, start_at as start, end_at as "end", reason, target_records, _ord, {STAMP.format(c='start_at')} as s, {STAMP.format(c='end_at')} as e, row_number() over (partition by plan_id order by _ord) - 1 as n, row_number() over (partition by plan_id, id order by _ord) as k from split_plan),
      x as (select *, {errors(WINDOW_RULES)} as own from w), g as (select *, lag(e) over q as pe, lag(id) over q as pid from x where len(own) = 0 window q as (partition by plan_id, {repo('repo_url')} order by s, e, id))
      select plan_id, id, _ord, unnest(own) as error from x union all select plan_id, id, _ord, 'overlapping split windows for ' || {repo('repo_url')} || ': ' || pid || ' overlaps ' || id from g where s < pe""",
    "window_manifest_errors": f"""select w.id, unnest(list_filter([case when m.repo is null then 'repo_url is not present in source manifest' end, case when m.repo is not null and not coalesce(list_contains(allowed_splits, w.split), false) then 'split ' || w.split || ' is not allowed by source manifest' end], lambda x: x is not null)) as error
      from {PLAN} w left join {MANIFEST} m using (repo)""",
    "plan_ecosystems": f"select split, coalesce(array_to_string(list_sort(list_distinct(list(nullif(lower(trim(ecosystem)), '')))), ','), '') as ecosystems, count(*) filter (m.repo is null) as outside from {PLAN} w left join {MANIFEST} m using (repo) group by split",
    "source_errors": f"""select id, _ord, unnest(list_concat({errors(SOURCE_RULES)}, case when source_repo_url is null or source_repo_url not in (select repo_url from source_manifest where repo_url is not null) then ['source_repo_url is not present in the source manifest: ' || coalesce(source_repo_url, 'None')] else [] end)) as error from {SOURCES.format('generated_label')}""",
    "source_review_errors": f"""select id, unnest(list_concat(own, d)) as error from (select r.id, {errors([(b.replace('id', 'r.id', 1) if b.startswith('coalesce(length(id)') else b, m) for b, m in SOURCE_REVIEW_RULES]).replace('length(s', 'length(r.s').replace('length(p', 'length(r.p').replace('length(d', 'length(r.d').replace('length(review', 'length(r.review').replace('data_split is not null and data_split not in', 'r.data_split is not null and r.data_split not in').replace('|| data_split', '|| r.data_split').replace('regexp_matches(', 'regexp_matches(r.').replace('changed_paths is null', 'r.changed_paths is null').replace('len(changed_paths)', 'len(r.changed_paths)')} as own,
      {errors([(f'r.{f} is distinct from s.{f}', f"'{f} does not match source diff record'") for f in ('source_repo_url', 'source_commit', 'parent_commit', 'data_split', 'changed_paths')])} as d from {SOURCE_REVIEWS} r join {SOURCES.format(LABEL)} s on s.id = r.source_diff_id)""",
    "label_review_errors": f"""with r as (select *, {errors(LABEL_REVIEW_RULES)} as own from {LABEL_REVIEWS}) select r.id, unnest(list_concat(own, {errors([(f'r.{f} is distinct from l.{f}', f"'{f} does not match generated label'") for f in ('source_repo_url', 'source_commit', 'teacher_model_id', 'prompt_version', 'header')])})) as error from r join {LABEL} l on l.id = r.generated_label_id""",
    "teacher_input_errors": f"""with i as (select *, {errors(INPUT_RULES)} as own, row_number() over (partition by source_diff_id order by _ord) as k from {INPUTS.format('generated_label')}), a as (select source_diff_id as ok from {SOURCE_REVIEWS} where decision = '{ACCEPTED}')
      select i.id, i._ord, unnest(list_concat(list_concat(own, case when ok is null then ['source_diff_id is not accepted for teacher labeling: ' || i.source_diff_id] else {errors([(f'i.{f} is distinct from s.{f}', f"'{f} does not match source diff record'") for f in (*SHARED, 'diff_stat', 'historical_subject')])} end), case when k > 1 then ['duplicate teacher input for source_diff_id: ' || i.source_diff_id] else [] end)) as error
      from i join {SOURCES.format(LABEL)} s on s.id = i.source_diff_id left join a on a.ok = i.source_diff_id""",
    "label_input_errors": f"""with l as (select *, {errors(LABEL_RULES)} as own, row_number() over (partition by id order by _ord) as k from generated_label)
      select l.id, l._ord, unnest(list_concat(list_concat(own, {errors(AGAINST)}), case when k > 1 then ['duplicate generated label id: ' || l.id] else [] end)) as error from l join {FIRST_INPUTS} i on i.source_diff_id = regexp_replace(l.id, '^generated-', '')""",
    "sft_errors": f"with {TRAINED} select review_id as generated_label_review_id, unnest(errs) as error from tr",
    "training_rows": f"""with {TRAINED} select 'sft-' || source_id as id, source_id as source_diff_id, generated_label_id, review_id as generated_label_review_id, input_id as teacher_input_id, data_split, case decision when 'accept' then 'teacher_generated_human_accepted' else 'teacher_generated_human_edited' end as label_source, decision as review_decision,
      teacher_model_id, teacher_size, diff_sha256, target_header, sha256(target_message) as target_sha256, sha256(user_message) as user_sha256, cast(3 as bigint) as messages, confidence from ok""",
    "lineage_errors": f"""with {TRAINED} select 'sft-' || o.source_id as id, unnest({errors(LINEAGE)}) as error from ok o join {FIRST} f on f.id = o.generated_label_id join {FIRST_INPUTS} i on i.source_diff_id = o.source_id""",
    "eval_signals": f"""{SCORES}, x as (select data_split, message, unnest(['format_validity', 'scope_quality', 'specificity', 'brevity']) as signal, unnest([format_validity, scope_quality, specificity, brevity]) as v from e)
      select coalesce(data_split, 'ALL') as data_split, message, signal, count(*) filter (v) as n_true, count(*) filter (not v) as n_false, count(*) filter (v is null) as n_null from x group by grouping sets ((data_split, message, signal), (message, signal))""",
    "eval_types": f"{SCORES} select message, ptype as type, count(*) as n from e where ptype is not null group by 1, 2",
    "eval_errors": f"{SCORES}, c as (select message, error, count(*) as n from (select message, unnest(errors) as error from e) group by 1, 2) select message, error, n from c qualify row_number() over (partition by message order by n desc, error) <= 10",
    "changed_labels": f"with {SIDES} select count(*) as records, count(*) filter (target is distinct from teacher) as changed from sd",
    "artifact_summary": f"""with {SUMMARY} select 'records' as measure, null as key, cast(sum(n) as double) as value from per union all select 'split', s, coalesce((select sum(n) from per where sp = s), 0) from (values ('DEV'), ('REPORT'), ('HELD_OUT')) v(s)
      union all select 'repos', s, (select count(repo) from per where sp = s) from (values ('DEV'), ('REPORT'), ('HELD_OUT')) v(s) union all select * from (select 'top_repo', repo, n from dev order by n desc, repo limit 10) union all select 'max_repo_fraction', null, round(max(n) / sum(n), 6) from dev
      union all select 'count', 'source_license:' || source_license, count(*) from r group by source_license union all select 'count', 'human_review_status:' || human_review_status, count(*) from r group by human_review_status union all select 'count', 'prompt_version:' || prompt_version, count(*) from r group by prompt_version
      union all select distinct 'ecosystem', eco, 1.0::double from own where length(eco) > 0 union all select distinct 'missing_repo', repo, 1.0::double from own where m is null""",
    "decision_report": f"""with r as (select coalesce({split('data_split')}, 'NONE') as sp, * from {SOURCE_REVIEWS}) select 'decision' as measure, sp as split, decision as key, count(*) as n from r group by sp, decision union all select 'reason', null, reason, count(*) from r where reason is not null group by reason""",
    "noise_paths": f"""select id, coalesce(regexp_matches(header, '(?i)\\b(merge|revert|release|bump|deps?|dependenc|changelog|change log|pre-commit|version)\\b'), false) as noise_subject, len(list_filter(changed_paths, lambda x: not {NOISE})) = 0 as all_noise, cast(len(list_filter(changed_paths, lambda x: {NOISE})) as bigint) as noise,
      len(list_filter(changed_paths, lambda x: {CODE})) > 0 as code_or_tests, len(list_filter(changed_paths, lambda x: list_has_any({NAMED}, ['baselines', 'snapshots', 'snapshot']))) > 0 and (len(changed_paths) * 2 > 8 or cast('10' || (len(changed_paths) + 10) as bigint) + 7 > 800) as snapshot_bulk,
      cast(len(changed_paths) * 2 as bigint) as files, cast('10' || (len(changed_paths) + 10) as bigint) + 7 as lines from {LABEL}""",
    "sequence_errors": f"""select record_id, unnest({errors([('input_length > coalesce(m.context_tokens, r.context_tokens)', "'input_length exceeds context_tokens'"), ('coalesce(loss_tokens, 0) <= 0', "'missing loss tokens'")])}) as error from {valid('sequence_metadata', 'record_id')} m left join sequence_run r using (materialization_id)""",
    "missing_reviews": f"select distinct id as generated_label_id from generated_label where id is not null and id not in (select generated_label_id from {LABEL_REVIEWS} where decision <> 'needs_review')",
    "updated_reviews": f"""select case when r.decision = 'needs_review' then (case when l.verifier_score = 1.0 then 'accept' else 'reject' end) else r.decision end as decision, case when r.decision = 'needs_review' then 'by score' else '' end as notes, count(*) as reviews
      from {LABEL_REVIEWS} r left join {LABEL} l on l.id = r.generated_label_id group by 1, 2""",
    "generated_rows": f"""with {SCORED}, ev as (select *, list_transform(evidence_paths, lambda p: regexp_replace(p, '(#L\\d+(?:-L?\\d+)?|:\\d+(?::\\d+)?)$', '')) as bare,
      case when coalesce(header, '') = '' then 'teacher output header must be a non-empty string' when confidence is null or isnan(confidence) then 'teacher output confidence must be numeric' end as fault from (select * exclude (error), error as parse_error from e)),
      k as (select *, list_distinct(list_filter(bare, lambda p: list_contains(changed_paths, p))) as kept, len(list_filter(bare, lambda p: not list_contains(changed_paths, p))) as lost from ev)
      select id, case when fault is null then header end as header, cast(case when fault is null then len(body) end as bigint) as n_body, case when fault is null then coalesce(nullif(type, ''), ptype, '') end as type, case when fault is null then scope end as scope, case when fault is null then greatest(0.0::double, least(1.0::double, confidence)) end as confidence,
      cast(case when fault is null then len(kept) end as bigint) as n_evidence, cast(case when fault is null then len(warnings) + (lost > 0)::int end as bigint) as n_warnings,
      case when fault is null then round((format_validity::int + specificity::int + brevity::int + (len(list_filter(errors, lambda x: not (starts_with(x, 'scope ') and contains(x, ' is not visible in changed paths')))) = 0)::int + (len(kept) > 0)::int + 1) / 6.0::double, 6) end as verifier_score,
      cast(case when fault is null then len(errors) end as bigint) as n_errors, fault as error from k""",
    "two_level_limit": f"""select id, _ord from (select id, _ord, {split('data_split')} as s from generated_label qualify row_number() over (partition by coalesce({repo('source_repo_url')}, '') order by _ord) <= 20) where s = 'DEV' order by _ord limit 500""",
    "first_sequences": f"select record_id from {valid('sequence_metadata', 'record_id')} where {split('data_split')} = 'DEV' and decision <> 'exclude_oversize' order by _ord limit 64",
}
