"""The same results in DuckDB SQL, over the same tables."""

from __future__ import annotations

from catalog import fixtures
from plumbline import fixed_values as fixed


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(values) -> str:
    return ", ".join(_text(v) for v in values)


# white space as in fixed_values, for trim(text, characters)
BLANKS = "||".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
# and the same set as a character class (DuckDB's \s is ASCII)
BLANK_CLASS = "".join(rf"\x{{{ord(c):x}}}" for c in fixed.WHITESPACE)

POSITIVE, NEGATIVE = _text(fixed.POSITIVE), _text(fixed.NEGATIVE)


def strip(value: str) -> str:
    return f"trim({value}, {BLANKS})"


def words_of(value: str) -> str:
    return f"cast(len(regexp_extract_all({value}, '[^{BLANK_CLASS}]+')) as int)"


def template(text: str, **values: str) -> str:
    """A prompt template as a concatenation of literals and SQL expressions."""
    sql = _text(text)
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", "' || " + value + " || '")
    return "(" + sql + ")"


def baseline(text: str) -> str:
    return template(fixed.BASELINE_PROMPT, user_text=f"coalesce({text}, '')")


# --- inputs ----------------------------------------------------------------

PATCHY = f"""patchy as (
  select d.doc_id as id, {fixtures.PATCHY_TEXT_SQL} as sentence
  from documents d left join labels l on d.doc_id = l.doc_id)"""

SENTENCES = """sentences as (
  select d.doc_id as id, d.text as sentence, e.embedding
  from documents d left join embeddings e on e.vec_id = d.doc_id)"""

ITEM_RESPONSES = f"""item_responses as (
  select doc_id, {fixtures.ITEM_TYPE_SQL} as type_requested, {fixtures.ITEMS_SQL} as response
  from labels)"""

_IS_JSON_NUMBER = "in ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"


def _integer(name: str) -> str:
    """Python's int() of a JSON value, as double; null where it fails."""
    return f"""case
      when {name}_type {_IS_JSON_NUMBER} then trunc(try_cast({name} as double))
      when {name}_type = 'BOOLEAN' then case when {name} = 'true' then 1.0 else 0.0 end
      when {name}_type = 'VARCHAR' and regexp_full_match({strip(name)}, '[+-]?[0-9]+(_[0-9]+)*')
        then try_cast(replace({strip(name)}, '_', '') as double) end"""


def predictions(shift: int, name: str = "predictions") -> str:
    """CTEs that end in ``name``: labels with their normalised answers."""
    fields = ("diagnosis", "severity", "confidence", "reasoning", "explanation")
    got = ",\n    ".join(
        f"json_extract_string(answer, '$.{f}') as v_{f}, "
        f"json_type(answer, '$.{f}') as v_{f}_type"
        for f in fields
    )
    severity, confidence = _integer("v_severity"), _integer("v_confidence")
    word = f"lower({strip('v_diagnosis')})"
    return f"""{name}_1 as (
  select doc_id as id, toxic as diagnosis, {fixtures.GOLD_TEXT_SQL} as gold_text,
    {fixtures.GOLD_SEVERITY_SQL} as severity, {strip(fixtures.answer_sql(shift))} as t
  from labels),
{name}_2 as (
  select * exclude (t), case when starts_with(t, '{{') then t
    else nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') end as js
  from {name}_1),
{name}_3 as (select * exclude (js), case when json_valid(js) then js end as answer from {name}_2),
{name}_4 as (select * exclude (answer), {got} from {name}_3),
{name}_5 as (select *, case
    when v_diagnosis_type {_IS_JSON_NUMBER} then
      case when trunc(try_cast(v_diagnosis as double)) = 1 then {POSITIVE} else {NEGATIVE} end
    when v_diagnosis_type = 'BOOLEAN' then
      case when v_diagnosis = 'true' then {POSITIVE} else {NEGATIVE} end
    when v_diagnosis_type = 'VARCHAR' and {word} in ({_words(fixed.POSITIVE_WORDS)}) then {POSITIVE}
    when v_diagnosis_type = 'VARCHAR' and {word} in ({_words(fixed.NEGATIVE_WORDS)}) then {NEGATIVE}
    end as pred_diagnosis,
    {severity} as sev, {confidence} as conf,
    case when coalesce(v_reasoning_type, 'NULL') = 'NULL'
        or (v_reasoning_type = 'VARCHAR' and v_reasoning = '')
        or (v_reasoning_type = 'BOOLEAN' and v_reasoning = 'false')
        or (v_reasoning_type {_IS_JSON_NUMBER} and try_cast(v_reasoning as double) = 0)
        or (v_reasoning_type in ('ARRAY', 'OBJECT') and v_reasoning in ('[]', '{{}}'))
      then 'explanation' else 'reasoning' end as used
  from {name}_4),
{name} as (select id, diagnosis, gold_text, severity, pred_diagnosis,
    cast(case when pred_diagnosis = {POSITIVE} and sev between 1 and 3 then sev end as int)
      as pred_severity,
    cast(case when conf is not null then greatest(0, least(100, conf)) end as int)
      as pred_confidence,
    case when used = 'reasoning' and v_reasoning_type = 'VARCHAR' then v_reasoning
      when used = 'explanation' and v_explanation_type = 'VARCHAR' then v_explanation end
      as pred_reasoning
  from {name}_5)"""


def gold(column: str) -> str:
    folded = f"lower({strip(f'cast({column} as varchar)')})"
    cases = " ".join(
        f"when {_text(s)} then {_text(label)}" for s, label in fixed.GOLD_SPELLINGS.items()
    )
    return f"case {folded} {cases} else {folded} end"


SCORED = f"""{predictions(0)},
scored as (select *, {gold('gold_text')} as gold, pred_diagnosis is not null as valid,
    coalesce(pred_diagnosis = {gold('gold_text')}, false) as pred_correct
  from predictions)"""


def measured(shift: int, name: str) -> str:
    return f"""{predictions(shift, f'p{shift}')},
{name} as (select id,
    cast(coalesce(pred_diagnosis = {gold('diagnosis')}, false) as int) as correct,
    cast(abs(pred_severity - severity) as double) as severity_error, pred_confidence
  from p{shift})"""


_LONG = " union all ".join(
    f"select id, '{m}' as measure, cast({m} as double) as value from {{run}}"
    for m in ("correct", "severity_error", "pred_confidence")
)

TWO_RUNS = f"""{measured(0, 'first_run')},
{measured(fixtures.SECOND_RUN, 'second_run')},
first_long as ({_LONG.format(run='first_run')}),
second_long as ({_LONG.format(run='second_run')}),
differences as (
  select id, measure, a.value - b.value as d
  from first_long a join second_long b using (id, measure)
  where a.value is not null and b.value is not null)"""


def nearest(source: str, k: int = fixed.TOP_K) -> str:
    """Brute force over all pairs of ``source(id, embedding)``; ends in ``matches``."""
    return f"""vectors as (
  select id, list_transform(embedding, lambda x: cast(x as double)) as v from {source}
  where embedding is not null),
units as (
  select id, list_transform(v, lambda x: x / case when n > 0 then n else 1 end) as v
  from (select id, v, sqrt(list_dot_product(v, v)) as n from vectors)),
pairs as (
  select q.id as query_id, c.id as corpus_id,
    round(list_dot_product(q.v, c.v), 6) + 0.0 as similarity
  from units q, units c),
ranked as (
  select *, row_number() over (
    partition by query_id order by similarity desc, corpus_id) as rank
  from pairs),
matches as (
  select query_id, cast(rank as int) as rank, corpus_id, similarity
  from ranked where rank <= {k})"""


VECTORS = "select vec_id as id, embedding from embeddings"

CONTEXTS = f"""{SENTENCES},
{nearest('sentences')},
contexts as (
  select query_id, string_agg(sentence, {_text(fixed.CONTEXT_SEPARATOR)} order by rank) as context
  from matches join sentences on id = corpus_id group by query_id)"""

ALL_CONTEXTS = f"""with {CONTEXTS}
  select id as query_id, cast(length(context) as int) as n_chars, md5(context) as context_md5
  from sentences left join contexts on query_id = id"""

RETRIEVAL = template(
    fixed.RETRIEVAL_PROMPT, user_text="sentence", context="coalesce(context, '')"
)

GRID = template(
    fixed.GENERATION_USER_PROMPT,
    definitions="text",
    rubric=_text(fixed.SEVERITY_RUBRIC),
    type_name="type_requested",
    n_delusional=_text("10"),
    n_normal=_text("10"),
    n_first_normal=_text("11"),
    n_total=_text("20"),
)

# The stand-in model as SQL; n is the length of the prompt.
STAND_IN = f"""case when n % 2 = 1 then {POSITIVE} else {NEGATIVE} end as pred_diagnosis,
  cast(case when n % 2 = 1 then 1 + n % 3 end as int) as pred_severity,
  cast(least(100, n % 130) as int) as pred_confidence,
  'length ' || n as pred_reasoning"""

LETTERS = ", ".join(
    f"cast(length({{text}}) - length(replace({{text}}, chr({ord(c)}), '')) as double) as v{i}"
    for i, c in enumerate(fixtures.COUNTED)
)

KEY = f"sha256({_text(fixtures.MODEL)} || chr(31) || {{text}})"

STORE = f"""{SENTENCES},
store as (
  select {KEY.format(text='sentence')} as key, arg_min(embedding, id) as embedding
  from sentences where embedding is not null group by 1)"""

MISSES = f"""{STORE},
misses as (
  select distinct {KEY.format(text='text')} as key, text from documents
  where {KEY.format(text='text')} not in (select key from store))"""

ITEMS = f"""{ITEM_RESPONSES},
lines as (
  select doc_id, type_requested, {strip('line')} as line, pos
  from (
    select doc_id, type_requested, unnest(string_split(response, chr(10))) as line,
      generate_subscripts(string_split(response, chr(10)), 1) as pos
    from item_responses)),
objects as (
  select * from (
    select doc_id, type_requested, pos,
      case when json_valid(line) and starts_with(line, '{{') then line end as js
    from lines)
  where js is not null),
kept as (
  select *, row_number() over (partition by doc_id order by pos) as n
  from objects
  where json_exists(js, '$.type') and json_exists(js, '$.sentence')
    and json_exists(js, '$.severity')),
items as (
  select doc_id, type_requested, cast(n as int) as sentence_id,
    cast(json_extract_string(js, '$.id') as int) as id,
    json_extract_string(js, '$.label') as label,
    json_extract_string(js, '$.type') as type,
    json_extract_string(js, '$.sentence') as sentence,
    cast(json_extract_string(js, '$.severity') as int) as severity,
    case when json_exists(js, '$.rationale') then json_extract_string(js, '$.rationale')
      else '' end as rationale
  from kept)"""

_CHECKS = ("counts", "ids", "agreement", "word_limit", "repetition")

CONTRACT = f"""with {ITEMS},
per_response as (
  select r.doc_id, r.type_requested as type,
    count(i.doc_id) <> 2 or count(*) filter (i.label = 'delusional') <> 1
      or count(*) filter (i.label = 'normal') <> 1 as bad_counts,
    count(i.doc_id) > 0 and not coalesce(count(distinct i.id) = count(i.doc_id)
      and min(i.id) = 1 and max(i.id) = count(i.doc_id), false) as bad_ids,
    count(i.doc_id) filter (not coalesce(
      (i.label = 'delusional' and i.type = r.type_requested and i.severity between 1 and 3)
      or (i.label = 'normal' and i.type = 'Normal' and i.severity = 0), false)) as bad_items,
    count(i.doc_id) filter ({words_of('i.sentence')} > 30) as long_items
  from item_responses r left join items i on i.doc_id = r.doc_id
  group by 1, 2),
repeats as (
  select type_requested as type, sum(n - 1) as n_bad from (
    select type_requested, sentence, count(*) as n from items
    where sentence is not null group by 1, 2) group by 1),
per_type as (
  select p.type, count(*) filter (bad_counts) as counts, count(*) filter (bad_ids) as ids,
    sum(bad_items) as agreement, sum(long_items) as word_limit,
    coalesce(any_value(r.n_bad), 0) as repetition
  from per_response p left join repeats r on r.type = p.type group by 1)
""" + " union all ".join(
    f"select type, '{c}' as check, cast({c} as bigint) as n_bad, {c} = 0 as passed from per_type"
    for c in _CHECKS
)

_COUNTS = f"""counts as (
  select count(*) as n_rows, count(*) filter (valid) as n_valid,
    count(*) filter (valid and pred_correct) as n_correct,
    count(*) filter (valid and pred_diagnosis = {POSITIVE} and gold = {POSITIVE}) as pos_both,
    count(*) filter (valid and pred_diagnosis = {POSITIVE}) as pos_pred,
    count(*) filter (valid and gold = {POSITIVE}) as pos_gold,
    count(*) filter (valid and pred_diagnosis = {NEGATIVE} and gold = {NEGATIVE}) as neg_both,
    count(*) filter (valid and pred_diagnosis = {NEGATIVE}) as neg_pred,
    count(*) filter (valid and gold = {NEGATIVE}) as neg_gold
  from scored)"""

def report(rows: str, ctes: str = SCORED) -> str:
    """The report's lines over ``rows`` (gold, pred_diagnosis, valid, pred_correct)."""
    return f"""with {ctes},
      labels_of as (
        select gold, coalesce(gold, {_text(fixed.NO_GOLD)}) as name,
          count(*) filter (pred_diagnosis = {POSITIVE}) as d,
          count(*) filter (pred_diagnosis = {NEGATIVE}) as n
        from {rows} where valid group by 1),
      totals as (
        select sum(d) as d, sum(n) as n, greatest(4, max(length(name))) as width,
          (select count(*) filter (pred_correct) / count(*) from {rows} where valid) as share
        from labels_of),
      numbered as (
        select l.*, row_number() over (order by gold nulls last) as place from labels_of l),
      lines as (
        select 1 as line, {_text(fixed.ACCURACY_LINE)} || printf('%.3f', share) as metrics from totals
        union all select 2, ''
        union all select 3, {_text(fixed.MATRIX_LINE.strip())}
        union all select 4, rpad('pred', cast(width as int), ' ')
          || case when d > 0 then '  ' || {POSITIVE} else '' end
          || case when n > 0 then '  ' || {NEGATIVE} else '' end from totals
        union all select 5, rpad('gold', cast(width as int), ' ')
          || case when d > 0 then repeat(' ', 12) else '' end
          || case when n > 0 then repeat(' ', 16) else '' end from totals
        union all select 5 + place, rpad(name, cast(width as int), ' ')
          || case when t.d > 0 then '  ' || lpad(cast(l.d as varchar), 10, ' ') else '' end
          || case when t.n > 0 then '  ' || lpad(cast(l.n as varchar), 14, ' ') else '' end
        from numbered l, totals t)
      select cast(line as bigint) as line, metrics from lines"""


_METRICS = {
    "n_rows": "cast(n_rows as double)",
    "n_valid": "cast(n_valid as double)",
    "accuracy": "n_correct / n_valid",
    "precision": "pos_both / pos_pred",
    "recall": "pos_both / pos_gold",
    "precision_non_delusional": "neg_both / neg_pred",
    "recall_non_delusional": "neg_both / neg_gold",
}

_PAIRED_T = f"""with {TWO_RUNS},
  moments as (
    select measure, count(*) as n, avg(d) as mean, stddev_samp(d) as sd
    from differences group by measure),
  paired_t as (
    select measure, n, round(mean, 6) as mean, round(sd, 6) as sd,
      round(mean / nullif(sd / sqrt(n), 0), 6) as t, n - 1 as df
    from moments)"""

_WILCOXON = """
  tied as (
    select measure, d, rank() over (partition by measure order by abs(d)) as low,
      count(*) over (partition by measure, abs(d)) as c
    from differences where d <> 0),
  average as (select measure, d, c, low + (c - 1) / 2 as rank from tied),
  sums as (
    select measure, cast(count(*) as double) as n,
      sum(case when d > 0 then rank else 0 end) as w_plus,
      sum(case when d < 0 then rank else 0 end) as w_minus,
      sum(cast(c as double) * c - 1) as ties
    from average group by measure),
  all_pairs as (select measure, count(*) as pairs from differences group by measure),
  wilcoxon as (
    select measure, pairs, cast(coalesce(n, 0) as bigint) as n, coalesce(w_plus, 0.0) as w_plus,
      coalesce(w_minus, 0.0) as w_minus,
      round((w_plus - n * (n + 1) / 4)
        / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0), 6) as z
    from all_pairs left join sums using (measure))"""

# documents as vectors of letter counts, each against all
FROM_TEXT = f"""vectors_of as (
  select doc_id as id, text as sentence,
    [{", ".join(f"cast(length(text) - length(replace(text, chr({ord(c)}), '')) as float)" for c in fixtures.COUNTED)}] as embedding
  from documents),
{nearest('vectors_of')},
contexts as (
  select query_id, string_agg(sentence, {_text(fixed.CONTEXT_SEPARATOR)} order by rank) as context
  from matches join vectors_of on id = corpus_id group by query_id)"""


def _evaluated(gold_column: str, columns: str) -> str:
    rows = f"""select *, pred_diagnosis is not null as valid,
      coalesce(pred_diagnosis = gold, false) as pred_correct
      from (select *, {gold(gold_column)} as gold from predictions)"""
    counts = _COUNTS.removeprefix("counts as (").removesuffix(")").replace("from scored", f"from ({rows})")
    return " union all ".join(
        f"select '{columns}' as columns, '{name}' as name, round({value}, 6) as value from ({counts})"
        for name, value in _METRICS.items()
    )


SQL: dict[str, str] = {
    "knn_top3": f"with {nearest(f'({VECTORS})')} select * from matches",
    "knn_top3_few_queries": f"with {nearest(f'({VECTORS})')} select * from matches",
    "knn_top3_by_blocks": f"with {nearest(f'({VECTORS})')} select * from matches",
    "knn_top3_quantised": f"with {nearest(f'({VECTORS})')} select * from matches",
    "knn_top3_stored_index": f"with {nearest(f'({VECTORS})')} select * from matches",
    "l2_normalized": f"""with {nearest(f'({VECTORS})')}
      select id, cast(pos as int) as pos, round(value, 6) as value from (
        select id, unnest(v) as value, generate_subscripts(v, 1) - 1 as pos from units)""",
    "rag_context": ALL_CONTEXTS,
    "rag_context_few_queries": ALL_CONTEXTS,
    "rag_context_by_blocks": ALL_CONTEXTS,
    "rag_prompt_md5": f"""with {CONTEXTS}
      select id, md5({RETRIEVAL}) as prompt_md5
      from sentences left join contexts on query_id = id""",
    "baseline_prompt_md5": f"select doc_id, md5({baseline('text')}) as prompt_md5 from documents",
    "prompt_grid": f"""select doc_id, type_requested, md5({GRID}) as prompt_md5
      from (select doc_id, text, unnest([{_words(fixed.TYPES)}]) as type_requested
        from documents)""",
    "clean_text": f"""with {PATCHY}
      select id, cast(length(coalesce(sentence, '')) as int) as n_chars,
        {strip("coalesce(sentence, '')")} = '' as is_blank from patchy""",
    "empty_input_split": f"""with {PATCHY},
      sized as (
        select id, case when {strip("coalesce(sentence, '')")} <> ''
          then length({baseline('sentence')}) end as n from patchy)
      select id, case when n % 2 = 1 then {POSITIVE} when n % 2 = 0 then {NEGATIVE} end
          as pred_diagnosis,
        cast(case when n % 2 = 1 then 1 + n % 3 end as int) as pred_severity,
        cast(case when n is not null then least(100, n % 130) end as int) as pred_confidence,
        case when n is null then {_text(fixed.EMPTY_INPUT)} else 'length ' || n end
          as pred_reasoning
      from sized""",
    "word_count_flags": f"""select conv_id, turn, {words_of('text')} as word_count,
        {words_of('text')} > 30 as over_30_words from conversations""",
    "word_count_documents": f"""select doc_id, {words_of('text')} as word_count,
        {words_of('text')} > 30 as over_30_words from documents""",
    "embed_texts": f"select doc_id, {LETTERS.format(text='text')} from documents",
    "embedding_cache_misses": f"""with {MISSES}
      select key, cast(length(text) as int) as n_chars from misses""",
    "embedding_refresh": f"with {MISSES} select key, {LETTERS.format(text='text')} from misses",
    "embedding_reuse": f"""with {STORE}
      select doc_id as id, embedding is not null as is_stored,
        round(cast(embedding[1] as double), 6) as first_value
      from documents left join store on key = {KEY.format(text='text')}""",
    "baseline_run": f"""select id, {STAND_IN} from (
        select doc_id as id, length({baseline('text')}) as n from documents)""",
    "resumed_run": f"""select id, {STAND_IN} from (
        select doc_id as id, length({baseline('text')}) as n from documents)""",
    "rag_run": f"""with {CONTEXTS}
      select id, {STAND_IN} from (
        select id, length({RETRIEVAL}) as n
        from sentences left join contexts on query_id = id)""",
    "normalized_predictions": f"""with {predictions(0)}
      select id, pred_diagnosis, pred_severity, pred_confidence, pred_reasoning
      from predictions""",
    "attach_predictions": f"""with {predictions(0)}
      select doc_id as id, lang, pred_diagnosis, pred_severity, pred_confidence, pred_reasoning
      from documents left join predictions on id = doc_id""",
    "gold_labels": f"""with {predictions(0)}
      select id, {gold('gold_text')} as gold, {gold('diagnosis')} as gold_from_number
      from predictions""",
    "valid_predictions": f"""with {SCORED}
      select id, pred_diagnosis from scored where valid""",
    "accuracy": f"""with {SCORED}, {_COUNTS}
      select n_rows, n_valid, round(n_correct / n_valid, 6) as accuracy from counts""",
    "precision_recall": f"""with {SCORED}, {_COUNTS},
      both_labels as (
        select {POSITIVE} as label, pos_gold as n_gold, pos_pred as n_pred, pos_both as n_both
        from counts
        union all select {NEGATIVE}, neg_gold, neg_pred, neg_both from counts)
      select *, round(n_both / n_pred, 6) as precision, round(n_both / n_gold, 6) as recall
      from both_labels""",
    "confusion_matrix": f"""with {SCORED}
      select gold, count(*) filter (pred_diagnosis = {POSITIVE}) as delusional,
        count(*) filter (pred_diagnosis = {NEGATIVE}) as non_delusional
      from scored where valid group by gold""",
    "row_correctness": f"with {SCORED} select id, pred_correct from scored",
    "metrics": f"with {SCORED}, {_COUNTS} "
    + " union all ".join(
        f"select '{name}' as name, round({value}, 6) as value from counts"
        for name, value in _METRICS.items()
    ),
    "metrics_report": report("scored"),
    "severity_error": f"with {measured(0, 'run')} select id, severity_error from run",
    "paired_differences": f"with {TWO_RUNS} select id, measure, d from differences",
    "descriptives": f"""with {TWO_RUNS},
      both_runs as (
        select 'first' as run, measure, value from first_long
        union all select 'second', measure, value from second_long)
      select run, measure, count(value) as n, count(*) filter (value is null) as missing,
        round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd,
        min(value) as min, max(value) as max, round(median(value), 6) as median
      from both_runs group by run, measure""",
    "paired_t": f"{_PAIRED_T} select * from paired_t",
    "wilcoxon_signed_rank": f"with {TWO_RUNS}, {_WILCOXON} select * from wilcoxon",
    "wilcoxon_many_values": f"""with differences as (
        select l_returnflag as measure, l_extendedprice * l_discount - l_quantity * 50 as d
        from lineitem where l_extendedprice * l_discount - l_quantity * 50 is not null),
      {_WILCOXON} select * from wilcoxon""",
    "compare_runs": f"""{_PAIRED_T}, {_WILCOXON}
      select t.*, pairs, w_plus, w_minus, z from paired_t t join wilcoxon using (measure)""",
    "evaluated_run": f"with {predictions(0)} "
    + " union all ".join(
        [
            _evaluated("diagnosis", "diagnosis"),
            _evaluated("gold_text", "dignosis"),
            _evaluated("diagnosis", "both"),
            "select 'neither', 'no metrics', cast(count(*) as double) from predictions",
        ]
    ),
    "rag_run_from_text": f"""with {FROM_TEXT}
      select id, {STAND_IN} from (
        select id, length({RETRIEVAL}) as n
        from vectors_of left join contexts on query_id = id)""",
    "jsonl_items": f"with {ITEMS} select * from items",
    "generated_dataset": f"""with {ITEMS}
      select doc_id, type, sentence_id, sentence, severity, rationale,
        {_text(fixtures.MODEL)} as model, cast(0.4 as double) as temperature,
        {words_of('sentence')} as word_count, {words_of('sentence')} > 30 as over_30_words
      from items""",
    "appended_datasets": f"""with {ITEMS}, {predictions(0, 'p0')}, {predictions(fixtures.SECOND_RUN, 'p3')}
      select doc_id as id, type as label from items
      union all select id, pred_diagnosis from p0
      union all select id, pred_diagnosis from p3""",
    "class_balance": f"""with {SCORED}
      select gold as label, count(*) as n,
        round(count(*) / (select count(*) from scored), 6) as share
      from scored group by gold""",
    "contract_checks": CONTRACT,
    "row_cap": """select doc_id as id, md5(text) as sentence_md5
      from documents order by doc_id limit 50""",
}
