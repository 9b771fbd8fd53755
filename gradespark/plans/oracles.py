"""The registered queries in DuckDB's SQL, written independently of Spark."""

from __future__ import annotations

# Whitespace in Python's sense, spelled out because RE2's \s is ASCII only.
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def method_of(key: str) -> str:
    return (
        f"case {key} % 11 when 0 then 'BASE' when 1 then 'BASE_CHAIN' when 2 then 'AST' "
        "when 3 then 'AST_CHAIN' when 4 then 'DFG' when 5 then 'DFG_CHAIN' when 6 then 'CFG' "
        "when 7 then 'CFG_CHAIN' when 8 then 'PDG' when 9 then 'PDG_CHAIN' else 'PDG_CHAIN_FEEDBACK' end"
    )


V_TASKS = """v_tasks as (select concat('HumanEval/', p_partkey) task_id,
  concat('def fn_', p_partkey, '(x):') prompt, p_type canonical_solution, p_brand test,
  concat('fn_', p_partkey) entry_point from part)"""

V_MBPP = """v_mbpp as (select p_partkey id,
  case when p_partkey % 5 <> 0 then concat('mbpp/', p_partkey) end task_id,
  p_name text, p_type code, [concat('assert f(', p_size, ')'), 'assert True'] test_list from part)"""

V_ATTEMPTS = f"""v_attempts as (select concat('HumanEval/', o_custkey) task_id,
  {method_of('o_orderkey')} as method, o_orderdate, o_orderkey,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn_task,
  concat('  def fn(x):', chr(10), '    return ', o_orderkey, chr(10)) code,
  o_orderstatus = 'F' ok, o_orderpriority <> '1-URGENT' produced,
  case o_orderstatus when 'P' then 'SyntaxError' when 'O' then 'AssertionError' end error
  from orders)"""

V_LOG = f"""v_log as (select {method_of('event_id')} as method, event_id line_no,
  case when event_id % 50 = 0 then 'INFO progress'
    when event_type = 'signup' then concat('❌ SYNTAX ERROR in code for fn_', user_id)
    when event_type = 'error' then concat('❌ TEST EXECUTION ERROR for fn_', user_id, ': ValueError: bad value')
    when event_type = 'view' then concat('❌ RUNTIME ERROR raised for fn_', user_id, '  ')
    else concat('✅ HumanEval tests for fn_', user_id, ' passed successfully.') end line from events)"""

V_TESTS = """v_tests as (select p_partkey + 1 test_id, concat('fn_', p_partkey // 2) test_name from part)"""

LAST = """v_parsed as (select method, line_no,
   regexp_extract(line, 'HumanEval tests for (.+?) passed successfully', 1) ok,
   regexp_extract(line, '(?:SYNTAX ERROR|RUNTIME ERROR).+? for (.+)', 1) bad from v_log),
 v_verdicts as (select method, line_no, trim(case when ok <> '' then ok else bad end) test_name,
   case when ok <> '' then 1 else 0 end passed from v_parsed where ok <> '' or bad <> ''),
 v_last as (select method, test_name, passed from v_verdicts
   qualify row_number() over (partition by method, test_name order by line_no desc) = 1)"""

METHODS = [
    "BASE", "BASE_CHAIN", "AST", "AST_CHAIN", "DFG", "DFG_CHAIN", "CFG", "CFG_CHAIN",
    "PDG", "PDG_CHAIN", "PDG_CHAIN_FEEDBACK",
]
METHOD_VALUES = ", ".join(f"('{m}')" for m in METHODS)

CELLS = f"""v_cells as (select t.test_id, t.test_name, m.method, coalesce(l.passed, 0) passed
  from v_tests t cross join (values {METHOD_VALUES}) m(method)
  left join v_last l on l.method = m.method and l.test_name = t.test_name),
 v_totals as (select method, cast(sum(passed) as bigint) passed, count(*) total from v_cells group by method)"""


def label(p: str, n: str) -> str:
    return f"printf('%d/%d (%.1f%%)', {p}, {n}, cast({p} as double) / {n} * 100)"


ORACLES: dict[str, str] = {}

ORACLES["method_leaderboard"] = f"""with {V_LOG}, {V_TESTS}, {LAST}, {CELLS}
select method, passed, total, passed * 100.0e0 / total pct, {label('passed', 'total')} as label from v_totals"""

ORACLES["log_verdicts_long"] = f"""with {V_LOG},
 p as (select method, line_no,
   regexp_extract(line, 'HumanEval tests for (.+?) passed successfully', 1) ok,
   regexp_extract(line, 'SYNTAX ERROR.*?for (.+)', 1) bad from v_log),
 v as (select method, line_no, trim(case when ok <> '' then ok else bad end) test_name,
   cast(case when ok <> '' then 1 else 0 end as int) passed from p where ok <> '' or bad <> '')
select method, line_no, test_name, passed, dense_rank() over (order by test_name) test_id from v"""

ORACLES["log_verdicts_full"] = f"""with {V_LOG},
 p as (select method, line_no,
   regexp_extract(line, 'HumanEval tests for (.+?) passed successfully', 1) ok,
   regexp_extract(line, '(?:SYNTAX ERROR|RUNTIME ERROR).+? for (.+)', 1) bad,
   regexp_extract(line, 'TEST EXECUTION ERROR for (.+?): ', 1) run,
   regexp_extract(line, '(SYNTAX|RUNTIME) ERROR', 0) kind,
   regexp_extract(line, 'TEST EXECUTION ERROR for .+?: ([A-Za-z]+): ', 1) etype from v_log)
select method, line_no, trim(case when ok <> '' then ok when bad <> '' then bad else run end) test_name,
  cast(case when ok <> '' then 1 else 0 end as int) passed,
  case when ok <> '' then null when bad <> '' then kind else etype end error_type
from p where ok <> '' or bad <> '' or run <> ''"""

ORACLES["method_stats_long"] = f"""with {V_LOG}, {LAST},
 n as (select count(distinct test_name) total_tests from v_verdicts),
 a as (select method, cast(sum(passed) as bigint) passed from v_verdicts group by method),
 b as (select method, cast(sum(passed) as bigint) passed_distinct from v_last group by method)
select method, passed, passed_distinct, total_tests, passed * 100.0e0 / total_tests pct,
  {label('passed', 'total_tests')} as label from a join b using (method) cross join n"""

ORACLES["verdict_matrix"] = f"""with {V_LOG}, {V_TESTS}, {LAST}, {CELLS}
select test_id, test_name, {', '.join(f"cast(max(case when method = '{m}' then passed end) as int) as {m}" for m in METHODS)}
from v_cells group by test_id, test_name"""

ORACLES["heatmap_rows"] = f"""with {V_LOG}, {V_TESTS}, {LAST}, {CELLS},
 r as (select method, row_number() over (order by passed, method) method_rank from v_totals)
select test_id, test_name, method, cast(passed as int) passed, method_rank from v_cells join r using (method)"""

ORACLES["base_vs_chain"] = f"""with {V_LOG}, {V_TESTS}, {LAST}, {CELLS}
select b.method, b.passed base_passed, c.passed chain_passed, b.total,
  b.passed * 100.0e0 / b.total base_pct, c.passed * 100.0e0 / b.total chain_pct,
  (c.passed - b.passed) * 100.0e0 / b.total delta_points,
  {label('b.passed', 'b.total')} as base_label, {label('c.passed', 'b.total')} as chain_label
from v_totals b join v_totals c on c.method = concat(b.method, '_CHAIN')
where b.method in ('AST', 'DFG', 'CFG', 'PDG')"""


# --- tasks and prompts -------------------------------------------------------

ORACLES["tasks_normalized"] = f"""with {V_TASKS}
select task_id, prompt, [test] test_code, entry_point, row_number() over (order by task_id) - 1 example_index from v_tasks"""

ORACLES["mbpp_normalized"] = f"""with {V_MBPP}
select coalesce(task_id, concat('mbpp_', row_number() over (order by id) - 1)) task_id, text prompt,
  code canonical_solution, test_list test_code from v_mbpp"""

ORACLES["custom_split"] = """select concat('generic_', row_number() over (order by p_partkey) - 1) task_id,
  p_name prompt, [case when p_partkey % 3 <> 0 then p_type else '' end] test_code from part where p_size > 25"""

ORACLES["tasks_sorted_limit"] = f"""with {V_TASKS}
select task_id, prompt, entry_point from v_tasks order by task_id limit 50"""

ORACLES["task_lookup"] = f"""with {V_TASKS}, r as (select concat('HumanEval/', o_orderkey) task_id from orders)
select r.task_id, '<prompt>' || prompt || '<prompt><setting>code generation without docstring</setting>' prompt,
  case when t.task_id is null then 'Task ID ' || r.task_id || ' not found' end error
from r left join v_tasks t using (task_id)"""

RUN_PROMPT = (
    "'<setting>code generation without docstring</setting><setting>don''t use List, use list</setting><prompt>'"
    " || prompt || '<prompt>'"
)
ORACLES["prompts_full_run"] = f"with {V_TASKS} select task_id, {RUN_PROMPT} prompt from v_tasks"

# The text of the repair prompt.
ORACLES["repair_prompts"] = f"""with {V_TASKS}, {V_ATTEMPTS}
select task_id, o_orderkey, case when prompt is not null then concat({RUN_PROMPT}, chr(10), chr(10), 'Previous solution:', chr(10), code, chr(10), chr(10),
 'The last attempt failed during automatic checking with the following error (exact text):', chr(10), '```', chr(10),
 error, chr(10), '```', chr(10), chr(10),
 'Analyze the code carefully and return a corrected, fully functional, syntactically correct Python function.', chr(10),
 'Keep the same function name and parameters. Fix all indentation and syntax errors and any runtime error reported above. ',
 'Do not include any explanations, comments or additional text — return only the updated code.', chr(10)) end prompt
from v_attempts left join v_tasks using (task_id) where not ok and produced"""

# --- completions -------------------------------------------------------------

V_COMPLETIONS = """v_notes as (select *, concat(repeat(chr(39), 3), translate(text, '''"\\`', '    '), repeat(chr(39), 3)) note from documents),
 v_completions as (select doc_id, source, case doc_id % 7
 when 0 then concat('```python', chr(10), 'def fn_', doc_id, '(x):', chr(10), '    ', note, chr(10), '    return ', n_chars, chr(10), '```')
 when 1 then concat('  ```PY', chr(10), 'x = 1', chr(10), 'y = ', note, chr(10), '```  ')
 when 2 then concat('note = ', note, '\\ndef f(x):\\n\\treturn x')
 when 3 then concat('    def f(x):', chr(10), '        return x', chr(10), chr(10), 'note = ', note, chr(10), chr(10), 'if __name__ == ''__main__'':', chr(10), '    print(f(1))')
 when 4 then concat('<|im_start|>', text, '<|im_end|><tool_call><|endoftext|>')
 when 5 then concat('note = ', note, chr(10), chr(10), 'import doctest', chr(10), chr(10), '  doctest.testmod()', chr(10))
 else case when doc_id % 70 = 6 then regexp_replace(text, '\\S', '', 'g') else concat('   ', text, ' ?', chr(10), '   ') end end code from v_notes)"""


def fences(x: str) -> str:
    opened = f"regexp_replace({x}, '^{WS}*```(?:py(?:thon)?)?{WS}*\\n', '', 'i')"
    return f"regexp_replace({opened}, '\\n{WS}*```{WS}*$', '')"


ORACLES["clean_completions"] = f"""with {V_COMPLETIONS},
 a as (select doc_id, {fences(strip('code'))} t from v_completions),
 b as (select doc_id, list_transform(string_split(t, chr(10)), lambda l: regexp_replace(l, '^[ \\t]+$', '')) ls from a),
 c as (select doc_id, ls, list_transform(list_filter(ls, lambda l: l <> ''), lambda l: regexp_extract(l, '^[ \\t]*')) ind from b),
 d as (select doc_id, ls, coalesce(list_max(list_filter(range(0, len(list_min(ind)) + 1),
   lambda i: left(list_min(ind), i) = left(list_max(ind), i))), 0) margin from c),
 e as (select doc_id, array_to_string(list_transform(ls, lambda l: substring(l, margin + 1)), chr(10)) t from d)
select doc_id, replace(replace({strip('t')}, '\\n', chr(10)), '\\t', chr(9)) code from e"""

ORACLES["extract_functions"] = f"""with {V_COMPLETIONS},
 a as (select doc_id, case when doc_id % 10 = 9 then 'generation failed' end err,
   replace(concat(case doc_id % 3 when 0 then '' when 1 then concat('# document ', doc_id, '\\n') else concat('# document ', doc_id, chr(10)) end, code), '\\n', chr(10)) t from v_completions),
 b as (select doc_id, err, regexp_replace(t, '(?s:if{WS}+__name__{WS}*=={WS}*[''"]__main__[''"]{WS}*:.*)', '') t from a),
 c as (select doc_id, err, regexp_replace(t, 'import{WS}+doctest{WS}*\\n{WS}*doctest\\.testmod\\(\\)', '', 'g') t from b),
 d as (select doc_id, err, {strip(fences('t'))} t from c)
select doc_id, case when err is null then t else '' end code,
  case when err is not null then err when t = '' then 'Could not extract executable code' end error from d"""

DROPPED = (
    r"<\|(endoftext|im_start|im_end|object_ref_start|object_ref_end|box_start|box_end|quad_start|quad_end|"
    r"vision_start|vision_end|vision_pad|image_pad|video_pad)\|>"
)
ORACLES["special_token_scrub"] = f"""with {V_COMPLETIONS}
select doc_id, regexp_replace(code, '{DROPPED}', '', 'g') code,
  cast((length(code) - length(replace(code, '<|im_end|>', ''))) // 10 as bigint) ends,
  cast((length(code) - length(replace(code, '<tool_call>', ''))) // 11 as bigint) tool_calls from v_completions"""

ORACLES["termination_ratio"] = f"""with {V_COMPLETIONS},
 a as (select source, {strip("string_split(" + strip('code') + ", chr(10))[-1]")} l from v_completions)
select source, count(*) completions, 1.0e0 termination_ratio,
  cast(count(*) filter (where l = '' or starts_with(l, 'return ') or starts_with(l, '\"\"\"')) as double) / count(*) ends_cleanly
from a group by source"""

ORACLES["rtf_clean"] = """select doc_id, replace(translate(text, '{}\\', '   '), chr(10), chr(10)) text from documents"""

# --- conversations -----------------------------------------------------------

ORACLES["chat_render"] = """with m as (select conv_id, turn, role,
  case when turn = 0 and role = 'system' then '' else concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) end piece,
  case when turn = 0 then concat('<|im_start|>system', chr(10), case when role = 'system' then text else 'You are a helpful assistant.' end, '<|im_end|>', chr(10)) else '' end opening
  from conversations)
select conv_id, turn, concat(opening, piece, case when turn = max(turn) over (partition by conv_id) then '<|im_start|>assistant' || chr(10) else '' end) as text
from m"""

ORACLES["chat_render_tools"] = """with a as (select conv_id, turn, text,
   case when role <> 'system' and turn > 0 and (turn + conv_id) % 5 < 2 then 'tool' else role end role from conversations),
 b as (select *, role = 'assistant' and conv_id % 3 = 1 calls from a),
 c as (select conv_id, turn, role, calls, case when calls and conv_id % 6 = 1 then '' else text end as text,
   lag(role) over w before, lead(role) over w after from b window w as (partition by conv_id order by turn)),
 p as (select conv_id, turn, case
   when turn = 0 and role = 'system' then ''
   when role = 'tool' then concat(case when before = 'tool' then '' else '<|im_start|>user' end, chr(10), '<tool_response>', chr(10), text,
     chr(10), '</tool_response>', case when coalesce(after, '') = 'tool' then '' else '<|im_end|>' || chr(10) end)
   when calls then concat('<|im_start|>assistant', case when text <> '' then chr(10) || text else '' end,
     chr(10), '<tool_call>', chr(10), '{"name": "fn_', turn, '", "arguments": {"x": ', conv_id, '}}', chr(10), '</tool_call>',
     chr(10), '<tool_call>', chr(10), '{"name": "next", "arguments": {}}', chr(10), '</tool_call>', '<|im_end|>', chr(10))
   else concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) end piece,
   case when turn = 0 then concat('<|im_start|>system', chr(10), case when role = 'system' then text else 'You are a helpful assistant.' end,
     chr(10), chr(10), '# Tools', chr(10), chr(10), 'You may call one or more functions to assist with the user query.', chr(10), chr(10),
     'You are provided with function signatures within <tools></tools> XML tags:', chr(10), '<tools>', chr(10), '{"name": "fn_1"}', chr(10), '{"name": "next"}',
     chr(10), '</tools>', chr(10), chr(10), 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:',
     chr(10), '<tool_call>', chr(10), '{"name": <function-name>, "arguments": <args-json-object>}', chr(10), '</tool_call><|im_end|>', chr(10)) else '' end opening
   from c)
select conv_id, turn, opening || piece as text from p"""

# --- attempts and scores -----------------------------------------------------

ORACLES["chain_resolution"] = f"""with {V_ATTEMPTS},
 r as (select *, row_number() over (partition by task_id, method order by o_orderdate, o_orderkey) rn from v_attempts),
 g as (select task_id, method, count(*) attempts, min(case when ok and produced then rn end) won, max(case when produced then rn end) made
   from r group by task_id, method)
select g.task_id, g.method, won is not null solved, attempts, coalesce(trim(r.code, chr(10) || ' '), '') code
from g left join r on r.task_id = g.task_id and r.method = g.method and r.rn = coalesce(won, made)"""

ORACLES["pass_at_k"] = f"""with {V_ATTEMPTS},
 t as (select task_id, count(*) n, min(case when ok then rn_task end) hit from v_attempts group by task_id)
select cast(k as int) k, count(*) tasks, count(*) filter (where n >= k and hit <= k) passed,
  cast(count(*) filter (where n >= k and hit <= k) as double) / count(*) * 100 pass_at_k
from t cross join (values (1), (5), (10)) v(k) group by k"""

ORACLES["dataset_eval"] = f"""with {V_TASKS}, {V_ATTEMPTS},
 f as (select task_id, method, ok from v_attempts
   qualify row_number() over (partition by task_id, method order by o_orderdate, o_orderkey) = 1)
select method, count(*) total_examples, count(*) filter (where ok and t.task_id is not null) passed_examples,
  cast(count(*) filter (where ok and t.task_id is not null) as double) / count(*) * 100 pass_rate
from f left join v_tasks t using (task_id) group by method"""

ORACLES["dataset_eval_all"] = f"""with {V_TASKS}, {V_ATTEMPTS}
select method, count(*) total_examples, count(*) filter (where ok and t.task_id is not null) passed_examples,
  cast(count(*) filter (where ok and t.task_id is not null) as double) / count(*) * 100 pass_rate
from v_attempts left join v_tasks t using (task_id) group by method"""

V_RUNS = f"""v_runs as (select {method_of('o_orderkey')} benchmark, date_trunc('month', o_orderdate) as "month",
   count(*) filter (where o_orderstatus = 'F') passed_examples, count(*) total_examples, max(o_orderdate) as "timestamp",
   cast(count(*) filter (where o_orderstatus = 'F') as double) / count(*) * 100 pass_rate from orders group by 1, 2)"""

ORACLES["run_summary"] = f"""with {V_RUNS}
select benchmark, passed_examples, total_examples, "timestamp", pass_rate,
  concat(benchmark, ':', chr(10), '  Pass Rate: ', printf('%.2f', pass_rate), '%', chr(10), '  Passed: ', passed_examples, '/', total_examples, chr(10),
    '  Timestamp: ', strftime("timestamp", '%Y-%m-%dT%H:%M:%S')) report
from v_runs qualify row_number() over (partition by benchmark order by "timestamp" desc) = 1"""

ORACLES["run_documents"] = f"""with {V_RUNS}
select cast("month" as timestamp) as "month", benchmark, passed_examples, total_examples, "timestamp", pass_rate, 3 iterations, '40' top_k from v_runs"""

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ORACLES["log_lines"] = f"""with a as (select doc_id, regexp_split_to_array(text, '{LINE_END}') l from documents),
 b as (select doc_id, case when l[-1] = '' then l[1:len(l) - 1] else l end l from a)
select doc_id, cast(unnest(range(0, len(l))) as int) line_no, {strip('unnest(l)')} line from b"""

ORACLES["log_methods"] = f"""with {V_LOG} select method, method by_rule, count(*) as lines from v_log group by method"""

ORACLES["log_tests_sketched"] = f"""with {V_LOG}, {LAST}
select method, count(distinct test_name) tests, true within_bound from v_verdicts group by method"""

ORACLES["log_round_trip"] = f"""with {V_ATTEMPTS}
select o_orderkey line_no, task_id test_name, cast(ok as int) passed,
  case when ok then null when error = 'SyntaxError' then 'SYNTAX ERROR' else error end error_type from v_attempts"""

ORACLES["run_timing"] = f"""select {method_of('o_orderkey')} as method, round(sum(o_totalprice), 2) total_time,
  round(sum(o_totalprice) / count(*), 4) avg_time_per_problem from orders group by 1"""

ORACLES["run_config_normalized"] = """with c as (select c_custkey, c_name, cast(c_nationkey as varchar) nk, c_nationkey % 2 = 0 even,
   c_acctbal > 0 pos, c_mktsegment in ('BUILDING', 'MACHINERY') greedy from customer)
select c_custkey, setting, value from (
 select c_custkey, 'max_new_tokens' setting, '400' as value from c
 union all select c_custkey, 'do_sample', case when greedy then 'false' else 'true' end from c
 union all select c_custkey, 'temperature', case when greedy then '0.0' when pos then nk else '0.6' end from c
 union all select c_custkey, 'top_k', case when greedy then '1' else nk end from c
 union all select c_custkey, 'top_p', '1.0' from c where greedy
 union all select c_custkey, 'pad_token_id', '151643' from c
 union all select c_custkey, 'eos_token_id', '151643' from c
 union all select c_custkey, case when even then 'num_beams' else 'seed' end, case when even and greedy then '1' else '5' end from c
 union all select c_custkey, 'max_length', cast(length(c_name) + 400 as varchar) from c) x"""

ORACLES["bleu_pairs"] = f"""with d as (select doc_id, case when doc_id % 50 = 49 then -1 else doc_id % (select count(*) from benchmark) end item_id,
   case when doc_id % 60 <> 59 then text end text from documents),
 p as (select doc_id, item_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '') w from d where text is not null),
 b as (select item_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '') w from benchmark),
 n as (select unnest([1, 2, 3, 4]) n),
 cg as (select doc_id, item_id, n, g, count(*) c from (
   select doc_id, item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) g
   from p cross join n) x group by all),
 rg as (select item_id, n, g, count(*) r from (
   select item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) g
   from b cross join n) x group by all),
 m as (select doc_id, n, sum(least(c, r)) hits from cg join rg using (item_id, n, g) group by doc_id, n),
 s as (select p.doc_id, len(p.w) h, len(b.w) r, n.n, coalesce(m.hits, 0) hits
   from p join b using (item_id) cross join n left join m on m.doc_id = p.doc_id and m.n = n.n),
 f as (select doc_id pair_id, round(case when max(case when n = 1 then hits end) = 0 then 0.0e0
  else exp(sum(0.25e0 * ln(case when hits = 0 then 0.1e0 else hits end / greatest(h - n + 1, 1)))
    + case when max(h) > max(r) then 0.0e0 else 1 - max(r) / cast(max(h) as double) end) end, 9) bleu
from s group by doc_id)
select doc_id pair_id, coalesce(bleu, 0.0e0) bleu from documents left join f on pair_id = doc_id"""

ORACLES["exact_match"] = f"""with p as (select source, d.text cand, b.text ref
   from documents d join (select item_id, text from benchmark) b on b.item_id = d.doc_id % (select count(*) from benchmark))
select source, count(*) pairs, avg(cast({strip('ref')} = {strip('cand')} as int)) exact_match, 1.0e0 spaced_match from p group by source"""


# --- embedding bags ----------------------------------------------------------


def rnd(x: str, places: int) -> str:
    # DuckDB rounds to -0.0 where Spark gives 0.0.
    return f"case when round({x}, {places}) = 0 then 0.0e0 else round({x}, {places}) end"


V_EMB = """v_emb as (select vec_id, cast(unnest(range(0, len(embedding))) as int) d, cast(unnest(embedding) as double) x from embeddings)"""

V_BAGS = """v_bags as (select user_id bag_id, event_id element, event_id * 7 % (select count(*) from embeddings) vec_id,
  value weight, row_number() over (partition by user_id order by event_id) - 1 pos from events)"""

ORACLES["bag_sum"] = f"""with {V_EMB}, {V_BAGS},
 s as (select bag_id, d, sum(x) x from v_bags join v_emb using (vec_id) group by bag_id, d),
 g as (select c_custkey bag_id, cast(d as int) d from customer cross join (select unnest(range(0, 64)) d) r)
select bag_id, d, {rnd('coalesce(x, 0.0e0)', 4)} x from g left join s using (bag_id, d)"""

ORACLES["bag_weighted"] = f"""with {V_EMB}, {V_BAGS}
select bag_id, d, {rnd('sum(weight * x)', 4)} x from v_bags join v_emb using (vec_id) group by bag_id, d"""

ORACLES["bag_positional"] = f"""with {V_EMB}, {V_BAGS}
select bag_id, d, {rnd('sum(o_totalprice / 100000 * x)', 4)} x from v_bags join orders on o_orderkey = pos
join v_emb using (vec_id) group by bag_id, d"""

ORACLES["bag_mean"] = f"""with {V_EMB}, {V_BAGS}
select bag_id, d, {rnd('sum(x) / count(*)', 4)} x from v_bags join v_emb using (vec_id) group by bag_id, d"""

ORACLES["bag_quantized"] = f"""with {V_EMB}, {V_BAGS},
 l as (select vec_id, d, x, min(x) over (partition by vec_id) lo, max(x) over (partition by vec_id) hi from v_emb),
 q as (select vec_id, d, lo, (hi - lo) / 255.0e0 scale, round((x - lo) / ((hi - lo) / 255.0e0)) q from l)
select bag_id, d, {rnd('sum(weight * (scale * q + lo))', 4)} x from v_bags join q using (vec_id) group by bag_id, d"""

V_CUT = """v_cut as (select vec_id, d, sign(x) * case when x = 0 then 0
  when floor(log2(abs(x))) < {low} then floor(abs(x) * pow(2.0e0, {mant} - ({low}))) / pow(2.0e0, {mant} - ({low}))
  else floor(abs(x) / pow(2.0e0, floor(log2(abs(x))) - {mant})) * pow(2.0e0, floor(log2(abs(x))) - {mant}) end x
  from v_emb where x <> 0 union all select vec_id, d, 0.0e0 from v_emb where x = 0)"""

for _name, _low, _mant in (("bag_half", -14, 10), ("bag_bfloat16", -126, 7)):
    ORACLES[_name] = f"""with {V_EMB}, {V_CUT.format(low=_low, mant=_mant)}, {V_BAGS}
select bag_id, d, {rnd('sum(x)', 4)} x from v_bags join v_cut using (vec_id) group by bag_id, d"""

V_RANGES = """v_len as (select user_id bag_id, count(*) length from events group by user_id),
 v_ranges as (select bag_id, length, sum(length) over (order by bag_id) - length start from v_len),
 v_cutbags as (select bag_id, cast(event_id - start as bigint) pos, event_id * 7 % (select count(*) from embeddings) vec_id
  from v_ranges join events on event_id >= start and event_id < start + length)"""

ORACLES["bag_lengths"] = f"""with {V_EMB}, {V_RANGES}
select bag_id, d, {rnd('sum(x)', 4)} x from v_cutbags join v_emb using (vec_id) group by bag_id, d"""

ORACLES["bag_offsets"] = f"with {V_RANGES} select bag_id, pos, vec_id from v_cutbags"

ORACLES["bag_call_check"] = """select cast(sum(length) as bigint) listed, min(length) shortest, (select count(*) from events) ids,
 cast(0 as bigint) bad_ids, sum(length) = (select count(*) from events) and min(length) >= 0 valid
from (select count(*) length from events group by user_id)"""

ORACLES["bag_bad_ids"] = """with p as (select user_id bag_id, event_id, event_id % ((select count(*) from embeddings) + 3) - 1 vec_id from events)
select * from p where vec_id not in (select vec_id from embeddings)"""

ORACLES["bag_checked"] = f"""with {V_EMB},
 p as (select user_id bag_id, event_id, event_id % ((select count(*) from embeddings) + 3) - 1 vec_id from events),
 b as (select bag_id, count(*) filter (where vec_id not in (select vec_id from embeddings)) bad from p group by bag_id)
select bag_id, bad, d, {rnd('sum(x)', 4)} x from b join p using (bag_id) join v_emb using (vec_id) where bad = 0 group by bag_id, bad, d
union all select bag_id, bad, null, null from b where bad > 0"""

ORACLES["bag_offsets_check"] = """with l as (select user_id bag_id, count(*) length from events group by user_id),
 g as (select cast(0 as bigint) bag_no, cast(0 as bigint) "offset" union all select bag_id + 1, cast(sum(length) over (order by bag_id) as bigint) from l),
 k as (select 'none' kind, * from g union all select 'gap', * from g where bag_no <> 5
  union all select 'repeated', case when bag_no = 7 then 6 else bag_no end, "offset" from g
  union all select 'falling', bag_no, case when bag_no = 3 then 0 else "offset" end from g
  union all select 'short', bag_no, least("offset", 90) from g),
 f as (select a.kind, count(*) filter (where b."offset" < a."offset") falls from k a join k b on a.kind = b.kind and b.bag_no = a.bag_no + 1 group by a.kind),
 s as (select kind, count(*) entries, count(*) - count(distinct bag_no) repeated, max(bag_no) + 1 - count(distinct bag_no) gaps, cast(0 as bigint) negative,
  arg_max("offset", bag_no) - arg_min("offset", bag_no) covered, (select count(*) from events) ids from k group by kind)
select s.*, falls, repeated = 0 and gaps = 0 and falls = 0 and covered = ids valid from s join f using (kind)"""

# --- products ----------------------------------------------------------------

ORACLES["vec_dot"] = f"""with {V_EMB}, n as (select count(*) n from embeddings),
 e as (select event_id, event_id % n a, (event_id * 7 + 3) % n b from events cross join n)
select event_id, {rnd('sum(x.x * y.x)', 6)} dot from e join v_emb x on x.vec_id = a join v_emb y on y.vec_id = b and y.d = x.d group by event_id"""

ORACLES["mat_vec"] = f"""with {V_EMB}, v as (select d, sum(x) s from v_emb group by d)
select vec_id, {rnd('sum(x * s)', 4)} as value from v_emb join v using (d) group by vec_id"""

ORACLES["vec_mat"] = f"""with {V_EMB}
select d j, {rnd('sum(x * label)', 4)} as value from v_emb join embeddings using (vec_id) group by d"""

ORACLES["mat_mul"] = f"""with {V_EMB}
select a.d i, b.d j, {rnd('sum(a.x * b.x)', 4)} as value from v_emb a join v_emb b using (vec_id) group by a.d, b.d"""

ORACLES["mat_mul_shapes"] = f"""with {V_EMB}, w as (select vec_id, any_value(label) y from embeddings group by vec_id)
select 'matrix matrix' shape, a.d::int i, b.d::int j, {rnd('sum(a.x * b.x)', 4)} as value from v_emb a join v_emb b using (vec_id) group by a.d, b.d
union all select 'matrix vector', a.d::int, null, {rnd('sum(a.x * y)', 4)} from v_emb a join w using (vec_id) group by a.d
union all select 'vector matrix', null, a.d::int, {rnd('sum(a.x * y)', 4)} from v_emb a join w using (vec_id) group by a.d
union all select 'vector vector', null, null, {rnd('sum(y::double * y)', 4)} from w"""

# --- reductions and scatter updates ------------------------------------------

# Exact product of 64-bit integers modulo 2^64.
_PRODUCT = ("list_reduce(list_prepend(1::uhugeint, list(((4000000014 * l_orderkey::hugeint + 1) % 18446744073709551616)::uhugeint)), "
            "lambda x, y: (x * y) % 18446744073709551616::uhugeint)")
_SIGNED = "cast(case when p >= 9223372036854775808 then p::hugeint - 18446744073709551616 else p::hugeint end as bigint)"

ORACLES["reduce_all"] = f"""with p as (select l_returnflag, {_PRODUCT} p from lineitem group by 1)
select * exclude (p), {_SIGNED} multiply_whole from p join (select l_returnflag, round(sum(l_extendedprice), 2) add, round(product(1 + l_tax / 1000), 6) multiply,
 bit_and(l_orderkey) bitwise_and, bit_or(l_orderkey) bitwise_or, bit_xor(l_orderkey) bitwise_xor,
 bool_and(l_linenumber <> 0) logical_and, bool_or(l_tax <> 0) logical_or,
 count(*) filter (where l_discount <> 0) % 2 = 1 logical_xor,
 max(l_quantity) maximum, min(l_quantity) minimum, max(l_extendedprice) fmax, min(l_extendedprice) fmin,
 round(sqrt(sum(l_quantity * l_quantity)), 4) hypot,
 max(l_shipdate) maximum_date, min(l_shipdate) minimum_date, max(l_shipdate) fmax_date, min(l_shipdate) fmin_date,
 cast(trunc(sum(epoch_us(l_shipdate) - epoch_us(timestamp '1995-01-01')) / 86400000000) as bigint) add_interval,
 {", ".join(f"cast(trunc({f}(epoch_us(l_shipdate) - epoch_us(timestamp '1995-01-01')) / 86400000000) as bigint) {n}_interval" for n, f in (("maximum", "max"), ("minimum", "min"), ("fmax", "max"), ("fmin", "min")))}
 from lineitem group by l_returnflag) using (l_returnflag)"""

ORACLES["reduce_logaddexp"] = """select l_returnflag, l_linestatus, round(ln(sum(exp(l_quantity))), 6) logaddexp,
 round(log2(sum(pow(2.0e0, l_quantity))), 6) logaddexp2 from lineitem group by 1, 2"""

ORACLES["reduce_gcd"] = """select l_suppkey, list_reduce(list(cast(l_quantity * 6 as bigint)), lambda x, y: greatest_common_divisor(x, y)) gcd
from lineitem group by l_suppkey"""

ORACLES["scatter_update"] = f"""with u as (select l_partkey idx, sum(l_quantity) s, product(1 + l_tax) f,
   max(l_extendedprice / 40) hi, min(l_extendedprice / 40) lo from lineitem group by l_partkey),
 p as (select p_partkey idx, p_retailprice v from part union all select -1 - p_partkey, p_retailprice from part),
 t as (select idx, v, s, f, hi, lo from p left join u using (idx))
select idx, {rnd('coalesce(v + s, v)', 6)} as add, {rnd('coalesce(v - s, v)', 6)} as subtract,
 {rnd('coalesce(v * f, v)', 6)} as multiply, {rnd('coalesce(v / f, v)', 6)} as divide, {rnd('greatest(v, hi)', 6)} as maximum,
 {rnd('least(v, lo)', 6)} as minimum, {rnd('greatest(v, hi)', 6)} as fmax, {rnd('least(v, lo)', 6)} as fmin from t"""

_HOT = "case when l_orderkey % 3 = 0 then 1 else l_partkey end"
_SINCE = "epoch_us(l_shipdate) - epoch_us(timestamp '1995-06-17')"
_WHOLE_DAYS = lambda x: f"cast(trunc(coalesce({x}, 0) / 86400000000) as bigint)"

ORACLES["scatter_types"] = f"""with u as (select {_HOT} idx, max(l_shipdate) hi, min(l_shipdate) lo, sum({_SINCE}) s, max({_SINCE}) a, min({_SINCE}) b,
  max(4000000014 * l_orderkey + 1) w, min(4000000014 * l_orderkey + 1) v, {_PRODUCT} f from lineitem group by 1),
t as (select p_partkey idx, u.* exclude (idx), (coalesce(f, 1::uhugeint) * (2 * p_partkey + 1)::uhugeint) % 18446744073709551616::uhugeint p from part left join u on idx = p_partkey)
select idx, greatest(hi, timestamp '1995-06-17') maximum_date, least(lo, timestamp '1995-06-17') minimum_date, greatest(hi, timestamp '1995-06-17') fmax_date,
 least(lo, timestamp '1995-06-17') fmin_date, {_WHOLE_DAYS("s")} add_interval, {_WHOLE_DAYS("-s")} subtract_interval, {_WHOLE_DAYS("greatest(a, 0)")} maximum_interval,
 {_WHOLE_DAYS("least(b, 0)")} minimum_interval, {_WHOLE_DAYS("greatest(a, 0)")} fmax_interval, {_WHOLE_DAYS("least(b, 0)")} fmin_interval,
 {_SIGNED} multiply_whole, cast(greatest(w, 2 * idx + 1) as bigint) maximum_whole, cast(least(v, 2 * idx + 1) as bigint) fmin_whole from t"""

# Quotients rounded down, one update after the other; remainders of doubles are exact.
_DOWN = "case when y = 0 then 0 else (x - ((x % y) + y) % y) // y end"
_DOWN_REAL = "round((x - x % y) / y) - case when x % y <> 0 and (x % y < 0) <> (y < 0) then 1 else 0 end"
ORACLES["scatter_floor_divide"] = f"""with l as (select {_HOT} idx, l_orderkey, l_linenumber,
  case when l_linenumber = 2 then -1 when l_linenumber > 4 then case when l_orderkey % 5 < 2 then -2 else 3 end else 1 end::bigint u,
  case when l_linenumber = 2 then case when l_orderkey % 5 = 0 then 0.25 else -0.5 end when l_linenumber = 3 then 1.5 else -1.25 + (l_orderkey % 5) / 2 end::double r from lineitem),
u as (select idx, list(u order by l_orderkey, l_linenumber, u) us from l group by 1), r as (select idx, list(r order by l_orderkey, l_linenumber, r) rs from l group by 1)
select p_partkey idx, list_reduce(list_prepend((p_partkey * 1000003 - 900000000)::bigint, coalesce(us, [])), lambda x, y: {_DOWN})::bigint whole,
 list_reduce(list_prepend((p_partkey * 1000.5 - 90000)::double, coalesce(rs, [])), lambda x, y: {_DOWN_REAL})::double as real
from part left join u on u.idx = p_partkey left join r on r.idx = p_partkey"""


# --- column functions --------------------------------------------------------

V_NUM = """o as (select o_orderkey, o_custkey, o_orderdate, (case when o_orderkey % 2 = 0 then o_totalprice else -o_totalprice end) / 1000 x,
  cast(o_custkey % 7 - 3 as double) y from orders)"""


def rounded(**columns: str) -> str:
    return ", ".join(f"{rnd(f'({sql})', 6)} as {name}" for name, sql in columns.items())


QUOT = "case when y = 0 then (case when x > 0 then 1 else -1 end) * cast('inf' as double) else floor(x / y) end"
MOD = "case when y = 0 then cast('nan' as double) else x - y * floor(x / y) end"

ORACLES["fn_arith"] = f"""with {V_NUM}, k as (select *, o_orderkey - 5000 a, o_custkey % 7 - 3 b from o)
select o_orderkey, {rounded(
    add_='x + y', subtract_='x - y', multiply_='x * y',
    divide_="case when y = 0 then (case when x > 0 then 1 else -1 end) * cast('inf' as double) else x / y end",
    fmod_="case when y = 0 then cast('nan' as double) else x - y * trunc(x / y) end", remainder_=MOD, absolute_='abs(x)', fabs_='abs(x)',
    negative_='-x', positive_='x', reciprocal_='1 / x', square_='x * x', sqrt_='sqrt(abs(x))', cbrt_='cbrt(x)',
    power_='pow(x / 10, 3)', float_power_='sqrt(abs(x))', hypot_='sqrt(x * x + y * y)', floor_divide_=QUOT, quotient_=QUOT, rest_=MOD)},
  1.0e0 ones_like_, cast(case when b = 0 then 0 else floor(a / cast(b as double)) end as bigint) floor_divide_int_ from k"""

ORACLES["fn_exp_log"] = f"""with {V_NUM}
select o_orderkey, {rounded(
    exp_='exp(x / 100)', exp2_='pow(2.0e0, x / 100)', expm1_='exp(x / 100) - 1',
    log_="case when x > 0 then ln(x) else cast('nan' as double) end", log2_="case when x > 0 then log2(x) else cast('nan' as double) end",
    log10_="case when x > 0 then log10(x) else cast('nan' as double) end", log1p_="case when x > -1 then ln(1 + x) else cast('nan' as double) end",
    log_zero_="cast('-inf' as double)",
    logaddexp_='greatest(x, y) + ln(1 + exp(-abs(x - y)))', logaddexp2_='greatest(x, y) + log2(1 + pow(2.0e0, -abs(x - y)))')} from o"""

ORACLES["fn_trig"] = f"""with {V_NUM}
select o_orderkey, {rounded(
    sin_='sin(x)', cos_='cos(x)', tan_='tan(x / 1000)', arcsin_='asin(x / 1000)', arccos_='acos(x / 1000)', arctan_='atan(x)',
    arctan2_='atan2(x, y)', sinh_='sinh(x / 1000)', cosh_='cosh(x / 1000)', tanh_='tanh(x)', arcsinh_='asinh(x / 1000)',
    arccosh_='acosh(abs(x) + 1)', arctanh_='atanh(x / 1000)', degrees_='degrees(x / 1000)', radians_='radians(x)',
    rad2deg_='degrees(x / 1000)', deg2rad_='radians(x)')} from o"""

ORACLES["fn_round"] = f"""with {V_NUM}
select o_orderkey, {rounded(
    ceil_='ceil(x)', floor_='floor(x)', trunc_='trunc(x)', rint_='round_even(o_orderkey / 2.0e0, 0)',
    fraction_='x - trunc(x)', integral_='trunc(x)', clip_='least(greatest(x, -50.0e0), 80.0e0)')} from o"""

ORACLES["fn_compare"] = f"""with {V_NUM}, c as (select o_orderkey, round_even(x, 0) x, y * 20 y, y z, o_orderkey % 10 = 0 isn from o)
select o_orderkey, x = y equal_, isn not_equal_, not isn and y > x greater_, x >= y greater_equal_, x < y less_, not isn and x <= y less_equal_,
  {rounded(maximum_='greatest(x, y)', minimum_='least(x, y)', fmax_='case when isn then x else greatest(x, y) end',
           fmin_='case when isn then x else least(x, y) end',
           heaviside_='case when z < 0 then 0.0e0 when z = 0 then 0.5e0 else 1.0e0 end', sign_='cast(sign(z) as double)')} from c"""

ORACLES["fn_logic_bits"] = """with o as (select o_orderkey a, o_custkey b, o_custkey % 5 n from orders)
select a o_orderkey, a & b bitwise_and_, a | b bitwise_or_, xor(a, b) bitwise_xor_, -a - 1 invert_, cast(bit_count(a) as bigint) bitwise_count_,
 a * cast(pow(2.0e0, n) as bigint) left_shift_, a // cast(pow(2.0e0, n) as bigint) right_shift_, n <> 0 and a % 2 <> 0 logical_and_,
 n <> 0 or a % 2 <> 0 logical_or_, (n <> 0) <> (a % 2 <> 0) logical_xor_, n = 0 logical_not_ from o"""

ORACLES["fn_float_class"] = f"""with {V_NUM}
select o_orderkey, o_orderkey % 8 = 0 isnan_, o_orderkey % 8 <> 0 and o_orderkey % 4 < 2 isinf_, o_orderkey % 4 >= 2 isfinite_,
  x < 0 signbit_, case when x < 0 then -2.5e0 else 2.5e0 end copysign_ from o"""

ORACLES["fn_datetime"] = """with o as (select o_orderkey, o_orderdate d, timestamp '1996-01-01' s, epoch_us(o_orderdate) - epoch_us(timestamp '1996-01-01') g from orders)
select o_orderkey, d + interval 1 day next_day, d - interval 1 day day_before, make_timestamp(epoch_us(s) + 2 * g) mirrored,
  make_timestamp(epoch_us(s) + g // 2) halfway, d > s later, d <= s not_later, case when o_orderkey % 3 = 0 then true end same_day,
  greatest(d, s) latest, least(d, s) earliest, d known, least(greatest(d, s), s + interval 365 day) clipped, g > 604800000000 long_gap,
  cast(sign(g) as double) direction, true isfinite_, false isnan_, round(g / 604800000000.0e0, 6) as weeks,
  cast(floor(g / 604800000000.0e0) as bigint) whole_weeks, make_timestamp(epoch_us(s) + g - cast(floor(g / 604800000000.0e0) as bigint) * 604800000000) as rest, o_orderkey % 3 <> 0 isnat_ from o"""

ORACLES["fn_int_exact"] = """with k as (select o_orderkey, (o_orderkey * 3 + 9007199254740993) * case when o_orderkey % 2 = 0 then 1 else -1 end x, o_custkey % 15 - 7 y from orders),
 m as (select *, case when y = 0 then 0 else x % y end f from k),
 r as (select *, case when f <> 0 and (f < 0) <> (y < 0) then f + y else f end r from m)
select o_orderkey, f fmod_, r remainder_, r rest_, cast(case when y = 0 then 0 else (x - r) // y end as bigint) quotient_, x floor_, x ceil_, x trunc_,
 cast(list_reduce(list_prepend(cast(1 as hugeint), list_transform(range(o_orderkey % 20), lambda i: cast(y as hugeint))), lambda a, b: a * b) as bigint) power_,
 cast(case when y = 0 then null when abs(y) = 1 then y else 0 end as bigint) reciprocal_, x + 1 fmax_, x fmin_, greatest(x, y) maximum_, false equal_, abs(x) absolute_ from r"""

ORACLES["fn_bool"] = """with k as (select o_orderkey, o_orderkey % 2 = 0 a, o_custkey % 3 = 0 b from orders)
select o_orderkey, a or b add_, a and b multiply_, a absolute_, a and b and_, a or b or_, a <> b xor_, not a invert_, a or b maximum_, a and b minimum_, not a and b less_, a = b equal_ from k"""

ORACLES["fn_gcd_lcm"] = """select l_orderkey, l_partkey, cast(gcd(l_orderkey, l_partkey) as bigint) gcd,
  cast(lcm(l_orderkey, l_partkey) as bigint) lcm from lineitem"""

ORACLES["fn_str_pad_strip"] = r"""with p as (select p_partkey, p_name n, p_type t, p_size, greatest(15 - length(p_name), 0) pad,
   cast(p_size as varchar) digits, 8 - length(p_type) % 8 t1 from part)
select p_partkey, concat(repeat('*', pad // 2 + pad % 2), n, repeat('*', pad - pad // 2 - pad % 2)) center_,
 concat(n, repeat('-', pad)) ljust_, concat(repeat(' ', pad), n) rjust_,
 case when p_size % 2 = 0 then concat('-', lpad(digits, 4, '0')) else lpad(digits, 5, '0') end zfill_,
 n strip_, concat(n, ' ', chr(10)) lstrip_, concat(chr(9), ' ', n) rstrip_, trim(n, 'abcdefr ') strip_chars_, ltrim(n, 'abcdefr ') lstrip_chars_,
 rtrim(n, 'getdr ') rstrip_chars_, concat(t, repeat(' ', t1), n, repeat(' ', 8 - length(n) % 8), '|') expandtabs_,
 cast(length(t) + t1 + length(n) + 8 - length(n) % 8 + 1 as int) expandtabs_length_, cast(length(n) as int) str_len_ from p"""

ORACLES["fn_str_find_count"] = """with d as (select doc_id, text t, length(text) n from documents),
 w as (select *, substring(t, 6, 195) a, substring(t, 11, greatest(n - 20, 0)) b, substring(t, 4, 497) c from d)
select doc_id, cast(instr(t, 'en') - 1 as int) find_, cast(case when instr(a, 'e') = 0 then -1 else instr(a, 'e') + 4 end as int) find_from_,
 cast(case when instr(t, 'e') = 0 then -1 else n - instr(reverse(t), 'e') end as int) rfind_,
 cast(case when instr(b, 'en') = 0 then -1 else 10 + length(b) - instr(reverse(b), 'ne') - 1 end as int) rfind_from_,
 cast(n - length(replace(t, 'e', '')) as int) count_, cast((length(c) - length(replace(c, 'en', ''))) // 2 as int) count_from_,
 starts_with(t, 'E') startswith_, starts_with(substring(t, 2, 8), 'a') startswith_from_, ends_with(t, '.') endswith_,
 cast(case when instr(t, '#') > 0 then instr(t, '#') - 1 else n end as int) index_,
 cast(case when instr(t, '#') > 0 then n - instr(reverse(t), '#') + 1 else 0 end as int) rindex_, cast(n as int) length_ from w"""

ORACLES["fn_str_split_slice"] = """with d as (select doc_id, text t, length(text) n, instr(text, ' ') p, instr(reverse(text), ' ') r from documents)
select doc_id, case when p > 0 then left(t, p - 1) else t end head, case when p > 0 then ' ' else '' end sep,
 case when p > 0 then substring(t, p + 1) else '' end tail, case when r > 0 then left(t, n - r) else '' end rhead,
 case when r > 0 then substring(t, n - r + 2) else t end rtail, substring(t, 4, 37) slice_,
 substring(t, greatest(n - 12, 0) + 1, greatest(n - 2, 0) - greatest(n - 12, 0)) slice_end_,
 array_to_string(list_transform(range(1, least(n, 60) + 1, 3), lambda i: substring(t, i, 1)), '') slice_step_,
 array_to_string(list_reverse(list_transform(range(1, n + 1), lambda i: array_extract(t, i))), '') slice_back_,
 replace(t, 'e', '<e>') replace_, regexp_replace(regexp_replace(t, 'e', chr(1)), 'e', '<e>').replace(chr(1), '<e>') replace_two_ from d"""

ORACLES["fn_str_class"] = f"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '')) w from documents),
 b as (select doc_id, len(regexp_extract_all(text, '[ \\t\\r\\n]+')) + len(list_filter(regexp_extract_all(text, '[^ \\t\\r\\n]+'), lambda t: regexp_matches(t, '^{WS}+$'))) as blanks from documents)
select doc_id, count(w) words, count(*) filter (where regexp_matches(w, '^\\p{{L}}+$')) isalpha,
 count(*) filter (where regexp_matches(w, '^\\p{{Nd}}+$')) isdecimal, count(*) filter (where regexp_matches(w, '^[\\p{{Nd}}²³¹]+$')) isdigit,
 count(*) filter (where regexp_matches(w, '^\\p{{N}}+$')) isnumeric, count(*) filter (where regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$')) isalnum,
 any_value(blanks) isspace, count(*) filter (where lower(w) = w and upper(w) <> w) islower, count(*) filter (where upper(w) = w and lower(w) <> w) isupper,
 count(*) filter (where regexp_matches(w, '\\p{{Lu}}') and not regexp_matches(w, '[\\p{{Lu}}\\p{{Ll}}]\\p{{Lu}}')
   and not regexp_matches(w, '(?:^|[^\\p{{Lu}}\\p{{Ll}}])\\p{{Ll}}')) istitle
from b left join w using (doc_id) group by doc_id"""

# --- syntax and suites: known by the way the completions are made ------------

ORACLES["syntax_screen"] = """select doc_id, false raw, doc_id % 7 < 4 cleaned, doc_id % 7 in (0, 1, 3, 5) extracted from documents"""

ORACLES["suite_verdicts"] = """select doc_id,
  case doc_id % 7 when 0 then 'humaneval' when 1 then 'mbpp' when 3 then 'import' else 'generic' end test_type,
  doc_id % 7 = 3 or (doc_id % 7 < 3 and doc_id % 2 = 0) passed,
  case when doc_id % 7 > 3 then 'SyntaxError' when doc_id % 7 <> 3 and doc_id % 2 = 1 then 'AssertionError' end error_type
from documents"""

ORACLES["syntax_metrics"] = """select source, avg(case when doc_id % 7 < 4 then 1.0e0 else 0.0e0 end) "is syntactically_valid",
  avg(case when doc_id % 7 < 4 then 1.0e0 else 0.0e0 end) is_importable from documents group by source"""

ORACLES["example_results"] = f"""with {V_ATTEMPTS}
select method, o_orderkey example_index, case when o_orderkey % 7 <> 3 then task_id else concat('task_', o_orderkey) end task_id,
  cast(null as varchar) entry_point, o_orderkey % 5 <> 0 and ok passed from v_attempts"""

# --- files -------------------------------------------------------------------

ORACLES["matrix_files"] = f"""with {V_LOG}, {V_TESTS}, {LAST}, {CELLS},
 n as (select method, count(*) "lines" from v_verdicts group by method)
select method, passed, "lines" from v_totals left join n using (method)"""

ORACLES["log_files"] = f"""with {V_LOG}, {LAST} select test_name, cast(passed as int) passed, count(*) "lines" from v_verdicts group by all"""

ORACLES["suite_files"] = f"""with {V_TASKS}, {V_MBPP}
select 'humaneval' suite, task_id, prompt, [test] tests from v_tasks where cast(substring(prompt, 8, length(prompt) - 11) as bigint) % 4 = 0
union all select 'mbpp', task_id, text, test_list from v_mbpp where id % 4 = 0
union all select 'custom', case when p_partkey % 4 = 0 then 'test' else 'train' end, cast(count(*) as varchar), [] from part group by 1, 2"""

ORACLES["run_files"] = """with r as (select *, o_orderstatus = 'F' ok from orders), {1}
select method, total_examples, passed_examples from (
 select {0} as method, count(*) total_examples, count(*) filter (where ok) passed_examples from r group by 1
 union all select 'all', count(*), count(*) filter (where ok) from r)
 union all select concat_ws(' ', benchmark, strftime("month", '%Y-%m'), '40', cast(round(pass_rate, 3) as varchar)), total_examples, passed_examples from v_runs""".format(method_of("o_orderkey"), V_RUNS)
