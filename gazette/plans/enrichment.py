"""Enrichment queries: dispatch, prompts, model answers, failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import LANG_NAMES, WHITESPACE_CODES
from ..operators import enrich, jobs
from ..operators.fence import where_computed
from .jobs import _MESSAGES_SQL
from ..session import scratch_path
from ..sources.answers import AnswerStore
from .registry import query

_WS_SQL = " || ".join(f"chr({c})" for c in WHITESPACE_CODES)


def _trim_sql(x):
    return f"trim({x}, {_WS_SQL})"


_LANG_CASE = ("case target_lang " + " ".join(f"when '{k}' then '{v}'" for k, v in LANG_NAMES.items())
              + " else target_lang end")


def _dispatch_case(i):
    return ("case job_type " + " ".join(
        f"when '{k}' then {repr(v[i]).lower() if isinstance(v[i], bool) else repr(v[i])}"
        for k, v in enrich.DISPATCH.items()) + " end")


_DISPATCH_SQL = f"""
select *, {_dispatch_case(0)} as input_source,
  case when {_dispatch_case(1)} = 'display' then {_LANG_CASE} else target_lang end as prompt_lang,
  {_dispatch_case(2)} as result_kind, {_dispatch_case(3)} as post_clean,
  case when {_dispatch_case(2)} = 'thumbnail.webp' then s3_prefix || '/' || {_dispatch_case(2)}
       else s3_prefix || '/lang=' || target_lang || '/' || {_dispatch_case(2)} end as result_key
from ({_MESSAGES_SQL}) where job_type in ({", ".join(repr(k) for k in enrich.DISPATCH)})
"""

_TEXTS_SQL = """
select a.id as article_id, d.text from article a join documents d on d.doc_id = a.id
where a.s3_prefix <> ''
"""


def _fill_sql(template, lang, text):
    return f"replace(replace('{template}', '{{lang}}', {lang}), '{{text}}', {text})"


def _user_msg_sql():
    parts = " ".join(f"when '{k}' then {_fill_sql(enrich.PROMPTS[k][1], 'prompt_lang', 'src')}"
                     for k in enrich.TEXT_JOBS)
    return f"case job_type {parts} end"


_REQ_SQL = f"""
select x.*, {_user_msg_sql()} as user_msg from (
  select d.*, case when d.input_source = 'title' then d.title else t.text end as src
  from ({_DISPATCH_SQL}) d left join ({_TEXTS_SQL}) t on t.article_id = d.article_id
  where d.job_type in ({", ".join(repr(k) for k in enrich.TEXT_JOBS)})) x
where src is not null
"""

_RESULTS_SQL = f"""
select event_id, article_id, target_lang as lang, result_kind as kind, result_key as key,
  case when post_clean then translate({_trim_sql('user_msg')}, ',.;', '')
       else {_trim_sql('user_msg')} end as body
from ({_REQ_SQL})
"""


def parsed_jobs(m):
    js, _ = jobs.parse_job_messages(m.job_message().select("event_id", "body"))
    return js


def stored_texts(m):
    a = m.article().where(F.col("s3_prefix") != "").select(F.col("id").alias("article_id"))
    d = m.t.documents.select(F.col("doc_id").alias("article_id"), "text")
    return a.join(d, "article_id")


@query("job_dispatch", f"""
select event_id, job_type, input_source, prompt_lang, result_kind, post_clean, result_key
from ({_DISPATCH_SQL})""")
def q_job_dispatch(m):
    """ENR-06: per job type the input, language form, artifact and cleaning."""
    d, _ = enrich.job_dispatch(parsed_jobs(m))
    return d.select("event_id", "job_type", "input_source", "prompt_lang", "result_kind",
                    "post_clean", "result_key")


@query("job_with_text", f"""
select d.event_id, d.article_id, d.job_type, t.text
from ({_DISPATCH_SQL}) d join ({_TEXTS_SQL}) t on t.article_id = d.article_id
where d.input_source = 'article.txt'""")
def q_job_with_text(m):
    """JOIN-13: each text job with the stored text of its article."""
    d, _ = enrich.job_dispatch(parsed_jobs(m))
    return d.where(F.col("input_source") == "article.txt").join(stored_texts(m), "article_id").select(
        "event_id", "article_id", "job_type", "text")


@query("artifact_text", f"select article_id, text from ({_TEXTS_SQL})")
def q_artifact_text(m):
    """SRC-06: stored article texts by key (the crawled articles)."""
    return stored_texts(m)


def _prompt_query(job_type):
    sys_t, user_t, asst_t = enrich.PROMPTS[job_type]
    return f"""
select event_id, 'chat-default' as model, 0 as temperature,
  {_fill_sql(sys_t, 'prompt_lang', 'src')} as system_msg, user_msg,
  {_fill_sql(asst_t, 'prompt_lang', 'src')} as assistant_msg
from ({_REQ_SQL}) where job_type = '{job_type}'"""


def _prompt_spark(m, job_type):
    d, _ = enrich.job_dispatch(parsed_jobs(m))
    r = enrich.requests(d.where(F.col("job_type") == job_type), stored_texts(m))
    p = F.from_json("request", "model string, temperature int, "
                               "messages array<struct<role string, content string>>")
    return r.select("event_id", p.alias("q")).select(
        "event_id", F.col("q.model").alias("model"), F.col("q.temperature").alias("temperature"),
        F.col("q.messages")[0]["content"].alias("system_msg"),
        F.col("q.messages")[1]["content"].alias("user_msg"),
        F.col("q.messages")[2]["content"].alias("assistant_msg"))


@query("prompt_summarize_article", _prompt_query("summarize_article"))
def q_prompt_summarize_article(m):
    """ENR-01: summary requests (language by display name)."""
    return _prompt_spark(m, "summarize_article")


@query("prompt_translate_article", _prompt_query("translate_article"))
def q_prompt_translate_article(m):
    """ENR-02: article translation requests."""
    return _prompt_spark(m, "translate_article")


@query("prompt_summarize_title", _prompt_query("summarize_title"))
def q_prompt_summarize_title(m):
    """ENR-03: headline requests."""
    return _prompt_spark(m, "summarize_title")


@query("prompt_translate_title", f"""
select a.id as article_id, 'chat-default' as model, 0 as temperature,
  {_fill_sql(enrich.PROMPTS['translate_title'][0], "'zh-CN'", 'a.title')} as system_msg,
  {_fill_sql(enrich.PROMPTS['translate_title'][1], "'zh-CN'", 'a.title')} as user_msg,
  {_fill_sql(enrich.PROMPTS['translate_title'][2], "'zh-CN'", 'a.title')} as assistant_msg
from article a where a.s3_prefix <> ''""")
def q_prompt_translate_title(m):
    """ENR-04: title translation requests for every crawled article (no job
    producer emits this type, so the requests are built from the articles)."""
    a = m.article().where(F.col("s3_prefix") != "")
    q = enrich.prompt("translate_title", F.col("title"), F.lit("zh-CN"))
    return a.select(F.col("id").alias("article_id"), q.alias("q")).select(
        "article_id", F.col("q.model").alias("model"), F.col("q.temperature").alias("temperature"),
        F.col("q.messages")[0]["content"].alias("system_msg"),
        F.col("q.messages")[1]["content"].alias("user_msg"),
        F.col("q.messages")[2]["content"].alias("assistant_msg"))


_COMPLETION_SQL = f"""
select conv_id, turn, status,
  case when status = 200 then {_trim_sql('text')} else '' end as reply
from completion
"""


def _completions(m):
    c = m.completion()
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"))
                                               .alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", "status",
                    enrich.completion_parse(F.col("status"), body).alias("reply"))


@query("completion_parse", _COMPLETION_SQL)
def q_completion_parse(m):
    """ENR-05: status 200 -> trimmed first choice content, else ''."""
    return _completions(m)


@query("non_empty_result", f"select conv_id, turn, reply from ({_COMPLETION_SQL}) where reply <> ''")
def q_non_empty_result(m):
    """FLT-08: only non-empty answers count as success."""
    return where_computed(_completions(m), F.col("reply") != "").select("conv_id", "turn", "reply")


@query("enrich_batch", _RESULTS_SQL)
def q_enrich_batch(m):
    """ENR-07: requests answered by a model function in Arrow batches
    (default: the deterministic echo stub), parsed into artifact rows."""
    good, _failed = enrich.enrich_batch(parsed_jobs(m), stored_texts(m))
    return good


@query("failed_jobs", f"""
select event_id, article_id, job_type from ({_DISPATCH_SQL}) d
where job_type in ({", ".join(repr(k) for k in enrich.TEXT_JOBS)})
  and event_id not in (select event_id from ({_RESULTS_SQL}) where body <> '')""")
def q_failed_jobs(m):
    """AGG-06: text jobs that produced nothing (no stored text) stay queued."""
    _good, failed = enrich.enrich_batch(parsed_jobs(m), stored_texts(m))
    return failed.select("event_id", "article_id", "job_type")


def silent_model(batch):
    """A model that is out of order."""
    import pandas as pd

    return pd.DataFrame({"event_id": batch["event_id"], "status": 500, "body": None})


@query("enrich_replayed", _RESULTS_SQL)
def q_enrich_replayed(m):
    """ENR-07, AGG-06: the batch enriched again from the kept answers alone, by a
    model that answers nothing any more."""
    store = AnswerStore(m.spark, scratch_path(m.spark, "answers"))
    enrich.enrich_batch(parsed_jobs(m), stored_texts(m), answers=store)
    good, _failed = enrich.enrich_batch(parsed_jobs(m), stored_texts(m), silent_model, answers=store)
    return good
