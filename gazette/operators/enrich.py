"""Model enrichment as batch-inference tables.

Jobs become request rows (a chat request struct per job), a caller-supplied
model function answers them batch by batch through ``mapInPandas`` (Arrow
batches, one call per batch, never per row), and answers are parsed back into
artifact rows.  An empty answer is a failure: nothing is written and the job
stays for retry.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import image_link_eligible, lang_display, text_trim, title_clean
from ..sources.answers import AnswerStore, digest
from .fence import where_computed

# Prompt wording (our own), slots {lang} and {text}; the
# assistant turn is always last.
PROMPTS = {
    "summarize_article": (
        "You are a news editor who summarizes articles in {lang}. Keep names of people and "
        "companies in English.",
        "Summarize this news article in {lang} in a few sentences. Article: {text}",
        "Summary of the article in {lang}: "),
    "translate_article": (
        "You are a translator of news articles into {lang}. Keep names of people and companies "
        "in English.",
        "Translate this news article into {lang}. Article: {text}",
        "The article in {lang}: "),
    "summarize_title": (
        "You are a news editor who writes one-line headlines in {lang}. Keep names of people and "
        "companies in English.",
        "Write a one-sentence headline in {lang} for this article: {text}",
        "Headline in {lang}: "),
    "translate_title": (
        "You are a translator of news headlines into {lang}. Keep names of people and companies "
        "in English.",
        "Translate this news headline into {lang}: {text}",
        "The headline in {lang}: "),
}
DEFAULT_MODEL, LARGE_MODEL = "chat-default", "chat-large"

# Per job type, the input, the language form, the artifact written
# and whether punctuation is stripped from the answer.
DISPATCH = {
    "summarize_article": ("article.txt", "display", "summary.txt", False),
    "translate_title": ("title", "code", "title.txt", True),
    "translate_article": ("article.txt", "code", "article.txt", False),
    "summarize_title": ("article.txt", "code", "title.txt", True),
    "get_image": ("image", "code", "thumbnail.webp", False),
}
TEXT_JOBS = tuple(k for k, v in DISPATCH.items() if v[0] != "image")


def _fill(template: str, lang: Column, text: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{lang}"), lang), F.lit("{text}"), text)


def prompt(job_type: str, text: Column, lang: Column, use_large: bool = False) -> Column:
    """Chat request struct ``{model, temperature, messages[system,user,assistant]}``."""
    sys_t, user_t, asst_t = PROMPTS[job_type]
    model = LARGE_MODEL if use_large and job_type != "translate_title" else DEFAULT_MODEL
    msgs = F.array(*[F.struct(F.lit(r).alias("role"), _fill(t, lang, text).alias("content"))
                     for r, t in (("system", sys_t), ("user", user_t), ("assistant", asst_t))])
    return F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature"), msgs.alias("messages"))


def job_dispatch(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dispatched, rejects): each job with its input, language form, result key
    and cleaning flag; unknown job types are rejected."""
    jt = F.col("job_type")

    def pick(i):
        e = None
        for k, v in DISPATCH.items():
            e = (F.when(jt == k, F.lit(v[i])) if e is None else e.when(jt == k, F.lit(v[i])))
        return e

    known = jt.isin(*DISPATCH)
    lang = F.when(pick(1) == "display", lang_display(F.col("target_lang"))).otherwise(F.col("target_lang"))
    out = jobs.where(known).select(
        "*", pick(0).alias("input_source"), lang.alias("prompt_lang"),
        pick(2).alias("result_kind"), pick(3).alias("post_clean"))
    out = out.withColumn("result_key", F.when(
        F.col("result_kind") == "thumbnail.webp",
        F.concat_ws("/", "s3_prefix", "result_kind")).otherwise(
        F.concat_ws("/", "s3_prefix", F.concat(F.lit("lang="), "target_lang"), "result_kind")))
    return out, jobs.where(~known)


# Articles of a batch that are named to every task (about 100 bytes each).
FEW_ARTICLES = 100_000
FOLDERS = r"(?s)media=(.*)/Year=(\d{1,9})/Month=(\d{1,9})/Day=(\d{1,9})/Hour=(\d{1,9})/"


def text_folder(prefix: Column) -> dict[str, Column]:
    """Folder columns of the text layout from a storage prefix (null: no such
    prefix); a media name may hold slashes."""
    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(prefix, FOLDERS, group), F.lit(""))

    return {"media": part(1), **{c: part(i).cast("int") for i, c in enumerate(("Year", "Month", "Day", "Hour"), 2)}}


def texts_of_jobs(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(article_id, text)`` of the articles that the jobs name, no others.

    With the stored layout's folder columns the jobs' prefixes say where a text is:
    the folders of the batch's articles are read (dynamic partition pruning), not
    the whole store.  The list of a batch's articles goes to every task only up
    to ``FEW_ARTICLES``, counted first; larger batches join by shuffle.
    """
    if "Year" not in texts.columns:
        return texts.select("article_id", "text").join(jobs.select("article_id").distinct(), "article_id", "left_semi")
    folder = text_folder(F.col("s3_prefix"))
    wanted = jobs.select("article_id", *[c.alias(n) for n, c in folder.items()]).where("Year is not null").distinct()
    if wanted.count() <= FEW_ARTICLES:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, [*folder, "article_id"]).select("article_id", "text")


def requests(dispatched: DataFrame, texts: DataFrame, use_large: bool = False) -> DataFrame:
    """Request rows for text jobs whose input exists.

    ``texts``: ``(article_id, text)`` — the stored article text — or the stored
    layout with its folder columns (``texts_of_jobs``).  Jobs whose article has no
    stored text get no request (they fail and are retried).
    """
    tj = dispatched.where(F.col("job_type").isin(*TEXT_JOBS))
    # many jobs of one article (retries, languages): AQE splits the left side
    j = tj.join(texts_of_jobs(tj, texts), "article_id", "left")
    src = F.when(F.col("input_source") == "title", F.col("title")).otherwise(F.col("text"))
    req = None
    for k in TEXT_JOBS:
        p = prompt(k, src, F.col("prompt_lang"), use_large)
        req = F.when(F.col("job_type") == k, p) if req is None else req.when(F.col("job_type") == k, p)
    return j.where(src.isNotNull()).select(
        "event_id", "article_id", "target_lang", "result_kind", "result_key", "post_clean",
        F.to_json(req).alias("request"))


def echo_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in model (no network): answers with the user turn."""
    def answer(req: str) -> str:
        user = json.loads(req)["messages"][1]["content"]
        return json.dumps({"choices": [{"message": {"content": user}}]}, ensure_ascii=False)

    return pd.DataFrame({"event_id": batch["event_id"], "status": 200,
                         "body": batch["request"].map(answer)})


ModelFn = Callable[[pd.DataFrame], pd.DataFrame]


def call_model(reqs: DataFrame, model_fn: ModelFn = echo_model) -> DataFrame:
    """Apply ``model_fn`` to request batches inside the executors' Python workers.

    ``model_fn`` sees ``(event_id, request)`` and returns ``(event_id, status,
    body)``; every other column of ``reqs`` is carried through the same batch,
    so answers never need a join back to their requests (the request pipeline
    runs once).
    """
    carry = [c for c in reqs.columns if c != "request"]
    fields = [f for f in reqs.schema.fields if f.name in carry]
    out_schema = T.StructType(fields + [T.StructField("status", T.IntegerType()),
                                        T.StructField("body", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ans = model_fn(b[["event_id", "request"]]).drop_duplicates("event_id").set_index("event_id")
            out = b[carry].copy()
            # a request the model function did not answer counts as a failed call
            out["status"] = ans["status"].reindex(b["event_id"]).fillna(0).to_numpy().astype("int32")
            body = ans["body"].reindex(b["event_id"])
            out["body"] = body.astype(object).where(body.notna(), None).to_numpy()
            yield out

    return reqs.mapInPandas(run, out_schema)


def completion_parse(status: Column, body: Column) -> Column:
    """Status 200 -> first choice's message content, whitespace-trimmed; else ''."""
    content = F.get_json_object(body, "$.choices[0].message.content")
    return F.when(status == 200, F.coalesce(text_trim(content), F.lit(""))).otherwise(F.lit(""))


def results(answered: DataFrame) -> DataFrame:
    """Artifact rows ``(event_id, article_id, lang, kind, key, body)``; title
    answers lose ``,.;``.  Empty answers are kept with body '' (failures)."""
    text = completion_parse(F.col("status"), F.col("body"))
    text = F.when(F.col("post_clean"), title_clean(text)).otherwise(text)
    return answered.select("event_id", "article_id", F.col("target_lang").alias("lang"),
                           F.col("result_kind").alias("kind"), F.col("result_key").alias("key"),
                           text.alias("body"))


def enrich_batch(jobs: DataFrame, texts: DataFrame, model_fn: ModelFn = echo_model,
                 use_large: bool = False, answers: AnswerStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(artifacts to put, failed jobs) for one batch of parsed jobs.

    Image jobs succeed without text (an ineligible link is done with no output);
    text jobs fail when the input is missing or the answer is empty.  The model
    is called once per request: with ``answers`` what it said is kept there, for
    this batch, for a repetition of it and for equal requests of later ones;
    without, it is checkpointed for this batch.
    """
    dispatched, _unknown = job_dispatch(jobs)
    reqs = requests(dispatched, texts, use_large)
    if answers is not None:
        reqs = reqs.withColumn("digest", digest(F.col("request")))
        answers.ask(reqs, lambda todo: call_model(todo, model_fn), completion_parse(F.col("status"), F.col("body")) != "")
        res = results(answers.answered(reqs))
        good = where_computed(res, F.col("body") != "")
        return good, failed_jobs(dispatched, good)
    # Answers are written once to the checkpoint folder: both outputs (and
    # every later action on them) read them back instead of calling the model
    # again, and a lost executor never triggers a second call for a stored
    # answer.
    answered = call_model(reqs, model_fn).checkpoint(eager=True)
    res = results(answered)
    good = where_computed(res, F.col("body") != "")
    failed = failed_jobs(dispatched, good)
    return good, failed


def unknown_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs of a type that nothing handles (``enrich_batch`` leaves them out)."""
    return job_dispatch(jobs)[1]


def failed_jobs(jobs: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Text jobs without a non-empty result stay queued for retry."""
    text_jobs = jobs.where(F.col("job_type").isin(*TEXT_JOBS))
    return text_jobs.join(succeeded.select("event_id"), "event_id", "left_anti")


def image_jobs_done(jobs: DataFrame) -> DataFrame:
    """Image jobs with their eligibility (ineligible = done, nothing written)."""
    return jobs.where(F.col("job_type") == "get_image").withColumn(
        "eligible", image_link_eligible(F.col("image_link")))
