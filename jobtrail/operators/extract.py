"""Posting extraction: keyword tags (X1), fallback posting (X2), reply shapes (X3),
candidate normalization (X4), routing + explode (X5), request table (P14), J5.

Everything is per-row column algebra over ``VariantType`` and arrays: no shuffle
except the J5 join of pages with their replies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.keywords import MAX_TAGS, display_form, tag_text
from jobtrail.functions.text import capitalize_words, collapse_ws, cut, first_items, let, trim_js
from jobtrail.operators.cuts import Cuts

MAX_CANDIDATES = 20
MAX_STACK = 20
FALLBACK_SUMMARY_CHARS = 550

# Defaults of the rule-based extraction.
UNKNOWN_ROLE = "Unknown Role"
UNKNOWN_COMPANY = "Unknown Company"
NO_SUMMARY = "No requirement summary available."

# Fixed value: the instruction sent with every extraction request, line by line.
SYSTEM_PROMPT = "\n".join([
    "Extract job postings from the provided page text.",
    "Return STRICT JSON only. No markdown or commentary.",
    "JSON shape:",
    "{",
    '  "jobs": [',
    "    {",
    '      "job_title": "string",',
    '      "company_name": "string",',
    '      "salary": "string or null",',
    '      "tech_stack": ["string"],',
    '      "requirements_summary": "string",',
    '      "job_url": "string"',
    "    }",
    "  ]",
    "}",
    "If salary is unknown, return null. If there are multiple jobs, include all of them.",
])

POSTING_FIELDS = ["job_title", "company_name", "salary", "tech_stack", "requirements_summary", "job_url"]


def _c(col):
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- X1
def tag_keywords(df: DataFrame, text_col: str = "text", out_col: str = "tech", keywords=None, limit: int | None = MAX_TAGS) -> DataFrame:
    """Keywords found in ``text_col`` (case-insensitive substring), list order, first ``limit`` (None: all).

    One test for each keyword; for lists of hundreds of words or more see ``tag_many``.
    """
    return (df.withColumn("_lower_text", F.lower(F.col(text_col)))
              .withColumn(out_col, tag_text(F.col("_lower_text"), keywords, limit))
              .drop("_lower_text"))


def tag_many(df: DataFrame, keywords: list[str], text_col: str = "text", out_col: str = "tech", limit: int | None = MAX_TAGS) -> DataFrame:
    """``tag_keywords`` for large lists: an Aho-Corasick automaton reads each text once, however many words there are.

    The list goes to the tasks with the function (its size is the caller's; 20,000 words take a few MB), the automaton
    is built once for each task. Equal words of different case are one hit each, in list order. A null text has null tags.
    """
    words = [k.lower() for k in keywords]
    shown = [display_form(k) for k in keywords]

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        always = places.pop("", [])  # every text contains the empty word
        for w, at in places.items():
            tree.add_word(w, at)
        tree.make_automaton()

        def one(text):
            hits = set(always)
            if places:
                for _, at in tree.iter(text):
                    hits.update(at)
            return [shown[i] for i in sorted(hits)[:limit]]

        for batch in texts:
            yield batch.map(one, na_action="ignore")

    return df.withColumn(out_col, found(F.lower(F.col(text_col))))


# ---------------------------------------------------------------- X2
def fallback_summary(text: Column, chars: int | None = FALLBACK_SUMMARY_CHARS) -> Column:
    t = collapse_ws(text)
    return F.when(t == "", F.lit(NO_SUMMARY)).otherwise(cut(t, chars))


def fallback_title(text: Column) -> Column:
    """First line of 5..119 characters, else "Unknown Role"."""
    lines = F.transform(F.split(text, r"[\r\n]+"), lambda l: trim_js(l))
    ok = F.filter(lines, lambda l: (F.length(l) > 4) & (F.length(l) < 120))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(UNKNOWN_ROLE))


# host of an absolute URL: after the scheme, slashes and userinfo, up to port or path
_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/\\?#@]*@)?(\[[^\]]*\]|[^/\\?#:]*)"


def company_guess(source_url: Column) -> Column:
    """First label of the host without a leading ``www.``, words capitalized."""
    host = F.regexp_replace(F.lower(F.regexp_extract(trim_js(source_url), _HOST_RE, 1)), r"^www\.", "")
    label = F.substring_index(host, ".", 1)
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit(UNKNOWN_COMPANY)).otherwise(capitalize_words(label))


def fallback_struct(text: Column, source_url: Column, tech: Column, chars: int | None = FALLBACK_SUMMARY_CHARS) -> Column:
    return F.struct(
        fallback_title(text).alias("job_title"),
        company_guess(source_url).alias("company_name"),
        F.lit(None).cast("string").alias("salary"),
        tech.alias("tech_stack"),
        fallback_summary(text, chars).alias("requirements_summary"),
        source_url.alias("job_url"),
    )


def fallback_postings(pages: DataFrame, text_col: str = "page_text", url_col: str = "source_url", max_tags: int | None = MAX_TAGS,
                      chars: int | None = FALLBACK_SUMMARY_CHARS) -> DataFrame:
    """One rule-based posting per page."""
    t = tag_keywords(pages, text_col, "_tech", limit=max_tags)
    return t.withColumn("posting", fallback_struct(F.col(text_col), F.col(url_col), F.col("_tech"), chars)) \
            .drop("_tech").select("*", "posting.*").drop("posting")


# ---------------------------------------------------------------- X3
def strict_json(raw: Column) -> Column:
    """The JSON value that ``raw`` holds and nothing besides, else NULL.

    The parser stops behind the first value. Only a single value is both the one element of
    an array put around it and the one field of an object put around it. The text is parsed twice, whatever is
    made of the value.
    """
    text = F.when(trim_js(raw) != "", raw)
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    field = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$", "map<string,variant>")
    return let(items, lambda i: F.when((F.size(i) == 1) & (F.size(field) == 1), F.get(i, F.lit(0))))


def may_repeat_keys(raw: Column) -> Column:
    """Whether a key stands twice in a reply, in one object or in several (escaped characters count as a repeat)."""
    keys = F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*+)"\s*+:'), F.lit(1))
    return raw.contains("\\u") | let(keys, lambda k: F.size(k) > F.size(F.array_distinct(k)))


def last_keys(raw: str | None) -> str | None:
    """The same JSON with the last one of equal keys in each object; None for what is no JSON."""

    def constant(name):
        raise ValueError(name)

    try:
        return None if raw is None else json.dumps(json.loads(raw, parse_constant=constant), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def with_last_keys(replies: DataFrame, raw_col: str = "raw_content", out_col: str = "raw_content") -> DataFrame:
    """Replies whose objects hold every key once: the last value of a repeated key counts.

    Spark's parser refuses repeated keys, so replies in which a key stands twice are written anew; all others pass as
    they are (what the helper cannot read stays, too, and is refused by the parser).
    """

    @F.pandas_udf("string")
    def rewritten(raw: pd.Series) -> pd.Series:
        return raw.map(last_keys, na_action="ignore")

    suspect = F.when(may_repeat_keys(F.col(raw_col)), F.col(raw_col))
    return replies.withColumn("_once", rewritten(suspect)).withColumn(out_col, F.coalesce("_once", raw_col)).drop("_once")


def candidate_list(raw: Column) -> Column:
    """The candidate list of a reply by its shape, see ``reply_candidates``."""

    def pick(v):
        return let(F.schema_of_variant(v), lambda kind: let(F.try_variant_get(v, "$.jobs", "array<variant>"), lambda jobs: (
            F.when(v.isNull() | ~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.lit(None).cast("array<variant>"))
             .when(kind.startswith("OBJECT") & jobs.isNotNull(), jobs).otherwise(F.array(v)))))

    return let(strict_json(raw), pick)


def reply_candidates(replies: DataFrame, raw_col: str = "raw_content", out_col: str = "candidates") -> DataFrame:
    """Parse a reply and pick its candidate list by shape; NULL means "use the fallback".

    object with array ``jobs`` -> its elements; other object or array -> itself as
    the single candidate; null, scalar, blank, invalid JSON -> NULL. Text behind the
    value makes the JSON invalid. Of equal keys in one object the last counts.
    """
    return with_last_keys(replies, raw_col, "_reply").withColumn(out_col, candidate_list(F.col("_reply"))).drop("_reply")


# ---------------------------------------------------------------- X4
def _string_field(e: Column, name: str) -> Column:
    """Collapsed text of a JSON string field; '' when missing or not a string."""
    f = F.try_variant_get(e, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(f) == "STRING", collapse_ws(F.try_variant_get(f, "$", "string"))).otherwise(F.lit(""))


def normalize_candidate(e: Column, source_url: Column, fb_tech: Column | None, fb_summary: Column | None,
                        max_stack: int | None = MAX_STACK) -> Column:
    """One candidate -> struct(valid, fields). With ``fb_tech``/``fb_summary`` None the page
    fallbacks are not applied here (the caller applies them outside the lambda)."""
    title = _string_field(e, "job_title")
    company = _string_field(e, "company_name")
    salary = _string_field(e, "salary")
    summary = _string_field(e, "requirements_summary")
    url = _string_field(e, "job_url")
    raw_stack = F.coalesce(F.try_variant_get(e, "$.tech_stack", "array<variant>"), F.array().cast("array<variant>"))
    items = F.transform(raw_stack, lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                     collapse_ws(F.try_variant_get(x, "$", "string"))).otherwise(F.lit("")))
    stack = first_items(F.filter(items, lambda x: x != ""), max_stack)
    valid = F.schema_of_variant(e).startswith("OBJECT") & (title != "") & (company != "")
    return F.struct(
        valid.alias("valid"),
        title.alias("job_title"),
        company.alias("company_name"),
        F.nullif(salary, F.lit("")).alias("salary"),
        (stack if fb_tech is None else F.when(F.size(stack) > 0, stack).otherwise(fb_tech)).alias("tech_stack"),
        (summary if fb_summary is None else F.when(summary != "", summary).otherwise(fb_summary)).alias("requirements_summary"),
        F.when(url != "", url).otherwise(source_url).alias("job_url"),
    )


POSTINGS_TYPE = ("array<struct<job_title:string,company_name:string,salary:string,tech_stack:array<string>,"
                 "requirements_summary:string,job_url:string>>")


def valid_postings(cands: Column, source_url: Column, fb_tech: Column | None = None,
                   fb_summary: Column | None = None, max_candidates: int | None = MAX_CANDIDATES,
                   max_stack: int | None = MAX_STACK) -> Column:
    """Normalize every candidate, drop the invalid ones, then keep the first 20 (in that order; None: all)."""
    norm = F.transform(cands, lambda e: normalize_candidate(e, source_url, fb_tech, fb_summary, max_stack))
    kept = first_items(F.filter(norm, lambda p: p["valid"]), max_candidates)
    return F.transform(kept, lambda p: F.struct(*[p[f].alias(f) for f in POSTING_FIELDS]))


def normalize_candidates(df: DataFrame, cand_col: str = "candidates", text_col: str = "page_text",
                         url_col: str = "source_url", out_col: str = "valid_postings", cuts: Cuts = Cuts()) -> DataFrame:
    """The valid postings of every page as one array (one row per page, no shuffle)."""
    d = tag_keywords(df, text_col, "_fb_tech", limit=cuts.tags).withColumn("_fb_summary", fallback_summary(F.col(text_col), cuts.fallback))
    kept = valid_postings(F.col(cand_col), F.col(url_col), F.col("_fb_tech"), F.col("_fb_summary"), cuts.postings, cuts.stack)
    return d.withColumn(out_col, F.coalesce(kept, F.array().cast(POSTINGS_TYPE))).drop("_fb_tech", "_fb_summary")


# ---------------------------------------------------------------- J5 + X5
def pages_with_replies(pages: DataFrame, replies: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Every page with the latest reply to its snapshot; a page without one gets a NULL reply (-> fallback).

    The latest is an aggregate combined map-side (ties by the text), so repeated deliveries neither
    multiply postings nor pile up on one page's task.
    """
    latest = replies.groupBy(key).agg(F.max_by("raw_content", F.struct("replied_at", "raw_content")).alias("raw_content"))
    return pages.join(latest, key, "left")


def extract_postings(pages: DataFrame, replies: DataFrame | None = None, text_col: str = "page_text",
                     url_col: str = "source_url", key: str = "snapshot_id", cuts: Cuts = Cuts(), keep_text: bool = True) -> DataFrame:
    """Postings of every page, one row each, with ``pos`` = list order within the page.

    Valid candidates of the reply if any, else the single fallback posting.
    ``replies=None`` means no model is configured: every page takes the fallback. What the fallback takes
    from the text is drawn up before the pages meet their replies, so without ``keep_text`` the text is in no shuffle
    and in no row that comes out.
    """
    # page-level fallbacks are computed once per page, before the explode
    d = tag_keywords(pages, text_col, "_fb_tech", limit=cuts.tags).withColumn("_fb_summary", fallback_summary(F.col(text_col), cuts.fallback))
    d = d.withColumn("_fb", fallback_struct(F.col(text_col), F.col(url_col), F.col("_fb_tech"), cuts.fallback))
    d = d if keep_text else d.drop(text_col)
    if replies is None:
        d = d.withColumn("candidates", F.lit(None).cast("array<variant>"))
    else:
        d = reply_candidates(pages_with_replies(d, replies, key))
    # fallbacks are applied after the explode
    valid = valid_postings(F.col("candidates"), F.col(url_col), max_candidates=cuts.postings, max_stack=cuts.stack)
    chosen = let(valid, lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(F.col("_fb"))))
    drop = [c for c in ("candidates", "raw_content", "_fb") if c in d.columns]
    e = d.select("*", F.posexplode(chosen).alias("pos", "posting")).drop(*drop).select("*", "posting.*").drop("posting")
    e = e.withColumns({
        "tech_stack": F.when(F.size("tech_stack") > 0, F.col("tech_stack")).otherwise(F.col("_fb_tech")),
        "requirements_summary": F.when(F.col("requirements_summary") != "", F.col("requirements_summary"))
                                 .otherwise(F.col("_fb_summary")),
    })
    return e.drop("_fb_tech", "_fb_summary")


# ---------------------------------------------------------------- P14
def extraction_requests(pages: DataFrame, model: str, text_col: str = "page_text", url_col: str = "source_url",
                        key: str = "tracked_url_id") -> DataFrame:
    """One chat request per page, as a batch-inference input table (the call itself is not made here)."""
    return pages.select(
        key,
        F.lit(model).alias("model"),
        F.lit(0).alias("temperature"),
        F.lit("json_object").alias("response_format"),
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        F.concat(F.lit("Source URL: "), F.col(url_col), F.lit("\n\nPage text:\n"), F.col(text_col)).alias("user_message"),
    )
