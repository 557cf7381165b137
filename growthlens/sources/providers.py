"""Answer-engine payloads of five providers to one shape (built-in JSON functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls

OPENAI = (
    "status string, output array<struct<type:string,content:array<struct<text:string,"
    "annotations:array<struct<type:string,url:string>>>>>>"
)
CHAT = (
    "choices array<struct<message:struct<content:string,annotations:array<struct<type:string,url_citation:struct<url:string>>>>>>,"
    " citations array<string>, search_results array<struct<url:string>>, error string"
)
GEMINI = (
    "promptFeedback struct<blockReason:string>, candidates array<struct<content:struct<parts:array<struct<text:string>>>,"
    "groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>>>"
)
ANTHROPIC = (
    "stop_reason string, content array<struct<type:string,text:string,citations:array<struct<url:string>>,"
    "content:array<struct<url:string>>>>"
)
EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(EMPTY)


def _list(c: Column, kind: str = EMPTY) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _clean(c: Column) -> Column:
    """Distinct non-empty texts in order of first appearance."""
    return F.array_distinct(F.filter(_list(c), lambda u: F.coalesce(u, F.lit("")) != ""))


def _joined(c: Column) -> Column:
    return F.array_join(F.filter(_list(c), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


def _url_of(c: Column) -> Column:
    """A citation given as text or as an object with a url."""
    return F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(c)


def _out(raw: DataFrame, keep: list[str], answer, cited, retrieved, usage: str, error) -> DataFrame:
    done = raw.select(
        *keep, answer.alias("answer"), cited.alias("cited_urls"), retrieved.alias("retrieved_urls"),
        F.get_json_object("value", f"$.{usage}").alias("usage"), error.alias("__e"),
    )
    empty = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "empty answer")
    return done.withColumn("error", F.coalesce("__e", empty)).drop("__e")


def read_openai(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = raw.withColumn("p", F.from_json("value", OPENAI))
    parts = F.flatten(F.transform(F.filter("p.output", lambda o: o["type"] == "message"), lambda o: o["content"]))
    notes = F.flatten(F.transform(F.filter(parts, lambda x: x["annotations"].isNotNull()), lambda x: x["annotations"]))
    cited = F.transform(F.filter(notes, lambda n: n["type"] == "url_citation"), lambda n: n["url"])
    status = F.col("p.status")
    error = F.when(status.isNotNull() & (status != "completed"), F.concat(F.lit("openai status "), status))
    return _out(p, keep, _joined(F.transform(parts, lambda x: x["text"])), _clean(cited), _empty(), "usage", error)


def read_perplexity(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = raw.withColumn("p", F.from_json("value", CHAT))
    first = F.try_element_at("p.choices", F.lit(1))
    cited = F.transform("p.citations", _url_of)
    found = F.transform("p.search_results", lambda r: r["url"])
    answer = F.coalesce(first["message"]["content"], F.lit(""))
    return _out(p, keep, answer, _clean(cited), _clean(found), "usage", F.lit(None).cast("string"))


def grounded_url(uri: Column, title: Column) -> Column:
    """A grounding proxy hides the host; a title that looks like a host replaces it."""
    u, t = F.trim(F.coalesce(uri, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    proxy = (urls.url_host(u) == fixed.PROXY_HOST) | F.contains(u, F.lit(fixed.PROXY_MARK))
    named = F.contains(t, F.lit(".")) & ~F.contains(t, F.lit(" "))
    full = F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.nullif(F.when(proxy & named, full).otherwise(u), F.lit(""))


def read_gemini(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = raw.withColumn("p", F.from_json("value", GEMINI))
    first = F.try_element_at("p.candidates", F.lit(1))
    chunks = F.filter(first["groundingMetadata"]["groundingChunks"], lambda c: c["web"].isNotNull())
    cited = F.transform(chunks, lambda c: grounded_url(c["web"]["uri"], c["web"]["title"]))
    blocked = F.col("p.promptFeedback.blockReason")
    error = F.when(blocked.isNotNull(), F.concat(F.lit("gemini blockReason "), blocked)).when(
        F.size(F.coalesce("p.candidates", F.from_json(F.lit("[]"), "array<struct<content:struct<parts:array<struct<text:string>>>,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>>>"))) == 0,
        "gemini no candidates",
    )
    answer = _joined(F.transform(first["content"]["parts"], lambda x: x["text"]))
    return _out(p, keep, answer, _clean(cited), _empty(), "usageMetadata", error)


def read_anthropic(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = raw.withColumn("p", F.from_json("value", ANTHROPIC))
    said = F.filter("p.content", lambda b: b["type"] == "text")
    tools = F.filter("p.content", lambda b: (b["type"] == "web_search_tool_result") & b["content"].isNotNull())
    cites = F.flatten(F.transform(F.filter(said, lambda b: b["citations"].isNotNull()), lambda b: b["citations"]))
    found = F.flatten(F.transform(tools, lambda b: b["content"]))
    stop = F.col("p.stop_reason")
    error = F.when(stop.isin("pause_turn", "max_tokens"), F.concat(F.lit("anthropic stop_reason "), stop))
    return _out(
        p, keep, _joined(F.transform(said, lambda b: b["text"])), _clean(F.transform(cites, lambda c: c["url"])),
        _clean(F.transform(found, lambda c: c["url"])), "usage", error,
    )


def read_openrouter(raw: DataFrame, keep: list[str]) -> DataFrame:
    p = raw.withColumn("p", F.from_json("value", CHAT))
    m = F.try_element_at("p.choices", F.lit(1))["message"]
    notes = F.filter(m["annotations"], lambda n: n["type"] == "url_citation")
    cited = F.concat(
        _list(F.transform(notes, lambda n: n["url_citation"]["url"])), _list(F.transform("p.citations", _url_of))
    )
    body = m["content"]
    parts = F.transform(F.from_json(body, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x))
    answer = F.coalesce(F.when(body.startswith("["), _joined(parts)), body, F.lit(""))
    raised = F.col("p.error")
    label = F.coalesce(F.get_json_object(raised, "$.code"), F.get_json_object(raised, "$.message"), raised)
    no_choice = F.coalesce(F.size("p.choices"), F.lit(0)) <= 0
    error = F.when(F.coalesce(raised, F.lit("")) != "", label).when(no_choice, "openrouter no choices")
    return _out(p, keep, answer, _clean(cited), _empty(), "usage", error)


READERS = {
    "openai": read_openai,
    "perplexity": read_perplexity,
    "gemini": read_gemini,
    "anthropic": read_anthropic,
    "openrouter": read_openrouter,
}


def read_ai_payloads(raw: DataFrame, keep: list[str]) -> DataFrame:
    """``engine, value`` (raw JSON) of any mix of providers to the common answer columns."""
    out = None
    for engine, reader in READERS.items():
        part = reader(raw.filter(F.split_part("engine", F.lit(":"), F.lit(1)) == engine), keep)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("cost_usd", F.get_json_object("usage", "$.cost").try_cast("decimal(18,8)"))
