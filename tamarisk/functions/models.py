"""Functions that stand in for remote models.

Each is deterministic and local, so results can be checked; the answer quality of a real model is not reproduced. A
model function takes columns and gives a column. Another can be put in its place by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk.functions.scalars import fill_template, is_filled

#: Words that decide a topic, in order of precedence, and what passes as impolite or asserted without proof.
TOPIC_WORDS = {"spam": ("casino", "lottery", "seo", "click here", "cheap"), "development": ("develop", "build", "system", "project"), "product": ("product", "price", "license", "plan")}
RUDE = r"(?i)\b(idiot|stupid|shut up|moron)\b"
MONEY = r"(?i)([$€¥£]\s?\d|\d[\d,.]*\s?(yen|usd|dollars|eur|euros))"
CERTAIN = r"(?i)\b(guarantee|definitely|absolutely|100%)"

REPLY = "Dear {name}{company},\nthank you for your inquiry about {topic}. We have received: {content}"
ANSWER = "Answer the question from the context.\nContext: {context}\nQuestion: {question}"
HYDE_SUFFIX = " The answer is as follows."


def judge_spam(inquiry: Column) -> Column:
    """{is_spam, reason}."""
    found = model("classify_topic")(inquiry)["topic"] == "spam"
    return F.struct(found.alias("is_spam"), F.when(found, "unsolicited offer").otherwise("inquiry").alias("reason"))


def classify_topic(content: Column) -> Column:
    """{topic, confidence in 0..1}: the first topic one of whose words occurs, else other."""
    low = F.lower(F.coalesce(content, F.lit("")))
    topic, sure = F.lit("other"), F.lit(0.5)
    for name, words in reversed(TOPIC_WORDS.items()):
        hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
        topic = F.when(hits > 0, name).otherwise(topic)
        sure = F.when(hits > 0, 0.7 + 0.3 * hits / len(words)).otherwise(sure)
    return F.struct(topic.alias("topic"), sure.alias("confidence"))


def generate_response(topic: Column, name: Column, company: Column, content: Column) -> Column:
    """{subject, body}; no company reads as none given."""
    body = fill_template(REPLY, name=F.coalesce(name, F.lit("")), company=F.when(is_filled(company), F.concat(F.lit(" of "), company)).otherwise(""), topic=topic, content=F.coalesce(content, F.lit("")))
    return F.struct(F.concat(F.lit("Re: "), topic).alias("subject"), body.alias("body"))


def check_quality(body: Column) -> Column:
    """{politeness OK or NG, politeness_reason}."""
    rude = F.coalesce(body, F.lit("")).rlike(RUDE)
    return F.struct(F.when(rude, "NG").otherwise("OK").alias("politeness"), F.when(rude, "rude word").otherwise("no rude word").alias("politeness_reason"))


def politeness_judge(response: Column) -> Column:
    """{score 1 or 0, comment}; a missing response has a null score."""
    good = model("check_quality")(response)
    return F.struct(F.when(response.isNotNull(), (good["politeness"] == "OK").cast("int")).alias("score"), F.when(response.isNotNull(), good["politeness_reason"]).alias("comment"))


def forbidden_content_judge(response: Column) -> Column:
    """{score, comment}: 0 where money figures or unproven assertions occur; a missing response has a null score."""
    why = F.when(response.rlike(MONEY), "money figure").when(response.rlike(CERTAIN), "unverified assertion").otherwise("clean")
    return F.struct(F.when(response.isNotNull(), (why == "clean").cast("int")).alias("score"), F.when(response.isNotNull(), why).alias("comment"))


def answer_hallucination(context_tokens: Column, answer_tokens: Column) -> Column:
    """1 if every word of the answer is in the context, else 0."""
    return (F.size(F.array_except(answer_tokens, context_tokens)) == 0).cast("int")


def expand_query(words: Column) -> Column:
    """Three searches: all words, their first half, their second half."""
    half = F.ceil(F.size(words) / 2).cast("int")
    return F.array(words, F.slice(words, F.lit(1), half), F.slice(words, half + 1, F.greatest(F.size(words) - half, F.lit(0))))


def hypothetical_answer(question: Column) -> Column:
    return F.concat(question, F.lit(HYDE_SUFFIX))


def select_route(question: Column) -> Column:
    """documents for questions with an English article, else web."""
    return F.when(F.concat(F.lit(" "), F.lower(question), F.lit(" ")).contains(" the "), "documents").otherwise("web")


def rerank_score(coverage: Column, bm25: Column) -> Column:
    """Relevance of a candidate: how many of the question's words it covers."""
    return coverage.cast("double")


def answer(context: Column, question: Column) -> Column:
    """The prompt that a model would be given."""
    return fill_template(ANSWER, context=context, question=question)


REGISTRY: dict[str, Callable[..., Column]] = {
    f.__name__: f for f in (judge_spam, classify_topic, generate_response, check_quality, politeness_judge, forbidden_content_judge, answer_hallucination, expand_query, hypothetical_answer, select_route, rerank_score, answer)
}


def use(name: str, function: Callable[..., Column]) -> None:
    """Put another function in the place of a default."""
    REGISTRY[name] = function


def model(name: str) -> Callable[..., Column]:
    if name not in REGISTRY:
        raise ValueError(f"no model function {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
