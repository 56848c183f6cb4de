"""Scores and classes of rows as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider(model: Column, prefixes: dict[str, str], otherwise: str) -> Column:
    """The provider by the model's prefix, whatever its case."""
    out = None
    for prefix, name in prefixes.items():
        out = (F if out is None else out).when(model.ilike(f"{prefix}%"), name)
    return out.otherwise(otherwise)


# Prefixes of models' names by provider.
PROVIDERS_3 = {"deepseek:": "DeepSeek", "gemini:": "Gemini"}
PROVIDERS_4 = {"deepseek:": "DeepSeek", "gemini:": "Gemini", "gpt": "OpenAI", "o1": "OpenAI"}


def error_class(message: Column) -> Column:
    """The kind of a failure by its message; a message of no known kind stands for itself, cut at 50 characters."""
    m = F.lower(message)
    return (
        F.when(message.isNull() | (message == ""), "Unknown").when(m.contains("timeout"), "Timeout").when(m.contains("403") | m.contains("forbidden"), "Blocked (403)")
        .when(m.contains("404") | m.contains("not found"), "Not Found (404)").when(m.contains("connection"), "Connection Error").when(m.contains("both methods"), "Content Extraction Failed").otherwise(F.substring(message, 1, 50))
    )


def impact(value: Column) -> Column:
    """Impact class; elevated means negative and standard neutral in older rows, anything unknown is neutral."""
    return F.when(value.isin("elevated", "elevated_risk"), "negative").when(value.isin("positive", "negative", "neutral"), value).otherwise("neutral")


def impact_rank(value: Column) -> Column:
    """Negative before neutral before positive; a missing class is neutral, an unknown one comes last."""
    known = F.when(value.isNull() | (value == "standard"), "neutral").when(value.isin("elevated", "elevated_risk"), "negative").otherwise(value)
    return F.when(known == "negative", 0).when(known == "neutral", 1).otherwise(2)


def fallback_impact(topic: Column, confidence: Column, negative: list[str], least: float = 0.85) -> Column:
    """The class of a row that has none: negative for a sure row of one of these topics."""
    return F.when(topic.isin(*negative) & (F.coalesce(confidence, F.lit(0.0)) >= least), "negative").otherwise("neutral")


def quality(length: Column, has_author: Column, has_date: Column) -> Column:
    """0 to 1: a curve over the length, and three tenths each for author and date. The curve's constants are fixed values."""
    n = length.cast("double")
    curve = F.when(n < 500, n / 500 * 0.4).when(n < 1500, 0.2 + (n - 500) / 1000 * 0.2).when(n <= 5000, 0.4).otherwise(F.greatest(F.lit(0.2), 0.4 - (n - 5000) / 20000 * 0.2))
    return F.least(F.lit(1.0), curve + F.when(has_author, 0.3).otherwise(0.0) + F.when(has_date, 0.3).otherwise(0.0))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, cached_tokens: Column | None = None, cached_price: Column | None = None) -> Column:
    """Cost at prices per million tokens; cached input tokens have their own price."""
    cached = F.coalesce(cached_tokens, F.lit(0)) if cached_tokens is not None else F.lit(0)
    price = cached_price if cached_price is not None else input_price
    return F.round(((input_tokens - cached) * input_price + cached * price + output_tokens * output_price) / 1e6, 8)


def relevance_keywords(topics: Column, companies: Column) -> Column:
    """Two topics and one company, three at most."""
    none = F.array().cast("array<string>")
    return F.slice(F.concat(F.slice(F.coalesce(topics, none), 1, 2), F.slice(F.coalesce(companies, none), 1, 1)), 1, 3)
