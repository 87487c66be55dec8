"""What messages ask for: institutions named, categories, intents and the route of a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules
from ..functions.text import matches, word_pattern


def detect_entities(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Ids named in a text, by whole-word aliases, from left to right and once each; the longest alias wins at a place."""
    of = {a.lower(): key for key, names in aliases.items() for a in names}
    ordered = sorted(of, key=lambda a: (-len(a), a))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word_pattern(ordered)), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.array_distinct(F.transform(found, lambda a: names[a]))


def focus_entities(text: Column, aliases: dict[str, list[str]], words: str = rules.FOCUS_WORDS) -> Column:
    """The named ids, where at least two are named in a comparison or an enumeration; else none."""
    ids = detect_entities(text, aliases)
    return F.when((F.size(ids) >= 2) & (matches(text, words) | text.contains(",")), ids).otherwise(F.array().cast("array<string>"))


def category_hints(text: Column, words: dict[str, list[str]] = rules.CATEGORY_WORDS) -> Column:
    low = F.lower(text)
    hit = lambda needles: F.exists(F.lit(list(needles)), lambda n: low.contains(n))
    return F.array_compact(F.array(*[F.when(hit(n), F.lit(c)) for c, n in words.items()]))


def _any(text: Column, patterns: list[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


#: What the flags of a message look for: patterns of a ``why`` over lower case, phrases of a ``chart``, else one pattern.
INTENT_WORDS = {
    "why": rules.EXPLANATION_PATTERNS, "rerank": rules.RERANK_WORDS, "followup": rules.FOLLOWUP_WORDS, "question": rules.QUESTION_WORDS,
    "sign": rules.QUESTION_INDICATOR, "chart": rules.CHART_PHRASES, "focus": rules.FOCUS_WORDS,
}


def message_intents(text: Column, aliases: dict[str, list[str]], words: dict = INTENT_WORDS) -> dict[str, Column]:
    """Flags of a message: why a ranking, a new ranking wanted, a follow-up, a question, its signs, a chart explained."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    why = _any(low, words["why"])
    again, follow = matches(t, words["rerank"]), matches(t, words["followup"])
    chart = F.exists(F.lit(list(words["chart"])), lambda p: low.contains(p))
    focused = F.size(focus_entities(t, aliases, words["focus"])) > 0
    return {
        "asks_why_ranked": why,
        "asks_rerank": again,
        "is_followup": ~focused & ~(again & ~follow) & (follow | why),
        "is_question": (t != "") & ~chart & (t.contains("?") | matches(t, words["question"])),
        "has_question_sign": matches(t, words["sign"]),
        "asks_about_chart": chart,
    }


def resolve_entity(messages: DataFrame, aliases: dict[str, list[str]], lock: str | None = None) -> DataFrame:
    """The institution a user's message is about: a lock, else the first named, else the first of the last reply before."""
    reply = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    named = lambda c: F.get(detect_entities(c, aliases), F.lit(0))
    about = F.coalesce(F.lit(lock if lock != "all" else None).cast("string"), named(F.col("text")), named(F.col("reply")))
    return messages.withColumn("reply", reply).where("role = 'user'").select("conv_id", "turn", about.alias("entity"))


def route_turn(text: Column, aliases: dict[str, list[str]], has_ranking: Column, locked: Column, words: dict = INTENT_WORDS) -> Column:
    """Where a message goes: ``refine`` the ranking, ``answer_question`` or ``keep`` building the profile."""
    i = message_intents(text, aliases, words)
    focused = F.size(focus_entities(text, aliases, words["focus"])) > 0
    return (
        F.when(has_ranking & (focused | (i["asks_rerank"] & ~i["is_followup"])), "refine")
        .when(i["asks_about_chart"] | (has_ranking & (i["is_followup"] | i["is_question"])) | (locked & i["is_question"]), "answer_question")
        .otherwise("keep")
    )


def last_message_by_role(messages: DataFrame) -> DataFrame:
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return messages.groupBy("conv_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"))
