"""String cleaning, predicates and extraction as columns. Word lists are parameters; the defaults are the usual ones."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def matches(text: Column, pattern: str) -> Column:
    """``rlike`` with word borders, spaces and digits of all alphabets, whatever the Java release."""
    return text.rlike("(?U)" + pattern)


def clean_text(text: Column) -> Column:
    """Runs of white space, no-break spaces, line separators and byte-order marks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\u2028\u2029\ufeff\u00a0", "    "), r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(needle)))) / len(needle)


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def _garbled(text: Column) -> Column:
    control = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return (control > F.length(text) * 0.05) | (count_of(text, "\ufffd") > F.length(text) * 0.02)


def is_noise_page_text(text: Column, phrases: Sequence[str] = rules.PAGE_NOISE, repeated: Sequence[str] = rules.NAVIGATION_WORDS) -> Column:
    """Boilerplate of pages: a phrase, two navigation words in over 50 characters, few letters, or garbled characters."""
    low = F.lower(text)
    times = F.lit(0)
    for word in repeated:
        times = times + count_of(low, word)
    return _any([low.contains(p) for p in phrases]) | ((times >= 2) & (F.length(text) > 50)) | (_letters(text) < F.greatest(F.lit(10), F.length(text) * 0.4)) | _garbled(text)


def is_noise_record_text(text: Column, phrases: Sequence[str] = rules.RECORD_NOISE) -> Column:
    """Boilerplate of record fields: short, a phrase, few letters, or garbled."""
    return (F.length(text) < 20) | _any([F.lower(text).contains(p) for p in phrases]) | (_letters(text) < F.length(text) * 0.4) | _garbled(text)


def is_noise_fee_label(text: Column, phrases: Sequence[str] = rules.PAGE_NOISE) -> Column:
    return _any([F.lower(text).contains(p) for p in phrases]) | (count_of(text, "\ufffd") > F.length(text) * 0.02)


def split_snippets(text: Column, **noise) -> Column:
    """Sentences of a page without boilerplate."""
    return F.filter(F.split(clean_text(text), r"(?<=[.!?])\s+"), lambda s: (s != "") & ~is_noise_page_text(s, **noise))


def split_sentences(text: Column) -> Column:
    """Sentences; the space that markup lost behind a full stop is put back first."""
    spaced = F.regexp_replace(collapse(text), r"(?<=[.!?])(?=[A-Z])", " ")
    return F.filter(F.transform(F.split(spaced, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def word_pattern(words: Sequence[str], plural: bool = False) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(w.lower()).replace(r"\ ", " ").replace(r"\-", "-") for w in words) + ")" + ("s?" if plural else "") + r"\b"


def keyword_snippets(text: Column, words: Sequence[str], most: int = 5, **noise) -> Column:
    """The first snippets that hold a word of the list, or its plural, as a whole word."""
    return F.slice(F.filter(split_snippets(text, **noise), lambda s: F.lower(s).rlike(word_pattern(words, plural=True))), 1, most)


def numeric_range(text: Column) -> Column:
    """struct(amount_min, amount_max, currency, raw_text) of the whole numbers in a text; null if there is none."""
    bare = text
    for mark in ("₹", "Rs", "PKR", "Rs."):
        bare = F.replace(bare, F.lit(mark))
    numbers = F.filter(F.transform(F.regexp_extract_all(bare, F.lit(r"\d{1,3}[,\d]*"), F.lit(0)), lambda n: F.try_to_number(F.replace(n, F.lit(",")), F.lit("9" * 38))), lambda n: n.isNotNull())
    made = F.struct(F.array_min(numbers).alias("amount_min"), F.array_max(numbers).alias("amount_max"), F.lit("PKR").alias("currency"), bare.alias("raw_text"))
    return F.when(F.size(numbers) > 0, made)


def max_percentage(items: Column, patterns: Sequence[str] = rules.PERCENT_PATTERNS) -> Column:
    """The strictest percentage that the joined items ask for, above 0 and up to 100."""
    text = F.array_join(items, " ")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: (x > 0) & (x <= 100)))


def named_tests(items: Column, tests: Sequence[str] = rules.ENTRY_TESTS) -> Column:
    """Names of the list that occur as whole words, in the list's order; null if none does."""
    text = F.array_join(items, " ")
    found = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + word_pattern([t])), F.lit(t)) for t in tests]))
    return F.when(F.size(found) > 0, F.array_join(found, ", "))


def normalize_string_list(items: Column, phrases: Sequence[str] = rules.RECORD_NOISE) -> Column:
    """Cleaned items without boilerplate, each once, in order."""
    return F.array_distinct(F.filter(F.transform(items, collapse), lambda s: (s != "") & ~is_noise_record_text(s, phrases)))


def normalize_program_list(items: Column) -> Column:
    """Cleaned items, each once; short titles are kept."""
    return F.array_distinct(F.filter(F.transform(items, collapse), lambda s: s != ""))


def filter_marked_items(items: Column, markers: Sequence[str] = rules.HOUSING_NOISE) -> Column:
    return F.filter(items, lambda s: ~_any([F.lower(s).contains(m) for m in markers]))


def tri_state_evidence(items: Column, positive: str = rules.HOUSING_POSITIVE, negative: str = rules.HOUSING_NEGATIVE) -> Column:
    """Null without items; a positive statement outweighs a negative one; other mentions count as true."""
    text = F.array_join(items, " ")
    return F.when(items.isNull() | (F.size(items) == 0), F.lit(None).cast("boolean")).when(text.rlike(positive), True).when(text.rlike(negative), False).otherwise(True)


def entity_slug(name: Column) -> Column:
    """Lower case; runs of spaces, hyphens and slashes become an underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s\-/]+", "_"), "^_+|_+$", "")


def degree_levels(text: Column, levels: Sequence[tuple[str, str]] = rules.DEGREE_LEVELS) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(matches(text, p), F.lit(label)) for label, p in levels])), ",")


def sanitize_int(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def title_id(text: Column) -> Column:
    """A readable name of an id."""
    return F.initcap(F.replace(text.cast("string"), F.lit("_"), F.lit(" ")))


def natural_join(items: Column) -> Column:
    """``A``, ``A and B``, ``A, B, and C``; empty items are left out."""
    given = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    n = F.size(given)
    many = F.concat(F.array_join(F.slice(given, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(given, F.lit(-1)))
    return F.when(n <= 1, F.array_join(given, "")).when(n == 2, F.array_join(given, " and ")).otherwise(many)


def fee_label(amount: Column, period: Column) -> Column:
    """``12,000 PKR per semester``; null for a missing or zero amount."""
    unit = F.trim(F.replace(F.coalesce(period, F.lit("")), F.lit("_"), F.lit(" ")))
    pretty = F.concat(F.format_number(amount.cast("bigint"), 0), F.lit(" PKR"))
    return F.when(amount.isNotNull() & (amount != 0), F.trim(F.concat_ws(" ", pretty, unit)))


def normalize_role(role: Column) -> Column:
    low = F.lower(F.trim(role))
    return F.when(low.isin("human", "user"), "user").when(low.isin("ai", "assistant"), "assistant").otherwise(low)


def title_from_message(message: Column, most: int = 72, default: str = "New Chat") -> Column:
    """A short title: boilerplate prefixes dropped, white space collapsed, cut with an ellipsis."""
    text = collapse(F.coalesce(message, F.lit("")))
    profile = F.lower(text).startswith(rules.TITLE_PROFILE_PREFIX)
    after = F.regexp_replace(text, rules.TITLE_PROFILE_MARKER, "")
    dropped = F.regexp_replace(text, rules.TITLE_PROFILE_SENTENCE, "")
    text = F.when(profile, F.when(text.rlike(rules.TITLE_PROFILE_MARKER), after).otherwise(dropped)).otherwise(text)
    for pattern in rules.TITLE_PREFIXES:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(collapse(text), r"^[ .]+|[ .]+$", "")
    short = F.concat(F.regexp_replace(F.substring(text, 1, most - 1), "[ ,;:]+$", ""), F.lit("…"))
    return F.when(text == "", default).when(F.length(text) <= most, text).otherwise(short)


def program_to_field(raw: Column) -> Column:
    """A clean field-of-study label of a noisy programme string; null where it is none."""
    strip = lambda c, chars: F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")
    text = F.replace(collapse(F.coalesce(raw, F.lit(""))), F.lit("Gamming"), F.lit("Gaming"))
    bad = (text == "") | (F.length(text) > 90) | text.rlike(rules.FIELD_JUNK)
    inner = F.regexp_extract(text, r"\(([^)]{3,55})\)\s*$", 1)
    bare = strip(F.regexp_replace(text, rules.FIELD_DEGREE, ""), r" \-–—:()")
    label = F.when(inner != "", F.trim(inner)).otherwise(F.trim(F.regexp_replace(bare, r"(?i)^of\s+", "")))
    label = strip(collapse(label), r" \-.")
    bad = bad | (F.length(label) < 3) | (F.length(label) > 48)
    label = F.when(label.rlike("(?i)^in .* "), F.trim(F.substring(label, 4, 100))).otherwise(label)
    bad = bad | F.lower(label).rlike("^(programme|program |m\\.engg|mem programme)") | label.rlike(r"[()]|[+*.]$")
    words = F.split(label, " ")
    half = (F.size(words) / 2).cast("int")
    doubled = (F.size(words) >= 4) & (F.size(words) % 2 == 0) & (F.lower(F.array_join(F.slice(words, 1, half), " ")) == F.lower(F.array_join(F.slice(words, half + 1, half), " ")))
    label = F.when(doubled, F.array_join(F.slice(words, 1, half), " ")).otherwise(label)
    bad = bad | label.rlike(rules.FIELD_JUNK) | F.lower(label).isin(*rules.FIELD_REJECTED)

    def cased(word: Column, i: Column) -> Column:
        low = F.lower(word)
        capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))
        return F.when(low.isin(*rules.FIELD_SMALL_WORDS) & (i > 0), low).when(low.isin(*rules.FIELD_ACRONYMS), F.upper(word)).otherwise(capital)

    titled = F.array_join(F.transform(F.split(F.replace(label, F.lit(" and "), F.lit(" & ")), " "), cased), " ")
    alias = F.create_map(*[F.lit(x) for pair in rules.FIELD_ALIASES.items() for x in pair])
    return F.when(~bad, F.coalesce(F.try_element_at(alias, F.lower(label)), titled))
