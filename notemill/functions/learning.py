"""Column expressions for answers, hints, review intervals and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let


def norm_answer(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, fixed.ANSWER_DROPPED, ""))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams; a shorter text is its own gram, an empty one has none."""
    whole = lambda t: F.filter(F.array(t), lambda x: x != "")
    return let(c, lambda t: F.when(F.length(t) >= n, F.array_distinct(windows(t, n))).otherwise(whole(t)))


def windows(text: Column, n: int) -> Column:
    """All substrings of length n, by a look-ahead at every position (linear in the text)."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def coverage(answer: Column, reference: Column) -> Column:
    """Share of the first gram set found in the second; 0 when either is empty."""
    shared = lambda ref: F.size(F.array_intersect(answer, ref)) / F.size(answer)
    return let(reference, lambda ref: F.when((F.size(answer) > 0) & (F.size(ref) > 0), shared(ref)).otherwise(0.0))


def is_correct(answer: Column, references: Column) -> Column:
    """Normalized answer is part of a reference, or most of its bigrams occur in one."""
    refs = F.filter(F.transform(references, norm_answer), lambda r: r != "")

    def judge(norm: Column) -> Column:
        hit = lambda grams, ref: ((F.length(norm) >= 2) & F.contains(ref, norm)) | (
            coverage(grams, char_ngrams(ref)) >= fixed.COVERAGE_THRESHOLD
        )
        found = let(char_ngrams(norm), lambda grams: F.exists(refs, lambda ref: hit(grams, ref)))
        return (norm != "") & found

    return let(norm_answer(answer), judge)


def feedback(answer: Column, correct: Column) -> Column:
    return (
        F.when(norm_answer(answer) == "", "empty answer")
        .when(correct, "matched reference")
        .otherwise("did not match reference")
    )


def first_sentence(text: Column) -> Column:
    """First sentence ending at index 8 to 80, else the first 80 characters."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    found = F.when(F.lit(False), flat)
    for sep in ("。", "！", "？", ".", "!", "?"):
        at = F.locate(sep, flat)
        found = found.when(at.between(9, 81), F.substring(flat, F.lit(1), at))
    return found.otherwise(F.substring(flat, 1, 80))


def hint(answer: Column, explanation: Column) -> Column:
    seed = first_sentence(F.coalesce(F.when(answer != "", answer), explanation))
    return F.when(seed != "", F.format_string(fixed.HINT_FORMAT, seed)).otherwise(fixed.HINT_FALLBACK)


def full_reference(answer: Column, explanation: Column) -> Column:
    return F.when(answer != "", F.concat(F.lit(fixed.FULL_REFERENCE), answer)).otherwise(explanation)


def next_interval(count: Column) -> Column:
    days = F.array(*[F.lit(d) for d in fixed.INTERVAL_DAYS])
    return F.element_at(days, F.least(F.greatest(count, F.lit(1)), F.lit(len(fixed.INTERVAL_DAYS))).cast("int"))


def add_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def review_message(count: Column, next_review: Column, interval: Column) -> Column:
    day = F.coalesce(F.date_format(next_review, "yyyy-MM-dd"), F.lit(""))
    return F.format_string(fixed.REVIEW_MESSAGE, count, day, interval)


def effort_minutes(difficulty: Column) -> Column:
    return _lookup(fixed.DIFFICULTY_MINUTES, difficulty, fixed.DEFAULT_MINUTES)


def effort_priority(difficulty: Column) -> Column:
    return _lookup(fixed.DIFFICULTY_PRIORITY, difficulty, fixed.DEFAULT_PRIORITY)


def _lookup(table: dict, key: Column, default) -> Column:
    cases = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(default)))
    return cases.otherwise(F.lit(default))


def f1(recall: Column, precision: Column) -> Column:
    total = recall + precision
    return F.when(total == 0, 0.0).otherwise(2 * recall * precision / F.when(total != 0, total))


def hash_number(*parts: Column) -> Column:
    """Number from the first 8 hex digits of a SHA-1, the same in every engine."""
    return F.conv(F.substring(F.sha1(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def concept_question(tag: Column, seed: Column) -> Column:
    """One of the fixed templates filled with the tag; the choice depends on tag and seed only."""
    templates = F.array(*[F.lit(t) for t in fixed.CONCEPT_TEMPLATES])
    pick = (hash_number(tag, seed) % len(fixed.CONCEPT_TEMPLATES) + 1).cast("int")
    return F.replace(F.element_at(templates, pick), F.lit("{tag}"), tag)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; a dimension mismatch is an error, a zero norm counts as 1e-9."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = lambda x: F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(fixed.ZERO_NORM))
    mismatch = F.raise_error(
        F.format_string("vector dimension mismatch: query=%d, stored=%d", F.size(a), F.size(b))
    ).cast("double")
    return F.when(F.size(a) != F.size(b), mismatch).otherwise(dot(a, b) / (norm(a) * norm(b)))
