"""Classifiers and scores as ordered conditions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import first_match, has, joined


def industry(text: Column) -> Column:
    """The first profile with a keyword and none of another industry's words."""
    out = F.lit(None).cast("string")
    for label, _, keywords, others in reversed(list(fixed.INDUSTRIES.values())):
        out = F.when(has(text, keywords) & ~has(text, others), label).otherwise(out)
    return out


def with_industry_match(companies: DataFrame, target: str | Column) -> DataFrame:
    """companies with m: struct(matches, score, detected, conflict) against a profile's id, or a column of such ids.

    The text, then the four tests over it, are columns of their own, so each pattern runs once a row; with a column of ids
    only the row's own profile is asked.  An id that no profile has gives nulls.
    """
    names = [target] if isinstance(target, str) else list(fixed.INDUSTRIES)

    def of_target(test) -> Column:
        if isinstance(target, str):
            return test(*fixed.INDUSTRIES[target])
        out = F.lit(None)
        for name in reversed(names):
            out = F.when(target == name, test(*fixed.INDUSTRIES[name])).otherwise(out)
        return out

    own = F.trim(F.lower(F.coalesce("industry", F.lit(""))))

    def fits_field(label: str, aliases: list[str], _keywords: str, _others: str) -> Column:
        field = own == label.lower()
        for alias in aliases:
            field = field | own.contains(alias)
        return field

    staged = companies.withColumn("_text", company_text())
    text = F.col("_text")
    label = of_target(lambda name, *_: F.lit(name))
    field = of_target(fits_field)
    asked = F.lit(target == "healthcare") if isinstance(target, str) else target == "healthcare"
    health = asked & has(text, fixed.HEALTH_SOFTWARE) if "healthcare" in names else F.lit(False)
    keywords, others = of_target(lambda _n, _a, pattern, _o: has(text, pattern)), of_target(lambda _n, _a, _k, pattern: has(text, pattern))
    staged = staged.withColumns({"_detected": industry(text), "_keyword": keywords, "_other": others, "_field": field, "_health": health})
    detected, keyword, fits = F.col("_detected"), F.col("_keyword"), F.col("_field")
    apart = F.coalesce(detected != label, F.lit(False)) & ~keyword & ~fits
    score = F.when(fits, 0.5).otherwise(0.0) + F.when(keyword, 0.5).otherwise(0.0)
    score = F.least(F.when(F.coalesce(detected == label, F.lit(False)), F.greatest(score, F.lit(0.9))).otherwise(score), F.lit(1.0))

    def result(matches: bool, value: Column, found: Column, conflict: bool) -> Column:
        return F.struct(F.lit(matches).alias("matches"), value.alias("score"), found.alias("detected"), F.lit(conflict).alias("conflict"))

    m = (
        F.when(F.col("_other"), result(False, F.lit(0.0), detected, True))
        .when(apart & F.col("_health") & (detected == "Technology"), result(True, F.lit(0.85), F.lit(label), False))
        .when(apart, result(False, F.lit(0.1), detected, True))
        .when(~keyword & ~fits, result(False, F.lit(0.0), F.coalesce(detected, F.col("industry")), False))
        .otherwise(result(True, score, F.coalesce(detected, F.col("industry")), False))
    )
    return staged.withColumn("m", m).drop("_text", "_detected", "_keyword", "_other", "_field", "_health")


def company_type(text: Column, domain: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    out = F.lit("operating_company")
    for kind, pattern in reversed(fixed.COMPANY_TYPES):
        out = F.when(has(text, pattern), kind).otherwise(out)
    return (
        F.when(bare.isin(fixed.ACCELERATOR_DOMAINS) | has(text, fixed.ACCELERATOR_NAMES), "accelerator")
        .when(bare.isin(fixed.INVESTMENT_DOMAINS) | has(text, fixed.INVESTMENT_FIRMS), "investment_firm")
        .when(has(text, fixed.ACCELERATORS), "accelerator")
        .when(has(text, fixed.VENTURE) & ~has(text, fixed.HAS_PRODUCT), "vc")
        .otherwise(out)
    )


def type_label(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in fixed.TYPE_LABELS.items() for x in pair]), kind)


def _signals(text: Column) -> list[Column]:
    return [has(text, pattern) for _, _, pattern in fixed.INTENT_RULES]


def with_intent(df: DataFrame, text: str) -> DataFrame:
    """df with intent: struct(score, signals, evidence), evidence in the order of signals.

    White space is collapsed first.  The clean text and one flag a rule are columns of their own, so each pattern runs once
    a row; only the rules that fit are asked for their place.
    """
    df = df.withColumn("_clean", F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    names = [f"_signal_{rule}" for rule, _, _ in fixed.INTENT_RULES]
    df = df.withColumns(dict(zip(names, _signals(F.col("_clean")), strict=True)))
    score = F.lit(0)
    for name, (_, strength, _) in zip(names, fixed.INTENT_RULES, strict=True):
        score = score + F.when(F.col(name), fixed.INTENT_POINTS[strength]).otherwise(0)
    found = [F.when(F.col(n), F.lit(rule)) for n, (rule, _, _) in zip(names, fixed.INTENT_RULES, strict=True)]
    shown = [F.when(F.col(n), intent_evidence(F.col("_clean"), i)) for i, n in enumerate(names)]
    intent = F.struct(F.least(score, F.lit(100)).alias("score"), F.array_compact(F.array(*found)).alias("signals"), F.array_compact(F.array(*shown)).alias("evidence"))
    return df.withColumn("intent", intent).drop("_clean", *names)


def intent_score(text: Column) -> Column:
    text, total = F.regexp_replace(text, r"\s+", " "), F.lit(0)
    for (_, strength, _), hit in zip(fixed.INTENT_RULES, _signals(text), strict=True):
        total = total + F.when(hit, fixed.INTENT_POINTS[strength]).otherwise(0)
    return F.least(total, F.lit(100))


def intent_evidence(text: Column, rule: int) -> Column:
    """20 characters before a rule's first match and 80 from it on, of a text with single spaces."""
    place = F.regexp_instr(text, F.lit(f"(?i){fixed.INTENT_RULES[rule][2]}"))
    start = F.greatest(place - 20, F.lit(1))
    return F.when(place > 0, F.trim(F.substring(text, start, place + 80 - start)))


def title_relevance(title: Column, wanted: Column | None = None) -> Column:
    score = first_match(F.trim(title), fixed.TITLE_SCORES, 40)
    return score if wanted is None else F.when(wanted, F.least(score + 15, F.lit(100))).otherwise(score)


def department(title: Column) -> Column:
    return first_match(title, fixed.DEPARTMENTS)


def contact_confidence(title: Column, email: Column, guessed: Column, profile: Column, wanted: Column | None = None) -> Column:
    mail = F.coalesce(email != "", F.lit(False))
    score = title_relevance(title, wanted) + F.when(F.coalesce(profile != "", F.lit(False)), 12).otherwise(0) + F.when(mail & ~guessed, 18).when(guessed, -8).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def company_confidence(domain: Column, description: Column, industry_: Column, profile: Column, employees: Column, website: Column) -> Column:
    there = lambda c: F.coalesce(c != "", F.lit(False))
    points = [(there(domain), 15), (F.coalesce(F.length(description) > 40, F.lit(False)), 15), (there(industry_), 10), (there(profile), 10), (F.coalesce(employees != 0, F.lit(False)), 5), (F.coalesce(website.startswith("http"), F.lit(False)), 5)]
    total = F.lit(45)
    for test, value in points:
        total = total + F.when(test, value).otherwise(0)
    return F.least(total, F.lit(100))


def size_matches(employees: Column, low: int | None, high: int | None) -> Column:
    """No bound passes all; an unknown size passes none."""
    if low is None and high is None:
        return F.lit(True)
    test = F.lit(True)
    if low is not None:
        test = test & (employees >= low)
    if high is not None:
        test = test & (employees <= high)
    return F.coalesce(test, F.lit(False))


def technologies_match(have: Column, text: Column, wanted: list[str]) -> Column:
    """Each wanted one is part of a listed one, or the other way round, or of the text."""
    test = F.lit(True)
    for name in wanted:
        low = name.lower()
        listed = F.exists(F.coalesce(have, F.array().cast("array<string>")), lambda t: F.lower(t).contains(low) | F.lit(low).contains(F.lower(t)))
        test = test & (listed | F.coalesce(text.contains(low), F.lit(False)))
    return test


def lead_score(factors: dict[str, Column], weights: dict[str, int] | None = None, intent: Column | None = None) -> Column:
    """1 to 10: the weighted mean of six factors, and up to one more for intent."""
    weights = weights or fixed.LEAD_WEIGHTS
    total = sum(weights.values())
    if not total:
        return F.lit(1.0)
    mean = F.lit(0.0)
    for name, weight in weights.items():
        mean = mean + factors[name] * weight
    base = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(1 + mean / total * 9 + 0.5))).cast("double")
    if intent is None:
        return base
    return F.least(F.lit(10.0), base + F.when(intent >= 70, 1.0).when(intent >= 45, 0.5).otherwise(0.0))


def six_weights(row: dict[str, int]) -> dict[str, int]:
    """Five stored weights to six: the industry's is split, its half rounded up, the rest for the type."""
    half = (row["industry"] + 1) // 2
    return {"industry": half, "type": half, "size": row["size"], "location": row["location"], "role": row["role"], "technology": row["technology"]}


def display_status(syntax: Column, domain: Column, smtp: Column, guessed: Column) -> Column:
    ok = F.coalesce(domain, F.lit(False))
    return (
        F.when(~syntax | F.coalesce(~domain, F.lit(False)), "invalid")
        .when(guessed, F.when(smtp == "verified", "likely_valid").when(ok, "risky").otherwise("unknown"))
        .when(smtp == "verified", "verified")
        .when(smtp == "invalid", "invalid")
        .when(ok, "likely_valid")
        .otherwise("not_found")
    )


def quality_category(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "average").otherwise("reject")


def campaign_status(sent: Column, failed: Column) -> Column:
    return F.when((sent == 0) & (failed > 0), "failed").when(failed > 0, "partial").otherwise("completed")


def company_text(df_columns=None) -> Column:
    return joined(*[F.col(c) for c in (df_columns or ["name", "domain", "industry", "description"])])
