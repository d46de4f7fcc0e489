"""The label record: rules, coercion of loose answers, contract, fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom import fixed_values as fv
from trendloom.functions.text import bind


@dataclass(frozen=True)
class RuleSet:
    """Substring rules of the built-in labeler."""

    complaint_triggers: tuple[str, ...] = fv.COMPLAINT_TRIGGERS
    category: str = fv.RULE_CATEGORY
    subcategory: str = fv.RULE_SUBCATEGORY
    keywords: tuple[str, ...] = fv.RULE_KEYWORDS
    loan_triggers: tuple[str, ...] = fv.LOAN_TRIGGERS
    loan_product: str = fv.RULE_LOAN_PRODUCT
    confidence: float = fv.RULE_CONFIDENCE

LABEL_TYPE = (
    "struct<client_first_message:string,short_summary:string,is_complaint:boolean,"
    "complaint_category:string,complaint_subcategory:string,product_area:string,"
    "loan_product:string,severity:string,keywords:array<string>,confidence:double,notes:string>"
)
ANSWER_TYPE = (
    "struct<complaint_category:string,category:string,complaint_subcategory:string,"
    "subcategory:string,product_area:string,product:string,loan_product:string,"
    "is_complaint:string,severity:string,keywords:array<string>,confidence:string,"
    "short_summary:string,summary:string,notes:string>"
)


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _record(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()]).cast(LABEL_TYPE)


def contains_any(text: Column, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def rule_label(text: Column, product: Column, rules: RuleSet = RuleSet()) -> Column:
    """Label by substrings of the lower-cased dialog."""
    lowered = F.lower(text)
    bad = contains_any(lowered, rules.complaint_triggers)
    loan = contains_any(lowered, rules.loan_triggers)
    return _record(
        client_first_message=text,
        short_summary=F.substring(text, 1, fv.SUMMARY_CHARS),
        is_complaint=bad,
        complaint_category=F.when(bad, rules.category).otherwise(fv.OTHER),
        complaint_subcategory=F.when(bad, rules.subcategory),
        product_area=product,
        loan_product=F.when(loan, rules.loan_product).otherwise(fv.NO_LOAN),
        severity=F.when(bad, fv.COMPLAINT_SEVERITY).otherwise(fv.QUESTION_SEVERITY),
        keywords=F.when(bad, _words(rules.keywords)).otherwise(_words(fv.QUESTION_KEYWORDS)),
        confidence=F.lit(rules.confidence),
        notes=F.lit(None),
    )


def _first(*choices: Column) -> Column:
    """First choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def coerce_answer(answer: Column, dialog: Column) -> Column:
    """Label record from a parsed answer with synonyms, gaps and loose values."""
    category = _first(answer["complaint_category"], answer["category"], F.lit(fv.OTHER))
    complaint = F.coalesce(
        answer["is_complaint"].try_cast("boolean"),
        ~F.upper(category).isin(*fv.NOT_COMPLAINT_CATEGORIES),
    )
    severity = F.when(complaint, fv.COMPLAINT_SEVERITY).otherwise(fv.QUESTION_SEVERITY)
    given = F.slice(answer["keywords"], 1, fv.MAX_KEYWORDS)
    default = F.when(complaint, _words(fv.COMPLAINT_KEYWORDS)).otherwise(_words(fv.QUESTION_KEYWORDS))
    padding = F.array_repeat(F.lit(fv.PAD_KEYWORD), F.greatest(F.lit(0), fv.MIN_KEYWORDS - F.size(given)))
    sure = F.when(complaint, fv.COMPLAINT_CONFIDENCE).otherwise(fv.QUESTION_CONFIDENCE)
    return _record(
        client_first_message=dialog,
        # an empty dialog has an empty summary, which is no missing one
        short_summary=F.coalesce(_first(answer["short_summary"], answer["summary"]), F.substring(dialog, 1, fv.SUMMARY_CHARS)),
        is_complaint=complaint,
        complaint_category=category,
        complaint_subcategory=F.coalesce(
            F.nullif(answer["complaint_subcategory"], F.lit("")), answer["subcategory"]
        ),
        product_area=F.coalesce(F.nullif(answer["product_area"], F.lit("")), answer["product"]),
        loan_product=_first(answer["loan_product"], answer["product"], F.lit(fv.NO_LOAN)),
        severity=F.when(answer["severity"].isin(*fv.SEVERITIES), answer["severity"]).otherwise(severity),
        keywords=F.when(F.size(given) > 0, F.concat(given, padding)).otherwise(default),
        confidence=F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(answer["confidence"].try_cast("double"), sure))),
        notes=answer["notes"],
    )


def parse_answer(text: Column) -> Column:
    """Answer struct of a JSON object, null when the text is not one."""
    return F.when(F.rlike(text, F.lit(r"(?s)^\s*\{.*\}\s*$")), F.from_json(text, ANSWER_TYPE))


def violations(label: Column) -> Column:
    """Names of the contract rules a label record breaks."""
    words = label["keywords"]
    forbidden = F.exists(words, lambda w: F.lower(w).isin(*fv.FORBIDDEN_KEYWORDS))
    rules = {
        "missing_text": label["client_first_message"].isNull() | label["short_summary"].isNull(),
        "missing_verdict": label["is_complaint"].isNull() | label["complaint_category"].isNull(),
        "severity": ~F.coalesce(label["severity"].isin(*fv.SEVERITIES), F.lit(False)),
        "keyword_count": ~F.coalesce(F.size(words).between(fv.MIN_KEYWORDS, fv.MAX_KEYWORDS), F.lit(False)),
        "forbidden_keyword": F.coalesce(forbidden, F.lit(False)),
        "confidence": ~F.coalesce(label["confidence"].between(0.0, 1.0), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def fallback_label(dialog: Column, product: Column, error: Column) -> Column:
    """Neutral record for a row whose labelling failed; the error goes to the notes."""
    return _record(
        client_first_message=dialog,
        short_summary=F.substring(dialog, 1, fv.SUMMARY_CHARS),
        is_complaint=F.lit(False),
        complaint_category=F.lit(fv.OTHER),
        complaint_subcategory=F.lit(None),
        product_area=product,
        loan_product=F.lit(fv.NO_LOAN),
        severity=F.lit(fv.QUESTION_SEVERITY),
        keywords=_words(fv.QUESTION_KEYWORDS),
        confidence=F.lit(0.0),
        notes=F.concat(F.lit(fv.ERROR_PREFIX + " "), error),
    )


# --- answers to a batch --------------------------------------------------------------

_EMPTY_JSON = ("null", "false", "0", "0.0", '""', "[]", "{}")


def unwrap_answers(response: Column) -> Column:
    """``array<struct<idx:int,item:string>>`` of the objects in a batch response.

    The list is the response itself or sits under one of the known keys; items
    that are not objects are skipped.
    """

    def items_of(parsed: Column) -> Column:
        wrapped = None
        for key in fv.RESPONSE_LIST_KEYS:
            under = F.try_variant_get(parsed, f"$.{key}", "variant")
            filled = ~F.to_json(under).isin(*_EMPTY_JSON)
            items = F.try_variant_get(under, "$", "array<variant>")
            wrapped = F.when(filled, items) if wrapped is None else wrapped.when(filled, items)
        is_list = F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY"))
        listed = F.try_variant_get(parsed, "$", "array<variant>")
        return F.coalesce(F.when(is_list, listed).otherwise(wrapped), F.array().cast("array<variant>"))

    items = bind(F.try_parse_json(response), items_of)
    objects = F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    return F.transform(
        objects,
        lambda v: F.struct(
            F.try_variant_get(v, f"$.{fv.RESPONSE_INDEX_KEY}", "int").alias("idx"),
            F.to_json(v).alias("item"),
        ),
    )


def reconcile(requested: Column, answers: Column) -> Column:
    """Pair the answers of one batch with its requests.

    ``requested`` holds the request numbers in order, ``answers`` the unwrapped
    items.  The first answer naming a request takes it; the others are paired in
    order with the requests left over.  Result: ``array<struct<idx,item,matched>>``.
    """

    def pair(marked: Column) -> Column:
        taken = F.filter(marked, lambda a: a["matched"])
        rest = F.filter(marked, lambda a: ~a["matched"])
        unanswered = F.array_except(requested, F.transform(taken, lambda a: a["idx"]))
        pairs = F.least(F.size(unanswered), F.size(rest))
        paired = F.zip_with(
            F.slice(unanswered, F.lit(1), pairs),
            F.slice(rest, F.lit(1), pairs),
            lambda idx, a: F.struct(idx.alias("idx"), a["item"].alias("item"), F.lit(False).alias("matched")),
        )
        return F.concat(taken, paired)

    def mark(items: Column) -> Column:
        return bind(
            F.transform(items, lambda a: a["idx"]),
            lambda named: F.transform(
                items,
                lambda a, i: F.struct(
                    a["idx"].alias("idx"),
                    a["item"].alias("item"),
                    F.coalesce(
                        F.array_contains(requested, a["idx"]) & (F.array_position(named, a["idx"]) == i + 1),
                        F.lit(False),
                    ).alias("matched"),
                ),
            ),
        )

    return bind(bind(answers, mark), pair)
