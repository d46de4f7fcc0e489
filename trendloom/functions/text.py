"""Text expressions: dialogs, redaction, cleaning, n-grams.

Everything here is a ``Column -> Column`` expression that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom import fixed_values as fv


@dataclass(frozen=True)
class DialogConfig:
    """Speaker markers, and which of the client's messages counts as the first.

    ``match`` says where a marker must stand: anywhere in a line, or as its first word (``prefix``).
    """

    client_markers: tuple[str, ...] = fv.CLIENT_MARKERS
    operator_markers: tuple[str, ...] = fv.OPERATOR_MARKERS
    chatbot_markers: tuple[str, ...] = fv.CHATBOT_MARKERS
    match: str = "substring"
    min_client_len: int = fv.SHORT_MESSAGE_CHARS
    take_second_client_if_too_short: bool = True
    fallback_mode: str = "first_paragraph"
    fallback_first_n_chars: int = fv.FALLBACK_CHARS


@dataclass(frozen=True)
class RedactionConfig:
    """What stands for personal data, and in which order the patterns run.

    ``order`` is ``usual`` (a phone is any long run of digits) or ``specific_first`` (account and card before phone).
    """

    enabled: bool = True
    order: str = "usual"
    email: str = fv.EMAIL_TOKEN
    phone: str = fv.PHONE_TOKEN
    url: str = fv.URL_TOKEN
    card: str = fv.CARD_TOKEN
    account: str = fv.ACCOUNT_TOKEN


_SPACE = r"[\s\x1c-\x1f]"
# Every character that Unicode (and Python) counts as white space.
_SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a local variable)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(c, F.lit(_SPACE_CHARS))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def non_empty(c: Column) -> Column:
    """Neither null, blank, nor one of the words that spell a missing value."""
    s = strip(text_or_empty(c))
    return (s != "") & ~F.lower(s).isin(*fv.NULL_WORDS)


def blank(c: Column) -> Column:
    return strip(text_or_empty(c)) == ""


# --- dialogs -------------------------------------------------------------------

def split_lines(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return bind(
        F.split(c, fv.LINE_END),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a),
    )


def line_role(line: Column, cfg: DialogConfig) -> Column:
    """Speaker of a line by marker, client before operator before chatbot.

    With ``match="prefix"`` a marker counts only as the first word of a line, behind brackets at most.
    """
    if cfg.match not in ("substring", "prefix"):
        raise ValueError(f"match is {cfg.match!r}, not substring or prefix")

    def has_any(upper: Column, markers: Iterable[str]) -> Column:
        hit = F.lit(False)
        for marker in markers:
            m = marker.upper()
            first = rf"^[\[(\s]*\Q{m}\E(?![{fv.W}])"
            hit = hit | (F.rlike(upper, F.lit(first)) if cfg.match == "prefix" else F.contains(upper, F.lit(m)))
        return hit

    return bind(
        F.upper(line),
        lambda u: F.when(has_any(u, cfg.client_markers), "client")
        .when(has_any(u, cfg.operator_markers), "operator")
        .when(has_any(u, cfg.chatbot_markers), "chatbot"),
    )


def strip_marker(line: Column) -> Column:
    return F.regexp_replace(strip(line), fv.LEADING_MARKER, "")


def dialog_segments(c: Column, cfg: DialogConfig) -> Column:
    """``array<struct<role,text>>`` of the lines that name a speaker."""
    roles = F.transform(
        split_lines(c),
        lambda line: F.struct(line_role(line, cfg).alias("role"), line.alias("line")),
    )
    return F.transform(
        F.filter(roles, lambda s: s["role"].isNotNull()),
        lambda s: F.struct(s["role"].alias("role"), strip_marker(s["line"]).alias("text")),
    )


def fallback_message(c: Column, cfg: DialogConfig) -> Column:
    n = cfg.fallback_first_n_chars
    head = F.get(F.split(c, "\n\n", 2), F.lit(0)) if cfg.fallback_mode == "first_paragraph" else c
    return strip(F.substring(head, 1, n))


def client_first_message(c: Column, cfg: DialogConfig) -> Column:
    """What the client said first, or the second message if the first is too short."""
    dialog = strip(text_or_empty(c))

    def pick(messages: Column) -> Column:
        first = strip(F.get(messages, F.lit(0))["text"])
        if cfg.take_second_client_if_too_short:
            second = strip(F.get(messages, F.lit(1))["text"])
            short = F.length(F.get(messages, F.lit(0))["text"]) < cfg.min_client_len
            return F.when(short & (F.size(messages) > 1), second).otherwise(first)
        return first

    said = F.filter(
        dialog_segments(dialog, cfg), lambda s: (s["role"] == "client") & (strip(s["text"]) != "")
    )
    found = bind(said, lambda m: F.when(F.size(m) > 0, pick(m)))
    return F.when(dialog == "", "").otherwise(F.coalesce(found, fallback_message(dialog, cfg)))


# --- redaction -----------------------------------------------------------------

def redact_email(c: Column, token: str = fv.EMAIL_TOKEN) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, fv.EMAIL, token)).otherwise(c)


def redact_phone(c: Column, token: str = fv.PHONE_TOKEN) -> Column:
    return F.regexp_replace(c, fv.PHONE, token)


def redact_url(c: Column, token: str = fv.URL_TOKEN) -> Column:
    maybe = F.contains(c, F.lit("://")) | F.contains(c, F.lit("www."))
    return F.when(maybe, F.regexp_replace(c, fv.URL, token)).otherwise(c)


def redact_card(c: Column, token: str = fv.CARD_TOKEN) -> Column:
    return F.regexp_replace(c, fv.CARD, token)


def redact_account(c: Column, token: str = fv.ACCOUNT_TOKEN) -> Column:
    return F.regexp_replace(c, fv.ACCOUNT, token)


def redact(c: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    """E-mail, phone, URL, card, account, in this order.

    A phone number is any run of ten or more digits, so it takes longer runs before the card and account
    steps see them; the order is part of the result.  With ``order="specific_first"`` account and card
    come before phone, and longer runs keep their kind.
    """
    if cfg.order not in ("usual", "specific_first"):
        raise ValueError(f"order is {cfg.order!r}, not usual or specific_first")
    out = text_or_empty(c)
    if not cfg.enabled:
        return out
    phone, url, card, account = (redact_phone, cfg.phone), (redact_url, cfg.url), (redact_card, cfg.card), (redact_account, cfg.account)
    steps = (phone, url, card, account) if cfg.order == "usual" else (account, card, phone, url)
    for step, token in ((redact_email, cfg.email), *steps):
        out = step(out, token)
    return out


def redact_values(m: Column, cfg: RedactionConfig = RedactionConfig()) -> Column:
    return F.transform_values(m, lambda _, v: redact(v, cfg))


# --- cleaning and n-grams --------------------------------------------------------

def clean_for_model(c: Column, deny: Iterable[str]) -> Column:
    """Lower-case words without tags, bare numbers, denied and one-letter tokens."""
    out = F.regexp_replace(F.lower(text_or_empty(c)), fv.TAG, " ")
    # A bare number is a word of digits only, so the words are judged instead of every place of the text.
    words = F.regexp_extract_all(out, F.lit(fv.WORD), F.lit(0))
    denied = sorted(set(deny))

    def kept(w: Column) -> Column:
        usable = (F.length(w) > 1) & ~F.rlike(w, F.lit(fv.BARE_NUMBER))
        return usable & ~w.isin(*denied) if denied else usable

    return F.array_join(F.filter(words, kept), " ")


def feature_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(fv.FEATURE_WORD), F.lit(0))


def word_ngrams(words: Column, lo: int, hi: int) -> Column:
    """All runs of ``lo..hi`` neighbouring words, joined by a space."""

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return w
        count = F.greatest(F.size(w) - (n - 1), F.lit(0))
        gram = F.slice(w, F.lit(1), count)
        for shift in range(1, n):
            gram = F.zip_with(
                gram, F.slice(w, F.lit(shift + 1), count), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        return gram

    return bind(words, lambda w: F.concat(*[runs(w, n) for n in range(lo, hi + 1)]))


def spaced_words(c: Column) -> Column:
    """Lower-case pieces between white space."""
    return F.filter(F.split(F.lower(text_or_empty(c)), rf"(?U){_SPACE}+"), lambda w: w != "")


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside space-padded words.

    A padded word shorter than the smallest size yields itself once.
    """
    padded = F.transform(spaced_words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(ws: Column, n: int) -> Column:
        long_enough = ws if n == lo else F.filter(ws, lambda w: F.length(w) >= n)
        return F.flatten(
            F.transform(
                long_enough,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))),
                    lambda i: F.substring(w, i, F.lit(n)),
                ),
            )
        )

    return bind(padded, lambda ws: F.concat(*[of_size(ws, n) for n in range(lo, hi + 1)]))


# --- keys and sizes ----------------------------------------------------------------

def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def content_key(fields: dict[str, Column], version: str) -> Column:
    """SHA-256 of the sorted-key JSON of ``fields`` followed by ``version``."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    encoded = F.to_json(ordered, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(encoded, F.lit(version)), 256)


def decorate(code: Column, label: Column) -> Column:
    """``code (label)``, the code standing in for a missing label."""
    return F.concat(code, F.lit(" ("), F.coalesce(label, code), F.lit(")"))
