"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words of a-z and 0-9 of the lower-case text, then their neighbours joined by an underscore."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, pairs(w)).otherwise(F.array().cast("array<string>")))), 1)


def excerpt(text: Column, n: int = 300) -> Column:
    """The trimmed text, cut to n characters with the ellipsis counted."""
    t = F.trim(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…")))


#: Marks of headings, quotes, emphasis and lists, which aren't part of a sentence; and where sentences part.
MARKS = r"(?m)\*\*|__|`|^#+\s*|^\s*>\s*"
BULLETS = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"
PARTS = r"(?<=[.!?])[\"'”’)]*\s+(?=[\"'“‘(]*[A-Z0-9#*])|\n+"


def clean(text: Column) -> Column:
    """Straight quotes and dashes, a long dash as two, no markdown marks, no bullets; ids keep their underscores."""
    t = F.replace(F.translate(text, "‘’“”–", "''\"\"-"), F.lit("—"), F.lit(" -- "))
    return F.regexp_replace(F.regexp_replace(t, MARKS, ""), BULLETS, "")


def sentences(text: Column) -> Column:
    """Sentences of the cleaned text: after .!? with closers, before an opener, a capital, digit or mark; and at line ends."""
    return F.filter(F.transform(F.split(clean(text), PARTS), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def ids(text: Column) -> Column:
    """Order, payment and user ids and ten-digit numbers, in order."""
    rx = r"#W\d{7}|(?:credit_card|gift_card|paypal)_\d{7}|[a-z]+_[a-z]+_\d{4}|\b\d{10}\b"
    return F.regexp_extract_all(text, F.lit(rx), F.lit(0))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), F.lit(0))


def zips(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d{5}\b"), F.lit(0))


def order_id(raw: Column) -> Column:
    """An order id with exactly one leading #."""
    return F.concat(F.lit("#"), F.ltrim(raw, F.lit("#")))


#: Fixed value: how an amount is written, with a currency sign or with cents.
AMOUNT = r"\$\s?(\d[\d,]*(?:\.\d{1,2})?)|\b(\d[\d,]*\.\d{2})\b"


def money(text: Column) -> Column:
    """Amounts as numbers: $1,234.50, $ 12 or 12.30."""
    found = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, r"[$,\s]", "").cast("double"))


def states_amount(text: Column, amount: Column) -> Column:
    return F.exists(money(text), lambda v: F.abs(v - amount) < 0.005)


def confirmed_and_stopped(text: Column) -> Column:
    """A last message that stops and confirms at once, and doesn't just give thanks."""
    return text.contains("STOP") & text.rlike(r"(?i)\b(yes|proceed|go ahead)\b") & ~text.rlike(r"(?i)\bthank")


def short_equal(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def joined(names: Column) -> Column:
    """a, b and c"""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, names[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def lower_first(s: Column) -> Column:
    return F.concat(F.lower(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def payment_phrase(source: Column, brand: Column, last_four: Column) -> Column:
    card = F.concat(F.lit("the "), F.initcap(brand), F.lit(" card ending in "), last_four)
    return F.when(source == "credit_card", card).when(source == "gift_card", "my gift card").when(source == "paypal", "my PayPal account")


def opening_body(opening: Column) -> Column:
    """An opening without its greeting and the sentence that tells who speaks."""
    return F.regexp_replace(opening, r"(?is)^(?:hi|hello|hey)\b.*?[.!?,]\s+(?:(?:my (?:name|email)|i'm|i am)\b.*?[.!?]\s+)?(?=\S)", "")


def request(sentence: Column) -> Column:
    """Whether a sentence asks for something."""
    return sentence.rlike(r"(?i)\?\s*$|^(?:please|could you|can you|would you|may i|kindly)\b|\bplease (?:provide|share|confirm|tell|give|let)\b") & ~negated_request(sentence)


def negated_request(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)\b(?:no need to|don't need|do not need|you needn't)\b")


def consent(sentence: Column) -> Column:
    """Whether a sentence asks to confirm before acting."""
    return sentence.rlike(r"(?i)\b(?:confirm|shall i|should i|would you like me to|do you want me to|is that (?:ok|okay|correct|right)|proceed)\b") & (sentence.rlike(r"\?\s*$") | sentence.rlike(r"(?i)\b(?:reply|say|type) [\"']?yes\b"))


def refusal(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:unable to|cannot|can't|can not|not able to|not possible|isn't possible|not eligible|won't be able)\b")


#: Beginnings of the words for what may have been done, and what may stand before them.
DONE = "cancel|exchang|return|refund|modif|chang|updat|switch|process|submit|request|initiat|complet|confirm|plac"
CLAIM = rf"(?i)\b(?:(?:has|have|was|were|is|are)(?: (?:now|been|being|already|successfully))+|i(?:'ve| have)(?: (?:now|already|successfully))*|successfully) (?:{DONE})\w*"


def claims_done(text: Column) -> Column:
    """Whether a text says that something was done."""
    return text.rlike(CLAIM)


#: Words by which an action is told.
ACTIONS = {"cancel": r"(?i)\bcancel", "exchange": r"(?i)\bexchang", "return": r"(?i)\breturn", "modify": r"(?i)\b(?:modif|chang|updat)", "transfer": r"(?i)\btransfer"}


def action(text: Column, prefer: Column | None = None) -> Column:
    """The action a text speaks of most; the preferred one wins a tie, then the order above."""
    counts = [F.regexp_count(text, F.lit(rx)).alias(k) for k, rx in ACTIONS.items()]
    most = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for k, c in reversed(list(zip(ACTIONS, counts, strict=True))):
        out = F.when(c == most, k).otherwise(out)
    if prefer is not None:
        for k, c in zip(ACTIONS, counts, strict=True):
            out = F.when((prefer == k) & (c == most), k).otherwise(out)
    return F.when(most > 0, out)
