"""Text expressions: masking, token normalising, previews, HTML messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.schemas import EMAIL_MASK, PHONE_MASK, URL_MASK

# Without look-around and back-references, so that other regex engines agree on them.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PHONE_PATTERN = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
URL_PATTERN = r"(https?://|www\.)[^ \t\r\n<>\"']+"
MENTION_PATTERN = r"(^| )@[^ ]+"
LINK_PATTERN = r"(^| )http[^ ]*"


def mask_emails(text: Column) -> Column:
    # `contains` is a plain byte search: most texts never reach the regex.
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL_PATTERN, EMAIL_MASK)).otherwise(text)


def mask_phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE_PATTERN, PHONE_MASK)


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, URL_MASK)


def mask_pii(text: Column) -> Column:
    """E-mails, then phone numbers, then URLs. Each step names its input once: lambdas share nothing."""
    return mask_urls(mask_phones(mask_emails(text)))


def normalise_tokens(text: Column) -> Column:
    """Blank-separated `@name` becomes `@user`; a token starting with http becomes `http`."""
    return F.regexp_replace(F.regexp_replace(text, MENTION_PATTERN, "$1@user"), LINK_PATTERN, "$1http")


def preview(text: Column, length: int = 100) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html_message(message: Column, mask: bool = False, escape: bool = False) -> Column:
    """One message as HTML. A null part counts as empty.

    `mask` hides personal data in author and text only: the date of the header stays, which a
    phone pattern run over the finished HTML could take for a number.
    """
    author, kind, date, text = (
        F.coalesce(message[name], F.lit("")) for name in ("author_name", "user_type", "date", "text")
    )
    if mask:
        author, text = mask_pii(author), mask_pii(text)
    if escape:
        author, kind, date, text = map(escape_html, (author, kind, date, text))
    # Fixed format: what transcript searches look into.
    header = F.concat(F.lit("<b>"), author, F.lit(" ("), kind, F.lit(") on "), date, F.lit("</b><br>"))
    return F.concat(header, text, F.lit("<br><br>"))
