"""Text expressions: strip, message template, innermost frame, truncation, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import fixed_values as fv

# (?U) makes \s and \d follow Unicode; the four separators U+001C..U+001F are
# white space for Python but not for Java.
_SPACE = r"[\s\x1c-\x1f]"


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for NULL, empty and all-white-space text; never NULL."""
    return F.coalesce(text.rlike(f"(?U)^{_SPACE}*$"), F.lit(True))


def is_empty(text: Column) -> Column:
    return F.coalesce(text == "", F.lit(True))


def or_unknown(text: Column) -> Column:
    return F.when(is_empty(text), F.lit(fv.UNKNOWN)).otherwise(text)


def message_template(message: Column) -> Column:
    """Message with UUIDs, quoted runs and digit runs replaced, in this order."""
    out = F.regexp_replace(message, fv.UUID_PATTERN, "<uuid>")
    out = F.regexp_replace(out, fv.QUOTED_PATTERN, "<str>")
    return F.regexp_replace(out, "(?U)" + fv.DIGITS_PATTERN, "#")


def top_frame(stack_trace: Column) -> Column:
    """Function name of the last traceback frame, ``unknown`` where there is none."""
    names = F.regexp_extract_all(stack_trace, F.lit("(?U)" + fv.FRAME_PATTERN), F.lit(1))
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(fv.UNKNOWN))


def truncate_head(text: Column, limit: int) -> Column:
    """First ``limit`` characters plus a mark; shorter text unchanged."""
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(fv.HEAD_MARK))
    ).otherwise(text)


def truncate_tail(text: Column, limit: int) -> Column:
    """A mark plus the last ``limit`` characters; shorter text unchanged."""
    return F.when(
        F.length(text) > limit, F.concat(F.lit(fv.TAIL_MARK), F.right(text, F.lit(limit)))
    ).otherwise(text)


# Values that look like credentials or personal data in free text. The
# requirement names no patterns; these are ours, and they stay in the subset
# that Java and RE2 read alike. The first group, where there is one, is kept.
_NAME = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)[A-Za-z0-9_.-]{0,20}"
SECRET_PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", ""),
    ("authorization", r"(?i)(authorization[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?(?:(?:basic|bearer|digest)[ \t]+)?)[A-Za-z0-9._~+/=-]{6,}", "1"),
    ("bearer", r"(?i)(bearer[ \t]+)[A-Za-z0-9._~+/=-]{8,}", "1"),
    ("assigned_quoted", r"(?i)(" + _NAME + r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}\")[^\"\[]+", "1"),
    ("assigned_single", r"(?i)(" + _NAME + r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}')[^'\[]+", "1"),
    ("assigned", r"(?i)(" + _NAME + r"[\"']?[ \t]{0,3}[=:][ \t]{0,3})[^ \t\r\n,;&\"'}\])\[]{3,}", "1"),
    ("access_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}", ""),
    ("repository_token", r"gh[pousr]_[A-Za-z0-9]{16,}", ""),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", ""),
    ("ip_address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", ""),
    ("card", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,7}", ""),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}", ""),
)
REDACTED = "[REDACTED]"
# No pattern matches a text without one of these.
_TRIGGER = (r"(?i)private key|authorization|bearer|password|passwd|pwd|secret|token|api_?key|access_?key|akia|asia|gh[pousr]_|@"
            r"|[0-9]\.[0-9]{1,3}\.[0-9]|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|\+[0-9]")


# Quotes inside the texts of a JSON document stand behind a backslash.
_IN_JSON = (("assigned_escaped", r"(?i)(" + _NAME + r"(?:\\?[\"'])?[ \t]{0,3}[=:][ \t]{0,3}\\\")[^\"\\\[]+", "1"),)


def redact(text: Column, json: bool = False) -> Column:
    """Replace secret-shaped values in free text (or in the texts of a JSON document), all matches."""
    out = text
    for _, pattern, keep in (*(_IN_JSON if json else ()), *SECRET_PATTERNS):
        out = F.regexp_replace(out, pattern, ("$1" if keep else "") + REDACTED)
    return F.when(text.rlike(_TRIGGER), out).otherwise(text)


def redaction_count(text: Column, redacted: Column) -> Column:
    """Number of values ``redact`` replaced (a count of marks it added)."""
    mark = r"\[REDACTED\]"
    return F.regexp_count(redacted, F.lit(mark)) - F.regexp_count(text, F.lit(mark))
