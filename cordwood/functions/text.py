"""White space and encoding. All helpers take and give SQL text."""

from __future__ import annotations


def utrim(text: str) -> str:
    """Trim Unicode white space; the lookbehind keeps the scan linear in long blanks."""
    return rf"regexp_replace({text}, r'(?U)^\s+|(?<!\s)\s+\z', '')"


def is_blank(text: str) -> str:
    """True when the text is NULL or holds nothing but Unicode white space.

    Texts compare by bytes, so the two bounds tell that the first character is
    a visible ASCII one; only other texts are scanned.
    """
    visible = f"{text} >= '!' AND {text} < '\\u007f'"
    return rf"({text} IS NULL OR NOT ({visible} OR {text} RLIKE r'(?U)\S'))"


def lossy_utf8(data: str) -> str:
    """Bytes to text with U+FFFD in place of invalid sequences."""
    return f"make_valid_utf8(cast({data} AS string))"


def strip_carriage_return(line: str) -> str:
    """Drop one trailing carriage return; the line feed is the reader's separator.

    It is cut off as a byte: before the repair of broken UTF-8, a character may
    seem to reach into it.
    """
    cut = f"cast(substring(cast({line} AS binary), 1, octet_length({line}) - 1) AS string)"
    return f"if(endswith({line}, '\\r'), {cut}, {line})"
