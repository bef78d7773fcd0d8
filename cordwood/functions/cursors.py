"""Opaque page cursors: base64url (no padding) of ``{"v":1,"t":…,"i":…}``."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cordwood.functions.times import UTC, as_utc, format_rfc3339
from cordwood.schemas import MAX_ID_BYTES

CURSOR_VERSION = 1
MAX_CURSOR_LENGTH = 512

_ZERO_TIME = dt.datetime(1, 1, 1, tzinfo=UTC)
_RFC3339 = re.compile(
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})", re.ASCII
)


@dataclass(frozen=True)
class PageCursor:
    """Position of the last row of a page."""

    timestamp: dt.datetime
    id: str

    def is_zero(self) -> bool:
        return not self.id.strip() or as_utc(self.timestamp) == _ZERO_TIME


def parse_moment(text: str) -> dt.datetime:
    """Strict RFC 3339 text to an aware UTC datetime; raises ``ValueError``."""
    match = _RFC3339.fullmatch(text)
    if not match:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    seconds, fraction, zone = match.groups()
    micros = (fraction or "").ljust(6, "0")[:6]
    offset = "+00:00" if zone == "Z" else zone
    try:
        return dt.datetime.fromisoformat(f"{seconds}.{micros}{offset}").astimezone(UTC)
    except OverflowError as error:
        raise ValueError(str(error)) from error


def format_moment(moment: dt.datetime) -> str:
    utc = as_utc(moment).replace(tzinfo=None)
    text = utc.isoformat(timespec="microseconds").rstrip("0").rstrip(".")
    return text + "Z"


def encode_cursor(cursor: PageCursor | None) -> str:
    """Empty text when there is no next page."""
    if cursor is None or cursor.is_zero():
        return ""
    payload = {"v": CURSOR_VERSION, "t": format_moment(cursor.timestamp), "i": cursor.id}
    data = json.dumps(payload, separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def decode_cursor(raw: str | None) -> PageCursor | None:
    """None for blank text; ``ValueError('invalid cursor')`` for anything not ours."""
    raw = (raw or "").strip()
    if not raw:
        return None
    try:
        if len(raw.encode()) > MAX_CURSOR_LENGTH or not re.fullmatch(r"[A-Za-z0-9_-]+", raw):
            raise ValueError(raw)
        data = base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_", validate=True)
        payload = json.loads(data)
        version, moment, key = payload.pop("v"), payload.pop("t"), payload.pop("i")
        if payload or type(version) is not int or version != CURSOR_VERSION:
            raise ValueError(raw)
        if not isinstance(key, str) or len(key.encode()) > MAX_ID_BYTES:
            raise ValueError(raw)
        cursor = PageCursor(parse_moment(moment), key)
        if cursor.is_zero():
            raise ValueError(raw)
    except (ValueError, KeyError, TypeError, AttributeError, binascii.Error):
        raise ValueError("invalid cursor") from None
    return cursor


def cursor_column(timestamp: str, key: str) -> Column:
    """The cursor of every row, for exports that hand out a resume point per row."""
    moment = format_rfc3339(f"`{timestamp}`")
    payload = f"to_json(struct({CURSOR_VERSION} AS v, {moment} AS t, `{key}` AS i))"
    encoded = f"translate(base64(encode({payload}, 'UTF-8')), '+/\\r\\n', '-_')"
    return F.expr(f"rtrim('=', {encoded})")
