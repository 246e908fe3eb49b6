"""POST with retries, for model adapters that run inside worker functions."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

TRIES = 8
SCHEMES = ("https://", "http://localhost", "http://127.0.0.1")


def wait_before(attempt: int, retry_after: str | None) -> float:
    """Seconds before the next try: what the server asks for, else 2, 4, 8, …"""
    if retry_after and retry_after.strip().isdigit():
        return float(retry_after)
    return 2.0 * 2**attempt


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep, opener: Callable = urllib.request.urlopen) -> dict:
    """The JSON answer; busy and failing servers are tried again, other errors raise at once."""
    if not url.startswith(SCHEMES):
        raise ValueError(f"refusing to post to {url.split(':')[0]}")
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    for attempt in range(TRIES):
        try:
            with opener(request, timeout=120) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or attempt == TRIES - 1:
                raise
            sleep(wait_before(attempt, e.headers.get("Retry-After") if e.headers else None))
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
            sleep(wait_before(attempt, None))
    raise AssertionError("unreachable")
