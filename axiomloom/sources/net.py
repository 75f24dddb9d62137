"""Looking ontology documents up on the web: HEAD requests and redirects, on the driver."""

from __future__ import annotations

import http.client
import ssl
from urllib.parse import urljoin, urlsplit

#: Tries of a connection whose TLS handshake fails, and redirects that are followed.
TRIES, MOST_REDIRECTS = 6, 20


class ConnectionFailError(RuntimeError):
    """A server that can't be reached."""


class NotFoundError(RuntimeError):
    """A document that isn't there."""


def head(url: str, timeout: float = 30, connect=None) -> http.client.HTTPResponse:
    """The response to a HEAD request; one without a body. ``connect(scheme, host)`` may replace the connection."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ConnectionFailError(f"Unsupported protocol: {url}")
    make = connect or (lambda scheme, host: (http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection)(host, timeout=timeout))
    for n in range(TRIES):
        try:
            c = make(parts.scheme, parts.netloc)
            c.request("HEAD", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
            return c.getresponse()
        except ssl.SSLError as e:
            if n == TRIES - 1:
                raise ConnectionFailError(f"{url}: {e}") from e
        except (OSError, http.client.HTTPException) as e:
            raise ConnectionFailError(f"{url}: {e}") from e
    raise ConnectionFailError(url)


def final_url(url: str, connect=None) -> str:
    """Where ``url`` leads after all redirects; a circle or a very long chain is an error."""
    seen = set()
    while True:
        if url in seen or len(seen) > MOST_REDIRECTS:
            raise ConnectionFailError(f"{url}: the redirects don't end.")
        seen.add(url)
        r = head(url, connect=connect)
        if r.status == 404:
            raise NotFoundError(f"{url} was not found.")
        if r.status not in (301, 302, 303, 307, 308) or not r.headers.get("Location"):
            return url
        url = urljoin(url, r.headers["Location"])
