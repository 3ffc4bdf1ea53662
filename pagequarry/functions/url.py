"""URL parts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = (
    r"(?i)\A([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)(:[0-9]*)?(?=[/?#]|\z)"
)
_SCHEME_GROUP, _HOST_GROUP, _PORT_GROUP = 1, 2, 3
_PATH = r"\A[^/?#]*//[^/?#]*([^?#]*)"
_PAGE = r"\A[^?#]*\?(?:[^#]*?&)??(page=[0-9]+)(?:[&#]|\z)"
# "www." and "m." are dropped only in front of a name that still has a dot.
_MIRROR_PREFIX = r"\A(?:www|m)\.([^.]+\..+)\z"

# Ports a URL means when it names none.
DEFAULT_PORTS = ("http:80", "https:443")


def _trimmed(url: Column) -> Column:
    return F.trim(url, F.lit(" \t\r\n"))


def _authority(url: Column, group: int) -> Column:
    return F.lower(F.regexp_extract(_trimmed(url), _AUTHORITY, group))


def url_host(url: Column) -> Column:
    """Host of an absolute URL in lower case; null if there is none."""
    return F.nullif(_authority(url, _HOST_GROUP), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling for the URLs that lead to the same page.

    Host in lower case without ``www.``/``m.``, then a port that is not the
    scheme's own, the path, and ``?page=N`` if present. Scheme, other
    parameters and fragment are dropped. ``page=N`` stays because pages of a
    listing differ. A URL without scheme and host is returned trimmed.
    """
    host = F.regexp_replace(url_host(url), _MIRROR_PREFIX, "$1")
    port = _authority(url, _PORT_GROUP)
    own_port = F.concat(_authority(url, _SCHEME_GROUP), port).isin(*DEFAULT_PORTS)
    path = F.regexp_extract(_trimmed(url), _PATH, 1)
    page = F.regexp_extract(_trimmed(url), _PAGE, 1)
    canonical = F.concat(
        host,
        F.when(own_port | (port == ":"), "").otherwise(port),
        F.when(path == "", "/").otherwise(path),
        F.when(page == "", "").otherwise(F.concat(F.lit("?"), page)),
    )
    return F.coalesce(canonical, _trimmed(url))
