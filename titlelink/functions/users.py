"""Whose list is meant: profile addresses and ids as a user types them, by provider. The sites' hosts are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Providers in the order in which an address is tried.
ORDER = ("a", "c", "b")
_MOST = (1 << 53) - 1


def _front(host: str) -> str:
    return rf"^(?:https?://)?(?:www\.)?{re.escape(host)}"


def _trimmed(value: Column | str) -> Column:
    return F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"^\s+|\s+$", "")


def _address(provider: str, host: str) -> str:
    """The pattern of a profile's address; its group is the user."""
    if provider == "a":
        return rf"{_front(host)}/user/(\d+)(?:-[A-Za-z0-9_-]+)?/?$"
    if provider == "b":
        return rf"(?i){_front(host)}/user/([^/?#]+)(?:/(?:rated|watching|plans))?/?(?:[?#].*)?$"
    return rf"(?i){_front(host)}/(?:anime_list|profile)/(\d+)(?:/[0-5])?/?(?:[?#].*)?$"


def user(value: Column | str, provider: str, host: str) -> Column:
    """The user that a profile's address or a bare id names, or null."""
    text = _trimmed(value)
    linked = F.nullif(F.regexp_extract(text, _address(provider, host), 1), F.lit(""))
    if provider == "a":
        bare = F.nullif(F.regexp_extract(text, r"^(?:https?://)?(?:www\.)?(\d+)(?:-[A-Za-z0-9_-]+)?/?$", 1), F.lit(""))
        number = F.coalesce(linked, bare).try_cast("decimal(38,0)")
        return F.when((number > 0) & (number <= _MOST), number.cast("string"))
    name = F.coalesce(linked, text)
    return F.when(name.rlike(r"^[A-Za-z0-9_-]+$" if provider == "b" else r"^[0-9]+$"), name)


def scope(value: Column | str, provider: str, host: str) -> Column:
    """The key under which the user's overrides are kept."""
    found = user(value, provider, host)
    return F.concat(F.lit(f"{provider}:"), F.lower(found) if provider == "b" else found)


def provider_of(value: Column | str, hosts: dict[str, str]) -> Column:
    """The provider whose profile address the text is, or null."""
    text = _trimmed(value)
    return F.coalesce(*[F.when(text.rlike(_address(p, hosts[p])), F.lit(p)) for p in ORDER])
