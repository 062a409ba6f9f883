"""What can go wrong, as exceptions that carry a kind and details."""

from __future__ import annotations


class LinkError(Exception):
    kind = "internal"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, details

    def as_dict(self) -> dict:
        return {"kind": self.kind, "message": self.message, "details": self.details}


class NotLoaded(LinkError):
    kind = "not_loaded"


class EmptyCatalog(LinkError):
    kind = "catalog_empty"


class BadJson(LinkError):
    kind = "json"


class BadEnum(LinkError):
    kind = "enum"


class SourceRejected(LinkError):
    kind = "source_rejected"


class BadPage(LinkError):
    kind = "page"


class PrivateList(LinkError):
    kind = "private_list"


class OutOfIndex(LinkError):
    kind = "out_of_index"


class StaleVersion(LinkError):
    kind = "stale_version"


class BadDigest(LinkError):
    kind = "digest"


def of_provider(error: LinkError, provider: str) -> LinkError:
    """The same error as that of one provider's list: its kind begins with the provider."""
    error.kind = f"{provider}_{error.kind}" if not error.kind.startswith(f"{provider}_") else error.kind
    return error


class ListNotLoaded(NotLoaded):
    kind = "list_not_loaded"


class CatalogNotLoaded(NotLoaded):
    kind = "catalog_not_loaded"


class CatalogIo(LinkError):
    kind = "catalog_io"


class CatalogHttp(LinkError):
    kind = "catalog_http"


class MissingAsset(LinkError):
    """The release has no file of the catalogue."""

    kind = "catalog_missing_asset"


class SidecarIo(LinkError):
    kind = "sidecar_io"


class SidecarJson(LinkError):
    kind = "sidecar_json"


class ExportXml(LinkError):
    kind = "export_xml"


class ExportIo(LinkError):
    kind = "export_io"


class SourceIo(LinkError):
    kind = "io"


class SourceHttp(LinkError):
    kind = "http"


class RetryExhausted(LinkError):
    """All attempts at a page failed."""

    kind = "retry_exhausted"


class Cancelled(LinkError):
    kind = "cancelled"


class Unknown(LinkError):
    kind = "unknown"
