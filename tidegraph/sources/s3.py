"""Credentials for objects in S3, scoped to one execution.

They are handed to each scan as its own options and to each small-file access as its own configuration; the session's
configuration is never changed, so executions with different credentials can share a session.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field


@dataclass(frozen=True)
class S3Credentials:
    """Temporary keys; without ``session_token`` long-lived ones.  Secrets are not shown."""

    access_key: str
    secret_key: str = field(repr=False)
    session_token: str | None = field(default=None, repr=False)
    region: str | None = None

    def __post_init__(self):
        for name in ("access_key", "secret_key"):
            if not isinstance(getattr(self, name), str) or not getattr(self, name):
                raise ValueError(f"{name} is a text that isn't empty")
        for name in ("session_token", "region"):
            if getattr(self, name) is not None and not isinstance(getattr(self, name), str):
                raise ValueError(f"{name} is a text or None")

    def options(self) -> dict[str, str]:
        kind = "TemporaryAWSCredentialsProvider" if self.session_token else "SimpleAWSCredentialsProvider"
        out = {"fs.s3a.access.key": self.access_key, "fs.s3a.secret.key": self.secret_key, "fs.s3a.aws.credentials.provider": f"org.apache.hadoop.fs.s3a.{kind}"}
        out |= {"fs.s3a.session.token": self.session_token} if self.session_token else {}
        return out | ({"fs.s3a.endpoint.region": self.region} if self.region else {})


Provider = S3Credentials | Callable[[], S3Credentials | None] | None
_CURRENT: ContextVar[S3Credentials | None] = ContextVar("s3_credentials", default=None)


def current_s3_credentials() -> S3Credentials | None:
    """Those of the execution under way, if it has any."""
    return _CURRENT.get()


def scan_options() -> dict[str, str]:
    own = _CURRENT.get()
    return own.options() if own else {}


@contextmanager
def s3_scope(given: Provider):
    """Within: the credentials, or what a provider gives now; None leaves the session's own way of finding them."""
    own = given() if callable(given) else given
    if own is not None and not isinstance(own, S3Credentials):
        raise TypeError("a provider gives S3Credentials or None")
    mark = _CURRENT.set(own)
    try:
        yield own
    finally:
        _CURRENT.reset(mark)


def location(path: str) -> str:
    """``s3://bucket/key`` as Hadoop's client names it, without a trailing slash; other paths stay."""
    if not path.startswith("s3://"):
        return path
    bucket, _, key = path.removeprefix("s3://").partition("/")
    if not bucket or "?" in path or "#" in path:
        raise ValueError(f"{path!r} is not s3://bucket/key")
    return f"s3a://{bucket}/{key}".rstrip("/")
