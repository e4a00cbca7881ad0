"""Options of a process."""

from __future__ import annotations

from contextlib import contextmanager

_options = {"progress": False}


def get_options() -> dict:
    return dict(_options)


def set_options(**kw) -> None:
    unknown = set(kw) - set(_options)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    _options.update(kw)


@contextmanager
def options(**kw):
    before = get_options()
    set_options(**kw)
    try:
        yield
    finally:
        _options.update(before)
