"""Command line: collections and datasets."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from scenegrain import __version__


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    parts = tuple(float(x) for x in text.split(","))
    if len(parts) != 4 or parts[0] >= parts[2] or parts[1] >= parts[3]:
        raise argparse.ArgumentTypeError("a bbox is xmin,ymin,xmax,ymax")
    return parts


def parse_dates(text: str) -> tuple[str, str]:
    parts = tuple(x.strip() for x in text.split(","))
    if len(parts) != 2 or parts[0] > parts[1]:
        raise argparse.ArgumentTypeError("a date range is start,end")
    return parts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scenegrain")
    p.add_argument("--version", action="version", version=__version__)
    top = p.add_subparsers(dest="group", required=True)

    def command(group, name, text, *arguments):
        c = group.add_parser(name, help=text)
        for flags, kw in arguments:
            c.add_argument(*flags, **kw)
        c.add_argument("--json", action="store_true", help="print JSON")
        return c

    ws = (("--workspace",), {"default": os.path.expanduser("~/.scenegrain/collections")})
    box, dates = (("--bbox",), {"type": parse_bbox}), (("--date-range",), {"type": parse_dates})
    force, name = (("--force",), {"action": "store_true"}), (("name",), {})
    items = (("--items",), {"help": "items on disk, or a static catalog.json"})
    collections = top.add_parser("collections").add_subparsers(dest="command", required=True)
    command(collections, "build", "from an item search", name, (("--collection",), {"required": True}), box, dates, items, force, ws)
    command(collections, "list", "in the workspace", ws)
    command(collections, "info", "of one", name, ws)
    command(collections, "delete", "one", name, (("--yes",), {"action": "store_true"}), ws)
    command(collections, "import", "a record table", name, (("table",), {}), force, ws)
    command(top, "build", "a registered dataset", (("dataset",), {}), (("--name",), {"default": ""}), box, dates, items, force, ws)
    datasets = top.add_parser("datasets").add_subparsers(dest="command", required=True)
    command(datasets, "list", "all registered")
    command(datasets, "search", "by text", (("text",), {}))
    command(datasets, "info", "of one", (("dataset",), {}))
    command(datasets, "register-local", "a collection on disk", name, (("path",), {}), (("--registry",), {}))
    command(datasets, "unregister-local", "one", name, (("--registry",), {}))
    command(datasets, "export-local", "one as JSON", name, (("to",), {}), (("--registry",), {}))
    return p


def run(argv: list[str] | None = None, spark=None) -> int:
    from scenegrain import catalog
    from scenegrain.collection import Collection, list_collections
    from scenegrain.session import local_session

    a = parser().parse_args(argv)
    session = lambda: spark or local_session()

    def show(value) -> int:
        print(json.dumps(value, default=str, indent=None if a.json else 1))
        return 0

    def folder() -> str | None:
        return next((p for k in ("records", "stac") if os.path.isdir(p := os.path.join(a.workspace, f"{a.name}_{k}"))), None)

    def about(c: Collection) -> dict:
        return c.describe().first().asDict() | {"name": c.name}

    key = (a.group, getattr(a, "command", None))
    if key == ("collections", "list"):
        os.makedirs(a.workspace, exist_ok=True)
        return show([r.asDict() for r in list_collections(session(), a.workspace).collect()])
    if key == ("collections", "info"):
        return show(about(Collection.from_parquet(session(), folder(), a.name))) if folder() else _fail(f"no collection {a.name}")
    if key == ("collections", "delete"):
        if not folder():
            return _fail(f"no collection {a.name}")
        if not a.yes:
            return _fail("add --yes to delete")
        shutil.rmtree(folder())
        return 0
    if key == ("collections", "import"):
        return show(about(catalog.build_from_table(session(), a.table, a.name, workspace=a.workspace, force=a.force)))
    if key == ("collections", "build"):
        return show(about(catalog.build_from_stac(session(), a.name, a.collection, a.bbox, a.date_range, items_path=a.items, workspace=a.workspace, force=a.force, headers=False)))
    if a.group == "build":
        extra = {"items_path": a.items, "headers": False} if a.items else {}
        return show(about(catalog.build(session(), a.dataset, a.name, bbox=a.bbox, date_range=a.date_range, workspace=a.workspace, force=a.force, **extra)))
    if key == ("datasets", "list"):
        return show([d.id for d in catalog.Registry.all()])
    if key == ("datasets", "search"):
        return show([d.id for d in catalog.Registry.search(a.text)])
    if key == ("datasets", "info"):
        d = catalog.Registry.get(a.dataset)
        return show(vars(d)) if d else _fail(f"unknown dataset {a.dataset}")
    if key == ("datasets", "register-local"):
        return show(catalog.register_local(session(), a.name, a.path, registry=a.registry).id)
    if key == ("datasets", "unregister-local"):
        return 0 if catalog.remove_local(f"local/{a.name}", a.registry) else _fail(f"no dataset local/{a.name}")
    catalog.export_local(f"local/{a.name}", a.to, a.registry)
    return 0


def _fail(text: str) -> int:
    print(text, file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(run())
