"""The command line: python -m orrery.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json

from .plans import maps
from .session import home, local_session
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Answers questions about registered checkouts, with citations.")
    out.add_argument("--home", default=str(home()), help="where the registry and the indexes are")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, /, **options) -> None:
        own = commands.add_parser(name, help=about)
        for option, how in options.items():
            own.add_argument(option if how.pop("place", False) else f"--{option.replace('_', '-')}", **how)

    place = lambda **how: {"place": True, **how}
    project = commands.add_parser("project", help="manage registered checkouts").add_subparsers(dest="action", required=True)
    add = project.add_parser("add")
    add.add_argument("name")
    add.add_argument("path")
    add.add_argument("--description", default="")
    project.add_parser("list")
    project.add_parser("remove").add_argument("name")
    command("index", "publish a checkout's tables", project=place(), force={"action": "store_true"})
    command("embed", "make vectors of chunks", project=place(), model={"required": True}, encoder={"required": True, "help": "module:function from texts to vectors"}, batch_size={"type": int, "default": 8})
    command("status", "whether indexes match their checkouts")
    command("map", "the files that a question is about", project=place(), question=place(), max_files={"type": int, "default": 16}, semantic_mode={"choices": ["auto", "fast", "code"], "default": "fast"})
    command("inspect", "a symbol's definitions and relations", project=place(), name=place(), path={}, limit={"type": int, "default": 20})
    command("audit", "what the current changes may touch", project=place(), base_ref={"default": "HEAD"}, question={"default": ""}, max_candidates={"type": int, "default": 30})
    return out


def run(store: Store, args: argparse.Namespace) -> object:
    if args.command == "project":
        if args.action == "add":
            return store.registry.add(args.name, args.path, args.description)
        if args.action == "remove":
            return store.unregister(args.name)
        return [{"project": n, **e} for n, e in store.registry.entries().items()]
    if args.command == "index":
        return store.index(args.project, args.force)
    if args.command == "embed":
        module, _, name = args.encoder.partition(":")
        return store.embed(args.project, args.model, getattr(importlib.import_module(module), name), args.batch_size)
    if args.command == "status":
        return store.statuses()
    if args.command == "map":
        return maps.map_context(store, args.project, args.question, args.max_files, args.semantic_mode)
    if args.command == "inspect":
        return maps.inspect_symbol(store, args.project, args.name, args.path, args.limit)
    return maps.audit_change(store, args.project, args.base_ref, args.question, args.max_candidates)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(json.dumps(run(Store(local_session(), args.home), args), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
