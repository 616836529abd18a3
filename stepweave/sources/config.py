"""Configuration trees: includes, deep merge, dotted overrides, and stage manifests."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import platform
import time
from collections.abc import Callable
from urllib.parse import urlsplit, urlunsplit

import pyspark

from .sinks import atomic_json


def merge(left: dict, right: dict) -> dict:
    """``right`` over ``left``, key by key."""
    out = dict(left)
    for k, v in right.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def place(path: str) -> str:
    """One name for a file: absolute, or with its scheme where it has one."""
    scheme, host, rest, _, _ = urlsplit(path)
    return urlunsplit((scheme, host, os.path.normpath(rest), "", "")) if scheme else os.path.abspath(path)


def read_local(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def layers(path: str, read: Callable[[str], str] = read_local) -> list[dict]:
    """The trees of a file and all that it includes, in the order in which they are laid over each other: the included first, the file last."""
    out: list[dict] = []
    todo: list[tuple[str, dict | None]] = [(place(path), None)]
    open_files: list[str] = []
    while todo:
        file, own = todo.pop()
        if own is not None:  # all that it includes is out
            open_files.remove(file)
            out.append(own)
            continue
        if file in open_files:
            raise ValueError(f"cycle of includes at {file}")
        own = json.loads(read(file))
        if not isinstance(own, dict):
            raise ValueError(f"{file} holds no object")
        names = own.pop("include", [])
        names = [names] if isinstance(names, str) else names
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise ValueError(f"{file}: include is a path or a list of paths")
        open_files.append(file)
        todo.append((file, own))
        todo += [(place(os.path.join(os.path.dirname(file), n)), None) for n in reversed(names)]
    return out


def put(tree: dict, item: str) -> dict:
    """The tree with ``a.b=value``; the value is JSON if it parses, else text.  A path through a value that is no object is an error."""
    path, eq, raw = item.partition("=")
    keys = path.split(".")
    if not eq or not all(keys):
        raise ValueError(f"no override: {item!r}")
    try:
        value = json.loads(raw)
    except ValueError:
        value = raw
    at = out = merge({}, tree)
    for key in keys[:-1]:
        below = at.get(key, {})
        if not isinstance(below, dict):
            raise ValueError(f"{item!r}: {key} is a value and no object")
        at[key] = at = dict(below)
    at[keys[-1]] = value
    return out


def load(path: str, overrides: list[str] = (), read: Callable[[str], str] = read_local) -> dict:
    """A JSON file over what it includes (a path or a list, relative to it), with overrides ``a.b=value``; ``read`` gives a file's text."""
    tree: dict = {}
    for layer in layers(path, read):
        tree = merge(tree, layer)
    for item in overrides:
        tree = put(tree, item)
    return tree


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


@contextlib.contextmanager
def stage(folder: str, name: str, config: dict, write: Callable[[str, object], None] = atomic_json):
    """A manifest that says RUNNING, then COMPLETE or FAILED, with versions, the configuration's digest and what the stage adds to the value it is given."""
    path = f"{folder}/{name}.json"
    state = {"stage": name, "config": digest(config), "seed": config.get("seed"), "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "started": time.time(), "status": "RUNNING"}
    write(path, state)
    try:
        yield state
    except BaseException as e:
        write(path, state | {"status": "FAILED", "error": repr(e), "ended": time.time()})
        raise
    write(path, state | {"status": "COMPLETE", "ended": time.time()})
