"""Keeps what is dear to build between the tasks of one Python worker.

Helpers travel to the executors by value, so their module's globals are new in each task. The one
object kept here lives in a module of the worker process itself; building another one replaces it,
which bounds a worker's memory when it serves several operators.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import TypeVar

V = TypeVar("V")
_HOME = "_rolloom_worker"


def kept(key: Hashable, build: Callable[[], V]) -> V:
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if home.get("key") != key:
        home.pop("value", None)
        home["key"] = None
        home["value"] = build()
        home["key"] = key
    return home["value"]
