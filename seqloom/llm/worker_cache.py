"""Objects kept between the tasks of one Python worker (compiled tables, word memos).

The package's functions reach the workers by value, so module globals live for one
task only; a module entered in ``sys.modules`` lives as long as the worker. Whatever
is kept here is derived from the key and only saves time: a new worker makes it again.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

_NAME = "_seqloom_worker_cache"
KEEP = 4


def kept(key: tuple, make: Callable[[], object]):
    store = sys.modules.get(_NAME)
    if store is None:
        store = sys.modules[_NAME] = types.ModuleType(_NAME)
        store.items = {}
    if key not in store.items:
        while len(store.items) >= KEEP:
            store.items.pop(next(iter(store.items)))
        store.items[key] = make()
    return store.items[key]
