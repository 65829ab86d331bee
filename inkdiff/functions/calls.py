"""Calls that may hang, in a bounded pool of processes with a time limit and a breaker; and models loaded once a process."""

from __future__ import annotations

import multiprocessing
import time
import warnings
from collections.abc import Callable, Sequence
from multiprocessing.connection import wait

WORKERS = 8


def _serve(function: Callable, pipe) -> None:
    while True:
        item = pipe.recv()
        try:
            answer = True, function(item)
        except Exception as e:
            answer = False, (str(e) or type(e).__name__)
        try:
            pipe.send(answer)
        except Exception as e:  # an answer that cannot be sent
            pipe.send((False, str(e)))


class _Child:
    def __init__(self, function: Callable) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.process = context.Process(target=_serve, args=(function, other), daemon=True)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)  # of forks beside threads: the child only calls and answers
            self.process.start()
        other.close()
        self.at, self.until = -1, 0.0

    def end(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()


def call_each(function: Callable, items: Sequence, limit: float, workers: int = WORKERS) -> list:
    """function(item) of each item, or the error in its place; a call that takes more than `limit` seconds is ended.

    At most `workers` calls run at once, each in a process of its own, so that a hung one can be ended and nothing is
    left of it. When as many calls as there are workers end so one after another, without an answer between them, the
    function counts as dead: what was not asked yet gets an error at once. So the whole takes about one limit then.
    """
    out: list = [None] * len(items)
    following, silent = 0, 0
    children: list[_Child] = []
    busy: list[_Child] = []
    try:
        while following < len(items) or busy:
            if silent >= workers:
                for k in range(following, len(items)):
                    out[k] = TimeoutError(f"not asked, as {silent} calls had no reply")
                following = len(items)
            while following < len(items) and len(busy) < workers - silent:
                child = next((c for c in children if c not in busy), None)
                if child is None:
                    children.append(child := _Child(function))
                child.pipe.send(items[following])
                child.at, child.until, following = following, time.monotonic() + limit, following + 1
                busy.append(child)
            if not busy:
                break
            ready = wait([c.pipe for c in busy], max(0.0, min(c.until for c in busy) - time.monotonic()))
            for child in list(busy):
                if child.pipe in ready:
                    try:
                        good, value = child.pipe.recv()
                        out[child.at] = value if good else RuntimeError(value)
                        silent = 0
                    except EOFError:
                        out[child.at] = RuntimeError("the call's process ended")
                        children.remove(child)
                        child.end()
                    busy.remove(child)
                elif time.monotonic() >= child.until:
                    out[child.at] = TimeoutError(f"no reply after {limit} s")
                    silent += 1
                    busy.remove(child)
                    children.remove(child)
                    child.end()
    finally:
        for child in children:
            child.end()
    return out


_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable) -> object | None:
    """What load() gave in this process under that name; it is not tried again. None if it failed."""
    if name not in _LOADED:
        try:
            _LOADED[name] = load()
        except Exception:
            _LOADED[name] = None
    return _LOADED[name]
