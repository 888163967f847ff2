"""Calls that may hang, made in a process of their own."""

from __future__ import annotations

import contextlib
import ctypes
import os
import signal
from collections.abc import Callable
from multiprocessing import Pipe
from typing import Any


class ItemFailed(Exception):
    """What went wrong with one item, as text."""


class Supervised:
    """A function that runs in a child process and is ended when one call takes longer than ``seconds``.

    ``make`` gives the function; it runs in the child, once, and again in a new child after one was ended
    or died. Whatever happens to a call, a result comes back or ``ItemFailed`` is raised, and the next
    call is served. The child leads a process group, so programs it has started end with it, and it ends
    with the task that holds it. Arguments and results are pickled.
    """

    def __init__(self, make: Callable[[], Callable], seconds: float):
        self._make, self._seconds = make, seconds
        self._pid: int | None = None
        self._pipe: Any = None

    def __call__(self, *args):
        if self._pid is None:
            self._start()
        try:
            self._pipe.send(args)
            return self._answer()
        except (EOFError, BrokenPipeError, ConnectionResetError):
            raise ItemFailed(f"the process ended ({self._end()})") from None

    def _answer(self):
        if not self._pipe.poll(self._seconds):
            self._end()
            raise ItemFailed(f"no result within {self._seconds:g} seconds")
        good, value = self._pipe.recv()
        if not good:
            raise ItemFailed(value)
        return value

    def _start(self) -> None:
        ours, theirs = Pipe()
        parent = os.getpid()
        pid = os.fork()
        if pid == 0:
            try:
                os.setsid()
                with contextlib.suppress(Exception):
                    ctypes.CDLL(None).prctl(1, signal.SIGKILL)  # end with the parent
                # Nothing of the task stays open here, its connection to the executor least of all.
                keep = theirs.fileno()
                os.closerange(3, keep)
                os.closerange(keep + 1, 1 << 16)
                if os.getppid() == parent:
                    _serve(theirs, self._make)
            finally:
                os._exit(0)
        theirs.close()
        self._pid, self._pipe = pid, ours
        try:
            self._answer()
        except (EOFError, ConnectionResetError):
            raise ItemFailed(f"the process ended ({self._end()})") from None
        except ItemFailed:
            self.close()
            raise

    def _end(self) -> str:
        """End the child and what it has started; how it ended."""
        with contextlib.suppress(ProcessLookupError):
            os.killpg(self._pid, signal.SIGKILL)
        _, status = os.waitpid(self._pid, 0)
        self._pipe.close()
        self._pid = self._pipe = None
        code = os.waitstatus_to_exitcode(status)
        return f"signal {-code}" if code < 0 else f"exit code {code}"

    def close(self) -> None:
        if self._pid is not None:
            self._end()


def _serve(pipe, make: Callable[[], Callable]) -> None:
    try:
        call = make()
        pipe.send((True, None))
    except Exception as bad:
        pipe.send((False, f"{type(bad).__name__}: {bad}"))
        return
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        try:
            answer = True, call(*args)
        except Exception as bad:
            answer = False, f"{type(bad).__name__}: {bad}"
        try:
            pipe.send(answer)
        except (TypeError, AttributeError, ValueError) as bad:  # a result that cannot be pickled
            pipe.send((False, f"{type(bad).__name__}: {bad}"))
