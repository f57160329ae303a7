"""Sums that the tasks of a barrier stage make with each other."""

from __future__ import annotations

import hmac
import secrets
import socket

import numpy as np
from pyspark import BarrierTaskContext

#: Seconds in which tasks must have found each other.
PATIENCE = 30


class Links:
    """A link from each task to the first one. Messages of Spark's own barrier take a second each, so that it only introduces tasks.

    ``all``: whether every task has its link, the same in all tasks.
    """

    def __init__(self, context: BarrierTaskContext) -> None:
        self.me, self.links = context.partitionId(), []
        hosts = [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
        server, word = (socket.create_server(("", 0), backlog=len(hosts)), secrets.token_hex(16)) if self.me == 0 else (None, "")
        port, word = context.allGather(f"{server.getsockname()[1]} {word}" if server else "")[0].split()
        try:
            self.links = self._accepted(server, word, len(hosts)) if server else [self._called(hosts[0], int(port), word)]
            fine = True
        except OSError:
            fine = False
        finally:
            if server:
                server.close()
        self.all = all(x == "fine" for x in context.allGather("fine" if fine else "alone"))

    def _accepted(self, server: socket.socket, word: str, n: int) -> list[socket.socket]:
        """Links to the other tasks in their order; callers that don't know the word are turned away."""
        server.settimeout(PATIENCE)
        found: dict[int, socket.socket] = {}
        while len(found) < n - 1:
            link, _ = server.accept()
            link.settimeout(PATIENCE)
            said = _read(link, len(word) + 4)
            if hmac.compare_digest(said[:-4], word.encode()):
                found[int.from_bytes(said[-4:], "little")] = link
            else:
                link.close()
        return [_ready(found[k]) for k in sorted(found)]

    def _called(self, host: str, port: int, word: str) -> socket.socket:
        link = socket.create_connection((host, port), PATIENCE)
        link.sendall(word.encode() + self.me.to_bytes(4, "little"))
        return _ready(link)

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays of doubles, added in the order of tasks."""
        if self.me:
            self.links[0].sendall(own.tobytes())
            return np.frombuffer(_read(self.links[0], own.nbytes))
        for link in self.links:
            own = own + np.frombuffer(_read(link, own.nbytes))
        for link in self.links:
            link.sendall(own.tobytes())
        return own

    def __enter__(self) -> Links:
        return self

    def __exit__(self, *_) -> None:
        for link in self.links:
            link.close()


def _ready(link: socket.socket) -> socket.socket:
    link.settimeout(None)
    link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return link


def _read(link: socket.socket, size: int) -> bytes:
    out = bytearray()
    while len(out) < size:
        part = link.recv(size - len(out))
        if not part:
            raise ConnectionError("a task that shares the sweeps is gone")
        out += part
    return bytes(out)
