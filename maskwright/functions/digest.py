"""SHA-256 whose state can be put away and taken up again in another task; hashlib keeps its own to itself."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
from functools import cache


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX, a public structure of fixed layout."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _openssl() -> ctypes.CDLL | None:
    for name in (_hashlib.__file__, ctypes.util.find_library("crypto")):
        try:
            found = ctypes.CDLL(name) if name else None
            if found and found.SHA256_Init and found.SHA256_Update and found.SHA256_Final:
                found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
                return found
        except (OSError, AttributeError):
            continue
    return None


def resumable() -> bool:
    """True where OpenSSL's library can be reached."""
    return _openssl() is not None


class Sha256:
    """SHA-256 begun anew, or from `state`, the bytes that another one gave."""

    def __init__(self, state: bytes | None = None):
        self._context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            _openssl().SHA256_Init(ctypes.byref(self._context))

    @property
    def state(self) -> bytes:
        return bytes(self._context)

    @property
    def length(self) -> int:
        """Bytes hashed so far."""
        return ((self._context.high << 32) | self._context.low) // 8

    def update(self, address: int, n: int) -> None:
        """Go on with the `n` bytes at a memory address."""
        _openssl().SHA256_Update(ctypes.byref(self._context), address, n)

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(32), _Context.from_buffer_copy(self._context)
        _openssl().SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()
