"""SHA-256 that can be stopped after any byte and taken up by another process."""

from __future__ import annotations

import ctypes
import ctypes.util


class _Context(ctypes.Structure):
    """``SHA256_CTX`` of OpenSSL's public header ``openssl/sha.h``."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint), ("md_len", ctypes.c_uint),
    ]


STATE_BYTES = ctypes.sizeof(_Context)


def _crypto() -> ctypes.CDLL:
    library = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
    library.SHA256_Init.argtypes = [ctypes.c_void_p]
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return library


class Sha256:
    """hashlib has no way to store a half-done hash; OpenSSL, which it uses, has. States fit machines of one kind."""

    def __init__(self, state: bytes | None = None):
        self._library = _crypto()
        self._context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            self._library.SHA256_Init(ctypes.byref(self._context))

    def update(self, content: bytes) -> None:
        self._library.SHA256_Update(ctypes.byref(self._context), content, len(content))

    def state(self) -> bytes:
        return bytes(self._context)

    def length(self) -> int:
        """Bytes taken in so far."""
        return (self._context.high << 32 | self._context.low) // 8

    def hexdigest(self) -> str:
        last, out = _Context.from_buffer_copy(self.state()), ctypes.create_string_buffer(32)
        self._library.SHA256_Final(out, ctypes.byref(last))
        return out.raw.hex()
