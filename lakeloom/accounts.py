"""The engine's user: its host pattern and password hash."""

from __future__ import annotations

from dataclasses import dataclass

from lakeloom.errors import EngineError
from lakeloom.functions import passwords


@dataclass(frozen=True)
class User:
    name: str
    host: str
    password: str  # hashed

    def admits(self, name: str, host: str, password: str) -> bool:
        return self.name == name and host_matches(self.host, host) and passwords.verified(password, self.password)


def host_matches(pattern: str, host: str) -> bool:
    """Equal, or what stands before a % begins the host; a lone % is any host."""
    return host.startswith(pattern.split("%")[0]) if "%" in pattern else pattern == host


def denied(name: str, host: str) -> EngineError:
    return EngineError(f"access denied for user '{name}'@'{host}'")
