"""Errors of input; each can say what to do about it."""

from __future__ import annotations


class InputError(Exception):
    """Something about the input; the command line ends with status 2."""

    def __init__(self, message: str, remedy: str = "") -> None:
        super().__init__(message)
        self.remedy = remedy


class ManifestNotFound(InputError):
    pass


class ManifestUnreadable(InputError):
    pass


class ManifestTooLarge(InputError):
    pass


class UnsupportedVersion(InputError):
    pass


class UnsafePath(InputError):
    pass


class CycleError(InputError):
    """Nodes depend on each other; ``members`` names them."""

    def __init__(self, members: list[str]) -> None:
        super().__init__("dependency cycle: " + " -> ".join(members))
        self.members = members
