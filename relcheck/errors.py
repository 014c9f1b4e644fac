"""Outcomes that aren't values."""


class SpecError(ValueError):
    """What keeps a declaration or a source from being read; code names the kind, row the line if there is one."""

    def __init__(self, code: str, detail: str, row: int | None = None):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail, self.row = code, detail, row


class Unreadable(Exception):
    """A source that isn't read; found is a DataFrame (code, row, detail) of what is wrong with it, however much that is."""

    def __init__(self, found):
        super().__init__("the source isn't readable")
        self.found = found


class Undecidable(Exception):
    """A query that has no value. A check that asks it fails; it never passes silently."""


class Unsupported(Undecidable):
    """A query that the closed algebra doesn't express."""
