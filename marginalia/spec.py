"""Frozen option records that the operators take."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LineSpec:
    """Which lines of a text to keep and how to show them.

    A line is a hit when it matches every ``include`` pattern and no ``remove`` pattern. ``before`` and
    ``after`` pull in neighbouring lines; neighbours that match ``remove`` are blanked or left out.
    """

    include: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    before: int = 0
    after: int = 0
    numbers: bool = False

    def __post_init__(self) -> None:
        if self.before < 0 or self.after < 0:
            raise ValueError("context line counts must not be negative")

    @property
    def filters(self) -> bool:
        return bool(self.include or self.remove)

    @property
    def has_context(self) -> bool:
        return self.before + self.after > 0

    @classmethod
    def around(cls, count: int, **options) -> "LineSpec":
        """The same number of lines before and after."""
        return cls(before=count, after=count, **options)


@dataclass(frozen=True)
class Instruction:
    """One model instruction; ``criteria`` limits it to an extension, a site or an exact name."""

    text: str
    criteria: str = ""


@dataclass(frozen=True)
class FileSpec:
    """Which files to select. Empty ``globs`` means everything."""

    globs: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    ignore_lines: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    not_contains: tuple[str, ...] = ()
    lines: LineSpec = field(default_factory=LineSpec)
    instructions: tuple[Instruction, ...] = ()

    @classmethod
    def containing(cls, *patterns: str, lines: LineSpec = LineSpec(), **options) -> "FileSpec":
        """The same patterns at file and at line level."""
        both = LineSpec(lines.include + patterns, lines.remove, lines.before, lines.after, lines.numbers)
        return cls(contains=patterns, lines=both, **options)


@dataclass(frozen=True)
class SearchSpec:
    """How to select search hits and show their pages."""

    max_results: int = 10
    exclude_urls: tuple[str, ...] = ()
    own_hosts: tuple[str, ...] = ()
    get_content: bool = False
    strip: bool = False
    provider: str = "Corpus"
    instructions: tuple[Instruction, ...] = ()
