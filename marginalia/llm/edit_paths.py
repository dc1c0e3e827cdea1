"""Cheapest edits that give a row of turns its structure, with the first of equally cheap ones in ASCII order.

The audit of an edited row of turns has a letter per edit: ``K`` keep, ``R`` give another role, ``D`` delete, ``I``
insert an empty turn. Roles then read, by their initials, ``(s?(ua)+)?``. Edits so far are linked nodes that share their
beginnings; each node knows its ancestors at distances of powers of two and a rolling hash of its letters, so that
two of equal cost are compared at the first letter in which they differ, found by bisection over the ancestors.
"""

from __future__ import annotations

from collections.abc import Sequence

KEEP, RENAME, DELETE, INSERT, FLAWED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
MODULUS = (1 << 61) - 1
BASE = 1_000_003
#: From which states a user or an assistant turn may follow, and the state after it.
BEFORE_USER, BEFORE_ASSISTANT = (START, SYSTEM, ASSISTANT), (USER,)
#: What completes the turns that end in each state: its cost and letters.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


class Edit:
    """The last of a list of edits; ``ancestors[k]`` is the edit 2**k before it."""

    __slots__ = ("letter", "depth", "sign", "ancestors")

    def __init__(self, before: Edit | None, letter: str) -> None:
        self.letter = letter
        if before is None:
            self.depth, self.sign, self.ancestors = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.sign = (before.sign * BASE + ord(letter)) % MODULUS
        ancestors, k = [before], 0
        while k < len(ancestors[k].ancestors):
            ancestors.append(ancestors[k].ancestors[k])
            k += 1
        self.ancestors = ancestors

    def letters(self) -> str:
        row, edit = [], self
        while edit.depth:
            row.append(edit.letter)
            edit = edit.ancestors[0]
        return "".join(reversed(row))


def _at_depth(edit: Edit, depth: int) -> Edit:
    while edit.depth > depth:
        edit = edit.ancestors[(edit.depth - depth).bit_length() - 1]
    return edit


def _same_letters(a: Edit, b: Edit) -> bool:
    """Whether two edits of one depth have the same letters before them too; stops where the lists join."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.ancestors[0], b.ancestors[0]
    return True


def compare(a: Edit, b: Edit) -> int:
    """Below, at or above 0 as the letters of ``a`` come before, equal or come after those of ``b``."""
    if a is b:
        return 0
    depth = min(a.depth, b.depth)
    x, y = _at_depth(a, depth), _at_depth(b, depth)
    if x.sign == y.sign:
        if _same_letters(x, y):
            return a.depth - b.depth
    else:
        for k in reversed(range(len(x.ancestors))):
            if k < len(x.ancestors) and x.ancestors[k].sign != y.ancestors[k].sign:
                x, y = x.ancestors[k], y.ancestors[k]
        if x.letter != y.letter and _same_letters(x.ancestors[0], y.ancestors[0]):
            return -1 if x.letter < y.letter else 1
    # Two different lists had one hash: compare the letters themselves.
    left, right = a.letters(), b.letters()
    return (left > right) - (left < right)


Choice = tuple[int, Edit, str]  # cost, edits before, letter


def _better(now: Choice | None, other: Choice) -> Choice:
    """The cheaper of two, of equally cheap ones the one whose letters come first."""
    if now is None or other[0] < now[0]:
        return other
    if other[0] == now[0] and compare(Edit(other[1], other[2]), Edit(now[1], now[2])) < 0:
        return other
    return now


def paths(initials: str, kinds: Sequence[int], entry: int) -> dict[int, tuple[int, str]]:
    """``{exit state: (cost, letters)}`` of the best edits of a stretch of turns that is entered in state ``entry``.

    ``kinds`` has 0 for a sound turn, 1 for a flawed one (1 more unless deleted), 2 for one that has to go. Insertions
    stand before turns only; those after the last turn are in ``ENDING``. So no list of letters of a stretch begins
    with another one, and which comes first is decided within the stretch.
    """
    now: dict[int, tuple[int, Edit]] = {entry: (0, Edit(None, ""))}
    for initial, kind in zip(initials, kinds):
        opened: dict[int, Choice] = {}
        for state in BEFORE_USER:
            if state in now:
                opened[USER] = _better(opened.get(USER), (now[state][0] + INSERT, now[state][1], "I"))
        inserted = dict(now)
        if USER in opened:
            _settle(inserted, USER, opened[USER])
        if USER in inserted:
            cost, edit = inserted[USER]
            _settle(inserted, ASSISTANT, (cost + INSERT, edit, "I"))
        found: dict[int, Choice] = {}
        for state, (cost, edit) in inserted.items():
            found[state] = _better(found.get(state), (cost + DELETE, edit, "D"))
            if kind == 2:
                continue
            flaw = FLAWED if kind else 0
            after = ASSISTANT if state in BEFORE_ASSISTANT else USER
            found[after] = _better(found.get(after), (cost + RENAME + flaw, edit, "R"))
            if initial == "s" and state == START:
                found[SYSTEM] = _better(found.get(SYSTEM), (cost + KEEP + flaw, edit, "K"))
            elif initial == ("a" if after == ASSISTANT else "u"):
                found[after] = _better(found.get(after), (cost + KEEP + flaw, edit, "K"))
        now = {state: (cost, Edit(edit, letter)) for state, (cost, edit, letter) in found.items()}
    return {state: (cost, edit.letters()) for state, (cost, edit) in now.items()}


def _settle(states: dict[int, tuple[int, Edit]], state: int, choice: Choice) -> None:
    cost, edit, letter = choice
    held = states.get(state)
    if held is None or cost < held[0]:
        states[state] = (cost, Edit(edit, letter))
    elif cost == held[0]:
        made = Edit(edit, letter)
        if compare(made, held[1]) < 0:
            states[state] = (cost, made)


def unfold(initials: str, letters: str, entry: int) -> list[tuple[str, str]]:
    """For each turn what its letters mean: the roles inserted before it, and ``K``, ``D`` or the initial it is given."""
    state, before, out, at = entry, "", [], 0
    for letter in letters:
        following = "a" if state in BEFORE_ASSISTANT else "u"
        if letter == "I":
            before += following
        else:
            out.append((before, following if letter == "R" else letter))
            before = ""
            at += 1
            if letter == "K" and initials[at - 1] == "s":
                state = SYSTEM
                continue
        if letter != "D":
            state = ASSISTANT if following == "a" else USER
    return out
