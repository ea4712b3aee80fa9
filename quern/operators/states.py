"""A guard of states: which change of state is allowed."""

from __future__ import annotations


class StateMachine:
    """states: names; first: the one to begin with; moves: (from, to, why) of the allowed changes."""

    def __init__(self, states: list[str], first: str, moves: list[tuple[str, str, str]]):
        unknown = ({first} | {s for a, b, _ in moves for s in (a, b)}) - set(states)
        if unknown:
            raise ValueError(f"no such states: {sorted(unknown)}")
        self.states, self.state = frozenset(states), first
        self.moves = {(a, b): why for a, b, why in moves}

    def allows(self, to: str) -> bool:
        return (self.state, to) in self.moves

    def check(self, expected: str) -> None:
        if self.state != expected:
            raise RuntimeError(f"the state is {self.state}, not {expected}")

    def to(self, state: str) -> str:
        """Goes to the state and returns why one may; any other change is refused."""
        if state not in self.states:
            raise ValueError(f"no such state: {state}")
        if not self.allows(state):
            raise RuntimeError(f"no way from {self.state} to {state}")
        why, self.state = self.moves[self.state, state], state
        return why

    def compare_and_set(self, expected: str, state: str) -> bool:
        if self.state != expected:
            return False
        self.to(state)
        return True
