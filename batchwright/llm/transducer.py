"""Weighted finite-state transducers and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: arcs lead from (state, symbol) to (state, output, weight).

    Weights multiply along a composition. A symbol for which a state has no arc cannot be read.
    """

    start: Hashable
    arcs: dict[tuple[Hashable, Hashable], tuple[Hashable, Hashable, float]]

    def run(self, symbols: Iterable[Hashable]) -> list[tuple[Hashable, float]]:
        """(output, weight) of each symbol read."""
        state, out = self.start, []
        for symbol in symbols:
            state, output, weight = self.arcs[state, symbol]
            out.append((output, weight))
        return out


def build(start: Hashable, symbols: Sequence[Hashable], step: Callable) -> Transducer:
    """The transducer of all states that `step(state, symbol) -> (state, output, weight)` reaches from the start."""
    arcs, open_states, seen = {}, [start], {start}
    while open_states:
        state = open_states.pop()
        for symbol in symbols:
            arcs[state, symbol] = found = step(state, symbol)
            if found[0] not in seen:
                seen.add(found[0])
                open_states.append(found[0])
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` makes of its output."""
    symbols = list(dict.fromkeys(symbol for _, symbol in first.arcs))

    def step(state, symbol):
        one, middle, weight = first.arcs[state[0], symbol]
        two, output, factor = second.arcs[state[1], middle]
        return (one, two), output, weight * factor

    return build((first.start, second.start), symbols, step)
