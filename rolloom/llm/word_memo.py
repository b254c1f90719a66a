"""A bounded memo from words to what a tokenizer makes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Generic, TypeVar

V = TypeVar("V")
LONG = 256  # characters


class WordMemo(Generic[V]):
    """Values of words, made once for many words at a time.

    Two generations of at most about ``capacity`` words: when the young one is full it becomes the
    old one, from which words that occur again are carried over. The memo changes no result, only
    how often a word is made again.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[V]], capacity: int = 300_000):
        self._make = make
        self._capacity = capacity
        self._young: dict[str, V] = {}
        self._old: dict[str, V] = {}
        self._long: list[str] = []  # words kept for one call only

    def covering(self, words: set[str]) -> dict[str, V]:
        """A mapping that holds at least ``words``; valid until the next call."""
        if len(self._young) > self._capacity:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        for word in self._long:
            young.pop(word, None)
        missing = []
        for word in words.difference(young):
            value = old.get(word)
            if value is None:
                missing.append(word)
            else:
                young[word] = value
        if missing:
            young.update(zip(missing, self._make(missing), strict=True))
        self._long = [word for word in missing if len(word) > LONG]
        return young
