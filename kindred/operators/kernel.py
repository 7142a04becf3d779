"""The n-gram generator: from one query to its weighted n-grams.

A pure function of the query's text and of what the dimension tables say about its words. Spark
calls it through ``parsing.parse``.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from kindred.functions.text import BLANKED, DELETED, MAX_WORDS, MISSING_RELEVANCE, UMLAUTS

INDEX, SEARCH = "index", "search"
_MARKS = str.maketrans(BLANKED, " " * len(BLANKED), DELETED)
_DIGITS = re.compile(r"(?=\d\d)(?:(?<=[A-Za-z]{2})|(?<=\s)|^)\d+")


def size(word: str) -> int:
    """Bytes of a word."""
    return len(word) if word.isascii() else len(word.encode())


def has_number(word: str) -> bool:
    return not (word.isascii() and word.isalpha()) and any(c.isnumeric() for c in word)


def normalize(query: str) -> str:
    out = query.translate(_MARKS).lower()
    if not out.isascii():
        for mark, spelled in UMLAUTS:
            out = out.replace(mark, spelled)
    return _DIGITS.sub(r" \g<0> ", out).strip()


def bag(*parts: str) -> str:
    """The parts in byte order, which is that of code points."""
    if len(parts) == 1:
        return parts[0]
    if len(parts) == 2:
        a, b = parts
        return f"{a} {b}" if a <= b else f"{b} {a}"
    if len(parts) == 3 and parts[0] == parts[1] < parts[2]:
        return f"{parts[2]} {parts[0]} {parts[1]}"
    return " ".join(sorted(parts))


def tokenize(query: str, mode: str, dictionary: dict[str, str]) -> tuple[list[str], dict[int, str]]:
    """The words of a query, and in search mode the synonyms of some, by place.

    Single letters don't stand alone: they belong to the word before them. Where all words are
    short, everything fuses into one word; else search mode tries the letters glued on as a
    synonym of the last word that has some, in reverse.
    """
    words: list[str] = []
    letters: list[tuple[int, str]] = []
    for i, piece in enumerate(normalize(query).split(" ")):
        word = piece.strip()
        if size(word) > 1 or word and (i == 0 or word in "0123456789"):
            words.append(piece)
        elif word and word.isalpha():
            letters.append((len(words) - 1, word))
    kept = words[:MAX_WORDS]
    if not kept:
        return [], {}
    if (len(kept) > 2 or letters) and all(size(w) <= 4 for w in kept):
        glued = list(kept)
        waiting = deque(letters)
        for k in range(len(glued)):
            while waiting and waiting[0][0] == k:
                glued[k] += waiting.popleft()[1]
        if len(glued) > 1 and all(size(w) <= 4 for w in glued):
            return ["".join(glued)], {}
        return glued, {}
    if mode != SEARCH:
        return kept, {}
    synonyms: dict[int, str] = {}
    for k, word in enumerate(kept):
        tail = ""
        while letters and letters[-1][0] == k:
            tail += letters.pop()[1]
        if tail:
            synonyms[k] = word + tail
    present = set(kept)
    for k, word in enumerate(kept):
        if k not in synonyms and word in dictionary and dictionary[word] not in present:
            synonyms[k] = dictionary[word]
    return kept, synonyms


@dataclass
class Lookup:
    """What the dimension tables say."""

    relevance: Callable[[str], int | None]
    stop: Callable[[str], bool]
    toponym: Callable[[str], bool]
    dictionary: dict[str, str] = field(default_factory=dict)


@dataclass
class Weighed:
    """The words of a query by kind, with their shares of its relevance."""

    content: list[int]
    stops: list[int]
    shares: list[float]
    must: list[int]
    numeric: set[int]


def _known(relevance: int | None) -> float:
    return float(MISSING_RELEVANCE if relevance is None else relevance)


def weigh(words: list[str], synonyms: dict[int, str], look: Lookup) -> Weighed:
    content, stops, numeric, seen = [], [], set(), set()
    rels: list[float] = []
    total = 0.0
    top_number, top_place = (0.0, None), (0.0, None)
    for k, word in enumerate(words):
        rel = _known(look.relevance(word))
        if look.stop(word) or size(word) == 1:
            rel /= 2
            total += rel
            stops.append(k)
        else:
            if k in synonyms:
                rel = max(rel, _known(look.relevance(synonyms[k])))
            if word not in seen:
                total += rel
            if has_number(word):
                numeric.add(k)
                if rel > top_number[0]:
                    top_number = rel, k
            if look.toponym(word) and rel > top_place[0]:
                top_place = rel, k
            content.append(k)
        rels.append(rel)
        if word not in seen:
            seen.add(word)
            if word in look.dictionary:
                other = look.dictionary[word]
                seen.add(other)
                if look.toponym(other) and rel > top_place[0]:
                    top_place = rel, k
    shares = [r / total if total else 0.0 for r in rels]
    least = min(range(len(words)), key=lambda k: rels[k])
    if not stops and len(words) > 3 and shares[least] < 1 / (2 * len(words) + 1):
        stops = [least]
        content.remove(least)
    must = [top_number[1]] if top_number[1] is not None else []
    if top_place[1] is not None and top_place[1] not in must:
        must.append(top_place[1])
    return Weighed(content, stops, shares, must, numeric)


@dataclass
class Unit:
    """One to three words, or more at the end, that stand together."""

    text: str
    share: float
    ids: list[int]
    variants: list[str] = field(default_factory=list)


class Grouping:
    """Attaches stopwords to their neighbours; each rule below answers for one kind of place."""

    def __init__(self, words: list[str], w: Weighed, synonyms: dict[int, str], mode: str):
        self.words, self.shares, self.stop = words, w.shares, set(w.stops)
        self.synonyms = synonyms if mode == SEARCH else {}
        self.queue = deque(w.content)
        self.last = len(words) - 1
        self.units: list[Unit] = []
        self.linked: set[int] = set()
        self.skipped: set[int] = set()
        for i in w.stops:
            if i not in self.skipped:
                self._place(i)
        for k in self.queue:
            if k not in self.linked:
                self._emit(k)

    def _emit(self, *ids: int) -> None:
        own = [self.words[k] for k in ids]
        variants = [bag(*own[:n], self.synonyms[k], *own[n + 1 :]) for n, k in enumerate(ids) if k in self.synonyms] if self.synonyms else []
        share = 0 + self.shares[ids[0]] if len(ids) == 1 else sum(self.shares[k] for k in ids)
        self.units.append(Unit(bag(*own), share, list(ids), variants))

    def _unit(self, *ids: int) -> None:
        self.linked.update(ids)
        self._emit(*ids)

    def _alone(self, k: int) -> None:
        if k not in self.linked:
            self._unit(k)

    def _content_before(self, j: int) -> None:
        """Content words before ``j`` go out alone. The word that ends the search is not put back."""
        if not self.queue:
            return
        k = self.queue.popleft()
        while k < j and k not in self.linked and self.queue:
            self._unit(k)
            k = self.queue.popleft()

    def _place(self, i: int) -> None:
        if i == 0:
            self._first()
            return
        self._content_before(i - 1)
        if i == self.last:
            self._at_end(i)
            return
        before, after = i - 1 in self.stop, i + 1 in self.stop
        if before and after:
            self._between_stops(i)
        elif before:
            self._unit(i, i + 1)
        elif after:
            self._before_stop(i)
        else:
            self._between_content(i)

    def _first(self) -> None:
        self.skipped.add(1)
        if 1 not in self.stop or self.last == 1:
            self._unit(0, 1)
            return
        if 2 in self.stop:
            self.skipped.add(2)
        self._unit(0, 1, 2)

    def _before_stop(self, i: int) -> None:
        j, k = i - 1, i + 1
        further = k < self.last
        if further and k + 1 not in self.stop and self.shares[k + 1] >= self.shares[j]:
            self._alone(j)
            self.skipped |= {k, k + 1}
            self._unit(i, k, k + 1)
        elif further and self.shares[j] > self.shares[k + 1] and j not in self.linked:
            self._unit(j, i)
        else:
            self.skipped.add(k)
            self._unit(i, k)

    def _between_stops(self, i: int) -> None:
        k = i + 1
        self.skipped.add(k)
        if k == self.last or k + 1 in self.stop:
            self._unit(i, k)
        else:
            self.skipped.add(k + 1)
            self._unit(i, k, k + 1)

    def _between_content(self, i: int) -> None:
        j, k = i - 1, i + 1
        left, right = self.words[j], self.words[k]
        free = j not in self.linked
        longer = size(left) >= 4 * size(right)
        letter = size(self.words[i]) == 1 and (self.shares[j] > self.shares[k] or all(c.isnumeric() for c in right))
        if right in {self.words[x] for x in self.linked} or free and (longer or letter):
            self._unit(j, i)
            return
        self.linked |= {i, k}
        self._alone(j)
        self._emit(i, k)

    def _at_end(self, i: int) -> None:
        if i - 1 not in self.linked:
            self._unit(i - 1, i)
            return
        self.linked.add(i)
        unit = self.units[-1]
        unit.text = bag(unit.text, self.words[i])
        unit.share += self.shares[i]
        unit.ids.append(i)


def must_have(ranked: list[int], w: Weighed, bound: float) -> tuple[int | None, list[int]]:
    """The word that must be found, and all that must."""
    n, share = len(ranked), w.shares
    found, top = list(w.must), ranked[0]
    word = found[0] if found else None

    def add(k: int) -> None:
        if k not in found:
            found.append(k)

    clear = share[top] > 1.85 * bound or n > 1 and share[top] > 0.6
    if clear or n > 2 and share[top] > bound > share[ranked[2]]:
        add(top)
        return top, found
    if n <= 3 and found:
        add(top)
        return word, found
    if n <= 6:
        second = ranked[1]
        if second in found or share[second] < (0.78 if n > 4 else 0.85) * share[top]:
            for k in ranked:
                if k not in w.numeric and k not in found:
                    add(k)
                    return k, found
    return word, found


@dataclass
class Parsed:
    ngrams: dict[str, tuple[float, list[int]]]
    words: list[str]
    shares: list[float]
    must: list[int]
    synonyms: dict[int, str]


def _pairs(units: list[Unit], n: int, ngrams: dict[str, tuple[float, list[int]]]) -> None:
    """Units and pairs of units; most of the generator's time goes here."""
    bound = 1.8 / n
    for i, a in enumerate(units):
        left, part, ids = a.text, a.share, a.ids
        if len(ids) > 1 and part > bound:
            for text in (left, *a.variants):
                ngrams.setdefault(text, (part, ids))
        for step, b in enumerate(units[i + 1 :]):
            right = b.text
            if left == right:
                break
            share = (1 - step / 100) * (part + b.share)
            if step < 3 or share >= bound:
                text = f"{left} {right}" if left <= right else f"{right} {left}"
                if text not in ngrams:
                    ngrams[text] = share, ids + b.ids
                    for text in a.variants:
                        ngrams.setdefault(bag(text, right), (share, ids + b.ids))
                    for text in b.variants:
                        ngrams.setdefault(bag(left, text), (share, b.ids + ids))


def parse(query: str | None, mode: str, look: Lookup, tokens: tuple[list[str], dict[int, str]] | None = None) -> Parsed:
    """N-grams with their shares and words, in the order of emission; the first of a text counts."""
    words, synonyms = tokens if tokens is not None else tokenize(query or "", mode, look.dictionary)
    if not words:
        return Parsed({}, [], [], [], {})
    if len(words) == 1:
        return Parsed({words[0]: (1.0, [0])}, words, [1.0], [0], synonyms)
    n = len(words)
    w = weigh(words, synonyms, look)
    units = Grouping(words, w, synonyms, mode).units
    ngrams: dict[str, tuple[float, list[int]]] = {}

    def both(swap: int, *groups: tuple[int, ...]) -> None:
        """N-grams of words, and in search mode the same with one word's synonym."""
        other = {swap: synonyms[swap]} if mode == SEARCH and swap in synonyms else {}
        for swapped in ({}, other)[: 1 + bool(other)]:
            for ids in groups:
                text = bag(*[swapped.get(k, words[k]) for k in ids])
                if text not in ngrams:
                    ngrams[text] = sum([w.shares[k] for k in ids]), list(ids)

    _pairs(units, n, ngrams)
    ranked = sorted(range(n), key=lambda k: -w.shares[k])
    share = [w.shares[k] for k in ranked]
    bound = 1 / max(2, n - 1)
    first, second = ranked[:2]
    if n < 4 or share[0] > 1.5 * share[1]:
        both(first, (first,))
    if share[1] > 0.8 * share[0]:
        both(second, (second,))
    word, must = must_have(ranked, w, bound)
    if mode == SEARCH and n < 5 and word is not None:
        both(word, (word,))
    if n > 3:
        third, least = ranked[2], ranked[-1]
        both(first, (first, second, third))
        if share[0] <= bound:
            both(first, (first, least))
        else:
            both(second, (second, least), (second, third))
    if n >= 3:
        both(first, (first, second))
    if n >= 4:
        both(first, (first, ranked[2]))
    return Parsed(ngrams, words, w.shares, must, synonyms)
