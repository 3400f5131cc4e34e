"""Mapping free-entered values to a canonical list.

The entries of the list, and every alias path to them, stand in one trie per field. A typed value is
compiled to a Levenshtein automaton (insert, delete, replace and swap of neighbours cost one each) and
the automaton and the trie are walked together, which yields every entry within the distance that
its length allows. The trie holds the reference list (bounded, fixed), so it goes to the workers
as a closure; rows never move: the search is a narrow stage, memoized per distinct value in a worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.canon_aliases import ALIASES, COMPASS, TAILS
from ledgerloom.runtime import bounded

NONE = "(none)"
#: What people write around a value: a lead-in, a remark, an aside.
_ASIDES = re.compile(r"^\W*now\s*:|\s-\s*confirmed\W*$|,\s*see\s+crm\W*$|\(\s*per\s+app\s*\)\W*$|\bas\s+of\s+[\d/.-]+\W*$", re.I)
_MEMO = 200_000
#: A reference list with more entries than this is refused: its trie would not fit beside a worker's other work.
LIST_ROWS = 200_000


def key_of(text: str) -> str:
    """Letters and digits of the value without accents, case, remarks and spacing."""
    text = re.sub(r"[_\s]+", " ", text).strip()
    for _ in range(3):
        text = _ASIDES.sub("", text).strip()
    flat = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in flat if c.isalnum())


def reach(length: int, typed: int = 99) -> int:
    """Edits allowed for an entry of this many letters; a short entry may take two if letters were added to it."""
    if length <= 3:
        return 0
    if length <= 5:
        return 2 if typed > length else 1
    return 2 if length <= 16 else 3


class Automaton:
    """Levenshtein automaton of one word with swaps; states are sets of (place, edits, swap pending)."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.memo: dict[tuple[frozenset, str], frozenset] = {}

    def start(self) -> frozenset:
        return self._close({(0, 0, False)})

    def _close(self, at: set) -> frozenset:
        best: dict[tuple[int, bool], int] = {}
        for i, e, s in at:
            if e <= self.most and e < best.get((i, s), 99):
                best[i, s] = e
        for i in range(len(self.word)):  # a letter of the word left out
            e = best.get((i, False))
            if e is not None and e < self.most and e + 1 < best.get((i + 1, False), 99):
                best[i + 1, False] = e + 1
        return frozenset((i, e, s) for (i, s), e in best.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        known = self.memo.get((state, c))
        if known is not None:
            return known
        w, n, out = self.word, len(self.word), set()
        for i, e, swap in state:
            if swap:
                if c == w[i]:
                    out.add((i + 2, e, False))
                continue
            if i < n:
                out.add((i + 1, e + (c != w[i]), False))
                if i + 1 < n and c == w[i + 1] != w[i]:
                    out.add((i, e + 1, True))
            out.add((i, e + 1, False))
        self.memo[state, c] = res = self._close(out)
        return res

    def distance(self, state: frozenset) -> int | None:
        n = len(self.word)
        return min((e for i, e, s in state if i == n and not s), default=None)


class Trie:
    """Reference entries with alias paths; a node knows the largest distance any entry below allows."""

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.entries: list[tuple[str, str, int]] = []
        self.most = -1

    def add(self, key: str, code: str, rank: int) -> None:
        node, r = self, reach(len(key))
        node.most = max(node.most, r)
        for c in key:
            node = node.next.setdefault(c, Trie())
            node.most = max(node.most, r)
        if all(code != have for _, have, _ in node.entries):
            node.entries.append((key, code, rank))

    def search(self, key: str) -> list[tuple[int, str, str, int]]:
        """(distance, alias, code, rank) of every entry within the distance its length allows."""
        auto, found = Automaton(key, self.most), []
        stack = [(self, auto.start())]
        while stack:
            node, state = stack.pop()
            if node.entries:
                d = auto.distance(state)
                found += [(d, *x) for x in node.entries if d is not None and d <= reach(len(x[0]), len(key))]
            for c, child in node.next.items():
                after = auto.step(state, c)
                if after and min(e for _, e, _ in after) <= child.most:
                    stack.append((child, after))
        return sorted(found)


def spellings(code: str, label: str, field: str) -> Iterator[str]:
    """The code, the label and every alias path of one entry."""
    yield code
    yield label
    yield from ALIASES.get(field, {}).get(code, "").split(",")
    if field == "state":
        yield from (f"{label} {code}", f"{code} {label}", f"state of {label}", f"{label} usa", f"{label} state")
        head, _, tail = label.lower().partition(" ")
        for short in COMPASS.get(head, ()) if tail else ():
            for end in (tail, *TAILS.get(tail, ())):
                yield f"{short} {end}"
        for end in TAILS.get(tail, ()):
            yield f"{head} {end}"


def build(entries: list[tuple[int, str, str, str]]) -> dict[str, Trie]:
    """A trie per field from (canon_id, field_name, canon_code, label). A spelling claimed by two entries
    stays with the one that comes first."""
    tries: dict[str, Trie] = {}
    taken: set[tuple[str, str]] = set()
    for rank, (_, field, code, label) in enumerate(sorted(entries)):
        for s in spellings(code, label or "", field):
            key = key_of(s)
            if key and (field, key) not in taken:
                taken.add((field, key))
                tries.setdefault(field, Trie()).add(key, code, rank)
    return tries


def candidates(trie: Trie | None, typed: str) -> list[tuple[int, str, str, int]]:
    """All entries within reach of the typed value, best first. Ties of distance go to the same first
    letter, then the same letters in another order, then the nearer length, then list order."""
    key = key_of(typed)
    if not key or trie is None:
        return []
    seen: dict[str, tuple] = {}
    for d, alias, code, rank in trie.search(key):
        order = (d, alias[0] != key[0], sorted(alias) != sorted(key), abs(len(alias) - len(key)), rank, alias)
        if code not in seen or order < seen[code][0]:
            seen[code] = (order, (d, alias, code, rank))
    return [x for _, x in sorted(seen.values())]


_FINDERS: dict[tuple, Callable[[str, str], tuple]] = {}


def _finder(entries: tuple) -> Callable[[str, str], tuple]:
    """The memoized search of one reference list; a Python worker keeps it from task to task."""
    if entries in _FINDERS:
        return _FINDERS[entries]
    trie, memo = build(list(entries)), {}
    longest = max((len(key_of(s)) for _, f, c, label in entries for s in spellings(c, label or "", f)), default=0) + 3

    def find(field: str, typed: str) -> tuple:
        hit = memo.get((field, typed))
        if hit is None:
            found = candidates(trie.get(field), typed) if len(key_of(typed)) <= longest else []
            hit = (found[0][2], found[0][0], len(found)) if found else (NONE, None, 0)
            if len(memo) < _MEMO:
                memo[field, typed] = hit
        return hit

    _FINDERS.clear()
    _FINDERS[entries] = find
    return find


def map_values(df: DataFrame, canon: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, typed, canon_code, distance, n_candidates) for each cell of the fields that is
    not null and not itself a code of its field. canon_code is '(none)' where no entry is within reach.

    The reference list is fixed and small; it is read to the driver and sent with the task. Repeated
    rows each give their cells. Empty or blank text, and texts longer than any alias can reach, give '(none)'.
    """
    listed = canon.select("canon_id", "field_name", "canon_code", "label").where("canon_code is not null and field_name is not null")
    entries = [tuple(r) for r in bounded(listed, LIST_ROWS, "reference list")]
    codes: dict[str, list[str]] = {}
    for _, f, c, _ in entries:
        codes.setdefault(f, []).append(c)
    cells = df.select(
        F.col(key).alias(key),
        F.explode(
            F.array(*[
                F.struct(F.lit(f).alias("field_name"), F.when(~F.col(f).isin(codes.get(f, [""])), F.col(f)).alias("typed"))
                for f in fields
            ])
        ).alias("__c"),
    ).select(key, "__c.field_name", "__c.typed").where("typed is not null")

    def lookup(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = _finder(tuple(entries))
        for field, typed in parts:
            yield pd.DataFrame([find(f, v) for f, v in zip(field, typed)], columns=["canon_code", "distance", "n_candidates"]).astype({"distance": "Int32", "n_candidates": "int32"})

    udf = F.pandas_udf(lookup, "canon_code string, distance int, n_candidates int")
    return cells.withColumn("__m", udf("field_name", "typed")).select(key, "field_name", "typed", "__m.*")
