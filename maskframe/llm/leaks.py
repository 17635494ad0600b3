"""Evaluation passages inside training documents.

A passage of ``LETTERS`` normalised letters with slips at least ``APART`` right letters apart has at most
``BUDGET`` of them, so of any ``BUDGET + 1`` pieces it is cut into one is exact (pigeonhole). Every window of an
item counts as a passage; cutting each into ``BUDGET + 1`` equal pieces makes all the item's runs of ``PIECE``
letters pieces. Exact piece hits are found in one pass over each document by an automaton over all pieces.
Each window of the item through a hit is compared with the document by Myers' bit-parallel distance. A window
within the budget is a passage if its edits, as many as the distance says, can be isolated slips; a slip that
could stand at several places of a repeated letter is taken where the run from the hit ends.

The items are a stated, small query set and go to every task, in groups of bounded size; documents stay where
they are, without a shuffle, and whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS, APART = 45, 12
#: Most slips within a passage that begins and ends with right letters.
BUDGET = (LETTERS - 2 + APART) // (APART + 1)
PIECE = LETTERS // (BUDGET + 1)
#: Characters of the items searched for at once; more items are searched in further groups, each a pass over the documents.
GROUP_LETTERS = 500_000

_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Letters, digits and ideographs only, without case and character width."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.casefold())


def myers(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, by bit-parallel columns."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        best = min(best, score)
    return best


def _run_right(a: str, i: int, b: str, j: int) -> int:
    n, top = 0, min(len(a) - i, len(b) - j)
    while n < top and a[i + n] == b[j + n]:
        n += 1
    return n


def _run_left(a: str, i: int, b: str, j: int) -> int:
    n, top = 0, min(i, j)
    while n < top and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


#: A slip: letters passed over in the item and in the document.
SLIPS = ((1, 1), (1, 0), (0, 1))


def _run(a: str, i: int, b: str, j: int, step: int) -> int:
    if i < 0 or j < 0 or i > len(a) or j > len(b):
        return 0
    return _run_right(a, i, b, j) if step > 0 else _run_left(a, i, b, j)


def _slips(item: str, doc: str, i: int, j: int, step: int, need: int, most: int) -> int | None:
    """Fewest slips that reach ``need`` more item letters in one direction from (i, j), the end of a run; None if ``most`` do not suffice.

    Runs between two slips have ``APART`` letters; the last may be shorter.
    """
    if need <= 0:
        return 0
    best = None
    for di, dj in SLIPS if most > 0 else ():
        a, b = i + step * di, j + step * dj
        run = _run(item, a, doc, b, step)
        if not run:
            continue
        more = 0 if di + run >= need else _slips(item, doc, a + step * run, b + step * run, step, need - di - run, most - 1) if run >= APART else None
        if more is not None and (best is None or more + 1 < best):
            best, most = more + 1, more
    return best


def holds_passage(item: str, doc: str, i: int, j: int) -> bool:
    """Whether ``doc`` holds a passage of ``LETTERS`` letters of ``item`` through the exact hit at (i, j)."""
    left = _run_left(item, i, doc, j)
    i, j = i - left, j - left  # the start of the exact run the hit lies in
    run = _run_right(item, i, doc, j)
    if run < APART:  # every passage has a longer run than this, and that one is a hit too
        return False
    # One side has to bring half of what lacks, or a run that may stand between two slips.
    least = min(APART, (LETTERS - run + 1) // 2 - 1)
    ends = ((i + run, j + run, 1), (i, j, -1))
    if run < LETTERS and not any(_run(item, a + s * di, doc, b + s * dj, s) >= least for a, b, s in ends for di, dj in SLIPS):
        return False
    for s in range(max(0, i + run - LETTERS), min(i, len(item) - LETTERS) + 1) if run < LETTERS else (i,):
        before, after = i - s, max(0, s + LETTERS - i - run)
        edits = myers(item[s : s + LETTERS], doc[max(0, j - before - BUDGET) : j + LETTERS - before + BUDGET])
        if edits > BUDGET:
            continue
        right = _slips(item, doc, i + run, j + run, 1, after, edits)
        if right is not None and _slips(item, doc, i, j, -1, before, edits - right) is not None:
            return True
    return False


class Pieces:
    """The automaton over all pieces of all items, and where each piece stands."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(k, normalise(t)) for k, t in items]
        self.at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            if len(t) >= LETTERS:
                for i in range(len(t) - PIECE + 1):
                    self.at.setdefault(t[i : i + PIECE], []).append((n, i))
        self.automaton = ahocorasick.Automaton()
        for p in self.at:
            self.automaton.add_word(p, p)
        if self.at:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[int]:
        """Ids of the items of which ``text`` holds a passage."""
        doc = normalise(text)
        if len(doc) < LETTERS - BUDGET or not self.at:
            return []
        found: set[int] = set()
        done: dict[tuple[int, int], int] = {}
        for end, piece in self.automaton.iter(doc):
            j = end - PIECE + 1
            for n, i in self.at[piece]:
                if n in found or done.get((n, j - i), -1) >= j:
                    continue
                item = self.items[n][1]
                if holds_passage(item, doc, i, j):
                    found.add(n)
                else:
                    done[(n, j - i)] = j + _run_right(item, i, doc, j) - PIECE
        return sorted({self.items[n][0] for n in found})


#: The automaton of the group a worker is busy with, built once in each worker.
_BUILT: dict[str, Pieces] = {}


def _pieces(key: str, shared) -> Pieces:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Pieces(shared.value)
    return _BUILT[key]


def _search(documents: DataFrame, items: list[tuple], kinds: tuple[str, str]) -> DataFrame:
    key, shared = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(key, shared)
        for b in batches:
            out = [(d, i) for d, t in zip(b["d"], b["t"]) for i in pieces.leaks(t)]
            yield pd.DataFrame(out, columns=["d", "i"])

    return documents.mapInPandas(search, f"d {kinds[0]}, i {kinds[1]}")


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    group_letters: int = GROUP_LETTERS
) -> DataFrame:
    """``doc_id``, ``item_id``: one row for each document and each item it holds a passage of.

    Items of more than ``group_letters`` characters in all are searched in groups by the hash of their id. Null
    and short texts hold nothing; items shorter than a passage are in no document; repeated documents come out
    for each row, repeated items once; other columns do not matter.
    """
    some = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).dropna().distinct()
    groups = -(-int(some.agg(F.sum(F.length("t"))).first()[0] or 0) // group_letters) or 1
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    docs, found = documents.select(documents[doc_id].alias("d"), documents[text].alias("t")), None
    for g in range(groups):
        rows = some.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g).collect()  # a group of the stated query set
        part = _search(docs, [(r.i, r.t) for r in rows], kinds)
        found = part if found is None else found.unionByName(part)
    return found.toDF(doc_id, item_id)
