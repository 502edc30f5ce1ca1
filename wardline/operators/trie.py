"""Which terms of a large lexicon stand in a text, found by walking a trie.

A trie state is a number, 0 the root; the edge table is one sorted array of
``state << 21 | character``, and the edge at place i leads to state i + 1.  The
table is sent to every task once, and only if the lexicon has at most
``MAX_CHARACTERS`` characters (summed before anything is collected).  It takes
12 bytes a character and 16 a term at most.  All places of a batch of texts walk at
once, ``STEP`` at a time; most leave the trie after a character or two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARACTERS = 4_000_000
STEP = 1 << 19
_BITS = 21
_BETWEEN = (1 << _BITS) - 1  # no character: ends a text


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``_BETWEEN``, and where each text begins."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    begin = np.cumsum([0, *(len(c) + 1 for c in codes)])
    out = np.full(begin[-1], _BETWEEN, np.int64)
    for at, c in zip(begin, codes):
        out[at : at + len(c)] = c
    return out, begin


@dataclass(frozen=True)
class Trie:
    """Edges, the form that ends in each state (or -1), and for each form the terms that have it."""

    edges: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    terms: np.ndarray

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and form numbers, each pair once, in order."""
        chars, begin = _characters(texts)
        forms, found = max(len(self.first) - 1, 1), [np.zeros(0, np.int64)]
        for low in range(0, len(chars), STEP):
            at = np.arange(low, min(low + STEP, len(chars)))
            owner, state = np.searchsorted(begin, at, side="right") - 1, np.zeros(len(at), np.int64)
            while len(at):
                key = state << _BITS | chars[at]
                edge = np.searchsorted(self.edges[:-1], key)
                on = np.flatnonzero(self.edges[edge] == key)
                at, owner, state = at[on] + 1, owner[on], edge[on] + 1
                form = self.ends[state]
                hit = form >= 0
                found.append(np.unique(owner[hit] * forms + form[hit]))
        pairs = np.unique(np.concatenate(found))
        return pairs // forms, pairs % forms


def build(forms: list[str], owner: np.ndarray) -> Trie:
    """A trie of the different ``forms``; ``owner`` has the form of every term."""
    chars, begin = _characters(forms)
    sizes = np.diff(begin) - 1
    state, alive, edges = np.zeros(len(forms), np.int64), np.arange(len(forms)), []
    ends, before, depth = np.full(len(chars) + 1, -1, np.int64), 0, 0
    while len(alive):
        key = state[alive] << _BITS | chars[begin[alive] + depth]
        level, place = np.unique(key, return_inverse=True)
        state[alive] = before + place + 1
        edges.append(level)
        before, depth = before + len(level), depth + 1
        ends[state[alive[sizes[alive] == depth]]] = alive[sizes[alive] == depth]
        alive = alive[sizes[alive] > depth]
    terms = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[terms], np.arange(len(forms) + 1))
    edges.append(np.array([-1]))  # no key: what lies behind the last edge
    return Trie(np.concatenate(edges), ends[: before + 1].astype(np.int32), first, terms)


def load(terms: DataFrame, limit: int = MAX_CHARACTERS) -> tuple[Broadcast, Broadcast] | None:
    """The trie of ``(pos, term, form)`` and its terms by pos, for all tasks; None for more than ``limit`` characters."""
    size = terms.agg(F.sum(F.length("term") + F.length("form"))).first()[0]
    if (size or 0) > limit:
        return None
    table = terms.sort("pos", "term").select("term", "form").toArrow()
    form = table["form"].combine_chunks().dictionary_encode()
    context = terms.sparkSession.sparkContext
    trie = build(form.dictionary.to_pylist(), form.indices.to_numpy())
    return context.broadcast(trie), context.broadcast(table["term"].combine_chunks())


def terms_in(c: Column, loaded: tuple[Broadcast, Broadcast]) -> Column:
    """The terms whose form stands in ``c``, by pos; none in a null text."""
    shared, names = loaded

    def work(texts: pa.Array) -> pa.Array:
        trie = shared.value
        text, form = trie.places([t or "" for t in texts.to_pylist()])
        # Every term of every form found, by text and place in the list of terms.
        count = np.diff(trie.first)[form]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        term, text = trie.terms[np.repeat(trie.first[form], count) + at], np.repeat(text, count)
        order = np.lexsort((term, text))
        offsets = np.searchsorted(text[order], np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), names.value.take(pa.array(term[order])))

    return F.arrow_udf(work, "array<string>")(c)
