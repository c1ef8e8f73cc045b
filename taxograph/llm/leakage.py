"""Passages of test items inside training texts, by a suffix automaton over words.

The items' texts, as lists of words, build one generalised suffix automaton. Each document's words run through it, so that
at every word the longest passage is known that ends there and stands in an item; wherever that length reaches the limit,
the items that hold the last ``min_words`` words are the items leaked there.

A word that no item has, and a pair of neighbours that no item has, reset the automaton to length 1 at most. Both are found
for a whole batch at once with arrays, so the automaton itself only walks stretches that can reach the limit.

The automaton of a block of items is built once, on the driver, and broadcast as flat arrays; the size of a block is a parameter,
so what is broadcast is bounded. A worker reads it once, whatever the number of its tasks and batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of items in one automaton. More items are taken in several turns over the documents.
BLOCK_WORDS = 1 << 20
#: Texts whose words a task holds at a time.
TEXTS_PER_BATCH = 256
#: Above this share of leaked words a document is dropped whole.
MAX_COVERAGE = 0.5
WORD = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """The longest runs of a-z and 0-9 after lower-casing."""
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of ``(item, words)`` lists; items are told apart from ``min_words`` words on."""

    def __init__(self, texts: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in texts]
        for _, coded in self.coded:
            state = 0
            for w in coded:
                state = self._extend(state, w)

    def matcher(self) -> Matcher:
        """The automaton as arrays. Of every state with passages long enough, ``top`` is the state of their last ``min_words`` words."""
        import numpy as np

        top = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= self.min_words:
                top[v] = top[self.link[v]] or v
        holders: dict[int, set[int]] = {}
        pairs: set[int] = set()
        size = max(1, len(self.ids))
        for item, coded in self.coded:
            state = 0
            for n, w in enumerate(coded, 1):
                state = self.next[state][w]
                if n >= self.min_words:
                    holders.setdefault(top[state], set()).add(item)
            pairs.update(a * size + b for a, b in zip(coded, coded[1:], strict=False))
        starts = np.cumsum([0, *map(len, self.next)])
        arrows = [x for out in self.next for x in sorted(out.items())]
        flat = np.array(arrows, dtype="int32").reshape(-1, 2)
        held = sorted((v, tuple(sorted(x))) for v, x in holders.items())
        return Matcher(
            self.min_words, "\n".join(self.ids), starts.astype("int64"), flat[:, 0].copy(), flat[:, 1].copy(), np.array(self.link, "int32"), np.array(self.length, "int32"), np.array(top, "int32"),
            np.array([v for v, _ in held], "int32"), np.cumsum([0, *(len(x) for _, x in held)]).astype("int64"), np.array([i for _, x in held for i in x], "int32"), np.array(sorted(pairs), dtype="int64"),
        )

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _copy(self, p: int, q: int, w: int) -> int:
        """Split the passages of q that are at most one word longer than p's into a state of their own."""
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(last, known, w)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new


@dataclass
class Matcher:
    """An automaton as arrays, to be sent to workers; arrows of a state become a dictionary when it is first met."""

    min_words: int
    words: str
    starts: object
    symbols: object
    targets: object
    link: object
    length: object
    top: object
    held_states: object
    held_starts: object
    held_items: object
    pairs: object

    @cached_property
    def ids(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.split("\n"))} if self.words else {}

    @cached_property
    def size(self) -> int:
        return max(1, len(self.ids))

    @cached_property
    def met(self) -> dict[int, dict[int, int]]:
        return {}

    def arrows(self, state: int) -> dict[int, int]:
        out = self.met.get(state)
        if out is None:
            a, b = self.starts[state], self.starts[state + 1]
            out = self.met[state] = dict(zip(self.symbols[a:b].tolist(), self.targets[a:b].tolist(), strict=True))
        return out

    def items(self, state: int) -> list[int]:
        """The items with the last ``min_words`` words of the passages of a state."""
        import numpy as np

        at = int(np.searchsorted(self.held_states, self.top[state]))
        return self.held_items[self.held_starts[at] : self.held_starts[at + 1]].tolist()

    def walk(self, coded: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(position, items) of each word at which a long enough passage ends."""
        state, length = 0, 0
        for i, w in enumerate(coded):
            arrows = self.arrows(state)
            while state and w not in arrows:
                state = int(self.link[state])
                length = int(self.length[state])
                arrows = self.arrows(state)
            if w in arrows:
                state = arrows[w]
                length += 1
            if length >= self.min_words:
                yield i, self.items(state)

    def spans(self, texts: list[list[str]]) -> dict[int, dict[int, list[list[int]]]]:
        """Of each text (by index) and item: the spans [first word, last word] that passages of the item cover."""
        import numpy as np

        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        coded = np.full(starts[-1], -1, dtype="int64")
        for at, t in zip(starts, texts, strict=False):
            coded[at : at + len(t)] = np.fromiter(map(self.ids.get, t, repeat(-1)), dtype="int64", count=len(t))
        found: dict[int, dict[int, list[list[int]]]] = {}
        if len(coded) < 2 or not len(self.pairs):
            return found
        code = coded[:-1] * self.size + coded[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        linked = (coded[:-1] >= 0) & (coded[1:] >= 0) & (self.pairs[at] == code)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view("int8"), [0]))))
        for a, b in edges.reshape(-1, 2):  # neighbours linked from a to b: words a..b
            if b - a + 1 < self.min_words:
                continue
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            base = int(a - starts[doc])
            of = found.setdefault(doc, {})
            for i, items in self.walk(coded[a : b + 1].tolist()):
                for item in items:
                    own = of.setdefault(item, [])
                    if own and own[-1][1] == base + i - 1:
                        own[-1][1] = base + i
                    else:
                        own.append([base + i - self.min_words + 1, base + i])
        return {d: of for d, of in found.items() if of}


def covered(spans: list[list[int]]) -> list[list[int]]:
    """The union of spans, as spans that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def word_places(text: str) -> list[tuple[int, int]]:
    """Where in the text as it is each of its words stands; lower-casing may lengthen a character."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    of = [i for i, c in enumerate(text) for _ in c.lower()]
    if len(of) != len(low):  # a final sigma is lower-cased by its surroundings, at the same length
        of = list(range(len(low)))
    return [(of[m.start()], of[m.end() - 1] + 1) for m in WORD.finditer(low)]


def _slices(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
            yield batch.slice(at, TEXTS_PER_BATCH)


def _leaks(matcher: Matcher, batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["doc_id", "item_id", "doc_words", "longest", "covered"]
    for batch in _slices(batches):
        docs = batch.column("doc_id").to_pylist()
        split = [words_of(x) if x else [] for x in batch.column("text").to_pylist()]
        rows = [(docs[d], item, len(split[d]), max(b - a + 1 for a, b in s), sum(b - a + 1 for a, b in covered(s))) for d, of in matcher.spans(split).items() for item, s in of.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names)


def _without(matcher: Matcher, batches: Iterator) -> Iterator:
    """Record batches (doc_id, text, removed_words, share) with the block's passages removed and both figures brought up to date."""
    import pyarrow as pa

    for batch in _slices(batches):
        docs, raw = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        split = [words_of(x) if x else [] for x in raw]
        found = matcher.spans(split)
        out, removed, share = [], batch.column("removed_words").to_pylist(), batch.column("share").to_pylist()
        for d, text in enumerate(raw):
            spans = covered([s for of in found.get(d, {}).values() for s in of])
            n = sum(b - a + 1 for a, b in spans)
            if spans:
                places, at, kept = word_places(text), 0, []
                for a, b in spans:
                    kept.append(text[at : places[a][0]])
                    at = places[b][1]
                text = "".join([*kept, text[at:]])
            out.append(text)
            removed[d] += n
            share[d] = max(share[d], n / len(split[d]) if split[d] else 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.string()), pa.array(removed, pa.int32()), pa.array(share, pa.float64())], ["doc_id", "text", "removed_words", "share"])


def item_blocks(items: DataFrame, min_words: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' word lists of at least ``min_words`` words, in blocks of about ``block_words`` words each.

    The number of blocks follows from the counted size of the items, so that what goes to the driver and to each task
    is bounded whatever the number of items.
    """
    texts = items.select(F.col("item_id").cast("int").alias("item_id"), F.explode(F.array("prompt", "solution")).alias("text")).filter("item_id is not null and text is not null")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * block_words)))
    for k in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        lists = [(r["item_id"], words_of(r["text"])) for r in rows]
        if kept := sorted((i, w) for i, w in lists if len(w) >= min_words):
            yield kept


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, doc_words, longest, covered)``: documents with a passage of at least ``min_words`` words of an item.

    ``longest`` is the longest stretch of words covered by passages of the item, ``covered`` all of them together.
    Reads ``doc_id, text`` and ``item_id, prompt, solution``; null and empty texts hold nothing, items with fewer words
    leak nowhere. A repeated ``doc_id`` has its rows summed up: the largest figures of them.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id int, doc_words int, longest int, covered int"
    out = documents.sparkSession.createDataFrame([], schema)
    for texts in item_blocks(items, min_words, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(Automaton(texts, min_words).matcher())  # bounded by block_words
        out = out.unionByName(rows.mapInArrow(lambda batches, s=shared: _leaks(s.value, batches), schema))
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("doc_words", "longest", "covered")))


def decontaminate(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, text, removed_words)``: every document without the passages of items that it holds.

    A text more than ``max_coverage`` of whose words are leaked becomes null. With several blocks of items, passages are
    removed block by block. Texts without a leak, null and empty ones come out as they are.
    """
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("removed_words"), F.lit(0.0).alias("share"))
    for texts in item_blocks(items, min_words, block_words):
        shared = documents.sparkSession.sparkContext.broadcast(Automaton(texts, min_words).matcher())  # bounded by block_words
        out = out.mapInArrow(lambda batches, s=shared: _without(s.value, batches), "doc_id bigint, text string, removed_words int, share double")
    return out.select("doc_id", F.when(F.col("share") <= max_coverage, F.col("text")).alias("text"), "removed_words")
