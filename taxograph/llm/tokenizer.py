"""Encoding by a public byte-level BPE vocabulary, by halves that are joined exactly.

Every text above ``LEAF_CHARS`` characters is halved until the parts are small; neighbouring parts are then joined again
and again, within a task or, for texts above ``PART_CHARS``, between tasks. A join re-encodes a window around it:

* A text is scanned by the tokenizer's pattern into pieces, left to right, and each piece is merged into ids. No piece goes on
  from a visible character to a blank, so between the two there is always a border of pieces. The window grows on
  both sides to the next such border; what lies outside it is the same in the part and in the whole.
* A list of tokens is the encoding of the bytes of one piece if and only if each two neighbours are the encoding of theirs. So
  within a long piece a window around the join is re-encoded and grown until the pairs at both of its sides agree,
  and then all of it is exact.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograph.workspace import Workspace

#: The pattern of the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = re.compile("[ \\n]")
#: Texts with more characters are encoded by halves.
LEAF_CHARS = 1 << 11
#: Texts with more characters are split into parts of this size, which are encoded by different tasks.
PART_CHARS = 1 << 16
#: Pieces with more bytes are encoded by halves.
PIECE_BYTES = 1 << 12
#: Texts that a task holds as Python objects at a time.
TEXTS_PER_BATCH = 256


def vocabulary_path(name: str) -> str:
    """The file of a vocabulary of the installed package ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker process and file."""
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.scan = regex.compile(PATTERN).findall

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS, leaf: int = PIECE_BYTES) -> list[int]:
        """Ids of a text."""
        if len(text) <= leaf_chars:
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        a, b = text[:half], text[half:]
        return self.join(self.encode(a, leaf_chars, leaf), self.encode(b, leaf_chars, leaf), leaf, (a, b))

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")

    def agree(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        return self.encoding._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def piece(self, data: bytes, leaf: int = PIECE_BYTES) -> list[int]:
        """Ids of one piece."""
        if len(data) <= leaf:
            return self.encoding._encode_single_piece(data)
        half = len(data) // 2
        return self.join_tokens(self.piece(data[:half], leaf), self.piece(data[half:], leaf))

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """Ids of the piece whose halves have the ids ``a`` and ``b``."""
        if not a or not b:
            return a + b
        w = 1
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            middle = self.encoding._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, a[i:] + b[:j])))
            if (i == 0 or self.agree(a[i - 1], middle[0])) and (j == len(b) or self.agree(middle[-1], b[j])):
                return a[:i] + middle + b[j:]
            w *= 2

    def last_ids(self, ids: list[int], n_bytes: int) -> int:
        """How many ids at the end make up so many bytes."""
        n = 0
        while n_bytes > 0:
            n += 1
            n_bytes -= len(self.bytes_of[ids[-n]])
        return n

    def first_ids(self, ids: list[int], n_bytes: int) -> int:
        """How many ids at the beginning make up so many bytes."""
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[n]])
            n += 1
        return n

    def join(self, a: list[int], b: list[int], leaf: int = PIECE_BYTES, texts: tuple[str, str] | None = None) -> list[int]:
        """Ids of a text from those of its two parts; the parts' ``texts`` are read from the ids if they are not at hand."""
        if not a or not b:
            return a + b
        left, right = texts or (self.text(a), self.text(b))
        tail, head = left[last_border(left) :], right[: first_border(right)]
        i, j = len(a) - self.last_ids(a, len(tail.encode())), self.first_ids(b, len(head.encode()))
        if len(tail) + len(head) <= leaf:
            middle = self.encoding.encode_ordinary(tail + head)
        else:
            middle = self._across(tail, a[i:], head, b[:j], leaf)
        return a[:i] + middle + b[j:]

    def _across(self, tail: str, a: list[int], head: str, b: list[int], leaf: int) -> list[int]:
        """Ids of a window with a long piece; one that is the last piece of one side and the first of the other is joined from their ids."""
        last, first = self.scan(tail)[-1], self.scan(head)[0]
        out: list[int] = []
        for x in self.scan(tail + head):
            data = x.encode()
            if len(data) > leaf and x == last + first:
                out += self.join_tokens(a[len(a) - self.last_ids(a, len(last.encode())) :], b[: self.first_ids(b, len(first.encode()))])
            else:
                out += self.piece(data, leaf)
        return out


def _is_border(text: str, i: int) -> bool:
    """Whether the character before a blank at ``i`` is visible (of ASCII, where all scanners agree)."""
    return i > 0 and "!" <= text[i - 1] <= "~"


def last_border(text: str) -> int:
    """The last place where a visible character is followed by a blank; the beginning without one."""
    i = len(text)
    while i > 0:
        i = max(text.rfind(" ", 0, i), text.rfind("\n", 0, i))
        if _is_border(text, i):
            return i
    return 0


def first_border(text: str) -> int:
    """The first place where a visible character is followed by a blank; the end without one."""
    for m in BLANKS.finditer(text):
        if _is_border(text, m.start()):
            return m.start()
    return len(text)


def _slices(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
            yield batch.slice(at, TEXTS_PER_BATCH)


def _texts(path: str, batches: Iterator) -> Iterator:
    """Record batches (doc_id, text) to (doc_id, ids)."""
    import pyarrow as pa

    c = codec(path)
    for batch in _slices(batches):
        ids = [c.encode(x) if x else [] for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _split(part_chars: int, batches: Iterator) -> Iterator:
    """Record batches (key, doc_id, text) to a row (key, doc_id, part, text) for each part; one batch a text."""
    import pyarrow as pa

    for batch in batches:
        for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
            parts = [text[i : i + part_chars] for i in range(0, len(text), part_chars)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["key", "doc_id", "part", "text"])


def _parts(path: str, batches: Iterator) -> Iterator:
    import pyarrow as pa

    c = codec(path)
    for batch in _slices(batches):
        ids = [c.encode(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("part"), pa.array(ids, pa.list_(pa.int32()))], ["key", "doc_id", "part", "ids"])


def _joined(path: str, pdf):
    import pandas as pd

    c = codec(path)
    rows = [list(map(int, r.ids)) for r in pdf.sort_values("part").itertuples()]
    done = rows[0] if len(rows) == 1 else c.join(*rows)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "doc_id": [pdf["doc_id"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // 2], "ids": [done]})


def encode_corpus(documents: DataFrame, path: str, workspace: Workspace, part_chars: int = PART_CHARS) -> DataFrame:
    """``(doc_id, ids)``: ids of each document's text, without special tokens; an empty list for null and empty texts.

    One row for each row of the input; rows that share a ``doc_id`` (or have none) stay apart. Strings that look like
    special tokens are ordinary text. Texts above ``part_chars`` characters are split into parts, encoded in parallel
    and joined two by two in rounds, so that no task scans more than one part or merges more than two; within a part the
    same is done by halves.
    """
    rows = documents.select("doc_id", "text")
    long = F.length("text") > part_chars
    out = rows.filter(F.coalesce(~long, F.lit(True))).mapInArrow(lambda batches: _texts(path, batches), "doc_id bigint, ids array<int>")
    keyed = workspace.write(rows.filter(long).select(F.uuid().alias("key"), "doc_id", "text"), "long")
    most = keyed.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return out
    split = keyed.mapInArrow(lambda batches: _split(part_chars, batches), "key string, doc_id bigint, part int, text string").repartition("key", "part")
    schema = "key string, doc_id bigint, part int, ids array<int>"
    state = workspace.write(split.mapInArrow(lambda batches: _parts(path, batches), schema), "parts-0")
    parts, turn = -(-most // part_chars), 0
    while parts > 1:
        turn += 1
        state = workspace.write(state.groupBy("key", F.floor(F.col("part") / 2).alias("pair")).applyInPandas(lambda pdf: _joined(path, pdf), schema), f"parts-{turn}")
        workspace.drop(f"parts-{turn - 1}")
        parts = -(-parts // 2)
    return out.unionByName(state.select("doc_id", "ids"))


def same_ids(documents: DataFrame, path: str, workspace: Workspace, part_chars: int) -> DataFrame:
    """``(n_documents, n_same)``: of how many documents parts of ``part_chars`` characters, encoded apart and joined, have the
    ids that the library gives for the whole text."""

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = codec(path).encoding.encode_ordinary
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encode(x or "") for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "wanted"])

    wanted = documents.select("doc_id", "text").mapInArrow(whole, "doc_id bigint, wanted array<int>")
    both = encode_corpus(documents, path, workspace, part_chars).join(wanted, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("ids") == F.col("wanted"), 1)).alias("n_same"))
