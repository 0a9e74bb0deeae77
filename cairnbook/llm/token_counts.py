"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A text longer than ``chunk_chars`` is encoded in chunks that overlap.  Two neighbouring encodings are
spliced at a boundary inside their overlap that is *common* (neither has a token across it, and the
tokens that follow it up to the next boundary are the same with the same offsets) and *proven stable*
(a place where a pre-token begins whatever stands around it).  If the overlap holds no such place it is
doubled and the left chunk is encoded again, at worst up to the end of the text.  The spliced count is
therefore the count of the whole text, while no encoding holds more than a chunk and its overlap.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairnbook.llm.common import blocks, table, whole_texts, worker_memory
from cairnbook.llm.tokens import TokenMemory

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
LIMIT = 2_048

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                     ("over_limit", pa.bool_()), ("n_chunks", pa.int64()), ("n_widened", pa.int64())])

# A blank before a printable ASCII character, or the change from a letter to punctuation: pre-tokens
# never hold either in their middle, and nothing before such a place changes how the rest is cut.
_STABLE = regex.compile(r" (?=[!-~])|(?<=\p{L})(?=\p{P})")


def _encoded(tokenizer, text: str, start: int, stop: int) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends in the whole text, and ids, of the tokens of ``text[start:stop]``."""
    got = tokenizer.encode(text[start:stop], add_special_tokens=False)
    return [start + a for a, _ in got.offsets], [start + b for _, b in got.offsets], got.ids


def _boundary(text: str, left, right, lo: int, hi: int) -> int | None:
    """A stable place in ``text[lo:hi]`` where both encodings begin a token, and agree up to the next place."""
    places = [m.start() for m in _STABLE.finditer(text, max(lo - 1, 0), hi) if lo < m.start() < hi]
    for here, then in zip(places, places[1:]):
        runs = []
        for begins, ends, ids in (left, right):
            i, j = bisect_left(begins, here), bisect_left(begins, then)
            if i and ends[i - 1] > here or j and ends[j - 1] > then:
                break
            runs.append((begins[i:j], ids[i:j]))
        if len(runs) == 2 and runs[0] == runs[1]:
            return here
    return None


def spliced_count(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
    """Tokens of ``text``, chunks used, and how often an overlap had to be widened."""
    total, begin, taken, chunks, widened = 0, 0, 0, 1, 0
    wide = overlap
    left = _encoded(tokenizer, text, 0, min(len(text), chunk + wide))
    while begin + chunk + wide < len(text):
        nxt = begin + chunk
        right = _encoded(tokenizer, text, nxt, min(len(text), nxt + chunk + overlap))
        place = _boundary(text, left, right, nxt, min(nxt + wide, nxt + chunk + overlap))
        while place is None and nxt + wide < len(text):
            wide *= 2
            widened += 1
            left = _encoded(tokenizer, text, begin, min(len(text), nxt + wide))
            right = _encoded(tokenizer, text, nxt, min(len(text), nxt + max(chunk, wide) + overlap))
            place = _boundary(text, left, right, nxt, min(len(text), nxt + wide))
        if place is None:  # the left chunk now reaches the end of the text
            break
        total += bisect_left(left[0], place) - taken
        taken = bisect_left(right[0], place)
        # The right chunk may have been read further than usual; go on from where it ends.
        begin, left, chunks = nxt, right, chunks + 1
        wide = overlap
        if len(right[0]) and begin + chunk + overlap < len(text):
            left = right if right[1][-1] <= begin + chunk + overlap else _encoded(tokenizer, text, begin, begin + chunk + overlap)
    return total + len(left[0]) - taken, chunks, widened


def _count(batches, path: str, limit: int, chunk: int, overlap: int):
    memory = worker_memory(f"tokens {path}", lambda: TokenMemory(path))
    for batch, data, starts in blocks(batches):
        n_bytes = np.diff(starts)
        tokens, chunks, widened = (np.full(len(n_bytes), k) for k in (0, 1, 0))
        huge = n_bytes > chunk  # a text of fewer bytes has fewer characters, too
        at = 0
        edges = [*np.flatnonzero(huge), len(n_bytes)]
        for edge in edges:
            if edge > at:
                _, ends = memory.encode(data[starts[at]:starts[edge]], starts[at:edge + 1] - starts[at])
                tokens[at:edge] = np.diff(ends)
            if edge < len(n_bytes):
                text = data[starts[edge]:starts[edge + 1]].tobytes().decode()
                tokens[edge], chunks[edge], widened[edge] = spliced_count(memory.tokenizer, text, chunk, overlap)
            at = edge + 1
        yield table({"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": tokens,
                     "over_limit": tokens > limit, "n_chunks": chunks, "n_widened": widened}, _SCHEMA)


def token_counts(docs: DataFrame, tokenizer_file: str, *, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened``: one row per row of ``docs``.

    One pass without a shuffle.  A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    Special strings inside a text are handled as the tokenizer file says.
    """
    slim = whole_texts(docs, id_col, text_col)
    run = partial(_count, path=tokenizer_file, limit=limit, chunk=chunk_chars, overlap=overlap_chars)
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long")
