"""Token counts of sections: whole documents are encoded once and their tokens attributed by character offsets.

A document's sections are sorted, disjoint spans of characters that cover it (here: sentences, cut after ``.``,
``!``, ``?`` and line ends).  The join of tokens with sections is one of sorted intervals, by binary search.  A token
across an edge goes by ``rule``: to the section of its first character, of its last, or of the most of it.

Defined cases: a null text is an empty one, without sections or tokens; a text of any length is encoded whole; rows that repeat a doc_id are separate rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import slices
from tidebar.llm.encoder import flat_bytes, span_encoder, vocabulary_path

RULES = ("first", "last", "most")
_COUNTS = (
    "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, most_tokens long, "
    "section_tokens array<int>"
)


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens [start, end): the section each goes to, and whether it crosses an edge; section k starts at edges[k].

    With "most", of equal shares the first section's counts, and only the sections of both its ends are held
    against each other where a token spans more than two and neither of these has less than one between.
    """
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, np.maximum(ends - 1, starts), "right") - 1
    crossing = first != last
    if rule == "first" or not crossing.any():
        return first, crossing
    if rule == "last":
        return last, crossing
    out = first.copy()
    for k in np.flatnonzero(crossing).tolist():
        inner = np.concatenate([[starts[k]], edges[first[k] + 1 : last[k] + 1], [ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(inner)))
    return out, crossing


def count_batches(path: str, marks: bytes, rule: str):
    """For mapInArrow: a row for each document, with the tokens of each of its sections in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = span_encoder(path).spans_many
        for batch in slices(batches, most=2_000_000):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            raw, at = flat_bytes(texts)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            doc_chars = chars[at]  # of all texts end to end
            full = np.diff(doc_chars) > 0
            cuts = chars[1:][np.isin(raw, np.frombuffer(marks, np.uint8))]
            edges = np.union1d(doc_chars[:-1][full], cuts[~np.isin(cuts, doc_chars[1:])])
            spans, token_at = encode(texts)
            spans = spans + np.repeat(doc_chars[:-1], np.diff(token_at))[:, None]
            section, crossing = attribute(spans[:, 0], spans[:, 1], edges, rule)
            counts = np.bincount(section, minlength=len(edges)).astype(np.int32)
            begin = np.searchsorted(edges, doc_chars[:-1])
            begin = np.append(begin, len(edges))
            crossed = np.concatenate([[0], np.cumsum(crossing)])[token_at]
            most = np.zeros(batch.num_rows, np.int64)
            if len(edges):
                most[full] = np.maximum.reduceat(counts, begin[:-1][full])
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(counts))
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(doc_chars)), pa.array(np.diff(token_at)),
                    pa.array(np.diff(begin).astype(np.int64)), pa.array(np.diff(crossed)), pa.array(most), lists,
                ],
                names=[c.split()[0] for c in _COUNTS.split(", ")],
            )

    return run


def count_sections(docs: DataFrame, path: str | None = None, marks: str = ".!?\n", rule: str = "first") -> DataFrame:
    """One row a document: doc_id, n_chars, n_tokens, n_sections, n_crossing, most_tokens, section_tokens."""
    if rule not in RULES or not marks.isascii():
        raise ValueError("rule is one of first, last and most; marks are ASCII signs")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(count_batches(path or vocabulary_path(), marks.encode(), rule), _COUNTS)
