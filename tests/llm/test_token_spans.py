"""Spans by lengths of ids, held against the library's own offsets."""

import random
import re

import pyarrow as pa
import pytest

from tidebar.llm import encoder, token_counts

PATH = encoder.vocabulary_path()


def characters():
    plain = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U" + m[1].zfill(8), encoder._PLAIN) + "]")
    return [c for c in map(chr, range(0x10000)) if plain.match(c)]


def same(texts):
    texts = pa.array(texts, pa.large_string())
    (spans, at), (want, want_at) = (e(PATH).spans_many(texts) for e in (encoder.SpanEncoder, encoder.WholeEncoder))
    assert at.tolist() == want_at.tolist()
    assert spans.tolist() == want.tolist()


def test_every_plain_character():
    found = characters()
    assert len(found) > 30_000
    same([f"a{c}b {c}" for c in found])


def test_random_texts():
    rng, plain = random.Random(3), characters()
    same(["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(3000)])
    signs = list("abXYZ .'sé\u0301İΣς\u00a0\u2028\x1c\x7f\u3000日が\u3099") + ["<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "'S"]
    same([None, "", *("".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000))])
    same([])


@pytest.mark.parametrize("text", ["Plain words, and more. 12 (a's)\n", "Größe: naïve Œuvre\u00a0— «да».", ""])
def test_plain_texts_need_no_offsets(monkeypatch, text):
    """Offsets of all texts were read as objects, which took op3 beyond its CPU seconds."""
    want = encoder.WholeEncoder(PATH)._library.encode(text, add_special_tokens=False)
    monkeypatch.setattr(encoder.WholeEncoder, "spans_many", None)
    batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    (found,) = token_counts.count_batches(PATH, b".!?\n", "first")(iter([batch]))
    assert found.column("n_tokens").to_pylist() == [len(want)]
