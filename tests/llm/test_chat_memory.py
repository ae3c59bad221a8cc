"""op7_chat holds one tokenizer in a Python worker, however many tasks it runs."""

import shutil

import pyarrow as pa
import tokenizers

from tidebar.llm import chat
from tidebar.llm.encoder import vocabulary_path


def test_one_tokenizer_over_tasks(monkeypatch, tmp_path):
    path, made = str(tmp_path / "vocabulary.json"), []
    shutil.copy(vocabulary_path("byte_bpe_50k.json"), path)
    library = tokenizers.Tokenizer

    class Counted:
        @staticmethod
        def from_file(name):
            made.append(name)
            return library.from_file(name)

    for module in (tokenizers, chat):
        monkeypatch.setattr(module, "Tokenizer", Counted, raising=False)
    rows = pa.record_batch({"conv_id": [1, 1], "role": ["user", "assistant"], "text": ["</s> a", "b"]})
    out = [list(chat.format_turns(path, ("assistant",))(iter([rows]))) for _ in range(3)]
    assert made == [path]
    assert out[0] == out[1] == out[2]
    assert out[0][0].column("formatted").to_pylist() == ["<s>user\n<\\/s> a</s><s>assistant\nb</s>"]
