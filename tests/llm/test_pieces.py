"""Pieces of plain texts, encoded by the model of a tokenizer alone, against whole texts."""

import random
import sys
import time

from nodewell.llm import packing, workers
from nodewell.llm import queries as q

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_contracts import SF  # noqa: E402

SIGNS = ["'", "OK", "<|ENDOFTEXT|>", "'s", "'re", "'Ll", "''d", ".", "...", "_", "\x00", "\x1b", "\x7f", "0", "42", "é", "ß", "Ñ", "ÿ", "×", "µ", "ª", "½", "²", "\xad", "\x85", "\xa0", "ﬁ", "é", "İ", "Σ", "中", "😀", "<|", "<|endoftext|>", "\x1c", " ", "\n"]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(7)
    plain = [s for s in SIGNS if packing.PLAIN.fullmatch(s)]
    words = ["The", "NASA", "san", "rest", "d", "m", "Über", "naïve", "x" * 50]
    texts = ["".join(rng.choice(rng.choice((of, words))) for _ in range(rng.randint(1, 12))) for of in (SIGNS, plain) for _ in range(3000)]
    path = q.tokenizer_path()
    tokenizer, known = packing._tokenizer(path)
    assert known.pieces
    for t, ids in zip(texts, packing.encode(texts, path), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_no_word_of_a_plain_text_is_given_to_the_whole_tokenizer(spark, monkeypatch):
    """Its normalising and splitting took most of the time."""
    texts = [r.text for r in q.table(spark, SF, "documents").select("text").collect()]
    assert all(packing.PLAIN.fullmatch(t) for t in texts)
    tokenizer, known = packing._tokenizer(q.tokenizer_path())
    small = packing.Chunks(None, 20_000, known.pieces)
    monkeypatch.setitem(packing._TOKENIZERS, q.tokenizer_path(), (None, small))
    for t, ids in zip(texts, packing.encode(texts, q.tokenizer_path()), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert small.size <= 10_300


def test_a_worker_gives_up_what_it_remembers_some_time_after_its_last_text(monkeypatch):
    """Idle workers of the pipeline held hundreds of MB beside the JVM of the stages that came then."""
    path, texts = q.tokenizer_path(), ["Some words of a text", "words"]
    monkeypatch.setattr(packing, "_KEPT", kept := workers.Kept(packing._TOKENIZERS.clear, 0.2))
    for _ in range(2):  # and takes it up again
        ids = [x.tolist() for x in packing.encode(texts, path)]
        tokenizer, known = packing._tokenizer(path)
        assert known.new and ids == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        with kept:
            time.sleep(0.5)
            assert packing._TOKENIZERS[path][1] is known  # not while in use
        until = time.monotonic() + 20
        while (packing._TOKENIZERS or kept.watched) and time.monotonic() < until:
            time.sleep(0.05)
        assert not packing._TOKENIZERS


def test_few_remembered_pieces_give_the_same_ids():
    path, few = q.tokenizer_path(), 100_000
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)} {i} {j}" for j in range(40)) for i in range(400)] * 2
    packing._TOKENIZERS.clear()
    small = [x.tolist() for i in range(0, len(texts), 50) for x in packing.encode(texts[i : i + 50], path, few)]
    tokenizer, known = packing._tokenizer(path)
    assert known.limit == few and 0 < known.size <= few // 2
    assert small == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
