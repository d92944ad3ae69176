"""New chunks are tokenized many at a time, and ids stay those of the whole text."""

import random

from shelfcast.llm import packing


class Counting:
    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **options)


def check(tok, model, texts):
    for ids, want in zip(tok.encode(texts), model.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == [*want.ids, packing.END]


def test_new_chunks_are_tokenized_together():
    tok = packing.ChunkedTokenizer(packing.default_tokenizer(), False)
    model, tok.model = tok.model, Counting(tok.model)
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeéñüß漢", k=9)) for _ in range(4000)]
    check(tok, model, [" ".join(f"{w}, {i}{w}" for i, w in enumerate(words[:2000])), "\n".join(f"{w}?!" for w in words[2000:]), "", "\n\n".join(words[:2])])
    assert tok.model.texts <= 20  # one for each chunk before
    many = tok.model.texts
    check(tok, model, [" ".join(words[:2000]), "z" * 70 + " " + "z" * 70 + "\n" + "z" * 70])
    assert tok.model.texts - many <= 6


def test_marks_after_letters_begin_a_chunk():
    tok = packing.ChunkedTokenizer(packing.default_tokenizer(), False)
    draw = random.Random(6)
    parts = ["word", "É", "é", "x's", "'s", "'", *".,;:!?$%&*#|()[]<>", "—", "7", " ", " a", "\nb", "́", "漢"]
    check(tok, tok.model, ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(5000)])
    check(tok, tok.model, ["end. end, end; end$$$ end.\nend."])
    assert "end" in tok.after_blank and "." in tok.first and "end." not in tok.after_blank


def test_other_vocabularies_are_tokenized_by_chunk():
    tok = packing.ChunkedTokenizer(packing.default_tokenizer(), False)
    tok.widths[:] = 1  # as if an id's text were not its bytes
    check(tok, tok.model, ["one two, three\nfour five.\n\nsix", "one 漢字 seven"])
