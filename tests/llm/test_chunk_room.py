"""Chunks that come again survive when the tokenizer makes room, and ids stay those of the whole text."""

from shelfcast.llm import packing


def test_recurring_chunks_survive(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 4000)
    tok = packing.ChunkedTokenizer(packing.default_tokenizer(), False)
    texts = [[f"common words, come again word{i}x{k}\nand once{k}z{i}." for k in range(12)] for i in range(5)] + [[""], ["common words, new"]]
    made_room = 0
    for batch in texts:
        full = tok.kept_bytes > packing.KEPT_BYTES
        found = tok.encode(batch)
        assert [x.tolist() for x in found] == [[*tok.model.encode(t, add_special_tokens=False).ids, packing.END] for t in batch]
        if full:
            made_room += 1
            assert "come" in tok.after_blank and "common" in tok.first
    assert made_room >= 3 and "word0x1" not in tok.after_blank
