"""Word pieces of a byte-level vocabulary."""

from covarium.llm import bpe, wordpiece


def test_no_word_of_a_byte_level_vocabulary_is_unknown():
    spec = bpe._spec(None)
    a = wordpiece.automaton(spec)
    initial, inner = map(set, wordpiece.pieces_of(spec))
    assert b"" in initial
    for w in ("рст", "р", "тест" * 9, "ภาษาไทยไม่มีช่องว่าง" * 3, "한국어" * 5, "漢字書籍" * 20, *map(chr, range(0x400, 0x460)), *map(chr, range(0x4E00, 0x5200))):
        w = w.encode()
        n = at = 0
        size = next((k for k in range(len(w), 0, -1) if w[:k] in initial), 0)
        n, at = 1, size
        while at < len(w):
            at, n = at + next(k for k in range(len(w) - at, 0, -1) if w[at : at + k] in inner), n + 1
        assert a.walk(w) == n > 0, w
    assert wordpiece.Automaton([b"ab"], [b"c"]).walk(b"c") == 0
