import zlib

import numpy as np
from brute import table

from gridloom.llm.cutting_stock import inverted, knapsack, patterns
from gridloom.llm.packing import pack, sequences
from gridloom.llm.tokens import WordTokens, default_path


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_tokens_are_the_tokenizers():
    texts = ["It's o'clock café's ½ Ǆ ẞ œuvre naïve", "ab\x1ccd \x85 x\xa0z 12345 a1b2 !!a??", "<|endoftext|> Don'T ümlaut ÀÉ ×÷ ªº", "a<|endoftext|>B <|ENDOFTEXT|> e\u0301<|startoftext|>\u0301x <|endoftext", "<|startoftext|><|endoftext|>\x1c y", "", "  ", "日本語 テキスト。", "Σίσυφος ΣΑΣ", "é a"]
    w = WordTokens.at(default_path())
    for t in texts * 2:
        assert w.ids(t) + (1).to_bytes(4, "little") == np.array(ids_of(t), "<u4").tobytes()


def test_special_tokens_in_a_text_are_what_the_tokenizer_says(spark):
    assert ids_of("x <|endoftext|> y")[1] == 49407
    text = "a <|endoftext|> b<|startoftext|>"
    row = pack(table(spark, [(1, text)])).first()
    assert (row.doc_tokens, row.ids_crc32) == (len(ids_of(text)), zlib.crc32(np.array(ids_of(text), "<u4").tobytes()))


def test_knapsack_is_the_best():
    value, count = knapsack(np.array([3.0, 5.0, 7.0]), np.array([2, 3, 4]), 9)
    assert value == 15.0 and (np.array([2, 3, 4]) @ count) <= 9 and np.array([3, 5, 7]) @ count == 15


def test_inverse():
    m = np.random.default_rng(0).random((9, 9))
    assert np.allclose(inverted(m) @ m, np.eye(9))


def test_patterns_meet_the_demand_near_the_bound():
    rng = np.random.default_rng(4)
    size, demand = np.unique(rng.integers(1, 257, 5000), return_counts=True)
    rows, times = patterns(size, demand, 256)
    assert ((times @ rows) == demand).all() and (rows @ size).max() <= 256
    assert times.sum() <= 1.02 * np.ceil((size * demand).sum() / 256) + 1
    assert patterns(np.zeros(0, np.int64), np.zeros(0, np.int64), 256)[1].sum() == 0


def test_every_id_lies_in_one_piece(spark, corpus):
    rows = [*corpus, (None, "no id"), (3, "short")]
    out = pack(table(spark, rows), capacity=256).collect()
    assert sorted((r.doc_id, r.start) for r in out if r.doc_id not in (None, 3)) == sorted({(r.doc_id, r.start) for r in out if r.doc_id not in (None, 3)})
    for i, t in corpus:
        ids = ids_of(t)
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id == i)
        own = own[:1] if i == 3 else own
        assert [s for s, *_ in own] == list(np.cumsum([0, *[n for _, n, *_ in own]])[:-1]) and sum(n for _, n, *_ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c and d == len(ids) for s, n, c, d in own)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *[n for _, n in s]])[:-1]) and sum(n for _, n in s) <= 256
    assert len(by) <= 1.15 * sum(r.length for r in out) / 256 + 1


def test_sequences_hold_the_ids(spark, corpus):
    docs = table(spark, corpus[2:12])
    packed = pack(docs, capacity=128)
    got = {r.sequence_id: r for r in sequences(docs, packed, capacity=128).collect()}
    for r in packed.collect():
        ids = ids_of(dict(corpus)[r.doc_id])[r.start : r.start + r.length]
        assert got[r.sequence_id].input_ids[r.offset : r.offset + r.length] == ids
        assert set(got[r.sequence_id].doc_ids[r.offset : r.offset + r.length]) == {r.doc_id}
    assert all(len(r.input_ids) == 128 or len(r.input_ids).bit_count() == 1 for r in got.values())


def test_empty_table(spark):
    assert pack(table(spark, [])).count() == 0
