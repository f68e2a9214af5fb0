import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetdrift.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["it's done, isn't it? <|endoftext|>x <|STARTOFTEXT|> a,b...c 3.14%%% 12,5", "é é É, ≠ a b c«d»,e", "don't.'s 'll!'re", "x<|endoftext|>,y"]


def test_counts_equal_the_tokenizer(docs, odd_rows, rows, tokenizer):
    given = [*odd_rows, *enumerate(ODD, 100)]
    assert rows(tokens.token_counts(docs(*given))) == sorted(((i, len(ids_of(tokenizer, t))) for i, t in given), key=repr)


def test_histogram_answers_every_limit(docs, odd_rows, tokenizer, prose, rows):
    given = [*odd_rows, *((200 + i, prose(i, i % 7)) for i in range(60))]
    lengths = [len(ids_of(tokenizer, t)) for _, t in given]
    histogram = tokens.length_histogram(tokens.token_counts(docs(*given)))
    want = []
    for n, docs_ in Counter(lengths).items():
        le, ge = [x for x in lengths if x <= n], [x for x in lengths if x >= n]
        want.append((n, docs_, n * docs_, len(le), sum(le), len(ge), sum(ge), sum(min(x, n) for x in lengths), len(le) / len(lengths)))
    assert rows(histogram) == sorted(want, key=repr)
    assert rows(tokens.at_limits(histogram, [0, 3, 100_000])) == sorted(
        [(c, sum(x <= c for x in lengths), sum(x for x in lengths if x <= c), sum(min(x, c) for x in lengths)) for c in (0, 3, 100_000)], key=repr
    )
    assert rows(tokens.length_quantiles(histogram, [0.5, 1.0])) == [(0.5, sorted(lengths)[(len(lengths) - 1) // 2]), (1.0, max(lengths))]


def test_empty_tables(docs, spark):
    none = docs((1, "x")).filter("false")
    assert tokens.length_histogram(tokens.token_counts(none)).count() == 0
    assert packing.pack(none).count() == 0


def check_pack(given, found, tokenizer):
    texts = {}
    for i, t in given:
        texts.setdefault(i, []).append(np.array([*ids_of(tokenizer, t), 1], "<u4"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc, key=repr) == sorted(texts, key=repr)
    for name, copies in texts.items():
        assert sum(r.length for r in by_doc[name]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(by_doc[name], key=lambda r: r.start):
                part = copies[0][r.start : r.start + r.length]
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(copies[0]), zlib.crc32(part.tobytes()))
                assert r.ids == part.tolist()
                at += r.length
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding == 0


def test_pieces_give_back_all_ids(docs, odd_rows, prose, tokenizer):
    given = [*odd_rows, *((300 + i, prose(i, 17 * i % 400)) for i in range(80))]
    check_pack(given, packing.pack(docs(*given).repartition(3), with_ids=True).collect(), tokenizer)


def test_one_tiny_document(docs, tokenizer):
    check_pack([(1, None)], packing.pack(docs((1, None)), with_ids=True).collect(), tokenizer)


def test_step_groups_are_even():
    packer = packing.Packer(0, packing.TIERS, 4 * 2048)
    windows = packer.pack([(i, 2048, 0, np.zeros(2048, "<u4")) for i in range(16)])
    assert Counter(packer.step_groups(windows)) == {0: 4, 1: 4, 2: 4, 3: 4}


def test_tiers_are_powers_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs((1, "x")), tiers=(300, 2048))
