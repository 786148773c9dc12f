import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, docs

from carelens.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(1)
    alpha = "aAbeéΣ1½'stsr \n\t 日😀!-▁theing<0x41>\x01"
    words = [p.replace("▁", " ") for p in sorted(pieces.transducer(PATH).id)[::3]]
    out = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(1000)]
    out += ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    out += [" " * n + "x" + " " * n for n in range(50)] + ["<s>a</s><unk>", "a" * 999, "ab" * 400 + "日" * 300, " " * 700]
    return [t for t in out if "\0" not in t]


def test_encoding_and_decoding_equal_the_library(library):
    t, rnd = pieces.transducer(PATH), random.Random(2)
    for text in texts():
        ids = t.encode(text).tolist()
        assert ids == library.encode(text), text
        assert t.decode(ids) == library.decode(ids) == text.replace("▁", " ")
    for _ in range(1500):
        ids = [rnd.randrange(32_000) if rnd.random() < .5 else rnd.randrange(3, 259) for _ in range(rnd.randint(0, 12))]
        assert t.decode(ids) == library.decode(ids)


def test_neighbour_weights_equal_merging():
    t, rnd = pieces.transducer(PATH), random.Random(3)
    arcs = sorted(t.arcs) + ["▁" * k for k in range(1, 17) if "▁" * k in t.arcs or k == 1] * 300 + ["\x01", "🜁"] * 200
    for _ in range(20_000):
        a, b = rnd.choice(arcs), rnd.choice(arcs)
        assert t._apart(a, b) == (t.merged(a + b) == [a, b]), (a, b)


def test_documents_of_awkward_and_empty_tables(spark, library):
    rows = awkward() + [(20, "with ▁ mark"), (21, "x" * 5000 + " é日" * 500)]
    got = pieces.encode_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        text = by_text[r.doc_id]
        assert r.ids == library.encode(text) and r.n_pieces == len(r.ids)
        assert r.exact == ("▁" not in text)
        assert r.decoded_sha256 == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
        assert r.n_byte_pieces == sum(3 <= i < 259 for i in r.ids)
    assert pieces.encode_documents(docs(spark, rows).limit(0)).count() == 0


def test_a_word_of_a_megabyte_takes_linear_time(library):
    import time
    t, rnd, seconds = pieces.transducer(PATH), random.Random(8), {}
    for n in (125_000, 1_000_000):
        word = "".join(rnd.choice("theiansrod") for _ in range(n))
        start = time.process_time()
        ids = t.encode(word)
        seconds[n] = time.process_time() - start
        if n < 200_000:
            assert ids.tolist() == library.encode(word)
    assert seconds[1_000_000] < 24 * max(seconds[125_000], .1)


def test_forgotten_words_encode_alike(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 5)
    t = pieces.Transducer(PATH)
    for text in texts()[-300:] * 2:
        assert t.encode(text).tolist() == library.encode(text)
