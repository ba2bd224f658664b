import hashlib
import os
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest

from docmap.llm.bpe import bpe_decode, bpe_digest, bpe_encode, loaded
from docmap.llm.packing import LibraryWords, assign, cost, pack_ids, pack_texts
from tests.llm.helpers import AWKWARD, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_and_decoded_text_equal_the_library(library):
    bpe, rng = loaded(PATH), random.Random(3)
    texts = [t or "" for _, t in AWKWARD] + ["ΑΣ ΟΔΟΣ", "İstanbul", "don't we'll I'M 'RE 'sup", "a\x1cb\x85c　d", "½ ² Ⅷ ٣ x1y2",
                                            "é ñ", "aaaa" * 300, "<|startoftext|>a<|endoftext|><|x|>"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x500), rng.randrange(0x3040, 0x3090),
                                      rng.randrange(0x1F600, 0x1F640), 32, 39])) for _ in range(50)) for _ in range(300)]
    words = LibraryWords(PATH, b"").encode_all(texts)
    for text, other in zip(texts, words, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = array("I")
        ids.frombytes(bpe.encode(text))
        assert ids.tolist() == want, text
        assert other == ids.tobytes(), text
        assert bpe.decode(ids.tobytes()).decode() == library.decode(want, skip_special_tokens=False)


def test_encode_decode_and_digest_tables(spark, library):
    docs = frame(spark, AWKWARD)
    encoded = bpe_encode(docs, PATH)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id, tuple(r.ids)) for r in encoded.collect()), key=str)
    assert got == sorted(((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD), key=str)
    decoded = {(r.doc_id, r.decoded) for r in bpe_decode(encoded, PATH).collect()}
    assert decoded == {(i, library.decode(list(x), skip_special_tokens=False)) for i, x in got}
    digest = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe_digest(docs, PATH).collect()}
    assert digest == {(i, len(x), hashlib.sha256(array("I", x).tobytes()).hexdigest()) for i, x in got}
    assert bpe_digest(frame(spark, []), PATH).count() == 0


def check_pieces(rows, ids_of, capacity):
    sequences, documents = defaultdict(list), defaultdict(list)
    for key, start, n, ids, total, sequence, offset in rows:
        assert ids == ids_of[key][4 * start:4 * (start + n)] and total == len(ids_of[key]) // 4 and n > 0
        sequences[sequence].append((offset, n))
        documents[key].append((start, n))
    padding = 0
    for pieces in [*sequences.values(), *documents.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    for pieces in sequences.values():
        n = sum(x for _, x in pieces)
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    assert {k: sum(n for _, n in v) for k, v in documents.items()} == {k: len(v) // 4 for k, v in ids_of.items() if v}
    return padding


def test_packing_whole_documents(spark, library):
    rows = [(i, prose(i, 5 + 37 * i % 900)) for i in range(120)] + [(500, None), (501, ""), (502, "word " * 9000)]
    docs = frame(spark, rows)
    ids_of = {i: array("I", library.encode(t or "", add_special_tokens=False).ids + [1]).tobytes() for i, t in rows}
    got = [tuple(r) for r in pack_texts(docs, PATH, block_tokens=20_000).collect()]
    assert check_pieces([(*r[:3], bytes(r[3]), *r[4:]) for r in got], ids_of, 2048) == 0
    # repeated and null ids: all tokens are there
    awkward = pack_texts(frame(spark, AWKWARD), PATH).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in AWKWARD)
    assert sum(r.length for r in awkward) == want
    assert all(zlib.crc32(bytes(r.ids)) >= 0 and len(r.ids) == 4 * r.length for r in awkward)
    assert pack_texts(frame(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_texts(docs, PATH, capacity=1000)


def test_pack_ids_and_cost_balance(spark):
    rng = random.Random(5)
    ids_of = {i: array("I", range(rng.choice([0, 1, 3, 40, 200, 900]))).tobytes() for i in range(200)}
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in ids_of.items()] + [(999, None)], "doc_id long, ids binary")
    got = [tuple(r) for r in pack_ids(table, capacity=256, block_tokens=4000).collect()]
    assert check_pieces([(*r[:3], bytes(r[3]), *r[4:]) for r in got], ids_of, 256) == 0
    # descending pieces go to the cheapest sequence with room
    filled, left = assign([(0, 0, 60), (1, 0, 50), (2, 0, 30), (3, 0, 20)], [100, 100], 1.0, 0.1)
    assert filled == [[(0, 0, 60), (3, 0, 20)], [(1, 0, 50), (2, 0, 30)]] and not left
    assert cost(50, 1.0, 0.1) + cost(30, 1.0, 0.1) < cost(60, 1.0, 0.1) + cost(20, 1.0, 0.1)
