import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmap.llm.bpe import byte_symbols
from docmap.llm.token_alignment import align_tokenizers
from tests.llm.helpers import AWKWARD, frame, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Both libraries on the whole text, all pairs of every group one by one."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    value = {s: b for b, s in byte_symbols().items()}
    names = {i: s for s, i in first.get_vocab().items()}
    docs = []
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(value[c] for c in names[x]) for x in a]
        bytes_b = []
        for x in b:
            s = second.id_to_piece(x)
            bytes_b.append(bytes([int(s[3:5], 16)]) if second.is_byte(x) else s.replace("\u2581", " ").encode())
        want = (" " + text).encode() if text else b""
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((i, [], [], []))
            continue
        ends = [set(), set()]
        for k, tokens in enumerate((bytes_a, bytes_b)):
            at = 0
            for t in tokens:
                at += len(t)
                ends[k].add(at)
        groups, ga, gb = [], [], []
        at_a = at_b = ia = ib = 0
        for end in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            while at_a < end:
                at_a += len(bytes_a[ia])
                ga.append(a[ia])
                ia += 1
            while at_b < end:
                at_b += len(bytes_b[ib])
                gb.append(b[ib])
                ib += 1
            groups.append((ga, gb))
        docs.append((i, a, b, groups))
    held = Counter()
    for _, _, _, groups in docs:
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = [
    "Hello  world,\n\n it's 2024!", " leading", "trailing ", "tab\tand\u00a0nbsp \u3000x", "a \u2581 b", "\u2581", "<s> </s> <0x0A> <unk>",
    "<|endoftext|>", "-----" * 30, " " * 700 + "x" + " " * 33, "\n" * 50, "e\u0301 \U0001F600\U0001F468\u200d\U0001F469 \ufffd", "ab" * 900,
    "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8" * 40, "x\x00y \x1c z\u2028w",
]


def test_equal_to_brute_force_on_awkward_rows(spark):
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200 + i, prose(i % 5, 120)) for i in range(12)]
    assert found(align_tokenizers(frame(spark, rows), A, B)) == brute(rows)


def test_random_texts_and_small_blocks(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", " ", " ", "\n", "-", "1", "\u00e9", "\u4e2d", "the", "\u2581", "'s", "\U0001F600", "."]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 80)))) for i in range(300)]
    rows += [(400 + i, " ".join(rng.choices(["the", "cat", "sat,", "on", "it's"], k=3000))) for i in range(3)]
    expected = brute(rows)
    # texts longer than a block go through in parts; counts still cover all blocks
    assert found(align_tokenizers(frame(spark, rows), A, B, block_bytes=1000)) == expected
    assert found(align_tokenizers(frame(spark, rows, 1), A, B)) == expected


def test_a_long_text_that_turns_bad_in_its_last_part(spark):
    rows = [(1, "the cat sat " * 400 + "\u2581"), (2, "the cat sat")]
    assert found(align_tokenizers(frame(spark, rows), A, B, block_bytes=500)) == brute(rows)


def test_copies_count_as_documents_and_empty_table(spark):
    rows = [(7, "same text here")] * 400 + [(None, "same other")] * 3
    assert found(align_tokenizers(frame(spark, rows, 8), A, B, block_bytes=100)) == brute(rows)
    assert found(align_tokenizers(frame(spark, []), A, B)) == []
    only_null = frame(spark, [(1, None)]).withColumn("_pairs", F.lit(1)).withColumn("a", F.lit(2))
    assert found(align_tokenizers(only_null, A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]
