"""Alignment of tokens: operator against whole texts encoded at once and every pair of tokens compared."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from nearfield.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(texts):
    """As the definition says, without segments: both tokenizers over whole texts, then ends of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    table = {c: b for c, b in alignment.byte_of().items()}
    docs = []
    for text in texts:
        docs.append(([], []))
        if not text:
            continue
        whole = (" " + text).encode()
        a = [(i, bytes(table[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("\u2581", " ").encode()))
        if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
            docs[-1] = a, b
    held, counts = [], collections.Counter()
    for a, b in docs:
        ends = []
        for side in (a, b):
            at, found = 0, {}
            for n, (i, x) in enumerate(side):
                at += len(x)
                found[at] = n
            ends.append(found)
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0][e]][0], b[ends[1][e]][0]) for e in common]
        counts.update(links)
        groups, x, y = [], 0, 0
        for e in common:
            groups.append(",".join(str(i) for i, _ in a[x : ends[0][e] + 1]) + "|" + ",".join(str(i) for i, _ in b[y : ends[1][e] + 1]))
            x, y = ends[0][e] + 1, ends[1][e] + 1
        held.append((len(a), len(b), links, ";".join(groups)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, len(g.split(";")) if g else 0, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), g) for n_a, n_b, links, g in held]


def texts():
    rng = random.Random(4)
    signs = ["a", "the", "Über", "naïve", "mot", "x1", "42", "...", "'s", "don't", "<|endoftext|>", "<s>", "<0x41>", "日本語", "🙂", "é", "\u200b", "{\r", "}", "\u2581", "\x00"]
    blanks = [" ", "  ", "\n", "\n\n", "\t", " \n ", "\r\n", "\r", "\xa0", "\u3000 ", "\u2003 ", "\x0b", "\x0c", "\x1c", "\x85 ", "\u200b", "", ""]
    out = [None, "", " ", "\n", "a", "a ", " a", "\u2581", "a\u2581 b", "\r a", "the the the", "the the the"]
    for _ in range(150):
        pool = signs if rng.random() < 0.4 else signs[:19]
        out.append("".join(rng.choice(pool) + rng.choice(blanks) for _ in range(rng.randrange(1, 30))))
    return out + ["x" * 20_000, "the " * 20_000, " " * 500, "\n" * 300 + "a"]


def test_segments_are_cut_where_nothing_joins():
    both = alignment.pair(A, B)
    assert "\r" not in alignment.cuts([both.bytes_b]) and " " in alignment.cuts([both.bytes_a, both.bytes_b])
    assert alignment.cuts([[b" a", b"\xc3", b"a b"], [b"{\r"]]) == "\t\n\x0b\x0c"
    for text in texts():
        if text:
            found = both.segments(text)
            assert "".join(found) == " " + text
            whole = both.a.encode(" " + text, add_special_tokens=False).ids
            assert [i for e in both.a.encode_batch(found, add_special_tokens=False) for i in e.ids] == whole
            assert [i for s in found for i in both.b.encode(both.lead + s)[1:]] == both.b.encode(text)
    assert both.segments("a\u3000 b") == [" a\u3000 b"] and both.segments("a \r b") == [" a", " \r b"]


@pytest.mark.parametrize("segments,codes,pairs", [(1 << 19, 1 << 20, 1 << 20), (20, 7, 0), (1, 1, 1 << 20)])
def test_alignment(spark, monkeypatch, segments, codes, pairs):
    monkeypatch.setattr(alignment, "SEGMENTS", segments)
    monkeypatch.setattr(alignment, "CODES", codes)
    monkeypatch.setattr(alignment, "BATCH", 1000)
    given = texts()[: 60 if segments == 1 else None]
    rows = [(i, t, 1, "x", 2, "y") for i, t in enumerate(given)] + [(None, "the", 1, "x", 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, segment string, n int, line string").repartition(3)
    expected = plain([r[1] for r in rows])
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, A, B, pairs=pairs).collect()}
    assert len(found) == len(rows)
    for (key, *_), e in zip(rows, expected):
        assert found[key] == e, key
    assert any(e[0] == 0 and t for e, (_, t, *_) in zip(expected, rows)), "some texts have no tokens"


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(spark.createDataFrame([(1, None), (2, "")], schema), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    twice = alignment.align(spark.createDataFrame([(1, "a b"), (1, "a b")], schema), A, B).collect()
    assert [tuple(r) for r in twice] == [(1, *plain(["a b", "a b"])[0])] * 2


def test_query_on_the_table(spark):
    from nearfield.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = {k: e for (k, _), e in zip(docs, plain([t for _, t in docs]))}
    found = queries.op11_token_alignment(spark, sf).withColumn("groups", F.col("groups_sha256")).collect()
    import hashlib

    for r in found:
        *numbers, groups = expected[r["doc_id"]]
        assert [r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == numbers
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert len(found) == len(docs)
