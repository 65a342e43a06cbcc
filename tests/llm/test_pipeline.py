"""The pipeline against a plain version of its stages."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SF, WORD, P, plain_bayes, plain_mix, plain_removal, shingle_set, tokenizer, union_find  # noqa: F401

import corpus_pipeline as pipeline


def plain_language(rows):
    judge = plain_bayes([(r["text"], r["lang"]) for r in rows])
    for r in rows:
        name, score = judge(r["text"])
        if name != "und" and score >= pipeline.LEAST_SCORE:
            yield r


def plain_near(rows):
    sets = [shingle_set(r["text"], pipeline.SHINGLE_WORDS) for r in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pipeline.SIMILARITY_PERCENT * len(sets[a] | sets[b])]
    root = union_find(len(rows), links)
    return [r for i, r in enumerate(rows) if root[i] == i]


def plain_passages(rows):
    for r, (_, _, removed, _, kept) in zip(rows, plain_removal([(r["doc_id"], (r["text"] or "").encode()) for r in rows], 50)):
        text = kept.decode(errors="ignore") if removed else r["text"] or ""
        if not removed or text.strip(" "):
            yield r | {"text": text, "n_chars": len(text)}


def plain_source_mix(rows):
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    _, total = plain_mix([(r["doc_id"], r["source"], size[r["doc_id"]]) for r in rows], pipeline.WEIGHTS, pipeline.MIX_PERCENT)
    place = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    copies = []
    for s in total:
        end = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            n = size[r["doc_id"]]
            end += n
            for copy in range(2 if n else 0):
                copies.append(((end + copy * total[s]) / pipeline.WEIGHTS[place[s] % 3], place[s], hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), copy, n, r))
    budget, so_far = sum(size.values()) * pipeline.MIX_PERCENT / 100, 0
    for *_, n, r in sorted(copies, key=lambda c: c[:4]):
        so_far += n
        if so_far > budget:
            break
        yield r


def test_pipeline(spark, tokenizer):  # noqa: F811
    rows = sorted((r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r["doc_id"])
    kept = list(plain_source_mix(list(plain_passages(plain_near(list(plain_language(rows)))))))
    expected = Counter()
    for r in kept:
        ids = np.array(tokenizer[2].encode_ordinary(r["text"]), "<u4")
        expected[r["doc_id"], r["lang"], r["source"], len(ids), ids.tobytes(), True] += 1
    found = pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    assert Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["exact"]) for r in found.collect()) == expected
    assert len(kept) > 100 and pipeline.ORACLE_SQL is None


CLASHING = "_lang_pred _score _part kept taken size target n_removed carried row lang_pred score component_id n_shingles copy".split()
WORDS = "Some words in a text that is long enough to be kept as it stands here, and a few more of them."


def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, WORDS, "en", None, 95), (2, None, None, "s", 0), (3, "", "en", "s", 0), (4, "Some other words.", "en", "s", None), (5, WORDS, "en", "s", 95), (5, WORDS, "en", "s", 95), (None, "Words without an id.", "en", "s", 20)]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


#: What each stage keeps of odd(); a text that the mix takes twice is there twice.
KEPT = {
    "language": [None, 1, 4, 5, 5],
    "near_dedup": [None, 1, 2, 3, 4],
    "repeated_passages": [None, 1, 2, 3, 4],
    "tokens": [None, 1, 2, 3, 4, 5, 5],
}


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    df = odd(spark)
    found = stage(spark, df, SF).collect()
    ids = sorted((r["doc_id"] for r in found), key=lambda i: (i is not None, i))
    if name == "source_mix":
        words = sum(len(WORD.findall(r["text"])) for r in found)
        total, longest = (f(len(WORD.findall(r["text"] or "")) for r in df.collect()) for f in (sum, max))
        assert set(ids) <= {1, 4, 5, None} and total - longest <= words <= total  # documents are taken whole
    else:
        assert ids == KEPT[name]
    if name != "tokens":
        assert all(r[c] == f"own {c}" for r in found for c in CLASHING) and found[0].__fields__ == df.columns
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        assert all((r["text"] or "") == texts[r["doc_id"]] for r in found)
    empty = stage(spark, df.limit(0), SF)
    assert empty.count() == 0 and (name == "tokens" or empty.schema.names == df.columns)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_two_results_of_a_stage_live_side_by_side(spark, name, stage):
    df = odd(spark)
    a, b = stage(spark, df, SF), stage(spark, df.where("doc_id = 1"), SF)
    assert b.count() <= 2 and a.count() >= 4 and a.count() >= 4
