"""The quality classifier: its gradients against differences, its sums over blocks, its rows, and held-out accuracy."""

import numpy as np
import pytest

from nearfield.llm import quality

SF = "/root/testdata/sf0.01"
GOOD = "The river rises in the hills and runs through farmland before it meets the sea near the old town. "
BAD = "BUY!! NOW!! CHEAP!! $$$ CLICK!! "


def test_gradients():
    rng = np.random.default_rng(1)
    d, h, g = 5, 4, 3
    p = {"W": rng.normal(size=(d, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, g)), "U": rng.normal(size=(h, g)), "w": rng.normal(size=g), "c": rng.normal(size=h), "k": np.array([0.3])}
    x, starts, y = rng.normal(size=(7, d)), np.array([0, 3, 4]), np.array([1.0, 0.0, 0.4])

    def loss(p):
        total = 0.0
        for a, b, t in zip(starts, [3, 4, 7], y):
            hidden = np.tanh(x[a:b] @ p["W"] + p["b"])
            e = (np.tanh(hidden @ p["V"]) / (1 + np.exp(-hidden @ p["U"]))) @ p["w"]
            weight = np.exp(e) / np.exp(e).sum()
            s = 1 / (1 + np.exp(-(weight @ hidden @ p["c"] + p["k"][0])))
            total -= t * np.log(s) + (1 - t) * np.log(1 - s)
        return total / 3

    found = quality._step(p, x, starts, y)
    for name, value in p.items():
        for at in np.ndindex(value.shape):
            moved = [{**p, name: value.copy()} for _ in range(2)]
            moved[0][name][at] += 1e-5
            moved[1][name][at] -= 1e-5
            assert found[name][at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-5, abs=1e-7)


def test_encoding_of_a_passage():
    (row,), owner = quality.encode(["Aa, aa aa\n"])
    assert owner.tolist() == [0]
    shares = row[: quality.CLASSES] ** 2
    assert shares[0] == pytest.approx(0.5) and shares[1] == pytest.approx(0.1) and shares[4] == pytest.approx(0.2) and shares[5] == pytest.approx(0.1)
    distinct, most, again = row[-6:-3]
    assert (distinct, most, again) == pytest.approx((2 / 3, 2 / 3, 1 / 3))
    rows, owner = quality.encode(["", "w " * 130, "  \n", "x"])
    assert owner.tolist() == [0, 1, 1, 1, 2, 3] and rows.shape == (6, quality.DIMS) and np.isfinite(rows).all()
    both = [quality.encode([t])[0] for t in ("", "w " * 130, "  \n", "x")]
    assert np.allclose(np.concatenate(both), rows)


def model():
    texts = [GOOD * (1 + i % 5) if i % 3 else BAD * (1 + i % 7) + GOOD * (i % 2) for i in range(90)]
    bags = [np.concatenate([f for f, _ in quality.blocks([t])]) for t in texts]
    return quality.fit(bags, np.array([float(i % 3 > 0) for i in range(90)]))


def test_scores_over_blocks(monkeypatch):
    fitted = model()
    texts = [GOOD * 200, BAD * 200, None, "", " ", GOOD * 30 + BAD * 30, GOOD, BAD]
    score, n, focus = quality.score(texts, fitted)
    assert ((0 <= score) & (score <= 1)).all() and score[0] > 0.5 > score[1] and score[6] > 0.5 > score[7] and (n > focus).all()
    assert score[2] == score[3] and (n[2:5] == 1).all()
    # Attention as its definition has it, over all passages of one text at once.
    passages = np.concatenate([f for f, _ in quality.blocks([texts[5]])])
    h = fitted.hidden(fitted.mean + np.clip((passages - fitted.mean) / fitted.spread, -8, 8) * fitted.spread)
    e = np.exp(fitted.weights(h))
    assert score[5] == pytest.approx(1 / (1 + np.exp(-(e / e.sum() @ h @ fitted.layers["c"] + fitted.layers["k"][0]))))
    assert n[5] == len(passages) and focus[5] == e.argmax()
    # Pieces that end where passages end change nothing.
    whole = ("abc " * 63 + "abc\n") * 8
    before = quality.score([whole, GOOD], fitted)
    monkeypatch.setattr(quality, "BLOCK", 2 * 256)
    after = quality.score([whole, GOOD], fitted)
    assert np.allclose(before[0], after[0], atol=1e-3) and (before[1] == after[1]).all()


def test_rows(spark):
    rows = [(i, (GOOD if i % 3 else BAD) * (1 + i % 4), 9, "x") for i in range(60)] + [(None, GOOD, 9, "x"), (100, None, 9, "x"), (101, "", 9, "x"), (0, BAD, 9, "x"), (0, BAD, 9, "x"), (102, GOOD * 20_000, 9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, y string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)] + [(None, 1), (7, None), (8, 0), (8, 1), (900, 1)], "doc_id long, quality int")
    fitted = quality.train(df, labels)
    found = quality.predict(df, fitted)
    assert found.columns == ["doc_id", "text", "y", "score", "n_passages", "focus"] and found.count() == len(rows)
    scores = {(r["doc_id"], r["text"]): r["score"] for r in found.collect()}
    assert all((s > 0.5) == (t is not None and t.startswith("The")) for (i, t), s in scores.items() if t)
    again = quality.train(df.repartition(2), labels)
    assert {(r["doc_id"], r["text"]): r["score"] for r in quality.predict(df, again).collect()} == scores
    assert quality.predict(df.limit(0), fitted).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("doc_id > 800")):
        flat = {r["score"] for r in quality.predict(df, quality.train(df, some)).collect()}
        assert len(flat) == 1 and 0 < flat.pop() < 1


def test_held_out(spark):
    from nearfield.llm import queries

    found = queries.op13_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.98 * len(good) * len(bad)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
