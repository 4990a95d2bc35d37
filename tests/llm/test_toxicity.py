import itertools
import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm.toxicity import (
    WINDOW, Restorer, decode, fit, language_model, lattice, op4_toxicity, score_documents)

LABELS = "doc_id bigint, toxic int"


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return Restorer(language_model(docs))


@pytest.mark.parametrize("text,want", [
    ("you 1d10t and tr4sh", "you idiot and trash"), ("s t u p i d person", "stupid person"),
    ("m.o.r.o.n here", "moron here"), ("patheeeetic l0s3r", "pathetic loser"),
    ("i d 1 o t", "idiot"), ("w0rthl3ss $cum", "worthless scum"), ("the!! end.", "the!! end."),
    ("plain words, as they are", "plain words, as they are"), ("", ""),
    ("such hat3", "such hate"), ("idi07", "idiot"), ("i  d  i  o  t", "idiot"),
    ("i/d/i/o/t", "idiot"), ("idiiot", "idiot"), ("i d i o 7", "idiot"), ("1 2 3 4", "1 2 3 4"),
    ("you are i d i o t", "you are idiot"), ("(the end)", "(the end)"), ("白痴白痴", "白痴白痴")])
def test_restores(restorer, text, want):
    assert " ".join(restorer.text(text).split()) == want


def spent(path, model):
    """The cost of one path through a lattice."""
    a = b = 0
    total = 0.0
    for letter, symbol, channel in path:
        total += channel
        if letter and (symbol or b):
            total += model.cost(a, b, symbol)
            a, b = b, symbol
    return total + (model.cost(a, b, 0) if b else 0.0)


@pytest.mark.parametrize("stretch", ["1d10t", "$cum!", "l0ss3r", "i d 1 o t", "éé1a", "(th3", "aaa",
                                     "a.b  c", "4", "дд0м"])
def test_decoding_is_the_cheapest_path(restorer, stretch):
    paths = list(itertools.product(*lattice(stretch)))
    best = min(spent(p, restorer.model) for p in paths)
    got = decode(stretch, restorer.model)
    texts = {"".join(letter for letter, _, _ in p) for p in paths
             if spent(p, restorer.model) < best + 1e-9}
    assert got in texts


def test_long_texts_are_decoded_whole(restorer):
    token = "ab0" * 20_000
    assert len(restorer.text(token)) > 10_000
    assert restorer.text("x " * 5_000 + "end").endswith("end")


def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for k in range(600):
        own = rng.choices(words, k=40)
        bad = k % 5 == 0
        if bad:
            own.insert(rng.randrange(40), "idiot")
            own.insert(rng.randrange(40), "moron")
        docs.append((k, " ".join(own)))
        labels.append((k, int(bad)))
    return docs, labels


def scores(model, df):
    return {r["doc_id"]: r["score"] for r in score_documents(df, model).collect()}


def test_learns_and_sees_through_disguise(spark, texts):
    docs, labels = corpus()
    model = fit(texts(docs), spark.createDataFrame(labels, LABELS))
    got = scores(model, texts(docs))
    assert np.mean([(got[k] >= 0.7) == bool(v) for k, v in labels]) > 0.97
    plain = docs[1][1]
    odd = scores(model, texts([(1, plain), (2, plain + " 1d10t m0r0n"), (3, None), (4, ""),
                               (5, plain + " i d i o t m.o.r.o.n"), (6, (plain + " ") * 3000),
                               (7, "idiooooot mooooron " + plain), (None, "idiot moron")]))
    assert all(odd[k] >= 0.7 for k in (2, 5, 7, None))
    assert all(odd[k] < 0.7 for k in (1, 3, 4, 6)) and odd[3] == odd[4]
    assert all(0 <= x <= 1 for x in odd.values())


def letter(c):
    return unicodedata.category(c)[0] in "LM"


def plain_features(text):
    """Words with their runs of four characters, as strings (scripts with spaces)."""
    out = {}
    for word in ["".join(g) for k, g in itertools.groupby(text, letter) if k]:
        edged = f"<{word}>"
        out[word] = [edged[k:k + 4] for k in range(len(edged) - 3)]
    return out


def plain_evidence(sample, texts):
    """Feature weights from ``sample`` (text, toxic), and the evidence of ``texts``."""
    size = Counter(t for _, t in sample)
    n = {0: Counter(), 1: Counter()}
    for text, toxic in sample:
        own = plain_features(text)
        n[toxic].update({("w", w) for w in own} | {("r", r) for rs in own.values() for r in rs})
    share = size[1] / len(sample)
    tested = len(n[0].keys() | n[1].keys())

    def odds(f):
        return (math.log((n[1][f] + 0.5) / (size[1] + 1))
                - math.log((n[0][f] + 0.5) / (size[0] + 1)))

    def ratio(f):
        both = n[0][f] + n[1][f]
        return 2 * sum(x * math.log(x / e) for x, e in
                       ((n[1][f], both * share), (n[0][f], both * (1 - share))) if x)

    kept = {f: odds(f) for f in n[0].keys() | n[1].keys()
            if odds(f) > 0 and ratio(f) > 2 * math.log(max(tested, 2)) + 4}

    def weight(word, word_runs):
        if ("w", word) in kept:
            return kept["w", word]
        each = [kept.get(("r", r), 0.0) for r in word_runs]
        width = min(WINDOW, len(each))
        best = max((sum(each[k:k + width]) / width for k in range(len(each) - width + 1)),
                   default=0.0) if width else 0.0
        if best and n[0]["w", word] + n[1]["w", word]:
            return max(0.0, odds(("w", word)))
        return best

    return [math.log1p(sum(math.expm1(weight(w, r)) for w, r in plain_features(t).items()))
            for t in texts]


def test_scores_equal_a_plain_recomputation(spark, texts):
    docs, labels = corpus()
    extra = [(9000, "idiots and idiom"), (9001, "moronic moron moron"), (9002, "été idiot été"),
             (9003, ""), (9004, "a b"), (9005, docs[3][1] + " idioten")]
    table = texts(docs + extra)
    model = fit(table, spark.createDataFrame(labels, LABELS))
    restorer = Restorer(model["cost"])
    held = {r["doc_id"] for r in table.where(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    toxic = dict(labels)
    seen = {(restorer.text(t), toxic[k], t) for k, t in docs if k not in held}
    want = plain_evidence([(t, y) for t, y, _ in seen], [restorer.text(t) for _, t in docs + extra])
    got = scores(model, table)
    for (k, _), e in zip(docs + extra, want, strict=True):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-model["slope"] * e - model["base"])))
    assert max(want) > 0 and got[9001] > got[9004]


@pytest.mark.parametrize("bad,clean,rest", [
    ("白痴", "今天天气很好我们去公园散步", 12), ("дурак", "погода сегодня хорошая идём гулять", 12)])
def test_other_scripts(spark, texts, bad, clean, rest):
    """A toxic word is found wherever it stands, and what begins alike isn't marked."""
    rng = random.Random(2)
    spaced = " " in clean
    parts = clean.split() if spaced else list(clean)
    glue = " " if spaced else ""
    docs, labels = [], []
    for k in range(400):
        own = rng.choices(parts, k=rest)
        if k % 4 == 0:
            own.insert(rng.randrange(rest), bad)
        docs.append((k, glue.join(own)))
        labels.append((k, int(k % 4 == 0)))
    model = fit(texts(docs), spark.createDataFrame(labels, LABELS))
    late = glue.join(parts * 4 + [bad])
    got = scores(model, texts([(1, late), (2, glue.join(parts * 4)), (3, bad[0] + glue + clean)]))
    assert got[1] >= 0.7 and got[2] < 0.7 and got[3] < 0.7


def test_a_clean_word_keeps_its_own_weight(spark, texts):
    docs, labels = corpus()
    docs = [(k, t + " idiom") if k % 5 and k % 2 else (k, t) for k, t in docs]
    model = fit(texts(docs), spark.createDataFrame(labels, LABELS))
    got = scores(model, texts([(1, "an idiom here"), (2, "an idiot here")]))
    assert got[1] < 0.7 <= got[2]


def test_training_rows_only(spark, texts):
    """Labels of held-out rows change nothing; nor do lang, source or doc order."""
    docs, labels = corpus()
    table = spark.createDataFrame(labels, LABELS)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = table.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = fit(texts(docs), table)
    b = fit(texts(docs[::-1]), turned)
    assert a["features"].tolist() == b["features"].tolist()
    assert a["slope"] == pytest.approx(b["slope"]) and a["base"] == pytest.approx(b["base"])


def test_without_labels(spark, texts):
    docs, labels = corpus()
    none = fit(texts(docs), spark.createDataFrame([(None, 1), (5, None), (9999, 1)], LABELS))
    assert set(scores(none, texts(docs)).values()) == {scores(none, texts([(1, "x")]))[1]}
    one = fit(texts(docs), spark.createDataFrame([r for r in labels if r[1]], LABELS))
    assert all(x > 0.99 for x in scores(one, texts(docs[:5])).values())
    assert scores(none, texts([])) == {}
    empty = fit(texts([]), spark.createDataFrame([], LABELS))
    assert scores(empty, texts([(1, "x")]))[1] < 0.01


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op4_toxicity(spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(clean) == 0 and np.mean(toxic) > 0.7
