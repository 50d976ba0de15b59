import numpy as np
import pyarrow as pa
import pytest

from jobtrail.llm import queries, toxicity
from jobtrail.llm.tables import read


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    rows = queries.op7_toxicity_score(spark, sf).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = np.mean([p for p, y in held if y == 1])
    false = np.mean([p for p, y in held if y == 0])
    assert len(rows) == read(spark, sf, "documents").count() and caught > 0.8 and false < 0.03


def test_subwords_of_a_text_do_not_depend_on_others():
    texts = ["one two  three. FOUR é", "", None, "x", "no-body " * 40, "tail words here"]
    whole: dict = {}
    for row, passage, bucket in toxicity.subwords(pa.array(texts)):
        for r, p, b in zip(row, passage, bucket):
            whole.setdefault(int(r), {}).setdefault(int(p), []).append(int(b))
    for i, t in enumerate(texts):
        alone: dict = {}
        for _, passage, bucket in toxicity.subwords(pa.array([t], pa.string())):
            for p, b in zip(passage, bucket):
                alone.setdefault(int(p), []).append(int(b))
        assert list(whole.get(i, {}).values()) == list(alone.values())
    # marks bound the words: "one" has " one " and its runs
    assert len(whole[0][0]) == sum(len(w) + 2 - n + 1 for w in ("one", "two", "three") for n in toxicity.LENGTHS if len(w) + 2 >= n)
    assert len(whole[4]) == -(-80 // toxicity.PASSAGE)


def test_misspelled_words_are_caught():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeioklmnrst"), 6))
    bad = ["blorgish", "zuxwaffle", "quizgrump"]
    texts, labels = [], []
    for i in range(300):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            w[int(rng.integers(60))] = bad[i % 9 // 3]
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels), 1 / 3)
    test = [" ".join([word() for _ in range(40)] + [x]) for x in ("blorgishh", "zuxwafle", "quizgrumps", word(), word())]
    score = model.score(pa.array(test))
    assert (score[:3] >= 0.3).all() and (score[3:] < 0.3).all()
    assert model.score(pa.array(["", None, test[0]]))[2] == pytest.approx(score[0])


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you fool", 0.5), (1, "you fool", 0.5), (None, None, 0.1), (2, "", 0.1), (3, "a fine day", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels, "true").collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in toxicity.classify(docs, labels.limit(0), "true").collect()}) == 1
    assert toxicity.classify(docs.limit(0), labels, "true").collect() == []


def test_sample_bounds_each_label(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y, share: seen.update(n=np.bincount(y).tolist(), share=share))
    toxicity.fit(docs, labels, "true", sample=7)
    assert seen == {"n": [7, 7], "share": 0.25}
