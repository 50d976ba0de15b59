from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from jobtrail.llm import rules
from jobtrail.llm.tables import read
from tests.llm.helpers import SF, WORD


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(spark, texts):
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, failed int, n_words int")
    return [tuple(r) for r in rules.ledger(docs).orderBy("doc_id").select(*COLUMNS).collect()]


def test_documents_and_edges(spark):
    texts = [r.text for r in read(spark, SF, "documents").collect()]
    texts += [None, "", "\n \t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 30, ("a b c d e f g h i " * 3 + "x " * 9) * 2, "é\x0bü\x0c#\r\n#\n#", "x y z\nx y z\n x y z\n", "w w   𝒳", "long " * 50_000]
    assert measured(spark, texts) == [plain(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n#é\t", max_size=120), min_size=1, max_size=40))
def test_random_texts(spark, texts):
    assert measured(spark, texts) == [plain(t) for t in texts]


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(1, "only a few words"), (None, None), (2, "# " * 40), (3, " ".join(f"word{i}" for i in range(60))), (3, " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string")
    entries = rules.ledger(docs).cache()
    bits = {r.doc_id: r.failed for r in entries.collect()}
    assert bits == {1: 1, None: 1, 2: rules.BIT["repeated_words"] | rules.BIT["symbols"] | rules.BIT["short_words"], 3: 0}
    assert {r.doc_id: r.kept for r in rules.apply_policy(entries, 1).collect()} == {1: False, None: False, 2: False, 3: True}
    got = {(r.version, r.rule): (r.fails, r.fails_alone, r.kept) for r in rules.ablation(entries).collect()}
    assert got[1, "few_words"] == (2, 2, 2) and got[1, "repeated_words"] == (1, 1, 2)
    assert got[2, "symbols"] == (1, 0, 2) and got[2, "capitals"] == (0, 0, 2)
    assert rules.ledger(docs.limit(0)).collect() == []
